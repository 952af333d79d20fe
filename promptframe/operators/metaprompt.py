"""Meta-prompt text operators and the prompt-optimisation loop (PRM2, STR4,
STR5, LLM4-LLM6).

The loop optimises a whole table of prompts at once: each iteration is two
LLM maps over the rows still active, and the table is checkpointed to the
shared checkpoint folder between iterations so lineage stays short and a
lost executor never re-issues finished LLM calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import render

# The markers the meta prompt asks the model to use.
BEGIN_MARKER = "<!-- BEGIN OF PROMPT -->"
END_MARKER = "<!-- END OF PROMPT -->"
NO_CHANGE_MARKER = "<!-- NO CHANGE TO PROMPT -->"
PROMPT_PATTERN = "(?s)" + BEGIN_MARKER + "(.*?)" + END_MARKER

# Fixed value: the user message sent to the prompt generator.
META_USER_TEMPLATE = (
    "\n* Prompt Template\n```\n{current_system_prompt}\n```\n* User Message\n```\n{testing_user_prompt}\n```\n"
    "{other_header}\n{other_user_prompts}\n* Expected GPT Message\n```\n{expect_output}\n```\n"
    "* GPT Message\n```\n{current_output}\n```\n"
)
OTHER_HEADER = "* Other User Messages"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_updated_prompt(response) -> Column:
    """Text between the first pair of prompt markers (STR4), null without markers.

    The match is stripped of ``\\n`` at both ends; a code fence around it is
    cut off (``s[3:-3]`` when it starts and ends with three backticks).
    """
    r = _c(response)
    inner = F.btrim(F.regexp_extract(r, PROMPT_PATTERN, 1), F.lit("\n"))
    fenced = F.startswith(inner, F.lit("```")) & F.endswith(inner, F.lit("```"))
    cut = F.when(fenced, F.substring(inner, 4, F.greatest(F.length(inner) - 6, F.lit(0)))).otherwise(inner)
    return F.when(r.rlike(PROMPT_PATTERN), cut)


def detect_no_change(response) -> Column:
    """True when the response carries the no-change marker (STR5)."""
    return F.contains(_c(response), F.lit(NO_CHANGE_MARKER))


def meta_user_message(current_system_prompt, testing_user_prompt, other_user_prompts, expect_output,
                      current_output, use_other) -> Column:
    """The generator's user message (PRM2); ``use_other`` is a bool or a boolean column."""
    flag = use_other if isinstance(use_other, Column) else F.lit(bool(use_other))
    return render(META_USER_TEMPLATE, {
        "current_system_prompt": _c(current_system_prompt),
        "testing_user_prompt": _c(testing_user_prompt),
        "other_header": F.when(flag, F.lit(OTHER_HEADER)).otherwise(F.lit("")),
        "other_user_prompts": F.when(flag, _c(other_user_prompts)).otherwise(F.lit("")),
        "expect_output": _c(expect_output),
        "current_output": _c(current_output),
    })


def merge_meta_system_prompt(meta_system_prompt, *args) -> Column:
    """``meta_system_prompt`` followed by the user message (one string)."""
    return F.concat(F.coalesce(_c(meta_system_prompt), F.lit("")), meta_user_message(*args))


def meta_result(df: DataFrame, response: str = "response", new_prompt: str = "new_prompt",
                changed: str = "changed") -> DataFrame:
    """From a generator response: new prompt and changed flag (LLM5 tail).

    ``new_prompt`` is the extracted prompt when non-empty, else the whole
    response; ``changed`` is false when the no-change marker is present.
    """
    ex = extract_updated_prompt(response)
    return df.withColumn(new_prompt, F.when(F.length(ex) > 0, ex).otherwise(F.col(response))) \
             .withColumn(changed, ~detect_no_change(response))


def _messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("human").alias("role"), user.alias("content")))


def test_prompt(df: DataFrame, system_col: str, user_col: str, client: dict, out: str = "output",
                batch_size: int = 10) -> DataFrame:
    """Run system + user prompt per row against the target model (LLM4).

    Errors fail the job (``on_error='fail'``), as the reference raises.
    """
    from .llm import llm_map

    staged = df.withColumn("__msgs", _messages(F.col(system_col), F.col(user_col)))
    res = llm_map(staged, "__msgs", client, batch_size=batch_size, on_error="fail", out=out)
    return res.drop("__msgs", "status", "error", "elapsed_ms")


def meta_step(df: DataFrame, generator: dict, meta_system_prompt: str, use_other: bool = False,
              cols: dict | None = None, batch_size: int = 10) -> DataFrame:
    """One optimisation step per row (LLM5): build the message, call the generator.

    ``cols`` names the row's fields: current_system_prompt, testing_user_prompt,
    other_user_prompts, expect_output, current_output.
    """
    from .llm import llm_map

    c = {"current_system_prompt": "current_system_prompt", "testing_user_prompt": "testing_user_prompt",
         "other_user_prompts": "other_user_prompts", "expect_output": "expect_output",
         "current_output": "current_output"}
    c.update(cols or {})
    other = F.col(c["other_user_prompts"]) if c["other_user_prompts"] in df.columns else F.lit("")
    user = meta_user_message(c["current_system_prompt"], c["testing_user_prompt"], other, c["expect_output"],
                             c["current_output"], use_other)
    staged = df.withColumn("__msgs", _messages(F.lit(meta_system_prompt), user))
    res = llm_map(staged, "__msgs", generator, batch_size=batch_size, on_error="fail", out="response")
    return meta_result(res.drop("__msgs", "status", "error", "elapsed_ms"))


def optimize_prompts(df: DataFrame, key: str, generator: dict, tester: dict, meta_system_prompt: str,
                     iterations: int = 1, use_other: bool = False, cols: dict | None = None,
                     batch_size: int = 10) -> DataFrame:
    """Optimise every row's system prompt for up to ``iterations`` rounds (LLM6).

    Per row and round: run the current prompt only if there is no current
    output; ask the generator; stop the row when it reports no change; adopt
    a new, different prompt and clear the output.  Output adds ``changed``
    (the last round's flag; false with zero rounds) and keeps the row's
    final ``current_system_prompt`` / ``current_output``.

    The driver loops over rounds, not rows: each round is two distributed LLM
    maps over the active rows, and the state is checkpointed (reliably, to
    the shared folder) so that finished calls are never repeated.
    """
    from ..session import checkpoint_dir

    c = {"current_system_prompt": "current_system_prompt", "testing_user_prompt": "testing_user_prompt",
         "other_user_prompts": "other_user_prompts", "expect_output": "expect_output",
         "current_output": "current_output"}
    c.update(cols or {})
    checkpoint_dir(df.sparkSession)
    cur_p, cur_o = c["current_system_prompt"], c["current_output"]
    state = df.withColumn("changed", F.lit(False)).withColumn("__active", F.lit(True))
    cols_out = state.columns
    for _ in range(int(iterations)):
        active = state.where("__active")
        done = state.where(~F.col("__active"))
        need = active.where(F.coalesce(F.col(cur_o), F.lit("")) == "")
        have = active.where(F.coalesce(F.col(cur_o), F.lit("")) != "")
        tested = test_prompt(need.drop(cur_o), cur_p, c["testing_user_prompt"], tester, out=cur_o,
                             batch_size=batch_size).select(*cols_out)
        ready = have.unionByName(tested)
        stepped = meta_step(ready.drop("changed"), generator, meta_system_prompt, use_other, c, batch_size)
        adopt = F.col("changed") & (F.length(F.col("new_prompt")) > 0) & (F.col("new_prompt") != F.col(cur_p))
        nxt = stepped.select(
            *[F.when(adopt, F.col("new_prompt")).otherwise(F.col(cur_p)).alias(x) if x == cur_p else
              F.when(adopt, F.lit(None).cast("string")).otherwise(F.col(cur_o)).alias(x) if x == cur_o else
              F.col("changed").alias(x) if x == "changed" else
              F.col("changed").alias(x) if x == "__active" else F.col(x) for x in cols_out])
        state = done.unionByName(nxt).checkpoint(eager=True)
        if state.where("__active").limit(1).count() == 0:
            break
    return state.drop("__active")

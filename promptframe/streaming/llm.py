"""LLM map over a stream (STM2).

The same ``mapInPandas`` function as the batch map runs per micro-batch
(stateless, append mode).  Output goes to a file sink whose commit log makes
each micro-batch's files visible once, so a restarted query does not expose
duplicate answers (the calls of a retried batch are repeated, as in batch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.chat import chat_prompt
from ..operators.llm import llm_map
from ..operators.positional import skip_filter


def llm_stream(stream: DataFrame, system_template: str, user_template: str, client: dict, out_path: str,
               checkpoint_path: str, keep: list[str] | None = None, batch_size: int = 10,
               on_error: str = "blank", available_now: bool = True):
    """Render, call and append results to parquet at ``out_path``; returns the query."""
    rows = skip_filter(stream)
    if keep is not None:
        from ..functions.template import placeholders

        need = set(placeholders(system_template)) | set(placeholders(user_template))
        rows = rows.select(*dict.fromkeys(list(keep) + sorted(need - set(keep))))
    res = llm_map(chat_prompt(rows, system_template, user_template), "messages", client, batch_size, on_error)
    w = (res.drop("messages").writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

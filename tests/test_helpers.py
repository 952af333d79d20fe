"""Smaller public helpers: listing files, embedded CSV, single-text embedding, meta prompt, hits JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from promptframe.operators import catalog as C
from promptframe.operators import vectors as V
from promptframe.operators.embed import embed_text
from promptframe.operators.metaprompt import merge_meta_system_prompt, meta_user_message
from promptframe.session import fs_path, scratch_path
from promptframe.sources.csv import read_embedded_csv


def test_read_listing_files(spark):
    root = fs_path(scratch_path(spark, "t-listing"))
    os.makedirs(root)
    with open(f"{root}/models.json", "w") as f:
        json.dump({"data": [{"id": "openrouter/auto", "name": "Auto"}, {"id": "gpt-4"}, {"id": "x/y"},
                            {"id": "gpt-4o"}]}, f, indent=2)
    ids = C.read_listing(spark, root)
    assert [r["id"] for r in ids.orderBy("idx").collect()] == ["openrouter/auto", "gpt-4", "x/y", "gpt-4o"]
    assert sorted(r["id"] for r in C.with_prefix(ids).collect()) == ["gpt-4", "gpt-4o"]


def test_embedded_csv(spark):
    root = fs_path(scratch_path(spark, "t-emb-csv"))
    os.makedirs(root)
    with open(f"{root}/e.csv", "w") as f:
        f.write('embedding,text\n"[0.1, 0.2, 0.3]",a\n"[1, 2]",b\nbad,c\n')
    got = {r["text"]: r["embedding"] for r in read_embedded_csv(spark, root).collect()}
    assert got == {"a": [0.1, 0.2, 0.3], "b": [1.0, 2.0], "c": None}


def test_embed_text_one_row(spark):
    v = embed_text(spark, "hello hello world", {"type": "hashing", "dim": 8})
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1.0) < 1e-6


def test_meta_prompt_block(spark):
    df = spark.createDataFrame([("SYS", "P", "U", "```\nO\n```", "E", "C")], "m string, p string, u string, o string, "
                               "e string, c string")
    with_other = df.select(meta_user_message("p", "u", "o", "e", "c", True)).first()[0]
    without = df.select(meta_user_message("p", "u", "o", "e", "c", False)).first()[0]
    assert "* Other User Messages\n```\nO\n```\n* Expected GPT Message" in with_other
    assert "```\n\n\n* Expected GPT Message" in without          # blank lines stay
    merged = df.select(merge_meta_system_prompt("m", "p", "u", "o", "e", "c", False)).first()[0]
    assert merged == "SYS" + without and without.startswith("\n* Prompt Template\n```\nP\n```")


def test_hits_json_pretty(spark):
    hits = spark.createDataFrame([(1, 2, 10, 0.5), (1, 1, 11, 0.9)], "q_id long, rank int, s_id long, score double")
    compact = V.hits_json(hits).first()["hits"]
    assert json.loads(compact) == [{"rank": 1, "id": 11, "score": 0.9}, {"rank": 2, "id": 10, "score": 0.5}]
    pretty = V.hits_json(hits, pretty=True).first()["hits"]
    assert "\n" in pretty and json.loads(pretty) == json.loads(compact)
    _ = F


def test_spread_runs_no_job_on_many_file_input(spark):
    from promptframe.session import scratch_path, spread

    path = scratch_path(spark, "t-spread")
    spark.range(0, 1000, numPartitions=16).write.parquet(path)
    agg = spark.read.parquet(path).groupBy((F.col("id") % 7).alias("g")).count()
    sc = spark.sparkContext
    sc.setJobGroup("t-spread", "t-spread")
    try:
        out = spread(agg, min_partitions=8)
        assert out is agg and sc.statusTracker().getJobIdsForGroup("t-spread") == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)

"""The pipeline's stages on a small table: columns, order and decisions."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination",
                                                      "packing"]
    texts = {r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names and docs.count() <= rows
            rows = docs.count()
        if name == "exact_dedup":
            kept = [r["text"] for r in docs.collect()]
            assert len(kept) == len(set(kept)) and set(kept) == {t for t in texts if t and any(c.isalpha() for c in t)}
    assert {"sequence_id", "offset", "ids_crc32"} <= set(docs.columns)
    assert corpus_pipeline.ORACLE_SQL is None

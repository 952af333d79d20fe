"""Co-training against labels that training did not see."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptframe.llm import quality

DATA = "/root/testdata/sf0.1"


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    _, inverse, count = np.unique(score[order], return_inverse=True, return_counts=True)
    mean = np.cumsum(count) - (count - 1) / 2
    rank[order] = mean[inverse]
    ones = y > 0.5
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    got = quality.classify(docs, labels.where(half == 0))
    rows = (got.join(labels.where(half == 1).distinct(), "doc_id")
            .select("score", "content_score", "metadata_score", "toxic_score", "quality", "toxic").toPandas())
    auc = {c: round(float(_auc(rows[c].to_numpy(), rows[t].to_numpy())), 3)
           for c, t in (("score", "quality"), ("content_score", "quality"), ("metadata_score", "quality"), ("toxic_score", "toxic"))}
    print(len(rows), int(rows["toxic"].sum()), auc)
    assert auc["score"] >= 0.8 and auc["toxic_score"] >= 0.8, auc


def test_an_id_of_many_rows_counts_once(spark, tmp_path):
    rows = [(i, f"{'good words' if i % 2 else 'bad junk'} page {i} and more", "web", "en") for i in range(200)]
    rows += [(1, "bad junk page again", "web", "en")] * 300 + [(None, "bad junk", None, None)] * 50
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(path)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(3, 1, 0)] * 20, "doc_id long, quality int, toxic int")
    got = quality.classify(spark.read.parquet(path), labels).collect()
    assert len(got) == len(rows)
    right = [(r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] >= 120]
    assert sum(right) >= 0.95 * len(right)
    assert all(r["toxic_score"] == 0 for r in got)  # one label only: its share

"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line:

  {"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is evaluated in full (``write.format("noop")``), once to warm up
and then ``$BENCH_REPEAT`` times (default 3); the median is reported.  The
same SQL run by DuckDB on the same files is timed alongside
(``duckdb_queries``) as a single-node reference; set ``BENCH_DUCKDB=0`` to skip.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["faq_fix", "md_parse", "bow_counts", "delta_similarity", "vdb_search", "llm_batch",
            "history_retained", "cluster_rows", "embed_table", "md_history"]


def _sf(path: str):
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from promptframe.plans import ORACLES, QUERIES
    from promptframe.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "12g"),
                               "spark.sql.files.maxPartitionBytes": "64m"})
    times, rows = {}, {}
    for name in names:
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    duck = {}
    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        import duckdb

        con = duckdb.connect()
        con.execute(f"SET threads = {cpus}")
        for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
                  "benchmark labels conversations").split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        for name in names:
            if name not in ORACLES:
                continue
            runs = []
            for i in range(repeat + 1):
                t0 = time.perf_counter()
                rows[name] = len(con.execute(ORACLES[name]).fetchall())
                if i > 0:
                    runs.append(time.perf_counter() - t0)
            duck[name] = round(statistics.median(runs), 3)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": _sf(sf_dir), "cpus": cpus, "duckdb_queries": duck}
    print(json.dumps(out))


if __name__ == "__main__":
    main()

"""The corpus operators against brute force on small fixtures, with the edge rows of every docstring."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from promptframe.llm import (chaining, decontaminate, langid, minhash, packing, pii, quality, sharding, stream_dedup,
                             suffix)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept string"


def _texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    passage, base = prose(70), prose(200)
    texts = [base, base, base.replace(base.split()[50], "zzz", 1), passage + " " + prose(60), prose(90) + " " + passage,
             prose(5), "x", "", None, None, "   \n", prose(4000), "mail me: a.b@c.org or +1 (234) 567-8901 now",
             "4111 1111 1111 1111 and 10.0.0.1 and 999.1.1.1", "a" * 450, "É " * 150, base]
    return texts, passage


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    texts, _ = _texts()
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", None, "own", "own") for i, t in enumerate(texts)]
    rows += [(None, "null id text here", None, None, None, None, None), rows[3]]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def _rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_packing_round_trip(docs, empty):
    cap = 64
    got = packing.pack_documents(docs, cap=cap, with_ids=True).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = collections.Counter()
    for i, t in _rows(docs):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), cap):
            want[(i, k // cap, k, tuple(ids[k:k + cap]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    for r in got:
        raw = b"".join(x.to_bytes(4, "little") for x in r["ids"])
        assert r["ids_crc32"] == zlib.crc32(raw) and r["length"] == len(r["ids"])
    for rows in _by(got, "sequence_id").values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap
    tokens = sum(r["length"] for r in got)
    assert len(_by(got, "sequence_id")) <= 1.05 * tokens / cap + 2
    assert packing.pack_documents(empty, cap=cap).count() == 0


def _by(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_token_bytes_match_the_tokenizer():
    import pyarrow as pa

    tokens, rnd = packing.TokenBytes(), random.Random(1)
    alphabet = ["a", "É", "s", "'", "'s", "re", "×", "ß", "9", "İ", "Σ", "\x1d", " ", "\xa0", "!!", "<|endoftext|>", "中"]
    texts = ["".join(rnd.choice(alphabet[:k]) for _ in range(rnd.randint(0, 20))) for k in (9, 17) for _ in range(400)]
    got = dict(tokens.column(pa.array(texts)))
    assert [got[i] for i in range(len(texts))] == tokens._encode(texts)


def _sets(rows, size):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    return out


def test_near_duplicates_match_all_pairs(docs, empty):
    rows, got = _rows(docs), minhash.near_duplicates(docs).collect()
    sets = _sets(rows, 4)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = _by([{"g": root(i), "id": rows[i][0]} for i in range(len(rows))], "g")
    low = {g: min((m["id"] for m in ms if m["id"] is not None), default=None) for g, ms in groups.items()}
    want = collections.Counter((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows)))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    linked = {i for i in range(len(rows)) if sets[i]}
    assert sum(r["first"] for r in got) == len({root(i) for i in linked}) + len(rows) - len(linked)
    assert minhash.near_duplicates(empty).count() == 0


def test_leaks(spark, docs, empty):
    passage = _texts()[1]
    bench = spark.createDataFrame([(1, passage + ". the end of it"), (2, None), (3, ""), (4, "nothing like this here")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaked_documents(docs, bench).collect()}
    assert got == {(3, 1), (4, 1)}
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3  # document 3 is there twice
    assert decontaminate.leaked_documents(empty, bench).count() == 0
    assert decontaminate.leaked_documents(docs, bench.limit(0)).count() == 0


def test_language_profiles(docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {7, 8, 9, 10}
    assert langid.identify(empty).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    joined = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in joined) >= 0.95 * len(joined)


def test_personal_data_base_spans(docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(2)
    parts = ["a@b.c", "@", "1.2.3.4", ".", "5", "4111111111111111", " ", "-", "+1 234 567 8901", "x", "+", "999.1.1.1", "a.b"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8)))
        want = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                        or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                    want.append((kind, m.start(), m.end()))
        assert pii.base_spans(text) == want, text
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert (got[12]["n_email"], got[12]["n_phone"], got[13]["n_card"], got[13]["n_ip"]) == (1, 1, 1, 1)
    assert got[8]["spans"] == "" and pii.find_personal_data(empty).count() == 0


def test_fuzzy_passages(docs, empty):
    got = chaining.fuzzy_passages(docs).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert {3, 4} <= {r["doc_id"] for r in got} and (2, 0) in pairs | {(b, a) for a, b in pairs}
    assert {r["doc_id"] for r in got} <= {0, 1, 2, 3, 4, 16}
    assert all(r["end"] - r["start"] >= 50 for r in got)
    assert chaining.fuzzy_passages(empty).count() == 0


def test_quality_runs_on_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_stream_dedup(docs, empty):
    rows, got = _rows(docs), stream_dedup.dedup_decisions(docs).collect()
    size = collections.Counter(t or "" for _, t in rows)
    keep = {}
    for i, t in rows:
        if i is not None:
            keep[t or ""] = max(keep.get(t or "", i), i)
    text = dict(rows)
    for r in got:
        t = text[r["id"]] or ""
        assert (r["keep_id"], r["group_size"]) == (keep.get(t), size[t])
        assert r["digest"] == hashlib.sha256(t.encode()).hexdigest()
    assert sum(r["kept"] for r in got) == len(size) == stream_dedup.deduplicate(docs).count()
    assert stream_dedup.deduplicate(docs).columns == docs.columns
    assert stream_dedup.dedup_decisions(empty).count() == 0


def test_substrings_match_brute_force(docs, empty):
    rows = [(i, (t or "").encode()) for i, t in _rows(docs)]
    count = collections.Counter(b[s:s + 200] for _, b in rows for s in range(len(b) - 199))
    want = collections.Counter()
    for i, b in rows:
        gone = set()
        for s in range(len(b) - 199):
            if count[b[s:s + 200]] > 1:
                gone.update(range(s, s + 200))
        spans = sum(1 for x in gone if x - 1 not in gone)
        want[(i, len(b), len(gone), spans, hashlib.sha256(bytes(c for x, c in enumerate(b) if x not in gone)).hexdigest())] += 1
    got = suffix.remove_repeats(docs).drop("rid").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert suffix.remove_repeats(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    for rows in _by(got, "shard").values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_balance_and_movement(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40_000).select(F.xxhash64("id").alias("k"))
    tree = sharding.layout(40)
    placed = sharding.place(sharding.place(ids, "k", tree, "a"), "k", sharding.grow(tree), "b")
    counts = [r["count"] for r in placed.groupBy("a").count().collect()]
    assert len(counts) == 40 and min(counts) > 800 and max(counts) < 1200
    moved = [r["b"] for r in placed.where("a != b").collect()]
    assert set(moved) == {40} and 700 < len(moved) < 1250

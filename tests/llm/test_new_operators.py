"""Importance resampling, weak quality rules and periodic runs against brute force, with their edge rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

from promptframe.llm import resampling, runs, weakrules
from promptframe.llm.wordblocks import joined, split_words, text_slices

SCHEMA = "doc_id long, text string, `a.b` string, rank string, __n string, __start string, _metadata string, __rid string"


def _texts(rnd):
    words = ["".join(rnd.choice("aeiLNéß9-") for _ in range(rnd.randint(1, 5))) for _ in range(60)]

    def prose(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    out = [prose(rnd.randint(0, 90)) for _ in range(60)]
    out += ["", None, None, " \n\t", "x", ". ! ?", "\x00a\x00b \x7f", prose(30) + "\n" + prose(5), "a b c a b c a b c " * 9,
            "one line\n\none line\n \none line\r\n", prose(25_000), "w " * 300, "# | # " * 40, "中文 字 " * 20]
    return out + out[:5] + [out[3]] * 30


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [(i, t) for i, t in enumerate(_texts(rnd))]
    out += [(None, out[0][1]), (None, None), (None, out[1][1])] + [out[2]] * 3 + [(500, out[4][1])] * 40
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("new") / "documents.parquet")
    spark.createDataFrame([(*r, *"uvwxyz") for r in rows], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_word_blocks_match_the_pattern(rows):
    texts = pa.array([t for _, t in rows])
    found = []
    for first, some in text_slices(texts, 1000):
        assert first == len(found)
        words = split_words(some)
        for r in range(len(some)):
            found.append(words.dictionary.take(pa.array(words.ids[words.starts[r]:words.starts[r + 1]])).to_pylist())
        assert joined(words, words.ids >= 0).to_pylist() == [" ".join(f) for f in found[first:]]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]


def _grams(text, grams):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [" ".join(w[i:i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("grams", [1, 3])
def test_resampling_matches_brute_force(spark, docs, rows, grams):
    target = [rows[3][1], rows[9][1], None, "", "target words that no one else has"]
    buckets, percent = 97, 30

    def crc(feature):
        return zlib.crc32(feature.encode()) % buckets

    s = collections.Counter(crc(f) for _, t in rows for f in _grams(t, grams)[1])
    t = collections.Counter(crc(f) for x in target for f in _grams(x, grams)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    want = []
    for key, text in rows:
        n_words, found = _grams(text, grams)
        weight = sum(gain[crc(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        want.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), grams=grams,
                              buckets=buckets, percent=percent).collect()
    assert collections.Counter((r[0], r[1], r[2], r[3], r[5]) for r in got) == collections.Counter(want)
    able = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[:percent * len(able) // 100]
    assert len(drawn) > 20
    by_rank = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, len(drawn) + 1))
    assert [(r["score"], r["doc_id"]) for r in by_rank] == [(x[3], x[0]) for x in drawn]


def test_resampling_numbers_large_groups_in_parts(spark, tmp_path, monkeypatch):
    """One key with most rows: each row gets a rank of its own although no task numbers them all."""
    from promptframe.llm import common

    split = common.number
    monkeypatch.setattr(resampling, "number", lambda *a: split(*a, rows_per_task=50))
    text = " ".join(f"w{i}" for i in range(25))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(7, text)] * 700 + [(i, text) for i in range(300)], "doc_id long, text string").write.parquet(path)
    got = resampling.resample(spark.read.parquet(path), spark.createDataFrame([(text,)], "text string"), percent=90)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert ranks == list(range(1, 901))


def test_resampling_edges(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, none).count() == 0
    got = resampling.resample(docs, none).collect()
    assert len(got) == docs.count() and {r["rank"] for r in got if r["n_words"] < 20} == {None}


def _brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_weak_rules_match_brute_force(docs, rows, empty):
    got = weakrules.judge(docs).collect()
    want = collections.Counter((k, *_brute_counts(t)) for k, t in rows)
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert weakrules.judge(empty).count() == 0


def test_estimate_matches_document_by_document_em():
    """EM over patterns equals EM that visits every document, and recovers the accuracies votes were drawn with."""
    rnd = random.Random(5)
    right = [(0.95, 0.9), (0.85, 0.7), (0.9, 0.95), (0.8, 0.8)]
    votes, truth = [], []
    for _ in range(6000):
        good = rnd.random() < 0.8
        truth.append(good)
        votes.append(tuple(0 if rnd.random() < 0.3 else (1 if (rnd.random() < a) == good else -1) if good else
                           (-1 if rnd.random() < b else 1) for a, b in right))
    model = weakrules.estimate(sorted(collections.Counter(votes).items()), 4)
    for (a, b), (x, y) in zip(right, model.accuracy):
        assert abs(a - x) < 0.05 and abs(b - y) < 0.1
    prior, acc = weakrules.PRIOR, [[weakrules.START] * 4, [weakrules.START] * 4]
    before = [0.0] * len(votes)
    for _ in range(weakrules.ROUNDS):
        post = []
        for v in votes:
            g, b = prior, 1 - prior
            for k, x in enumerate(v):
                if x:
                    g *= acc[0][k] if x == 1 else 1 - acc[0][k]
                    b *= acc[1][k] if x == -1 else 1 - acc[1][k]
            post.append(g / (g + b))
        if max(abs(p - q) for p, q in zip(post, before)) < weakrules.SETTLED:
            break
        before = post
        w, s = weakrules.WEIGHT, weakrules.START
        prior = (sum(post) + w * weakrules.PRIOR) / (len(votes) + w)
        acc = [[min(0.999, max(0.5, (sum(p for p, v in zip(side, votes) if v[k] == sign) + w * s)
                               / (sum(p for p, v in zip(side, votes) if v[k]) + w))) for k in range(4)]
               for side, sign in ((post, 1), ([1 - p for p in post], -1))]
    for k in range(4):
        assert abs(acc[0][k] - model.accuracy[k][0]) < 1e-6 and abs(acc[1][k] - model.accuracy[k][1]) < 1e-6
    agree = sum((p >= 0.5) == t for p, t in zip(post, truth)) / len(truth)
    assert agree > 0.93


def test_weak_rules_on_labels(spark):
    """Labelled documents of the test table: clean ones stay, most of what the base rules miss and labels call bad goes."""
    sf = "/root/testdata/sf0.1"
    got = weakrules.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    got = got.join(spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality as label"), "doc_id").collect()
    clean, bad = [r for r in got if r["label"] == 1], [r for r in got if r["label"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(not r["kept"] for r in bad) >= 0.4 * len(bad)


def _smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def _brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and _smallest_period(w[i:j + q]) == q:
                out.add((i, j + q - i, q))
            i = j
    return sorted(out)


def _periodic_text(rnd, vocabulary, n):
    w = [rnd.choice(vocabulary) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        a, q = rnd.randrange(n), rnd.choice([1, 2, 3, 5, 15, 16, 17, 18, 31, 32, 33, 34, 48, 63, 64, 65, 66, 100, 128, 129])
        unit = [rnd.choice(vocabulary) for _ in range(q)]
        k = rnd.choice([3 * q + q // 2, 4 * q - 1, 4 * q, 4 * q + 1, 9 * q + 3])
        w[a:a + k] = [unit[i % q] for i in range(len(w[a:a + k]))]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(11)
    fib = ["a", "b"]
    while len(fib) < 700:
        fib = fib + fib[:len(fib) - (0 if len(fib) == 2 else len(fib) * 382 // 1000)]
    texts = [fib, ["a"] * 400, ["a", "b"] * 200, (["a"] * 40 + ["b"]) * 9, (["a", "b"] * 20 + ["c"]) * 8, [], ["x"], ["x"] * 6,
             ["x"] * 5, list("aabaab" * 60)]
    texts += [_periodic_text(rnd, "ab", rnd.randint(1, 60)) for _ in range(300)]
    texts += [_periodic_text(rnd, "abcdefgh", rnd.randint(100, 900)) for _ in range(60)]
    for k in range(0, len(texts), 40):  # several texts in one block
        some = texts[k:k + 40]
        words = split_words(pa.array([" ".join(w) for w in some], pa.large_string()))
        start, length, period = runs.find_runs(words)
        got = collections.defaultdict(list)
        for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
            r = int(words.starts.searchsorted(s, "right")) - 1
            got[r].append((s - int(words.starts[r]), n, q))
        for r, w in enumerate(some):
            assert got[r] == _brute_runs(w), (k, r)
    assert sum(len(_brute_runs(w)) for w in texts) > 150


def test_runs_query_matches_brute_force(docs, rows, empty):
    want = collections.Counter()
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 20_000:
            continue  # brute force is quadratic; its row is looked at below
        found = _brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        want[(key, len(found), *best, 1000 * best[1] // best[2] if found else None,
              hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
              hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in runs.periodic_runs(docs, planted=True).collect())
    long = {key for key, text in rows if text and len(text.split()) > 20_000}
    assert {k: n for k, n in got.items() if k[0] not in long} == dict(want)
    assert sum(got.values()) == len(rows) and any(k[1] for k in got)
    assert runs.periodic_runs(empty).count() == 0


def test_runs_of_a_very_long_text():
    """Periods of thousands of words in one text larger than a block."""
    rnd = random.Random(2)
    w = [str(rnd.randrange(10 ** 6)) for _ in range(300_000)]
    unit = [str(rnd.randrange(10 ** 6)) for _ in range(5_000)]
    w[1_000:1_000 + 22_345] = [unit[i % 5_000] for i in range(22_345)]
    w[100_000:100_000 + 199_000] = (w[100_000:100_000 + 49_000] * 5)[:199_000]
    words = split_words(pa.array([" ".join(w)], pa.large_string()))
    found = list(zip(*(x.tolist() for x in runs.find_runs(words))))
    assert [(n >= 22_345, q) for s, n, q in found if s <= 1_000 < s + n] == [(True, 5_000)]
    assert [(s, n, q) for s, n, q in found if q == 49_000] == [(100_000, 199_000, 49_000)]


def test_folded_windows_are_the_sums_of_their_words():
    """Half windows of 0 to 16 known words, in more chunks than one, bit for bit as numpy sums them."""
    import numpy as np

    from promptframe.llm import decontaminate

    rng = np.random.default_rng(2)
    half, n = decontaminate.WINDOW // 2, 3 * decontaminate.SUMMED
    at = np.where(rng.random(500) < 0.8, rng.integers(0, 90, 500), -1)
    slot = np.concatenate([rng.integers(0, 500, n * half // 2), rng.choice(np.flatnonzero(at < 0), half),
                           rng.choice(np.flatnonzero(at >= 0), n * half // 2)])
    folded = rng.normal(size=(90, 40)).astype(np.float32)
    begin = np.arange(0, len(slot), half)
    joined = rng.random(len(begin)) < 0.9
    joined[-1] = False
    sums = np.zeros((len(begin), 40), np.float32)
    for i, b in enumerate(begin):
        known = at[slot[b:b + half]]
        if (known >= 0).any():
            sums[i] = np.add.reduceat(folded[known[known >= 0]], [0])[0]
    sums[:-1] += np.where(joined[:-1, None], sums[1:], 0)
    got = decontaminate._folded_windows(slot, at, folded, begin, joined)
    norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    assert np.array_equal(got, sums / np.maximum(norm, 1e-9)[:, None])

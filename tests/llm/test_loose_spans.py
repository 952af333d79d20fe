"""Loose personal data of every kind: planted spans come out, dates and versions do not."""

from __future__ import annotations

import random

from promptframe.llm import pii


def _card(rnd):
    d = "4" + "".join(str(rnd.randint(0, 9)) for _ in range(14))
    return next(d + str(x) for x in range(10) if pii.luhn(d + str(x)))


def test_short_ip_is_a_candidate():
    for text, want in (("8[.]8[.]8[.]8", (0, 13)), ("at 10[.]0[.]0[.]1:8080", (3, 17)), ("1 . 1 . 1 . 1", (0, 13))):
        assert ("ip", *want) in pii.candidates(text), text


def test_long_candidates_are_whole():
    secret, name = "a1" * 150, "q" * 80
    assert ("secret", 6, 306) in pii.candidates("token=" + secret)
    text = f"write {name}[at]one[dot]two[dot]three[dot]four[dot]five now"
    assert ("email", 6, len(text) - 4) in pii.candidates(text)
    row = "4000 1234 5678 9017 " * 4  # a long row of numbers still holds cards
    assert {("card", i, i + 19) for i in (0, 20, 40, 60)} <= set(pii.candidates(row))
    assert len(pii.candidates("z" * 300_000 + " dot com " + "7" * 300_000)) < 10


def test_sample_is_the_smallest_hashes(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(i, f"text {i}") for i in range(2000)] + [(7, "text 7")] * 900 + [(i, None) for i in range(20)] + [(5000, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    every = sorted(r[0] for r in docs.where("text rlike '[0-9@]'").selectExpr("xxhash64(doc_id, text)").distinct().collect())
    for limit in (100, 5000):
        assert sorted(r["h"] for r in pii._sample(docs, "doc_id", "text", limit).collect()) == every[:limit]
    assert pii._sample(docs.limit(0), "doc_id", "text", 10).count() == 0


def test_planted_loose_spans(spark, tmp_path):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows, planted, dated = [], {}, {}
    for i in range(1500):
        phone = [str(rnd.randint(1, 99)), str(rnd.randint(100, 999)), str(rnd.randint(100, 999)), str(rnd.randint(1000, 9999))]
        ip = [str(rnd.randint(1, 255)) if i % 2 else str(rnd.randint(1, 9)) for _ in range(4)]
        name, host, card = prose(1), prose(1), _card(rnd)
        secret = "".join(rnd.choice("abcdefghij0123456789") for _ in range(30)) + "a1"
        loose = i % 5 == 0
        spans = {"phone": ("phone ", ".".join(phone) if loose else "+" + " ".join(phone)),
                 "ip": ("server ", ("[.]" if loose else ".").join(ip)),
                 "card": ("card ", "_".join(card[k:k + 4] for k in range(0, 16, 4)) if loose else card),
                 "email": ("mail ", f"{name}[at]{host}[dot]org" if loose else f"{name}@{host}.org"),
                 "secret": ("token=", secret)}
        text = prose(12)
        for kind, (cue, span) in spans.items():
            text += f" {cue}"
            planted[i, kind] = (len(text), len(text) + len(span), loose)
            text += f"{span} {prose(12)}"
        dated[i] = (len(text) + 1, len(text) + 17)
        rows.append((i, text + f" {rnd.randint(1990, 2029)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)} 10:{rnd.randint(10, 59)} x"))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(","))}
           for r in pii.find_personal_data(spark.read.parquet(path)).collect()}
    for kind in pii.ADDED:
        own = [(i, s, e) for (i, k), (s, e, loose) in planted.items() if k == kind and (loose or k == "secret")]
        found = sum((kind, s, e) in got[i] for i, s, e in own)
        assert found >= 0.9 * len(own), (kind, found, len(own))
    wrong = sum(any(s < b and a < e for k, s, e in got[i] if k == "phone") for i, (a, b) in dated.items())
    assert wrong <= 0.02 * len(dated), wrong

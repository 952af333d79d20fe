"""CSV in ranges against the sequential parse, and the character set of planted files."""

from __future__ import annotations

import collections
import csv
import io
import os
import random

import pytest

from promptframe.session import scratch_path
from promptframe.sources.charset import charsets
from promptframe.sources.csv import read_csv_detected
from promptframe.sources.csv_ranges import ends_inside, read_csv_ranges


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few dozen bytes."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                                                   "spark.sql.files.minPartitionNum")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield cut
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(spark, name, files):
    root = scratch_path(spark, name)
    local = root.replace("file:", "")
    os.makedirs(local)
    for k, raw in files.items():
        with open(f"{local}/{k}", "wb") as f:
            f.write(raw)
    return root


def _cell(rnd):
    plain = rnd.choice(["", "x", "a b", "7", 'in"ner', "é", " ", "中文"])
    quoted = rnd.choice(['"a,b"', '"line\nbreak"', '"say ""hi"""', '"\n\n"', '""', '"tail"more', '"\r\n"', '""""', '"a\nb\nc, ""d\n"'])
    return quoted if rnd.random() < 0.4 else plain


def _file(rnd, names, rows):
    lines = [",".join(names)] + [",".join(_cell(rnd) for _ in range(rnd.choice([len(names)] * 4 + [len(names) - 1, len(names) + 2])))
                                 for _ in range(rows)]
    return rnd.choice(["\n", "\r\n"]).join(lines) + rnd.choice(["", "\n"])


def _sequential(text, names):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    out = []
    for r in rows[1:]:
        cells = dict(zip(rows[0], r))
        out.append(tuple(cells.get(n) or None for n in names))
    return out


def test_the_automaton_matches_the_parser():
    rnd = random.Random(2)
    for _ in range(4000):
        line = "".join(rnd.choice(['"', '""', ",", "a", " ", "\r"]) for _ in range(rnd.randint(0, 9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line
            # A record left open takes the next line in; a closed one does not.
            rows = list(csv.reader(io.StringIO(text + "\nEND", newline="")))
            assert ends_inside(line.encode(), inside) == (rows[-1] != ["END"]), (line, inside)


@pytest.mark.parametrize("size", [64, 333])
def test_ranges_equal_the_sequential_parse(spark, small_ranges, size):
    rnd = random.Random(size)
    names = ["id", "text", "note"]
    other = ["note", "id", "extra"]
    texts = {f"f{i}.csv": _file(rnd, other if i == 2 else names, 20) for i in range(4)}
    texts["empty.csv"], texts["head.csv"] = "", "id,text,note\n"
    root = _folder(spark, "ranges", {k: t.encode() for k, t in texts.items()})
    small_ranges(size)
    got = read_csv_ranges(spark, root)
    every = ["id", "text", "note", "extra"]
    assert got.columns == every
    want = collections.Counter(r for t in texts.values() if t for r in _sequential(t, every))
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_one_file_is_many_tasks(spark, small_ranges):
    body = "".join(f'{i},"first\nsecond ""{i}"" line",end\n' for i in range(30_000))
    root = _folder(spark, "one", {"big.csv": ("k,t,e\n" + body).encode()})
    small_ranges(100_000)
    got = read_csv_ranges(spark, root)
    ids = [int(r["k"]) for r in got.where("t = concat('first\\nsecond \"', k, '\" line') and e = 'end'").collect()]
    assert sorted(ids) == list(range(30_000))


CHINESE = "我们在这里讨论如何处理客户的问题，并且给出详细的说明。"
TAIWAN = "我們在這裡討論如何處理客戶的問題，並且給出詳細的說明。"
JAPANESE = "お客様からのご質問にお答えするために、この説明を書いています。"


def test_character_sets_of_planted_files(spark, small_ranges):
    files = {"utf8.csv": ("utf-8", CHINESE + "é"), "plain.csv": ("ascii", "only ascii"), "mark.csv": ("utf-8-sig", CHINESE),
             "gbk.csv": ("gbk", CHINESE), "gb18030.csv": ("gb18030", CHINESE + "𠀀"), "big5.csv": ("big5", TAIWAN),
             "sjis.csv": ("shift_jis", JAPANESE), "latin.csv": ("iso-8859-1", "Où est le café près de la forêt à Liège ?"),
             "le.csv": ("utf-16-le", "plain " + CHINESE), "be.csv": ("utf-16-be", "plain words"), "u16.csv": ("utf-16", CHINESE)}
    raw = {k: ("id,text\n" + "".join(f"{i},{'x' * 50 if i < 30 else t}\n" for i in range(40))).encode(codec)
           for k, (codec, t) in files.items()}
    root = _folder(spark, "sets", raw)
    small_ranges(2000)
    got = {os.path.basename(r["path"]): r["encoding"] for r in charsets(spark, root).collect()}
    want = {k: {"ascii": "utf-8", "utf-8-sig": "utf-8"}.get(codec, codec) for k, (codec, _) in files.items()}
    assert got == want


def test_detected_files_are_read_by_their_headers(spark, small_ranges):
    root = _folder(spark, "mixed", {"a.csv": f'id,text\n1,"{CHINESE}\nzwei"\n'.encode("gbk"),
                                    "b.csv": f"text,id\n{TAIWAN},2\n".encode("big5"),
                                    "c.csv": "\ufeffid,text\n3,é\n".encode(), "d.csv": "id,text\n4,wide\n".encode("utf-16")})
    small_ranges(20)
    got = read_csv_detected(spark, root, schema="id int, text string, none double").collect()
    assert {(r["id"], r["text"], r["encoding"], r["none"]) for r in got} == {
        (1, CHINESE + "\nzwei", "gbk", None), (2, TAIWAN, "big5", None), (3, "é", "utf-8", None), (4, "wide", "utf-16", None)}
    with pytest.raises(FileNotFoundError):
        read_csv_detected(spark, _folder(spark, "nothing", {}))

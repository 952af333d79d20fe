"""Operator 5: personal data by candidate generation and gradient-boosted trees.

The base patterns (e-mail, IP, card, phone) give spans that always stay.
High-recall generators propose further, overlapping spans: addresses with the
signs spelled out, numbers with other separators, keys and tokens.  Boosted
trees (Spark ML) score each from its format and its context; thresholds are
set per kind on held-out candidates, after calibration, for a stated precision,
and the spans above them are added.

Training needs no labels: the base matches of a bounded sample of documents
(``TRAIN_DOCS``, by hash) are rewritten into the looser forms in their own
context (positives).  Negatives are wrong for certain: cards without their check digit, and in
the place of the others dates, versions, order numbers, lists of numbers and plain words.  Loose
candidates of the documents themselves may be right, so they are in neither class; the stated
precision is against the negatives.

Defined results: a null text is empty and has no span; repeated rows are
treated alike; with too few base matches to learn from, no span is added;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .common import drop_table, materialise

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")
#: Documents that the trees are trained on, at most.
TRAIN_DOCS = 3000
#: Share of right ones among the held-out candidates above a kind's threshold, at least.
PRECISION = 0.98
TREES, DEPTH = 20, 4
#: Candidates that are scored at once.
BLOCK = 4096

Span = tuple[str, int, int]

# --- base patterns -------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping e-mails: for each at-sign, the local part reaches back to the last sign or match."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start; leftmost and non-overlapping within a kind."""
    out = _emails(text)
    for m in _CHAIN.finditer(text):
        parts = list(_DIGITS.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(_small(p.group()) for p in parts[i:i + 4]):
                out.append(("ip", parts[i].start(), parts[i + 3].end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := "".join(_DIGITS.findall(m.group()))) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- candidates ----------------------------------------------------------------------------------------------

#: A local part starts where its run of signs starts, so that long runs cost one attempt; a label of a domain has at most 63 signs.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[({<]? ?(?:at|AT) ?[\])}>]? ?[A-Za-z0-9-]{1,63}"
                      r"(?: ?(?:[\[({<] ?)?(?:dot|DOT|\.)(?: ?[\])}>])? ?[A-Za-z0-9-]{2,63})+")
_SPELLED_CUE = re.compile(r"[\[({< ](?:dot|DOT)[\])}> ]|[\[({<] ?(?:at|AT) ?[\])}>]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./_:\[\]-]{0,3}[0-9]){6,}")
_GROUPS = re.compile(r"(?<![0-9])[0-9]+(?:[\x20()./_:\[\]-]{1,3}[0-9]+){3,}")
_SECRET = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{1,40})[\x20\t]?[=:][\x20\t]?[\"']?([A-Za-z0-9+/_=-]{16,})")


#: Digits of a number that is proposed whole; of longer rows of numbers neighbouring groups are.
WHOLE_DIGITS = 25


def _card_windows(groups: list) -> list[Span]:
    """Neighbouring groups of digits that hold 16 to 19 digits together."""
    out = []
    for i, first in enumerate(groups):
        n = 0
        for last in groups[i:i + 19]:
            n += last.end() - last.start()
            if n > 19:
                break
            if n >= 16:
                out.append(("card", first.start(), last.end()))
    return out


def _near(text: str, cue: re.Match) -> tuple[int, int]:
    """The text about a cue: 140 signs on either side, and on to the ends of the runs of signs there."""
    lo, hi = max(0, cue.start() - 140), min(len(text), cue.end() + 140)
    while lo > 0 and text[lo - 1] in _LOCAL:
        lo -= 1
    while hi < len(text) and text[hi] in _LOCAL:
        hi += 1
    return lo, hi


def candidates(text: str) -> list[Span]:
    """High-recall proposals; they may overlap one another and base spans."""
    out = []
    if _SPELLED_CUE.search(text):
        for cue in _SPELLED_CUE.finditer(text):
            out += [("email", m.start(), m.end()) for m in _SPELLED.finditer(text, *_near(text, cue))
                    if m.start() <= cue.start() < m.end()]
    for m in _NUMBER.finditer(text):
        n = sum(map(len, _DIGITS.findall(m.group())))
        if n > WHOLE_DIGITS:
            out += _card_windows(list(_DIGITS.finditer(text, m.start(), m.end())))
        elif n >= 16:
            out.append(("card", m.start(), m.end()))
        elif n >= 7:
            out.append(("phone", m.start(), m.end()))
    for m in _GROUPS.finditer(text):
        parts = list(_DIGITS.finditer(text, m.start(), m.end()))
        gaps = [text[a.end():b.start()] for a, b in zip(parts, parts[1:])]
        for i in range(len(parts) - 3):  # among more than four numbers those with one separator
            if (len(parts) == 4 or len(set(gaps[i:i + 3])) == 1) and all(_small(p.group()) for p in parts[i:i + 4]):
                out.append(("ip", parts[i].start(), parts[i + 3].end()))
    out += [("secret", m.start(2), m.end(2)) for m in _SECRET.finditer(text)]
    return sorted(set(out))


#: Words that stand near personal data (fixed values).
_CUES = {
    "email": ("mail", "contact", "write", "inbox"),
    "ip": ("ip", "addr", "host", "server"),
    "card": ("card", "visa", "pay", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "key", "secret", "password", "passwd", "auth"),
}
FEATURES = 22


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its context."""
    kind, start, end = span
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    groups = _DIGITS.findall(s)
    letters = sum(c.isalpha() for c in s)
    before, after = text[max(0, start - 40):start].lower(), text[end:end + 20].lower()
    counts = np.bincount(np.frombuffer(s.encode("utf-8", "replace"), np.uint8))
    share = counts[counts > 0] / counts.sum()
    return [
        float(ADDED.index(kind)), float(len(s)), float(len(digits)), float(letters), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(digits) >= 12 and luhn(digits)), float(len(groups) == 4 and all(map(_small, groups))),
        float(s[0] == "+"), float(s.count("(")), float(s.count("-")), float(s.count(".")), float(s.count(" ")),
        float(s.count("/") + s.count("_") + s.count(":")), float(-(share * np.log2(share)).sum()),
        float(any(c in before for c in _CUES[kind])), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
        float(letters > 0 and s.upper() != s and s.lower() != s),
    ]


# --- training ------------------------------------------------------------------------------------------------


def _loosened(kind: str, s: str, draw: int) -> str:
    """A base match in one of its looser forms."""
    if kind == "email":
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", "."))[draw % 3]
        return s.replace("@", at).replace(".", dot)
    if kind == "ip":
        return s.replace(".", ("[.]", " . ", ":")[draw % 3])
    if kind == "card":
        d = "".join(_DIGITS.findall(s))
        return (".", "/", " - ", "_")[draw % 4].join(d[i:i + 4] for i in range(0, len(d), 4))
    return s[1:].replace(" ", (".", "-", " ")[draw % 3])


def _spoiled(s: str, draw: int) -> str:
    """The span with its digits turned, so that check digits and prefixes no longer hold."""
    return re.sub("[0-9]", lambda m: str((int(m.group()) * 7 + m.start() * (draw % 5 + 1) + 3) % 10), s)


def _wrong(kind: str, s: str, lead: str, draw: int) -> tuple[str, str]:
    """Text before, and a form that is not of the kind, in the place of a base match."""
    n = zlib.crc32(f"{draw} {s}".encode("utf-8", "replace"))
    away = lead[:20] + (" order ", " version ", " chapter ", " total ")[n % 4]  # beyond what speaks of the match
    day, month, year, clock = n % 28 + 1, n // 28 % 12 + 1, 1990 + n // 336 % 40, f"{n % 24:02}:{n // 24 % 60:02}"
    if kind == "email":
        a, b, c = (re.findall("[A-Za-z]{2,}", lead) + ["look", "us", "it"])[:3]
        return away, f"{a} at {b} dot {c}"
    if kind == "ip":
        parts = [str(n // 3 ** i % (30, 256)[i % 2]) for i in range(4)]
        return (away, lead)[n // 4 % 2], (" ", "/", "-", "_")[n // 8 % 4].join(parts)
    if kind == "card":
        return lead, _loosened(kind, _spoiled(s, draw), draw)
    digits = str(n * 7919 + 10 ** 14)
    return ((lead, f"{year}-{month:02}-{day:02} {clock}"), (lead, f"{day:02}.{month:02}.{year}"),
            (lead, f"{n % 20}.{n % 13}.{n % 90000 + 10000}.{n % 9000 + 1000}"), (away, digits[-(7 + n % 9):]),
            (lead, f"{digits[-3:]}-{digits[:4]}"), (lead, " ".join(digits[-(8 + n % 7):])))[n // 7 % 6]


def training_rows(text: str | None) -> list[tuple[str, float, list[float]]]:
    """(kind, label, features) from one document."""
    if not text:
        return []
    out, base = [], base_spans(text)
    draw = zlib.crc32(text.encode("utf-8", "replace"))
    for kind, s, e in base:
        for wrong in (False, True):
            form = _loosened(kind, text[s:e], draw)
            lead, tail = text[max(0, s - 60):s], text[e:e + 40]
            if wrong:
                lead, form = _wrong(kind, text[s:e], lead, draw)
            snippet = lead + form + tail
            for c in candidates(snippet):
                if c[0] == kind and c[1] <= len(lead) + 1 and c[2] >= len(lead) + len(form) - 1:
                    x = features(snippet, c)
                    if not (wrong and kind == "card" and x[7]):  # turned, and yet with a right check digit
                        out.append((kind, float(not wrong), x))
        draw += 1
    for c in candidates(text):
        if c[0] == "secret":  # a long value given to a name that says so
            value = text[c[1]:c[2]]
            named = any(w in text[max(0, c[1] - 44):c[1]].lower() for w in _CUES["secret"])
            mixed = any(x.isdigit() for x in value) and any(x.isalpha() for x in value)
            out.append(("secret", float(named and mixed), features(text, c)))
        elif c[0] == "card" and not any(s < c[2] and c[1] < e for _, s, e in base):
            x = features(text, c)
            if not x[7]:
                out.append(("card", 0.0, x))
    return out


class Trees:
    """Boosted trees as arrays, with a calibration and a threshold per kind."""

    def __init__(self, trees: list[tuple[float, np.ndarray]], scale: tuple[float, float],
                 thresholds: dict[str, float]):
        self.trees, self.scale, self.thresholds = trees, scale, thresholds

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                feature, inner = nodes[at, 0].astype(np.int64), nodes[at, 2] >= 0
                left = x[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]), at).astype(np.int64)
            out += weight * nodes[at, 4]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(a * self.margin(x) + b, -50, 50)))

    def chosen(self, found: list[list[Span]], texts: list[str]) -> list[list[Span]]:
        """Of each text's candidates, those at or above their kind's threshold."""
        flat = [(i, c) for i, cs in enumerate(found) for c in cs if c[0] in self.thresholds]
        out: list[list[Span]] = [[] for _ in found]
        for first in range(0, len(flat), BLOCK):
            part = flat[first:first + BLOCK]
            p = self.probability(np.asarray([features(texts[i], c) for i, c in part]))
            for (i, c), q in zip(part, p):
                if q >= self.thresholds[c[0]]:
                    out[i].append(c)
        return out


def _tree_nodes(tree) -> np.ndarray:
    """Rows (feature, threshold, left, right, value) of one Spark ML tree; left is -1 in a leaf."""
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([0, 0, -1, -1, float(node.prediction())])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
        return at

    add(tree._call_java("rootNode"))
    return np.asarray(rows, np.float64)


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton steps."""
    a, b = 2.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-2 * np.eye(2), x.T @ (label - p) - 1e-2 * np.array([a - 2, b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def _sample(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(h, text): the ``limit`` smallest hashes among documents with a digit or an at-sign, repeated rows once.

    A bound on the hash, from the approximate number of documents, keeps about twice as many; the texts
    stay spread over tasks, and only hashes are put in order.
    """
    rows = (docs.where(F.col(text_col).rlike("[0-9@]"))
            .select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text")))
    many = rows.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 2 * limit / max(many, 1))
    near = rows.where(F.col("h") <= int(-2 ** 63 + share * (2 ** 64 - 2 ** 11))) if share < 1 else rows
    near = materialise(near.groupBy("h").agg(F.min("text").alias("text")), "pii-sample")
    last = near.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return near.where(F.col("h") <= F.lit(last))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> Trees:
    """Train on at most ``limit`` documents with a digit or an at-sign, chosen by hash."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    ship_package(spark)
    sample = _sample(docs, id_col, text_col, limit)

    def rows(batches):
        for batch in batches:
            found = [(h, *r) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for r in training_rows(t)]
            yield pa.RecordBatch.from_pydict({
                "h": pa.array([r[0] for r in found], pa.int64()), "kind": pa.array([r[1] for r in found], pa.string()),
                "label": pa.array([r[2] for r in found], pa.float64()),
                "x": pa.array([r[3] for r in found], pa.list_(pa.float64()))})

    made = sample.mapInArrow(rows, "h long, kind string, label double, x array<double>").collect()  # bounded by ``limit``
    drop_table(sample)
    made.sort(key=lambda r: (r["h"], r["kind"], r["x"]))
    train = [(r["label"], r["x"]) for r in made if r["h"] % 4]
    if len({y for y, _ in train}) < 2:
        return Trees([], (2.0, 0.0), {})
    frame = spark.createDataFrame(train, "label double, x array<double>").coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(
        frame.select("label", array_to_vector("x").alias("features")).cache())
    trees = Trees([(w, _tree_nodes(t)) for w, t in zip(model.treeWeights, model.trees)], (2.0, 0.0), {})
    held = [r for r in made if r["h"] % 4 == 0]
    if not held:
        return trees
    x, y = np.asarray([r["x"] for r in held]), np.asarray([r["label"] for r in held])
    trees.scale = _calibrate(trees.margin(x), y)
    p, kind = trees.probability(x), np.asarray([r["kind"] for r in held])
    for k in ADDED:
        own = kind == k
        for t in np.unique(p[own]):
            above = own & (p >= t)
            if t >= 0.5 and y[above].mean() >= PRECISION:
                trees.thresholds[k] = float(t)
                break
    return trees


# --- result --------------------------------------------------------------------------------------------------


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(ADDED)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def find_spans(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, all spans (base and added) and how many were added."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            marked = [bool(_MARK.search(t)) for t in texts]
            base = [base_spans(t) if m else [] for t, m in zip(texts, marked)]
            added = model.chosen([candidates(t) if m else [] for t, m in zip(texts, marked)], texts)
            every = []
            for own, more in zip(base, added):
                more = [c for c in more if not any(c[1] < e and s < c[2] for _, s, e in own)]
                every.append(own + more)
            cols = {"doc_id": batch.column(0)}
            for k in KINDS:
                cols[f"n_{k}"] = pa.array([sum(s[0] == k for s in own) for own in base], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
            cols["spans"] = pa.array([_joined(s) for s in every], pa.string())
            cols["n_added"] = pa.array([len(s) - len(own) for s, own in zip(every, base)], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    schema = ("doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


#: Every base match and candidate has one of these.
_MARK = re.compile(r"[0-9@=:]|[\[({< ](?:dot|DOT|at|AT)[\])}> ]")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find_spans(docs, fit(docs, id_col, text_col), id_col, text_col)

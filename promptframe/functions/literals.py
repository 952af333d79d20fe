"""Literal values in text: JSON and Python spellings by one tokenizer and one parser, nothing evaluated (JS5).

Read are strings in all quotings (raw and triple ones, adjacent ones joined), numbers in both spellings, ``None`` /
``null``, ``True`` / ``true``, ``False`` / ``false``, lists, tuples, sets and objects with trailing commas.  The result is
canonical JSON text, so that the type of a column is inferred from the very text it is then read from.  Tuples
and sets become lists, keys become strings, of equal keys the last one counts.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deeper nesting than this is an error of the cell.
DEPTH = 200

_TOKEN = re.compile(r"""
    [ \t\r\n\f]*(?:
      (?P<prefix>[rRuU]?)(?P<string>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3}
                                   |"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    | (?P<number>[-+]?[ ]*(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+
                             |(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9]+)?)(?![0-9A-Za-z_.]))
    | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
    | (?P<mark>[{}\[\](),:])
    | (?P<end>$))""", re.X | re.S)
_NAMES = {"None": None, "null": None, "True": True, "true": True, "False": False, "false": False}
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|N\{([^}]+)\}|(\n)|(.))", re.S)
_SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "\\": "\\", "'": "'", '"': '"', "/": "/"}


class LiteralError(ValueError):
    """What is wrong with a cell, and where."""


def _unescaped(m: re.Match) -> str:
    octal, two, four, eight, name, joined, single = m.groups()
    if octal:
        return chr(int(octal, 8))
    if two or four or eight:
        return chr(int(two or four or eight, 16))
    if name:
        return unicodedata.lookup(name)
    return "" if joined else _SINGLE.get(single, m.group())


def _string(prefix: str, token: str) -> str:
    body = token[3:-3] if token[:3] in ('"""', "'''") and len(token) >= 6 else token[1:-1]
    if prefix not in ("r", "R"):
        body = _ESCAPE.sub(_unescaped, body)
    # Halves of one character come together; a half alone is no text.
    return body.encode("utf-16", "surrogatepass").decode("utf-16")


def _number(token: str):
    token = token.replace(" ", "").replace("_", "")
    sign, digits = (-1, token[1:]) if token[0] == "-" else (1, token.lstrip("+"))
    if digits[:2].lower() in ("0x", "0o", "0b"):
        return sign * int(digits, 0)
    if re.fullmatch("[0-9]+", digits):
        if len(digits) > 1 and digits[0] == "0" and digits.strip("0"):
            raise LiteralError("a number with a leading zero")
        return sign * int(digits)
    value = sign * float(digits)
    if value in (float("inf"), float("-inf")):
        raise LiteralError("a number out of range")
    return value


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.advance()

    def advance(self) -> None:
        m = _TOKEN.match(self.text, self.at)
        if m is None:
            raise LiteralError(f"unexpected character at {self.at}")
        self.start, self.at = self.at, m.end()
        self.kind = m.lastgroup if m.lastgroup != "prefix" else "string"
        self.token, self.prefix = m.group(self.kind), m.group("prefix") or ""

    def is_mark(self, mark: str) -> bool:
        return self.kind == "mark" and self.token == mark

    def fail(self):
        raise LiteralError(f"unexpected {self.token or 'end'!r} at {self.start}")

    def value(self, depth: int = 0):
        if depth > DEPTH:
            raise LiteralError("nested too deeply")
        if self.kind == "string":
            out = ""
            while self.kind == "string":
                out += _string(self.prefix, self.token)
                self.advance()
            return out
        if self.kind == "number":
            out = _number(self.token)
        elif self.kind == "name" and self.token in _NAMES:
            out = _NAMES[self.token]
        elif self.kind == "mark" and self.token in "[(":
            return self.items("])"["[(".index(self.token)], depth)
        elif self.is_mark("{"):
            return self.braces(depth)
        else:
            self.fail()
        self.advance()
        return out

    def items(self, close: str, depth: int):
        self.advance()
        out, commas = [], 0
        while not self.is_mark(close):
            out.append(self.value(depth + 1))
            if self.is_mark(","):
                commas += 1
                self.advance()
            elif not self.is_mark(close):
                self.fail()
        self.advance()
        # One value in round brackets without a comma is that value.
        return out[0] if close == ")" and len(out) == 1 and not commas else out

    def braces(self, depth: int):
        self.advance()
        pairs, members = {}, []
        while not self.is_mark("}"):
            key = self.value(depth + 1)
            if self.is_mark(":") and not members:
                if isinstance(key, (dict, list)):
                    raise LiteralError("a key that is no plain value")
                self.advance()
                name = key if isinstance(key, str) else json.dumps(key)
                pairs.pop(name, None)
                pairs[name] = self.value(depth + 1)
            elif not pairs:
                if key not in members:
                    members.append(key)
            else:
                self.fail()
            if self.is_mark(","):
                self.advance()
            elif not self.is_mark("}"):
                self.fail()
        self.advance()
        return members or pairs


def parse_literal(text: str):
    """The value of a whole text; :class:`LiteralError` says what is wrong."""
    try:
        reader = _Reader(text)
        out = reader.value()
        if reader.kind != "end":
            reader.fail()
        return out
    except (UnicodeError, KeyError, OverflowError) as e:
        raise LiteralError(str(e)) from e
    except ValueError as e:
        raise e if isinstance(e, LiteralError) else LiteralError(str(e)) from e


def canonical(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, error) of a cell; both are null for a null or blank one."""
    if text is None or not text.strip():
        return None, None
    try:
        return json.dumps(parse_literal(text), ensure_ascii=False, allow_nan=False), None
    except LiteralError as e:
        return None, str(e)


def literal_json(cell: Column) -> Column:
    """``struct<json, error>`` of text cells.  What the JVM reads as JSON stays there; only other cells go to Python."""
    @F.pandas_udf("json string, error string")
    def read(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([canonical(c) for c in cells], columns=["json", "error"], dtype=object)

    plain = F.try_parse_json(cell).isNotNull()
    other = read(F.when(plain, F.lit(None).cast("string")).otherwise(cell))
    return F.struct(F.when(plain, cell).otherwise(other["json"]).alias("json"), other["error"].alias("error"))

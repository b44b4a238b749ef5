"""Several values packed in one field (problem 1).

A finite-state tokenizer reads a field once, keeping track of quoting, escapes and bracket depth, and gives the values
between the delimiters that stand outside quotes. It runs over Arrow batches; the rows are made by ``posexplode`` in the
JVM, so nothing is shuffled.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",;|/、·，；｜／\t\n\r"
MARKS = "#"
OPEN, CLOSE = "[({", "])}"
JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def tokenize_packed(field: str | None, delimiters: str = DELIMITERS, marks: str = MARKS) -> list[str]:
    """The values of one field, in order.

    * null or blank: no values; empty values between delimiters are dropped; repeated values are kept.
    * A double quote opens a value only at its start; a doubled or escaped quote inside stands for itself. A single quote
      opens one at its start if a closing one stands before a delimiter, a closing bracket or the end.
    * A quote that is never closed is an ordinary character.
    * A backslash makes the next character ordinary, outside quotes too. Inside brackets the JSON escapes are decoded.
    * Brackets around the whole field, or nested lists in it, are dropped; any other bracket is an ordinary character.
    * A leading mark (``#``) introduces a value and also ends the marked value before it.
    """
    if field is None:
        return []
    s = field.strip()
    if not s:
        return []
    n, i, depth = len(s), 0, 0
    out: list[str] = []
    buf: list[str] = []
    marked = started = False
    keep = 0  # buf[:keep] came from quotes or escapes and isn't trimmed away
    wrapped = s[0] in OPEN and s[-1] == CLOSE[OPEN.index(s[0])]

    def emit() -> None:
        nonlocal buf, marked, started, keep
        text = "".join(buf).strip()
        if text:
            out.append(text)
        buf, marked, started, keep = [], False, False, 0

    while i < n:
        c = s[i]
        if not started:
            if c.isspace() and c not in delimiters:
                i += 1
                continue
            if wrapped and c in OPEN:
                depth += 1
                i += 1
                continue
            if c in marks:
                marked, started = True, True
                i += 1
                while i < n and (s[i] in marks or s[i] == " "):
                    i += 1
                continue
            if c == '"' or c == "'":
                end = _closing(s, i, c, delimiters)
                if end > 0:
                    i = _quoted(s, i + 1, end, c, depth > 0, buf)
                    started, keep = True, len(buf)
                    continue
            started = not (c in delimiters or depth and c in CLOSE)
        if c == "\\" and i + 1 < n:
            buf.append(s[i + 1])
            keep = len(buf)
            i += 2
            continue
        if c in delimiters:
            emit()
        elif depth and c in CLOSE and _ends_list(s, i, delimiters):
            emit()
            depth -= 1
        elif c in marks and (marked or (buf and buf[-1].isspace() and len(buf) > keep)):
            emit()
            marked = started = True
        else:
            buf.append(c)
        i += 1
    emit()
    return out


def _closing(s: str, at: int, q: str, delimiters: str) -> int:
    """Where the quote opened at ``at`` closes, or 0."""
    i, n = at + 1, len(s)
    while i < n:
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == q:
            if i + 1 < n and s[i + 1] == q and not (q == "'" or i == at + 1 and _bounded(s, i + 2, delimiters)):
                i += 2
                continue
            if q == '"' or _bounded(s, i + 1, delimiters):
                return i
        i += 1
    return 0


def _bounded(s: str, i: int, delimiters: str) -> bool:
    while i < len(s) and s[i] == " ":
        i += 1
    return i >= len(s) or s[i] in delimiters or s[i] in CLOSE


def _ends_list(s: str, i: int, delimiters: str) -> bool:
    return _bounded(s, i + 1, delimiters)


def _quoted(s: str, i: int, end: int, q: str, in_list: bool, buf: list[str]) -> int:
    while i < end:
        c = s[i]
        if c == "\\" and i + 1 < end:
            d = s[i + 1]
            if in_list and d == "u" and i + 6 <= end:
                try:
                    buf.append(json.loads(f'"{s[i : i + 6]}"'))
                    i += 6
                    continue
                except ValueError:
                    pass
            buf.append(JSON_ESCAPES.get(d, d) if in_list else d)
            i += 2
        elif c == q and i + 1 < end and s[i + 1] == q:
            buf.append(q)
            i += 2
        else:
            buf.append(c)
            i += 1
    return end + 1


def _values(fields: pd.Series, delimiters: str, marks: str) -> pd.Series:
    seen: dict[str, list[str]] = {}  # within one Arrow batch only
    out = []
    for x in fields:
        if x is None:
            out.append(None)
            continue
        got = seen.get(x)
        if got is None:
            got = seen[x] = tokenize_packed(x, delimiters, marks)
        out.append(got)
    return pd.Series(out)


def split_packed(df: DataFrame, field: str | Column, keys: list[str], pos: str = "pos", value: str = "value", delimiters: str = DELIMITERS, marks: str = MARKS) -> DataFrame:
    """One row per value: the key columns, the place among the field's values (from 0) and the value.

    Only the keys and the field are read, so columns of ``df`` that are named like the result's don't clash. A null or
    empty field gives no row; repeated rows give their values again. ``delimiters`` and ``marks`` are single characters.
    """
    column = F.col(field) if isinstance(field, str) else field
    slim = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], column.alias("__field")).where("length(trim(__field)) > 0")

    def values(fields: pd.Series) -> pd.Series:
        return _values(fields, delimiters, marks)

    packed_values = F.pandas_udf(values, T.ArrayType(T.StringType()))
    parts = slim.select(*[f"__k{i}" for i in range(len(keys))], F.posexplode(packed_values("__field")).alias("__pos", "__value"))
    return parts.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.col("__pos").cast("int").alias(pos), F.col("__value").alias(value))

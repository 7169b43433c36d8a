"""Problem 3: several values packed in one field, split into one value per row.

Method: a quote-aware finite-state tokenizer.  It tracks quoting, escapes and
nesting and emits values, numbered from 1, at delimiters outside quotes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayfold.functions.text import WHITE_SPACE

#: What separates values, what encloses a list, and the quotes with their ends.
DELIMITERS = ",，、;；|｜/／\t\n\r#＃"
LIST_SIGNS = "[]【】{}"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "《": "》"}
NESTING = {"(": ")", "（": "）"}

_SPECIAL = re.compile("[" + re.escape(DELIMITERS + LIST_SIGNS + "".join(QUOTES) + "".join(NESTING)) + "]")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)


def _partners(text: str) -> dict[int, int]:
    """The places of the opening signs that have an end of another shape, and of their ends: one pass with a stack for each kind."""
    ends = {close: opening for opening, close in (QUOTES | NESTING).items() if close != opening}
    waiting: dict[str, list[int]] = {opening: [] for opening in ends.values()}
    out = {}
    for i, ch in enumerate(text):
        if ch in waiting:
            waiting[ch].append(i)
        elif ch in ends and waiting[ends[ch]]:
            out[waiting[ends[ch]].pop()] = i
    return out


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """The value of the straight quote that opens at ``at`` and the place behind its end; None if it never ends."""
    sign, i, out = text[at], at + 1, []
    while i < len(text):
        ch = text[i]
        if ch == "\\" and (m := _ESCAPE.match(text, i)):
            code = m.group(1)
            if code[0] == "u" and len(code) == 5:
                out.append(chr(int(code[1:], 16)))
            else:  # an escaped sign is the sign; before any other letter a backslash is itself
                out.append(code if code in "\"'\\/" else m.group())
            i = m.end()
            continue
        if ch == sign:
            if text[i + 1 : i + 2] != sign:
                return "".join(out), i + 1
            i += 1  # a doubled quote is a quote
        out.append(ch)
        i += 1
    return None


def tokenize(text: str | None) -> list[str]:
    """The values of a field in order; an empty list for null, blank or valueless text.

    States: between values, in an unquoted value, in a quote (with its depth),
    behind a quote.  A quote opens only where a value begins and only if it
    ends; other quote signs belong to the value.  Delimiters inside round
    brackets belong to the value if the brackets close.  Time is linear in the
    text: where brackets and paired quotes end is found in one pass.
    """
    if not text:
        return []
    values: list[str] = []
    buf: list[str] = []
    begun = False  # the value has a sign that isn't white space
    i, n, partners = 0, len(text), None

    def hold(part: str):
        nonlocal begun
        buf.append(part)
        begun = begun or bool(part.strip(WHITE_SPACE))

    def emit():
        nonlocal begun
        if v := "".join(buf).strip(WHITE_SPACE):
            values.append(v)
        buf.clear()
        begun = False

    while i < n:
        m = _SPECIAL.search(text, i)
        if m is None:
            hold(text[i:])
            break
        hold(text[i : m.start()])
        ch, at, i = m.group(), m.start(), m.end()
        if partners is None and (ch in NESTING or ch in QUOTES):
            partners = _partners(text)
        if ch in DELIMITERS or ch in LIST_SIGNS:
            emit()
        elif ch in QUOTES:
            q = None
            if not begun:
                q = _quoted(text, at) if QUOTES[ch] == ch else (text[at + 1 : partners[at]], partners[at] + 1) if at in partners else None
            if q is not None:
                buf.clear()
                hold(q[0])
                i = q[1]
            elif begun or ch == "'":
                hold(ch)
            # a quote that opens a value and never ends only marks it
        else:
            i = partners[at] + 1 if at in partners else i
            hold(text[at:i])
    emit()
    return values


def split_values(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, value): one row for each value of each field, pos from 1.

    Null, blank and valueless fields give no row; repeated values and repeated
    rows come out as often as they come in; an empty table gives an empty one;
    other columns are not read.  A map over Arrow batches, as regular
    expressions can't track quotes; null and empty fields are not sent to
    Python.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def values(v: pa.Array) -> pa.Array:
        return pa.array([tokenize(x) for x in v.to_pylist()], pa.list_(pa.string()))

    per_field: Column = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields]))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), per_field.alias("f")).where("f.text is not null and f.text <> ''").select(id_col, "f.*")
    return rows.select(id_col, "field", F.posexplode(values("text")).alias("p", "value")).select(id_col, "field", (F.col("p") + 1).alias("pos"), "value")

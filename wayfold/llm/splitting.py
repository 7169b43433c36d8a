"""Problem 1: items over a size limit cut into pieces at natural boundaries.

Method: recursive bisection.  A text is cut at the strongest boundary near its
middle; halves still longer than the limit minus the overlap are cut again;
then each piece but the first gets the end of the piece before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from wayfold.functions.text import strip

LIMIT, OVERLAP = 320, 40

#: Boundaries from strong to weak; a cut falls behind the match.  Addresses come first, so that no sign inside
#: one counts, and signs between digits are no boundaries.
_BOUNDARY = regex.compile(
    r"(?P<inside>!?\[[^\[\]\n]*\]\([^()\s]+\)|https?://[^\s，。；、）)\]]+)"
    r"|(?P<b6>\n[ \t\u3000]*(?:\n[ \t\u3000]*)+)"
    r"|(?P<b5>\n)"
    r"|(?P<b4>[。！？!?…]+[”」』\"'）)]*|(?<!\d)\.(?=\s))"
    r"|(?P<b3>[；;：]|(?<=\D):(?=\s))"
    r"|(?P<b2>[，、|｜]|,(?!\d))"
    r"|(?P<b1>[ \t\u00a0\u3000]+)"
)
_GLUE = regex.compile(r"(?=[\p{M}\u200d\ufe0f\u200c\U0001F3FB-\U0001F3FF])|(?<=\u200d)|(?<=\r)(?=\n)")
_WORD = regex.compile(r"(?<=[\p{Latin}\p{N}_])(?=[\p{Latin}\p{N}_])")


def boundary_strengths(text: str) -> np.ndarray:
    """How well the text may be cut before each character: 9 to 3 by sign, 2 between signs of no word, 1 in an address or word, 0 in a character cluster."""
    s = np.full(len(text) + 1, 2, np.int8)
    for m in _WORD.finditer(text):
        s[m.start()] = 1
    for m in _BOUNDARY.finditer(text):
        if m.lastgroup == "inside":
            s[m.start() + 1 : m.end()] = 1
        else:
            s[m.end()] = 3 + int(m.lastgroup[1])
    for m in _GLUE.finditer(text):
        s[m.start()] = 0
    return s


def bisect_cuts(text: str, room: int, overlap: int) -> list[int]:
    """The places at which ``text``, longer than ``room``, is cut, in order.

    Of the places within a quarter of the length from the middle the strongest
    is taken, of equal ones the nearest to the middle, of these the first.
    """
    if len(text) <= room:
        return []
    strength, most = boundary_strengths(text), max(1, room - overlap)
    cuts, open_parts = [], [(0, len(text))]
    while open_parts:
        lo, hi = open_parts.pop()
        n = hi - lo
        if n <= most and not (lo == 0 and hi == len(text)):
            continue
        mid, reach = lo + n // 2, max(1, n // 4)
        a, b = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
        near = strength[a : b + 1].astype(np.int64) * (2 * len(text)) - np.abs(np.arange(a, b + 1) - mid)
        at = a + int(np.argmax(near))
        cuts.append(at)
        open_parts += [(lo, at), (at, hi)]
    return sorted(cuts)


def split_items(df: DataFrame, id_col: str, body_col: str, head_col: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, cut_heads: bool = True) -> DataFrame:
    """Pieces of the items of ``df``: (id, piece_no, n_pieces, head, piece, core_start, core_chars).

    An item is its head, a line feed and its body, both without white space at
    the ends, or the body alone without a head.  Every piece has the head on
    its first line and at most ``limit`` characters; each but the first repeats
    the last ``overlap`` characters before its core.  core_start (from 0) and
    core_chars place the core in the body: the cores of an item, joined, are
    its body.  Of a head that takes more than half of the limit in an item over
    the limit, every piece has as much as half of the limit holds, and the rest
    of the head is the first line of the body; with ``cut_heads`` false the
    whole head is that line and the pieces have none.  A null or blank body is
    one empty body; short items are one piece; repeated rows come out
    repeatedly; an empty table gives an empty one; other columns are not read.
    A map: no shuffle.
    """
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be under a quarter of the limit")
    head = F.nullif(strip(F.col(f"`{head_col}`")), F.lit("")) if head_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), head.alias("head"), F.coalesce(strip(F.col(f"`{body_col}`")), F.lit("")).alias("body"))
    size, half = F.char_length("head"), limit // 2
    wide = F.col("head").isNotNull() & (size + 1 > half) & (size + 1 + F.char_length("body") > limit)
    shown = F.substring("head", 1, half - 1) if cut_heads else F.lit("")
    rows = rows.withColumn("lead", F.coalesce(F.when(~wide, F.col("head")).when(wide, F.nullif(shown, F.lit(""))), F.lit("")))
    rows = rows.withColumn("body", F.when(wide, F.concat_ws("\n", F.substring("head", F.char_length("lead") + 1, size), "body")).otherwise(F.col("body")))
    rows = rows.withColumn("lead", F.when(F.col("lead") != "", F.concat("lead", F.lit("\n"))).otherwise(F.lit("")))
    rows = rows.withColumn("room", limit - F.char_length("lead"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cuts(text: pa.Array, room: pa.Array) -> pa.Array:
        return pa.array([bisect_cuts(t, r, overlap) if t else [] for t, r in zip(text.to_pylist(), room.to_pylist())], pa.list_(pa.int32()))

    long_body = F.when(F.char_length("body") > F.col("room"), F.col("body"))  # short bodies aren't sent to Python
    cut = rows.withColumn("at", F.concat(F.array(F.lit(0)), cuts(long_body, F.col("room"))))
    cut = cut.withColumn("n_pieces", F.size("at")).select("*", F.posexplode("at").alias("p", "start"))
    end = F.coalesce(F.try_element_at("at", F.col("p") + 2), F.char_length("body"))
    back = F.when(F.col("p") > 0, F.least("start", F.lit(overlap))).otherwise(0)
    return cut.select(
        id_col, (F.col("p") + 1).alias("piece_no"), "n_pieces", "head",
        F.concat("lead", F.substring("body", F.col("start") - back + 1, end - F.col("start") + back)).alias("piece"),
        F.col("start").alias("core_start"), (end - F.col("start")).alias("core_chars"),
    )

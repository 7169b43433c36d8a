"""Text expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Tab, line feed, carriage return, space, no-break space, ideographic space.
WHITE_SPACE = "\t\n\r \u00a0\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty or only white space."""
    return c.isNull() | (strip(c) == "")


def squeeze_out(c: Column) -> Column:
    """All white space removed; null stays null."""
    return F.translate(c, WHITE_SPACE, "")


def nonblank(c: Column) -> Column:
    """Stripped text, or null when blank."""
    return F.nullif(strip(c), F.lit(""))

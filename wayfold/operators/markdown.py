"""Markdown articles to titled sections of blocks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from wayfold.functions.text import WHITE_SPACE

_IMAGE = re.compile(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)")
ARTICLE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StructType([T.StructField("h2", T.StringType()), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])))]))),
])


def parse(text: str | None, fallback: str = "") -> dict:
    """{title, sections: [{h2, blocks: [{type, text}]}]}: a first-level heading is the title, a second-level one begins a section, images are blocks of their own."""
    title, sections, para = "", [], []

    def block(kind: str, value: str):
        if not sections:
            sections.append({"h2": "", "blocks": []})
        sections[-1]["blocks"].append({"type": kind, "text": value})

    def flush():
        if para:
            block("text", "\n".join(para))
            para.clear()

    for line in (text or "").split("\n"):
        s = line.strip(WHITE_SPACE)
        if s.startswith("# ") and not title:
            flush()
            title = s[2:].strip(WHITE_SPACE)
        elif s.startswith("## "):
            flush()
            sections.append({"h2": s[3:].strip(WHITE_SPACE), "blocks": []})
        elif images := _IMAGE.findall(s):
            flush()
            if rest := _IMAGE.sub("", s).strip():
                block("text", rest)
            for u in images:
                block("image", u)
        elif s:
            para.append(s)
        else:
            flush()
    flush()
    return {"title": title or fallback, "sections": sections}


def parse_column(text: Column, fallback: Column) -> Column:
    @F.arrow_udf(ARTICLE)
    def run(t: pa.Array, f: pa.Array) -> pa.Array:
        kind = pa.struct([("title", pa.string()), ("sections", pa.list_(pa.struct([("h2", pa.string()), ("blocks", pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())])))])))])
        return pa.array([parse(x, y or "") for x, y in zip(t.to_pylist(), f.to_pylist())], kind)

    return run(text, fallback)

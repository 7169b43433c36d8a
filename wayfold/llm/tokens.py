"""Problem 8: the whole corpus as token ids of a public byte-level tokenizer.

Method: the tiktoken library with a local rank file, regex pre-splitting of
long texts at safe boundaries, and decoding from raw bytes.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Texts beyond so many characters are encoded in parts, which bounds the buffers of the tokenizer.
PART_CHARS = 100_000
#: A part may end between a character that is neither white space nor an apostrophe and a following line feed
#: or space: the pattern begins a new piece there in any case.
_SAFE = regex.compile(r"(?<=[^\s'])(?=[ \n][^\s])")


def rank_file(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    """The path of a rank file: in ``folder``, else of the installed public tokenizers."""
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(f"{name}.tiktoken")
    return os.path.join(folder, f"{name}.tiktoken")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text cut at safe boundaries into parts of about ``size`` characters.

    Encoding the parts and concatenating the ids equals encoding the text: a
    cut is made only where the splitting pattern ends a piece whatever comes
    before.  A stretch without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def encode(text: str | None, path: str) -> list[int]:
    """Ids without special tokens; an empty list for an empty or null text."""
    if not text:
        return []
    enc = encoding(path)
    parts = safe_parts(text)
    return enc.encode_ordinary(text) if len(parts) == 1 else [i for p in parts for i in enc.encode_ordinary(p)]


def decode(ids: list[int], path: str) -> str:
    """The text of ids: the tokens' raw bytes are joined before they are read as UTF-8."""
    enc = encoding(path)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def encode_column(df: DataFrame, id_col: str, text_col: str, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(id, ids): one row per row of ``df``, with the token ids of its text.

    Null and empty texts give an empty list, blank ones the ids of their white
    space; repeated rows come out as often as they come in; an empty table
    gives an empty one; other columns are not read.  A map over Arrow batches:
    no shuffle.
    """
    path = rank_file(name, folder)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo in range(0, len(texts), 1000):
                lists = [np.array(encode(t, path), np.int32) for t in texts[lo : lo + 1000]]
                if lists:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, len(lists)), ids], [id_col, "ids"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, schema)


def decode_column(df: DataFrame, id_col: str, ids_col: str, text_col: str, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(id, text): the texts of token ids; null ids give null."""
    path = rank_file(name, folder)

    @F.arrow_udf(T.StringType())
    def text(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x, path) for x in v.to_pylist()], pa.string())

    return df.select(F.col(f"`{id_col}`").alias(id_col), text(F.col(f"`{ids_col}`")).alias(text_col))


def token_count(text: Column, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> Column:
    """The number of tokens of a text; 0 for an empty or null one."""
    path = rank_file(name, folder)

    @F.arrow_udf(T.IntegerType())
    def count(v: pa.Array) -> pa.Array:
        return pa.array([len(encode(t, path)) for t in v.to_pylist()], pa.int32())

    return count(text)

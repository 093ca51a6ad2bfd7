"""Overlapping chunks of long texts.

A cut depends on the one before it, so the cuts of a text are made in Python, from the
places of its blanks; the chunks themselves never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1800, 240


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the chunks: each ends at the last blank of its second half, or is full."""
    blanks = [m.start() for m in re.finditer("[ \n]", text)]
    out = [(0, 0)]
    for _ in range(len(text) + 1):
        low = max(out[-1][0] + 1, out[-1][1] - overlap) if out[-1][1] else 0
        high = min(low + size, len(text))
        last = bisect_left(blanks, high) - 1
        if high < len(text) and last >= 0 and blanks[last] >= max(low + 1, low + size // 2):
            high = blanks[last]
        out.append((low, high))
        if high == len(text):
            break
    return out[1:]


def chunk_spans(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text as ``array<struct<start,end>>``; an empty text is one empty chunk, a null one null."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in cuts(t, size, overlap)])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    return F.when(F.length(text) <= size, whole).otherwise(run(text))


def text_chunks(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, offset, chunk``: only texts longer than a chunk are seen by Python."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), chunk_spans(F.col(text_col), size, overlap).alias("_spans"))
    rows = rows.select("doc_id", "_text", F.explode_outer("_spans").alias("c")).where("c is not null")
    return rows.select("doc_id", F.col("c.start").alias("offset"), F.substring(F.col("_text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("chunk"))

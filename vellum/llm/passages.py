"""Substring dedup by hashing normalised lines, paragraphs and pieces of them.

Words are compared without regard to A-Z case and the white space between them.
Units have at least ``min_words`` words and are of three kinds: whole lines, whole
paragraphs (between blank lines), and pieces.  Passages are often pasted inside a
line, where line ends do not align them, so a piece begins after any line end or
after a word whose hash ends in ``CUT_BITS`` zero bits, and ends at the first such
place that makes it long enough.  All cuts depend on the words alone, so a repeated
passage is cut alike in every document.

Digests of units are grouped globally.  The occurrence of the smallest (document,
offset) stays; all others that do not overlap it lose their characters, in the
earliest document too.  Overlapping removed units merge to spans, in offsets of the
original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import Scratch
from vellum.llm._words import mix, placed_words, strings

#: One word in 2 ** CUT_BITS ends a piece of text, on average.
CUT_BITS = 2
MIN_WORDS = 25


def units(column: pa.Array, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, digests, starts, ends)`` of the units of each text that has any; offsets in characters."""
    raw, offsets, _ = strings(column)
    mask = np.uint64((1 << CUT_BITS) - 1)
    for row, stop, hashes, bounds, first, last in placed_words(column):
        if not len(hashes):
            continue
        low = offsets[row]
        text = raw[low : offsets[stop]]
        chars = np.cumsum((text & 0xC0) != 0x80) - 1
        lines = np.cumsum(text == 10)
        # A cut lies before word i if the word before it ends a line, a paragraph, or a piece.
        feeds = np.append(2, lines[first[1:]] - lines[first[:-1]])
        kinds = (feeds > 0, feeds > 1, np.append(True, (hashes[:-1] & mask == 0)) | (feeds > 0))
        sums = np.append(np.uint64(0), np.cumsum(mix(hashes) * _powers(len(hashes))))
        for i in range(stop - row):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a < min_words:
                continue
            begin, end = [], []
            for kind in kinds:
                cuts = np.union1d(np.flatnonzero(kind[a:b]) + a, [a, b])
                until = np.searchsorted(cuts, cuts + min_words)
                if kind is not kinds[2]:  # lines and paragraphs end at the next cut
                    until = np.where(until <= np.arange(len(cuts)) + 1, np.arange(len(cuts)) + 1, len(cuts))
                begin.append(cuts[until < len(cuts)])
                end.append(cuts[until[until < len(cuts)]])
            whole = np.unique(np.concatenate(begin) * (b + 1) + np.concatenate(end))
            begin, end = whole // (b + 1), whole % (b + 1)
            digest = mix((sums[end] - sums[begin]) * _inverses(begin) + (end - begin).astype(np.uint64))
            base = chars[offsets[row + i] - low]
            yield row + i, digest, chars[first[begin]] - base, chars[last[end - 1] - 1] + 1 - base


_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 2**64)
_TABLES: dict[int, np.ndarray] = {}


def _table(odd: int, n: int) -> np.ndarray:
    """The powers of an odd number modulo 2 ** 64, from the 0th to before the ``n``th."""
    if odd not in _TABLES or len(_TABLES[odd]) < n:
        steps = np.full(max(n, 1 << 17), odd, np.uint64)
        steps[0] = 1
        _TABLES[odd] = np.cumprod(steps)
    return _TABLES[odd][:n]


def _powers(n: int) -> np.ndarray:
    return _table(_ODD, n)


def _inverses(at: np.ndarray) -> np.ndarray:
    return _table(_BACK, int(at.max()) + 1 if len(at) else 1)[at]


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []

            def flush(parts: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in range(4)], names=["digest", "doc_id", "start", "end"])

            for row, digest, start, end in units(batch.column(1), min_words):
                parts.append((digest.view(np.int64), np.full(len(digest), ids[row], np.int64), start.astype(np.int32), end.astype(np.int32)))
                if len(parts) == 500:
                    yield flush(parts)
                    parts = []
            if parts:
                yield flush(parts)

    return run


def repeated_spans(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, kept_doc_id``: the spans of each text that an earlier document, or an earlier place in it, has.

    ``start`` and ``end`` count characters of the original text; spans of a document
    do not touch.  ``kept_doc_id`` is the earliest document of the span's units, which
    may be the document itself.  Texts that are null or have fewer than ``min_words``
    words have no units; rows with a null id are not read.  Rows that share an id are
    one document, so repeated rows keep what they repeat.  Other columns are not read;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.keep(rows.mapInArrow(_units(min_words), "digest long, doc_id long, start int, end int"), "units")
    # The owners are written, so that the join deals both sides anew and a digest of very many rows can be split.
    owners = found.groupBy("digest").agg(F.min(F.struct("doc_id", "start", "end")).alias("kept"), F.max(F.struct("doc_id", "start")).alias("last"))
    owners = owners.where("kept.doc_id < last.doc_id or kept.end <= last.start")
    owners = scratch.keep(owners.select("digest", F.col("kept.doc_id").alias("kept"), F.col("kept.end").alias("free")), "owners")
    found = found.join(owners, "digest").where("doc_id > kept or start >= free").select("doc_id", "start", "end", "kept")
    by = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept").alias("kept_doc_id"))
    return merged.select("doc_id", "start", "end", "kept_doc_id")


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text_col``; every other column and row stays."""
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("_cuts"))
    joined = docs.join(cuts, F.col(id_col) == F.col("_cut_id"), "left")
    text = F.col(text_col)
    kept = F.aggregate(
        "_cuts",
        F.struct(F.lit("").cast("string").alias("done"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"])).alias("done"), c["end"].alias("at")),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col("_cuts").isNull(), text).otherwise(kept)).drop("_cut_id", "_cuts")

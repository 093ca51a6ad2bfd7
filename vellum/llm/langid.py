"""Language identification by error-correcting output codes.

Every language has a codeword; each bit is predicted by a binary classifier over
byte n-grams: the log-odds of the n-gram in the languages whose bit is 1 against
those whose bit is 0.  The margins are decoded to the codeword of least total
logistic loss, each bit weighing as much as it was reliable in training.  A text
whose second-best codeword is nearly as close is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._folds import bounded_sample, fold
from vellum.llm._store import Scratch
from vellum.llm._words import RUN_BYTES, strings

#: Training rows of a language at most; larger languages are sampled by the hash of their ids.
ROWS_PER_LANGUAGE = 4000
#: Byte pairs have a bucket each, byte triples share as many by hash.
BUCKETS = 2 * 65536
#: N-grams of one text overlap, so they count as fewer independent observations.
EVIDENCE = 0.25
#: Two codewords are told apart if their scores differ by this.
CLEAR = 0.5

# ASCII letters and all bytes of other characters stay, the rest counts as blank.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An ``n`` x bits matrix of 0 and 1: all splits in two for few languages, else the
    best separated of random codes; no bit is constant."""
    if n <= 6:
        rows = [[(split >> i) & 1 for split in range(1, 2 ** (n - 1))] for i in range(n)]
        return np.array(rows, np.int8).reshape(n, -1)
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, 10 * math.ceil(math.log2(n))), dtype=np.int8)
        code = code[:, (code.min(0) == 0) & (code.max(0) == 1)]
        gaps = (code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * code.shape[1]
        if gaps.min() > apart:
            best, apart = code, gaps.min()
    return best


def _buckets(wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the middle of a triple of ``wide`` is no blank, and the buckets of its pair and triple."""
    a, b, c = wide[:-2], wide[1:-1], wide[2:]
    solid = np.flatnonzero(b != 32)
    a, b, c = a[solid], b[solid], c[solid]
    pairs = a * np.uint32(256) + b
    triples = ((a * np.uint32(65536) + b * np.uint32(256) + c) * np.uint32(2654435761)) >> np.uint32(16)
    buckets = np.empty(2 * len(solid), np.int64)
    buckets[0::2], buckets[1::2] = pairs, triples + np.uint32(65536)
    return solid, buckets


def grams(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, buckets, bounds)`` of runs of rows, as for word hashes.

    A text longer than a run comes in several runs of its one row, each with the bytes
    beside it, so that their n-grams together are those of the whole text.
    """
    raw, ends, _ = strings(pc.utf8_lower(texts))
    n, row = len(ends) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + run_bytes, "right")) - 1)
        low, high = int(ends[row]), int(ends[stop])
        if high - low > run_bytes:
            for at in range(low, high, run_bytes):
                end = min(at + run_bytes, high)
                wide = np.full(end - at + 2, 32, np.uint32)
                first, last = max(at - 1, low), min(end + 1, high)
                wide[first - at + 1 : last - at + 1] = _PLAIN[raw[first:last]]
                _, buckets = _buckets(wide)
                yield row, stop, buckets, np.array([0, len(buckets)])
            row = stop
            continue
        # Each text between blanks, so that n-grams know the ends of words and stay in their text.
        lens = np.diff(ends[row : stop + 1])
        heads = np.append(0, np.cumsum(lens + 3))
        wide = np.full(heads[-1], 32, np.uint32)
        shift = np.repeat(np.arange(1, len(lens) + 1) + 2 * np.arange(len(lens)), lens)
        wide[np.arange(len(shift)) + shift] = _PLAIN[raw[low:high]]
        solid, buckets = _buckets(wide)
        yield row, stop, buckets, 2 * np.searchsorted(solid, heads)
        row = stop


def _sums(table: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``table`` of each text."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(table[buckets], bounds[full], axis=0, dtype=np.float64)
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for row, stop, buckets, bounds in grams(batch.column(1)):
            for i, lang in enumerate(langs[row:stop]):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(buckets[bounds[i] : bounds[i + 1]], minlength=BUCKETS)
    for lang, count in held.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(count[at])], names=["lang", "bucket", "c"])


class LanguageCode:
    """The fitted bit classifiers: its size depends on languages, not on rows."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        odds = []
        for part in (slice(0, 65536), slice(65536, BUCKETS)):  # pairs and triples apart
            own = counts[:, part]
            share = (own + 0.02) / (own.sum(1, keepdims=True) + 0.02 * own.shape[1])
            ones, zeros = (np.stack([share[self.code[:, b] == v].mean(0) for b in range(self.code.shape[1])], 1) for v in (1, 0))
            odds.append(np.log(ones) - np.log(zeros))
        self.table = np.concatenate(odds).astype(np.float32)
        self.weight = np.ones(self.code.shape[1])

    def margins(self, texts: pa.Array, run_bytes: int = RUN_BYTES) -> np.ndarray:
        """The log-odds of each text's n-grams for each bit, summed over its runs."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for row, stop, buckets, bounds in grams(texts, run_bytes):
            out[row:stop] += _sums(self.table, buckets, bounds)
        return np.clip(EVIDENCE * out, -30, 30)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword."""
        sign = 2.0 * self.code - 1
        return (np.logaddexp(0, -margins[:, None, :] * sign[None]) * self.weight).sum(2)


def _bit_errors(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, wrong, seen = model.value, 0, 0
        index = {lang: i for i, lang in enumerate(fitted.langs)}
        for batch in batches:
            truth = fitted.code[[index[x] for x in batch.column(0).to_pylist()]]
            wrong = wrong + ((fitted.margins(batch.column(1)) > 0) != truth).sum(0)
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([wrong.tolist()], pa.list_(pa.int64()))], names=["seen", "wrong"])

    return run


def fit_languages(rows: DataFrame, scratch: Scratch, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageCode | str | None:
    """Fit on ``rows(doc_id, lang, text)``; the only language if there is one, else ``None``."""
    labelled = rows.where("lang is not null and text is not null")
    sample = scratch.keep(bounded_sample(labelled, "doc_id", "lang", rows_per_language).select("lang", "text"), "sample")
    tally = sample.mapInArrow(_tally, "lang string, bucket long, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toPandas()
    langs = sorted(tally["lang"].unique().tolist())
    if len(langs) < 2:
        return langs[0] if langs else None
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, tally["lang"].to_numpy(str)), tally["bucket"].to_numpy()] = tally["c"].to_numpy()
    model = LanguageCode(langs, counts)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    found = sample.mapInArrow(_bit_errors(shared), "seen long, wrong array<long>").collect()
    error = (sum(np.array(r["wrong"]) for r in found) + 1) / (sum(r["seen"] for r in found) + 2)
    model.weight = np.log(1 / np.clip(error, 1e-4, 0.49) - 1)
    model.weight /= model.weight.mean()
    scratch.drop("sample")
    return model


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            loss = fitted.losses(fitted.margins(batch.column(1)))
            likely = np.exp(loss.min(1, keepdims=True) - loss)
            likely /= likely.sum(1, keepdims=True)
            order, at = np.argsort(-likely, axis=1, kind="stable"), np.arange(batch.num_rows)
            best, score = order[:, 0], likely[at, order[:, 0]]
            clear = score - likely[at, order[:, 1]] >= CLEAR
            names = pa.array([fitted.langs[i] for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), names, pa.array(score), pa.array(~clear)], names=["doc_id", "held_out", "letters", "lang", "p", "close"])

    return run


def identify(docs: DataFrame, *, folds: int = 5, rows_per_language: int = ROWS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row of ``docs``.

    Learns from the non-null ``lang`` and text of rows outside fold 0, at most about
    ``rows_per_language`` a language; predicts from the text alone.  A text that is
    null or has no letter is ``und``, score 0 and not ambiguous.  With one learned
    language every other text is that one, score 1; with none, every text is ``und``.
    A null id is not held out and is not learned from.  Repeated rows are predicted
    each; other columns are not read; an empty table gives no rows.
    """
    held = F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held.alias("held_out"))
    model = fit_languages(rows.where("not held_out and doc_id is not null"), Scratch(docs.sparkSession, "langid"), rows_per_language)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if isinstance(model, LanguageCode):
        shared = docs.sparkSession.sparkContext.broadcast(model)
        told = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out", letters.alias("letters"))
        told = told.mapInArrow(_predict(shared), "doc_id long, held_out boolean, letters boolean, lang string, p double, close boolean")
    else:
        told = rows.select("doc_id", "held_out", (letters & F.lit(model is not None)).alias("letters"), F.lit(model).cast("string").alias("lang"), F.lit(1.0).alias("p"), F.lit(False).alias("close"))
    return told.select(
        "doc_id",
        "held_out",
        F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"),
        (F.col("letters") & F.col("close")).alias("ambiguous"),
    )

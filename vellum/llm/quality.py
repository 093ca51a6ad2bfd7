"""Quality classification by a factorisation machine.

Features are hashed words, statistics of the text's structure and numeric metadata.
The machine scores ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise
sum is taken in linear time as ``(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._folds import bounded_sample, fold
from vellum.llm._store import Scratch
from vellum.llm._words import mix, strings, word_hashes

#: Labelled rows of each label that are learned from, at most; more are sampled by the hash of their ids.
ROWS_PER_LABEL = 6000
#: Buckets of hashed words, and the rank of the pairwise interactions.
BUCKETS, RANK = 1 << 14, 4
EPOCHS, STEPS, BATCH, RATE, DECAY = 10, 1000, 128, 0.05, 1e-4  # epochs, or more up to so many steps

_KINDS = 9
_KIND = np.full(256, 8, np.uint8)  # 8: bytes of other characters
_KIND[:32] = 7
_KIND[[32, 9]] = 0
_KIND[[10, 13]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[[*b".,;:'\"()-"]] = 5
_KIND[[*b"!?#$%&*+/<=>@[\\]^_`{|}~"]] = 6

#: Structure statistics: shares of the kinds of bytes, then sizes and repetition.
STATISTICS = _KINDS + 7


def features(texts: pa.Array, extra: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, end row, buckets, values, bounds, dense)`` of runs of rows: the hashed
    words of each text, of unit length, and its statistics with ``extra`` beside them."""
    raw, ends, _ = strings(texts)
    for row, stop, hashes, bounds in word_hashes(texts):
        count = stop - row
        lens = np.diff(ends[row : stop + 1])
        kinds = np.zeros((count, _KINDS))
        for low in range(0, int(ends[stop] - ends[row]), 1 << 20):
            high = min(low + (1 << 20), int(ends[stop] - ends[row]))
            owner = np.searchsorted(ends[row + 1 : stop + 1] - ends[row], np.arange(low, high), "right")
            kinds += np.bincount(owner * _KINDS + _KIND[raw[ends[row] + low : ends[row] + high]], minlength=count * _KINDS).reshape(count, _KINDS)
        words = np.diff(bounds)
        dense = np.zeros((count, STATISTICS + extra.shape[1]))
        some = np.maximum(lens, 1)[:, None]
        dense[:, :_KINDS] = np.sqrt(kinds / some)
        dense[:, _KINDS] = np.log1p(words)
        dense[:, _KINDS + 1] = np.log1p(lens / np.maximum(words, 1))
        dense[:, _KINDS + 2] = kinds[:, 1] / np.maximum(words, 1)
        dense[:, STATISTICS:] = extra[row:stop]
        buckets, values, sizes = [], [], np.zeros(count, np.int64)
        for i in range(count):
            own = hashes[bounds[i] : bounds[i + 1]]
            if not len(own):
                continue
            uniq, times = np.unique(own, return_counts=True)
            dense[i, _KINDS + 3] = len(uniq) / len(own)
            dense[i, _KINDS + 4] = times.max() / len(own)
            if len(own) > 1:
                dense[i, _KINDS + 5] = (own[1:] == own[:-1]).mean()
                pairs = np.sort(mix(own[:-1]) + own[1:])
                dense[i, _KINDS + 6] = (pairs[1:] == pairs[:-1]).sum() / len(pairs)
            value = np.log1p(times)
            buckets.append((uniq % np.uint64(BUCKETS)).astype(np.int64))
            values.append(value / np.sqrt((value**2).sum()))
            sizes[i] = len(uniq)
        yield row, stop, np.concatenate([*buckets, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0)]), np.append(0, np.cumsum(sizes)), dense


class FactorisationMachine:
    """Weights over ``BUCKETS`` words and the dense features; its size is fixed."""

    def __init__(self, width: int, seed: int = 11) -> None:
        size = BUCKETS + width
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.bias, self.linear = 0.0, np.zeros(size)
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))

    def rows(self, buckets: np.ndarray, values: np.ndarray, bounds: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and dense features as one list of ``(index, value)`` a row, and its bounds."""
        count, width = dense.shape
        flat = np.clip((dense - self.mean) / self.scale, -4, 4) / 2
        words = np.diff(bounds)
        ends = np.append(0, np.cumsum(words + width))
        index, value = np.empty(ends[-1], np.int64), np.empty(ends[-1])
        at = np.arange(len(buckets)) + np.repeat(np.arange(count) * width, words)
        index[at], value[at] = buckets, values
        tail = (ends[1:, None] - width + np.arange(width)).ravel()
        index[tail], value[tail] = np.tile(BUCKETS + np.arange(width), count), flat.ravel()
        return index, value, ends

    def raw(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        heads = ends[:-1]
        each = self.factor[index] * value[:, None]
        total = np.add.reduceat(each, heads, axis=0)
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((each**2).sum(1), heads))
        return self.bias + np.add.reduceat(self.linear[index] * value, heads) + pairs, each, total

    def score(self, *row) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*row))[0], -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> None:
        """Adagrad over ``(buckets, values, dense)`` of each document, weighted to the true shares of labels."""
        dense = np.stack([d[2] for d in docs])
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        share = np.average(labels, weights=weights)
        self.bias = float(np.log((share + 0.01) / (1.01 - share)))
        rng, size = np.random.default_rng(seed), len(self.linear)
        heat, heats, heat0 = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
        for _ in range(max(EPOCHS, STEPS * BATCH // len(docs))):
            order = rng.permutation(len(docs))
            for low in range(0, len(order), BATCH):
                pick = order[low : low + BATCH]
                sizes = [len(docs[i][0]) for i in pick]
                index, value, ends = self.rows(np.concatenate([docs[i][0] for i in pick]), np.concatenate([docs[i][1] for i in pick]), np.append(0, np.cumsum(sizes)), dense[pick])
                raw, each, total = self.raw(index, value, ends)
                gap = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) * weights[pick] / len(pick) * 8
                spread = np.repeat(gap, np.diff(ends)) * value
                slope = np.bincount(index, spread, size) + DECAY * self.linear
                heat += slope**2
                self.linear -= RATE * slope / np.sqrt(heat)
                push = spread[:, None] * (np.repeat(total, np.diff(ends), axis=0) - each)
                for f in range(RANK):
                    slope = np.bincount(index, push[:, f], size) + DECAY * self.factor[:, f]
                    heats[:, f] += slope**2
                    self.factor[:, f] -= RATE * slope / np.sqrt(heats[:, f])
                heat0 += gap.sum() ** 2
                self.bias -= RATE * gap.sum() / np.sqrt(heat0)


def _dense(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Metadata columns from ``first`` on: logarithms of size, 0 for what is missing."""
    cols = [np.nan_to_num(np.asarray(batch.column(i).to_numpy(zero_copy_only=False), float), nan=0.0, posinf=0.0, neginf=0.0) for i in range(first, batch.num_columns)]
    return np.stack([np.sign(c) * np.log1p(np.abs(c)) for c in cols], 1) if cols else np.zeros((batch.num_rows, 0))


def _fit(width: int, total: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for row, _, buckets, values, bounds, dense in features(batch.column(1), _dense(batch, 3)):
                rows += [(ids[row + i], labels[row + i], (buckets[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]].astype(np.float32), dense[i])) for i in range(len(dense))]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1]))
        labels = np.array([r[1] for r in rows], float)
        seen = {v: max(1, int((labels == v).sum())) for v in (0, 1)}
        weights = np.array([total.get(int(v), 0) / seen[int(v)] for v in labels])
        model = FactorisationMachine(width)
        model.fit([r[2] for r in rows], labels, weights / weights.mean())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, stop, *rest in features(batch.column(1), _dense(batch, 4)):
                out[row:stop] = model.value.score(*rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out)], names=["doc_id", "held_out", "text_hash", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, rows_per_label: int = ROWS_PER_LABEL, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, text_hash, score, predicted`` of every row of ``docs``.

    ``text_hash`` is xxhash64 of the text, which tells apart rows of one id.

    Learns ``label_col`` (0 or 1) of the labelled rows outside fold 0, at most about
    ``rows_per_label`` of each label, weighted back to the labels' true shares, in one
    task.  Only the text and the numeric columns in ``metadata`` are inputs; a null one
    counts as 0.  Null or empty texts are scored by their statistics alone, all 0.
    Labels other than 0 and 1, and labels of ids that are labelled more than once with
    different values, teach nothing.  Without labels every score is 0.5.  A null id is
    not held out.  Repeated rows are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    held = F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False))
    extra = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(metadata)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), *extra)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").where(fold(F.col("doc_id"), folds) != 0).drop("other")
    total = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "doc_id", "label", rows_per_label)  # a bounded table of ids
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", *[f"x{i}" for i in range(len(extra))])
    sample = scratch.keep(sample, "sample")
    fitted = sample.coalesce(1).mapInArrow(_fit(STATISTICS + len(extra), total), "model binary").collect()
    scratch.drop("sample")
    if fitted:
        shared = spark.sparkContext.broadcast(pickle.loads(bytes(fitted[0]["model"])))
        scored = rows.mapInArrow(_score(shared), "doc_id long, held_out boolean, text_hash long, score double")
    else:
        scored = rows.select("doc_id", "held_out", "text_hash", F.lit(0.5).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

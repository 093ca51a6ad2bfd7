"""Exact top-k by inner product with a vector-approximation file.

Each block of rows has an approximation: every component's cell among ``CELLS`` of
equal width between the component's least and greatest value.  Only cells are moved
to the queries.  A query scans them for bounds of every score; rows whose upper bound
is below the kth lower bound are out.  Exact vectors are then read in the order of
their upper bounds: the ``FIRST`` of each query, which give a kth exact score, and
those others whose bound still reaches it, after which the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._blocks import clean, matrices, search
from vellum.llm._store import Scratch

CELLS = 256
#: Exact vectors of a query that are read before its kth score is known.
FIRST = 64
#: Components beyond this have no cells: such rows are read exactly.
LARGEST = 2.0**200
#: Sums of products below this are whole in double precision.
WHOLE = 2.0**53


def scaled(data: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * data)


def quantise(data: np.ndarray) -> bytes:
    """Which rows have cells, then the low end and the width of each dimension's cells, and the cells."""
    fits = (np.abs(data) <= LARGEST).all(1)
    held = data[fits]
    low = held.min(0) if len(held) else np.zeros(data.shape[1])
    width = np.maximum(np.ceil((held.max(0) - low + 1) / CELLS), 1.0) if len(held) else np.ones(data.shape[1])
    cells = np.clip(np.floor((held - low) / width), 0, CELLS - 1).astype(np.uint8)
    return fits.tobytes() + low.tobytes() + width.tobytes() + cells.tobytes()


def bounds(queries: np.ndarray, index: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's score with each of ``count`` rows, from the cells alone."""
    dim = queries.shape[1]
    fits = np.frombuffer(index, bool, count)
    low, width = np.frombuffer(index[count:], np.float64, 2 * dim).reshape(2, dim)
    floor = low + np.frombuffer(index, np.uint8, offset=count + 16 * dim).reshape(-1, dim) * width
    top = floor + (width - 1)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    lower, upper = np.full((len(queries), count), -np.inf), np.full((len(queries), count), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        # Sums of large numbers are rounded, by less than this.
        slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(floor), np.abs(top)).T)
        lower[:, fits] = plus @ floor.T + minus @ top.T - slack
        upper[:, fits] = plus @ top.T + minus @ floor.T + slack
    return np.nan_to_num(lower, nan=-np.inf, neginf=-np.inf, posinf=np.inf), np.nan_to_num(upper, nan=np.inf, neginf=-np.inf, posinf=np.inf)


def kth_lower(ids: np.ndarray, lower: np.ndarray, k: int) -> float:
    """The kth largest lower bound of different ids, which are in order; without so many, none."""
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else ids
    if len(heads) < k:
        return -np.inf
    return float(np.partition(np.maximum.reduceat(lower, heads), -k)[-k])


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products of paired rows of any size; one that leaves 64 bits is an error."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = np.abs(queries).max(1) * np.abs(rows).max(1) * queries.shape[1] < WHOLE
    out = np.zeros(len(rows), np.int64)
    out[plain] = (queries[plain] * rows[plain]).sum(1).astype(np.int64)
    for i in np.flatnonzero(~plain).tolist():
        if not (np.isfinite(queries[i]).all() and np.isfinite(rows[i]).all()):
            raise ArithmeticError("a scaled component exceeds double precision")
        score = sum(int(x) * int(y) for x, y in zip(queries[i], rows[i], strict=True))
        if not -(2**63) <= score < 2**63:
            raise ArithmeticError("a score exceeds 64 bits")
        out[i] = score
    return out


def _score(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = pa.array(np.arange(batch.num_rows))
            sides = [matrices(pa.RecordBatch.from_arrays([place, batch.column(c)], names=["at", "v"])) for c in ("asked", "v")]
            for (_, at, one), (_, _, other) in zip(*sides, strict=True):
                scores = exact_scores(scaled(one, scale), scaled(other, scale))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("vec_id").take(pa.array(at)), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, first: int = FIRST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products.

    Components become ``floor(scale * x)``.  Queries are the rows whose id is divisible
    by ``every``; candidates are all rows of the query's dimension but its own id.  Ties
    go to the smaller id; fewer candidates give fewer rows.  Vectors that are null,
    empty or hold null or non-finite components, and null ids take no part; a best score
    beyond 64 bits is an error.  Rows that repeat an id count once a different score, and
    once where they score alike.  Other columns are not read; an empty table gives no rows.
    """

    def answer(one: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: None, index: bytes) -> pa.RecordBatch:
        lower, upper = bounds(scaled(queries, scale), index, len(ids))
        out = []
        for i, q in enumerate(one.tolist()):
            other = ids != q
            own, low, high = ids[other], lower[i][other], upper[i][other]
            near = high >= kth_lower(own, low, k)
            out.append((np.full(near.sum(), q, np.int64), own[near], low[near], high[near]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(4)], names=["query_id", "vec_id", "lower", "upper"])

    scratch = Scratch(vectors.sparkSession, "vafile")
    rows = clean(vectors, id_col, vector_col)
    queries = rows.where(F.col("vec_id") % every == 0)
    found = search(rows, queries, index=lambda data: quantise(scaled(data, scale)), answer=answer, schema="query_id long, vec_id long, lower double, upper double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    by = W.partitionBy("query_id")
    kth = lambda place, value: F.max(F.when(F.col(place) == k, F.col(value)))
    found = found.withColumn("place", F.row_number().over(by.orderBy(F.desc("lower"))))
    found = found.withColumn("least", kth("place", "lower").over(by)).where("least is null or upper >= least")
    found = scratch.keep(found.select("query_id", "vec_id", "upper", F.row_number().over(by.orderBy(F.desc("upper"), "vec_id")).alias("place")), "near")

    def read(pairs: DataFrame) -> DataFrame:
        held = rows.join(pairs.select("vec_id").distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id", "v"])
        asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("asked")).dropDuplicates(["query_id", "asked"])
        both = pairs.select("query_id", "vec_id").join(held, "vec_id").join(asked, "query_id").where("size(v) = size(asked)")
        return both.mapInArrow(_score(scale), "query_id long, vec_id long, score long").distinct()

    def ranked(scores: DataFrame) -> DataFrame:
        return scores.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))

    early = scratch.keep(read(found.where(F.col("place") <= first)), "early")
    certain = ranked(early).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    late = found.where(F.col("place") > first).join(certain, "query_id", "left").where("kth is null or upper >= kth")
    return ranked(early.union(read(late)).distinct()).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

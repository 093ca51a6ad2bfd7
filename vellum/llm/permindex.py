"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its ``PREFIX`` nearest of ``PIVOTS`` pivots.
Each block of rows posts its vectors, with their positions, in one inverted list a
pivot.  A query reads the lists of its own nearest pivots, which gives the footrule
distance between its order and every vector's; the nearest by footrule are reranked
by their exact distance, ``RERANK`` times the square root of the number of rows in all.
A block's vectors travel with its lists: of the queries of a block some rerank nearly
every vector, so that reading them by id would move each of them many times.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._blocks import clean, precision, search

#: The pivots come from the first ``SAMPLE`` vectors by the hash of their ids: those that keep ``APART`` of the
#: median distance between sampled vectors from the pivots before them.
PIVOTS, PREFIX, SAMPLE, APART = 256, 128, 1024, 0.5
#: A query reranks so many times the square root of the number of rows, an equal share of each block.
RERANK = 6.0


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` vectors of a sample that are apart from each other, so that copies give one pivot."""
    far = np.sqrt(np.maximum((sample**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * sample @ sample.T, 0))
    least = APART * np.median(far[np.triu_indices(len(sample), 1)]) if len(sample) > 1 else 0.0
    kept: list[int] = []
    for i in range(len(sample)):
        if not kept or far[i, kept].min() > least:
            kept.append(i)
        if len(kept) == count:
            break
    return sample[kept]


def nearest_pivots(data: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    far = (pivots**2).sum(1)[None] - 2 * data @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def post(data: np.ndarray, pivots: np.ndarray, prefix: int) -> bytes:
    """Inverted lists: where each pivot's list ends, then rows and positions by pivot."""
    order = nearest_pivots(data, pivots, prefix)
    by = np.argsort(order.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(order.ravel(), minlength=len(pivots))).astype(np.int32)
    return ends.tobytes() + (by // order.shape[1]).astype(np.int32).tobytes() + (by % order.shape[1]).astype(np.int16).tobytes()


def footrules(index: bytes, order: np.ndarray, pivots: int, count: int) -> np.ndarray:
    """Footrule distance of one query's pivot order to each of ``count`` rows.

    A pivot missing from an order stands just behind its end, so a row that shares no
    pivot has the greatest distance, and each shared pivot takes some of it away.
    """
    prefix = len(order)
    ends = np.append(0, np.frombuffer(index, np.int32, pivots))
    rows = np.frombuffer(index, np.int32, count * prefix, 4 * pivots)
    places = np.frombuffer(index, np.int16, count * prefix, 4 * (pivots + count * prefix))
    spans = [slice(ends[p], ends[p + 1]) for p in order]
    own = np.repeat(np.arange(prefix, dtype=np.int32) * prefix, [s.stop - s.start for s in spans])
    hit, at = np.concatenate([rows[s] for s in spans]), np.concatenate([places[s] for s in spans])
    return prefix * (prefix + 1) - np.bincount(hit, savings(prefix)[own + at], count).astype(np.int32)


@lru_cache(maxsize=4)
def savings(prefix: int) -> np.ndarray:
    """What a shared pivot takes off the greatest distance, by its two places."""
    own, at = np.arange(prefix)[:, None], np.arange(prefix)[None]
    return ((prefix - own) + (prefix - at) - np.abs(own - at)).astype(np.float64).ravel()


def nearest_neighbours(vectors: DataFrame, *, every: int = 100, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by Euclidean distance.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of
    the query's dimension but its own id.  ``score`` is the exact distance; ties go to
    the smaller id; fewer candidates give fewer rows.  Vectors that are null, empty,
    zero or hold null or non-finite components, and null ids, take no part.  Rows that
    repeat an id count once a different distance.  Each dimension of the sample has its
    own pivots; a dimension too rare to be in it has no index and is searched exactly.
    Other columns are not read; an empty table gives no rows.
    """
    rows = clean(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    drawn = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(SAMPLE).collect()
    base = {dim: choose_pivots(np.array([r["v"] for r in drawn if len(r["v"]) == dim]), pivots) for dim in {len(r["v"]) for r in drawn}}
    total = rows.count()
    share = rerank / max(1, total) ** 0.5

    def index(data: np.ndarray) -> bytes:
        own = base.get(data.shape[1])
        return post(data, own, min(prefix, len(own))) if own is not None else b""

    def answer(one: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, lists: bytes) -> pa.RecordBatch:
        own = base.get(queries.shape[1])
        orders = nearest_pivots(queries, own, min(prefix, len(own))) if lists else None
        take = min(len(ids), int(np.ceil(share * len(ids))) + k)
        out = []
        for i, q in enumerate(one.tolist()):
            near = np.arange(len(ids))
            if lists:
                near = np.argsort(footrules(lists, orders[i], len(own), len(ids)), kind="stable")[:take]
            near = near[ids[near] != q]
            far = np.sqrt(((data[near].astype(np.float64) - queries[i]) ** 2).sum(1))
            order = np.lexsort((ids[near], far))
            found, far = ids[near][order], far[order]
            fresh = np.ones(len(found), bool)  # rows that repeat an id at one distance count once
            fresh[1:] = (found[1:] != found[:-1]) | (far[1:] != far[:-1])
            found, far = found[fresh][:k], far[fresh][:k]
            out.append((np.full(len(found), q, np.int64), found, far))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])

    found = search(rows, rows.where(F.col("vec_id") % every == 0), dtype=precision(vectors, vector_col), index=index, answer=answer, schema="query_id long, vec_id long, score double", total=total)
    by = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

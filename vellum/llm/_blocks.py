"""Vectors in blocks: a stated query set against all rows, block by block.

Rows are packed where they lie into blocks of bounded size: ids, an index, and where
an operator asks for it the vectors themselves, in their own precision.
Queries are dealt to blocks of bounded size by hash.  Each pair of a query block and
a row block is one row of a join on the pair's numbers, so no task holds more than
two blocks at a time and nothing passes through the driver.  There are as many lanes as
the table is long, so that more rows give more tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Rows of a row block and of a query block; a query block meets so many row blocks in a lane, and there are so many lanes at least.
ROW_BLOCK, QUERY_BLOCK, PER_LANE, LANES = 8192, 512, 4, 16

BLOCK = "dim int, ids binary, data binary, index binary"


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of vectors that are not null, not empty and wholly finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("vec_id is not null and v is not null and size(v) > 0").where(~odd)


def precision(vectors: DataFrame, vector_col: str) -> str:
    """The precision in which the vectors of a table lose nothing."""
    kind = vectors.schema[vector_col].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimension, ids, matrix)`` of the rows ``(vec_id, v)`` of each dimension."""
    lists = batch.column(1)
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    ids, dims = batch.column(0).to_numpy(), np.diff(ends)
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        yield int(dim), ids[own], flat[ends[own][:, None] + np.arange(dim)]


def pack(size: int, dtype: str | None, index: Callable):
    """Batches of ``(vec_id, v)`` to blocks of up to ``size`` rows in order of id, with vectors as ``dtype``, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, parts: list) -> pa.RecordBatch:
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], data[order]
            cols = [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.astype(dtype).tobytes() if dtype else b""], pa.binary()), pa.array([index(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["dim", "ids", "data", "index"])

        for batch in batches:
            for dim, ids, data in matrices(batch):
                for low in range(0, len(ids), size):
                    parts = held.setdefault(dim, [])
                    parts.append((ids[low : low + size], data[low : low + size]))
                    if sum(len(p[0]) for p in parts) >= size:
                        yield block(dim, held.pop(dim))
        for dim, parts in held.items():
            if parts:
                yield block(dim, parts)

    return run


def lanes_of(total: int) -> int:
    """Lanes of a table of ``total`` rows."""
    return max(LANES, -(-total // (ROW_BLOCK * PER_LANE)))


def search(rows: DataFrame, queries: DataFrame, *, index: Callable, answer: Callable, schema: str, dtype: str | None = None, total: int | None = None) -> DataFrame:
    """``answer(query ids, queries, row ids, rows, index)`` for each pair of blocks.

    ``answer`` gives the columns of ``schema`` for one pair of blocks of one dimension;
    its ``rows`` are ``None`` without ``dtype``, and then no vector of a row is moved.
    ``total`` is the number of rows, if it is known.
    """
    count = queries.count()
    lanes = lanes_of(rows.count() if total is None else total)
    blocks = max(1, -(-count // QUERY_BLOCK))
    packed = rows.mapInArrow(pack(ROW_BLOCK, dtype, index), BLOCK)
    packed = packed.withColumn("lane", F.pmod(F.crc32("ids"), F.lit(lanes)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"))
    dealt = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def gather(table: pa.Table) -> pa.Table:
        q = table.column("q")[0].as_py() if table.num_rows else 0
        run = pack(2 * QUERY_BLOCK, "<f8", lambda data: b"")
        found = list(run(iter(table.select(["vec_id", "v"]).combine_chunks().to_batches())))
        out = pa.Table.from_batches(found, pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("index", pa.binary())]))
        return pa.table({"q": pa.array([q] * out.num_rows, pa.int32()), "dim_q": out["dim"], "ids_q": out["ids"], "data_q": out["data"]})

    asked = dealt.groupBy("q").applyInArrow(gather, "q int, dim_q int, ids_q binary, data_q binary")
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    pairs = asked.join(packed, ["q", "lane"]).where("dim = dim_q").select("dim", "ids_q", "data_q", "ids", "data", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids_q, data_q, ids, data, extra = (c[i].as_py() for c in batch.columns)
                one, many = np.frombuffer(ids_q, np.int64), np.frombuffer(ids, np.int64)
                held = np.frombuffer(data, dtype).reshape(-1, dim) if dtype else None
                yield answer(one, np.frombuffer(data_q, "<f8").reshape(-1, dim), many, held, extra)

    return pairs.mapInArrow(run, schema)

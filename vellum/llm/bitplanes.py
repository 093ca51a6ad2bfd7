"""Centroid clustering on bit planes.

A vector of 64 whole numbers is held as bit planes: plane ``i`` packs bit ``i`` of all 64
components, in two's complement, into one unsigned 64-bit word.  The inner product of
two vectors is then a weighted sum of the population counts of the conjunctions of their
planes, and so are squared norms, which gives exact distances without a multiplication
of components.

Vectors are packed once and written; each round maps blocks of them to the nearest of
the centroids, of which there are few, and sums each task's members a cluster before
anything is shuffled.  The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import Scratch

#: Components of a vector, one a bit of a word.
WIDTH = 64
#: Vectors whose distances are counted at a time.
CHUNK = 4096
#: Up to so many planes sums of products stay within 64 bits.
NARROW = 28


def planes_needed(data: np.ndarray) -> int:
    """The width in bits, sign included, of the largest component."""
    if not data.size:
        return 1
    largest = max(int(data.max()), -int(data.min()) - 1, 0)
    return largest.bit_length() + 1


def to_planes(data: np.ndarray, count: int | None = None) -> np.ndarray:
    """Rows of 64 whole numbers to ``count`` words each, plane 0 first; the last is the sign."""
    count = count or planes_needed(data)
    bits = np.empty((len(data), count, WIDTH), np.uint8)
    for i in range(count):
        bits[:, i] = (data >> min(i, 63)) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def widen(planes: np.ndarray, count: int) -> np.ndarray:
    """The same numbers in more planes: the sign goes on."""
    more = np.repeat(planes[:, -1:], count - planes.shape[1], axis=1)
    return np.concatenate([planes, more], axis=1)


def weights(count: int) -> list[int]:
    """What a bit of each plane counts for; the last one is negative."""
    return [1 << i for i in range(count - 1)] + [-(1 << (count - 1))]


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The whole numbers again."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), planes.shape[1], 8), axis=2, bitorder="little")
    out = np.zeros((len(planes), WIDTH), np.int64)
    for i, w in enumerate(weights(planes.shape[1])):
        out += bits[:, i].astype(np.int64) * w
    return out


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of each row of planes with one vector's planes, exact whatever their width."""
    found: dict[int, np.ndarray] = {}  # counts by weight: 64 bits in up to 64 pairs of planes fit 16 bits
    for i, a in enumerate(weights(left.shape[1])):
        for j, b in enumerate(weights(len(right))):
            counts = found.setdefault(a * b, np.zeros(len(left), np.uint16))
            counts += np.bitwise_count(left[:, i] & right[j])
    return _weighted(found, len(left), left.shape[1] > NARROW or len(right) > NARROW)


def _weighted(found: dict[int, np.ndarray], size: int, wide: bool) -> np.ndarray:
    kind = object if wide else np.int64
    out = np.zeros(size, kind)
    for w, counts in found.items():
        out += counts.astype(kind) * w
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths: the planes of a row with each other, each pair of different planes twice."""
    w, found = weights(planes.shape[1]), {}
    for i, a in enumerate(w):
        for j in range(i + 1):
            counts = found.setdefault(a * w[j] * (1 if i == j else 2), np.zeros(len(planes), np.uint16))
            counts += np.bitwise_count(planes[:, i] & planes[:, j])
    return _weighted(found, len(planes), planes.shape[1] > NARROW)


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smallest number on ties, and the squared distance."""
    count = max(planes.shape[1], centroids.shape[1])
    planes, centroids = widen(planes, count), widen(centroids, count)
    base, own = norms(centroids), norms(planes)
    best, at = None, np.zeros(len(planes), np.int32)
    for c in range(len(centroids)):
        far = base[c] - 2 * dots(planes, centroids[c])  # the row's own length is the same for all
        if best is None:
            best = far
        else:
            closer = far < best
            at[closer], best[closer] = c, far[closer]
    best = best + own
    if best.dtype == object and len(best) and max(best) >= 2**63:
        raise ArithmeticError("a squared distance exceeds 64 bits")
    return at, best.astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and planes of written rows, those of one width at a time."""
    for batch in batches:
        held = batch.column("planes")
        ends, flat = np.asarray(held.offsets), np.asarray(held.values).view(np.uint64)
        sizes = np.diff(ends)
        for count in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == count)
            for low in range(0, len(own), CHUNK):
                some = own[low : low + CHUNK]
                yield batch.column("vec_id").take(pa.array(some)), flat[ends[some][:, None] + np.arange(count)]


def _pack(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.floor(scale * np.asarray(batch.column("v").flatten()).reshape(-1, WIDTH))
            if data.size and not (np.abs(data) < 2.0**62).all():
                raise ArithmeticError("a scaled component exceeds 62 bits")
            planes = to_planes(data.astype(np.int64))
            ends = np.arange(len(planes) + 1, dtype=np.int32) * planes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "planes"])

    return run


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), WIDTH), object), np.zeros(len(centroids), np.int64)
        for _, planes in _rows(batches):
            at, _ = nearest(planes, centroids)
            data = from_planes(planes)
            small = planes.shape[1] <= 63 - CHUNK.bit_length()
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
            total[at[order][heads]] += np.add.reduceat(data[order] if small else data[order].astype(object), heads, axis=0)
            count += np.bincount(at, minlength=len(centroids))
        full = np.flatnonzero(count)
        names = ["cluster", "at", "value", "members"]
        value = pa.array([str(x) for x in total[full].ravel()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, WIDTH).astype(np.int32)), pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(full))), value, pa.array(np.repeat(count[full], WIDTH))], names=names)

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, planes in _rows(batches):
            at, far = nearest(planes, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def _is_whole(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) == WIDTH) & ~odd


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: a row a vector.

    Components become ``floor(scale * x)``.  The first centroids are the ``k`` vectors of
    smallest SHA-256 of ``seed:id``; each round assigns every vector to the nearest
    centroid (ties: the smaller number) and moves each centroid that has members to the
    floor of their mean.  Vectors that are null, have not 64 components or hold null or
    non-finite ones are left out.  Rows without an id take part but are no first centroids;
    rows that repeat an id are vectors of their own, the smaller components first among
    equal hashes.  Fewer vectors than ``k`` give fewer centroids, and an empty table no
    rows; other columns are not read.  A distance or an inertia beyond 64 bits is an error.
    """
    scratch = Scratch(vectors.sparkSession, "bitplanes")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(_is_whole(F.col("v")))
    packed = scratch.keep(rows.mapInArrow(_pack(scale), "vec_id long, planes array<long>"), "planes")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where("vec_id is not null").orderBy(digest, "v").limit(k).collect()
    centers = np.floor(scale * np.array([r["v"] for r in first], np.float64)).astype(np.int64).reshape(-1, WIDTH)
    if not len(centers):
        return packed.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).where("false")
    for _ in range(rounds):
        sums = packed.mapInArrow(_sums(to_planes(centers)), "cluster int, at int, value string, members long")
        sums = sums.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("members").alias("members"))
        for r in sums.collect():  # k times 64 numbers
            centers[r["cluster"], r["at"]] = int(r["value"]) // r["members"]
    found = scratch.keep(packed.mapInArrow(_assign(to_planes(centers)), "vec_id long, cluster int, distance long"), "assigned")
    scratch.drop("planes")
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    if sum(inertia.values()) >= 2**63:
        raise ArithmeticError("the inertia exceeds 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    known = [(c, total, sum(inertia.values()), digests[c]) for c, total in inertia.items()]
    about = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """The same over ``embeddings``, for DuckDB: a pair of steps a round."""
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1)::INTEGER AS cluster, e AS c FROM v WHERE vec_id IS NOT NULL
  QUALIFY cluster < {k}
)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, e, min_by(cluster, (far, cluster)) AS cluster, min(far) AS distance FROM (
    SELECT v.rowid_ AS r, vec_id, e, cluster, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far
    FROM (SELECT *, row_number() OVER () AS rowid_ FROM v) v CROSS JOIN c{i}
  ) GROUP BY r, vec_id, e
)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (
    SELECT cluster, j, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT cluster, unnest(e) AS x, unnest(generate_series(1, 64)) AS j FROM a{i}) GROUP BY ALL
  ) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.cluster = m{i}.cluster
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, a{rounds}.cluster, distance, (sum(distance) OVER (PARTITION BY a{rounds}.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster
"""

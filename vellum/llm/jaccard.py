"""N-gram Jaccard self-join of documents by vertical partitioning.

A document is the set of its distinct ``k``-word shingles, hashed to 64 bits.
Two documents link when ``overlap / union >= num / den``, in integers.

1. *Classes.* Documents with equal sets form one class, so copies are never paired.
2. *Fragments.* The global order of shingle hashes is cut into ``F`` fragments,
   ``F`` set by the size class so that a linked pair, which differs in at most
   ``D < F`` shingles, agrees on whole fragments.  Only classes that share enough
   whole fragments with others go on (the pigeonhole principle: none is lost).
   Sizes a link can bridge meet in the class of the larger set.  Where too many of
   a set's fragments are empty to promise a shared one, its prefix shingles count.
3. *Prefixes.* Among those classes shingles are ordered by document frequency.
   Linked sets share a shingle of their prefixes, at positions that leave room
   for the overlap needed.
4. *Counting.* Each pair's overlap is counted fragment by fragment and the partial
   counts are summed per pair.  First every bucket of a prefix shingle is compared
   with one leader; the components so found are then only compared with each other,
   so that a group of near copies costs its size and not its square.
5. *Links.* Every link lies within a component.  Where they are to be counted, all
   pairs of a component are compared, as products of incidence matrices of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import Scratch, small
from vellum.llm._words import mix, shingle_sets
from vellum.llm.components import connected_components

#: Ranges of the hash order in which overlaps are counted apart.
COUNT_FRAGMENTS = 16
#: Bytes of a row of candidate ids, where they are broadcast.
ID_BYTES = 16
#: Classes and shingles of one product of two parts of a component whose links are counted.
LINK_BLOCK, LINK_WIDTH = 512, 4096
#: A component has up to so many blocks of so many classes before they grow, then blocks as large as they are many, so
#: that each set is copied about as often as the square root of the number of tasks; no block has more than so many shingles.
LINK_SPREAD, LINK_LEAST, LINK_SHINGLES = 8, 64, 1 << 22
#: Widths of the size classes; at least the largest ratio of sizes a link can bridge.
SIZE_RATIO = 1.5


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit id of a set of shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def size_classes(num: int, den: int) -> np.ndarray:
    """Lower bounds of the size classes; sets that can link lie in one or in neighbours."""
    ratio, out = max(SIZE_RATIO, den / num + 1e-9), [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * ratio))))
    return np.array(out)


def fragment_keys(shingles: np.ndarray, bounds: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(lot, need, keys)``: a linked class shares at least ``need`` keys of one lot.

    Of the whole fragments that a linked pair agrees on, at least ``spare``, this set's
    empty ones at most are no keys.  If those could be all, they could be all of the
    other set too, unless it counts on fewer; so such a set gives its prefix besides.
    """
    n = len(shingles)
    own = int(np.searchsorted(bounds, n, "right"))
    lots = [own, own + 1] if den * n >= num * int(bounds[own]) else [own]
    spread, sparse = mix(shingles), False
    for lot in lots:
        most = (2 * (int(bounds[lot]) - 1) * (den - num)) // (den + num)
        spare = 2 + most // 8
        count = most + spare
        part = ((shingles >> np.uint64(33)) * np.uint64(count)) >> np.uint64(31)
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        need = spare - (count - len(heads))
        sparse |= need < 1
        if len(heads):
            yield lot, max(1, need), mix(np.add.reduceat(spread, heads) + mix(part[heads] + (np.uint64(lot) << np.uint64(40))))
    if sparse:
        prefix = n - -(-num * n // den) + 1
        yield 0, 1, mix(shingles[:prefix] ^ np.uint64(0x5851F42D4C957F2D))


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls = [], []
            for own in shingle_sets(batch.column(1), k):
                n.append(len(own))
                cls.append(class_of(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "text_hash", "n", "cls"])

    return run


def _keys(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = size_classes(num, den)
        for batch in batches:
            keys, owners, tags, sizes, held, seen = [], [], [], [], 0, set()
            for own in shingle_sets(batch.column(0), k):
                if not len(own) or (cls := class_of(own)) in seen:
                    continue
                seen.add(cls)  # copies in one batch give their keys once
                for lot, need, some in fragment_keys(own, bounds, num, den):
                    keys.append(some)
                    owners.append(cls)
                    tags.append((lot << 32) + need)
                    sizes.append(len(some))
                    held += len(some)
                if held > 500_000:
                    yield _rows(keys, owners, tags, sizes)
                    keys, owners, tags, sizes, held = [], [], [], [], 0
            if keys:
                yield _rows(keys, owners, tags, sizes)

    return run


def _rows(keys: list, owners: list, tags: list, sizes: list) -> pa.RecordBatch:
    wide = [np.concatenate(keys).view(np.int64), np.repeat(np.array(owners, np.int64), sizes), np.repeat(np.array(tags, np.int64), sizes)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in wide], names=["key", "cls", "tag"])


def _segments(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, part, seg = [], [], [], []
            for c, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if c != class_of(own):
                    continue  # another text under the same id
                where = (own >> np.uint64(60)).astype(np.int64)
                for p in range(COUNT_FRAGMENTS):
                    low, high = np.searchsorted(where, [p, p + 1])
                    if high > low:
                        cls.append(c)
                        n.append(len(own))
                        part.append(p)
                        seg.append(own[low:high].view(np.int64))
            flat = pa.array(np.concatenate(seg) if seg else np.zeros(0, np.int64))
            ends = pa.array(np.append(0, np.cumsum([len(s) for s in seg], dtype=np.int64)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(part, pa.int32()), pa.ListArray.from_arrays(ends, flat)], names=["cls", "n", "part", "seg"])

    return run


def _need(a: str, b: str, num: int, den: int):
    """The least overlap that links sets of these sizes."""
    return F.expr(f"((({a}) + ({b})) * {num} + {num + den - 1}) div {num + den}")


def _room(num: int, den: int):
    """The first shared prefix shingle, at ``p`` and ``q``, leaves room for the overlap needed."""
    fits = F.expr(f"least(n, m) * {den} >= greatest(n, m) * {num}")
    return fits & (F.expr("1 + least(n - p - 1, m - q - 1)") >= _need("n", "m", num, den))


def _linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, n, b, m)`` the ends of those that link: partial overlaps of each
    fragment, summed per pair."""
    left = segments.select(F.col("cls").alias("a"), "part", F.col("seg").alias("x"))
    right = segments.select(F.col("cls").alias("b"), "part", F.col("seg").alias("y"))
    partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("c"))
    total = partial.groupBy("a", "b", "n", "m").agg(F.sum("c").alias("overlap"))
    return total.where(F.col("overlap") >= _need("n", "m", num, den)).select("a", "b")


def linked_degrees(owner: np.ndarray, shingles: np.ndarray, n: np.ndarray, block: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many sets each set links to: all pairs of one block, or those across two.

    Set ``owner[i]`` of ``n[owner[i]]`` shingles holds ``shingles[i]``.
    """
    _, column, often = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    low = block == block.min()
    high = ~low if not low.all() else low
    overlap = np.zeros((low.sum(), high.sum()), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_WIDTH):
        a, b = np.searchsorted(column, [start, start + LINK_WIDTH])
        cells = np.zeros((len(n), int(column[b - 1]) - start + 1), np.float32)
        cells[owner[a:b], column[a:b] - start] = 1
        overlap += (cells[low] @ cells[high].T).astype(np.int64)
    linked = overlap >= ((n[low][:, None] + n[high][None]) * num + num + den - 1) // (num + den)
    out = np.zeros(len(n), np.int64)
    if low.all():
        np.fill_diagonal(linked, False)
        return linked.sum(1)
    out[low], out[high] = linked.sum(1), linked.sum(0)
    return out


def _degrees(num: int, den: int, most: int):
    """The links within one block of a component, or across two: parts of ``most`` sets are multiplied at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("seg").combine_chunks()
        cls, first, own = np.unique(table.column("cls").to_numpy(), return_index=True, return_inverse=True)
        n, block, i, j = (table.column(c).to_numpy() for c in ("n", "block", "i", "j"))
        owner = np.repeat(own, lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(owner, kind="stable")
        shingles = lists.flatten().to_numpy(zero_copy_only=False)[order]
        ends = np.searchsorted(owner[order], np.arange(len(cls) + 1))
        n, block, counted = n[first], block[first], np.zeros(len(cls), np.int64)
        sides = [np.flatnonzero(block == side) for side in (i[0], j[0])]
        left, right = ([side[at : at + most] for at in range(0, len(side), most)] for side in sides)
        for at, a in enumerate(left):
            for b in right[at:] if i[0] == j[0] else right:
                both = a if a[0] == b[0] else np.append(a, b)
                held = np.concatenate([shingles[ends[c] : ends[c + 1]] for c in both])
                holder = np.repeat(np.arange(len(both)), np.diff(ends)[both])
                counted[both] += linked_degrees(holder, held, n[both], np.arange(len(both)) >= len(a), num, den)
        return pa.table({"node": cls, "links": counted})

    return run


def link_counts(roots: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """``node, links``: the links of each class of ``roots(node, root)``, all pairs of each component compared."""
    sizes = segments.groupBy("cls").agg(F.first("n").alias("n"))
    blocks = roots.join(sizes, F.col("node") == F.col("cls")).groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    spread, square = F.least(F.lit(LINK_SPREAD), F.ceil(F.col("members") / LINK_LEAST)), F.ceil(F.sqrt(F.col("members") / LINK_LEAST))
    blocks = blocks.select("root", "members", F.greatest(spread, square, F.ceil(F.col("total") / LINK_SHINGLES)).cast("int").alias("blocks"))
    placed = roots.join(blocks, "root")
    two = placed.where("members = 2").select("node", F.lit(1).cast("long").alias("links"))
    placed = placed.where("members > 2").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    rows = segments.join(placed, F.col("cls") == F.col("node")).select("root", "block", "cls", "n", "seg", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    rows = rows.select("root", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "cls", "n", "seg")
    counted = rows.groupBy("root", "i", "j").applyInArrow(_degrees(num, den, LINK_BLOCK), "node long, links long")
    return two.union(counted.groupBy("node").agg(F.sum("links").alias("links")))


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, count_links: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_shingles, component_id, class_id, group_id, n_links``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, itself included;
    ``class_id`` names the set of shingles, so rows of one class are copies of each
    other; ``group_id`` names the component whatever ids its rows share; ``text_hash``
    is xxhash64 of the text, which tells apart rows of one id; ``n_links`` counts the
    other classes that link with this one, and is left out without ``count_links``.

    A null or wordless text has an empty set, ``n_shingles`` 0, no class, and is its
    own component.  Fewer than ``k`` words make one shingle.  Rows that repeat are
    copies of each other; rows that share an id keep a row each.  Other columns are
    not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    classes = scratch.keep(hashed.mapInArrow(_classes(k), "doc_id long, text_hash long, n long, cls long"), "classes")

    # Classes that share enough whole fragments with another class.
    keys = texts.select("text").mapInArrow(_keys(k, num, den), "key long, cls long, tag long")
    # What the rows of a key are told is combined before it is shuffled, written, and joined back, so that a key of
    # very many rows is never one task's; the same below for shingles and buckets.
    several = scratch.keep(keys.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("key"), "several")
    shared = keys.join(several, "key", "left_semi")
    enough = shared.groupBy("cls", "tag").agg(F.count_distinct("key").alias("c")).where(F.expr("c >= tag & 4294967295"))
    chosen = scratch.keep(
        enough.select("cls").distinct().join(classes.where("doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "cls"), "chosen"
    )

    # Their shingles, in COUNT_FRAGMENTS ranges of the hash order.
    segments = scratch.keep(
        texts.join(small(chosen, ID_BYTES), "doc_id").select("cls", "text").mapInArrow(_segments(k), "cls long, n long, part int, seg array<long>").dropDuplicates(["cls", "part"]), "segments"
    )

    # Prefixes in the order of document frequency; shingles of one document come first and link nothing.
    apart = segments.select("cls", "n", F.explode("seg").alias("h"))
    df = scratch.keep(apart.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "df")
    often = apart.join(df, "h")
    by_class = W.partitionBy("cls")
    placed = often.withColumns({"r": F.row_number().over(by_class.orderBy("df", "h")), "c": F.count("*").over(by_class)})
    prefix = placed.select("h", "cls", "n", F.expr("n - c + r - 1").alias("p")).where(F.expr(f"p <= n - (n * {num} + {den - 1}) div {den}"))
    prefix = scratch.keep(prefix, "prefix")

    # Every bucket against its leader: the set with the fewest rarer shingles is nearest to what the bucket shares.
    leaders = scratch.keep(prefix.groupBy("h").agg(F.min(F.struct("p", "cls", "n")).alias("lead")), "leaders")
    star = prefix.join(leaders, "h").select(F.col("lead.cls").alias("a"), F.col("lead.n").alias("n"), F.col("lead.p").alias("p"), F.col("cls").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"))
    star = scratch.keep(star.where("a <> b").where(_room(num, den)).select("a", "n", "b", "m").distinct(), "star")
    first = scratch.keep(_linked(star, segments, num, den), "first")
    roots = connected_components(first, scratch, "found")

    # Then what is left between components; the smaller set's position is within the short prefix.
    at = prefix.join(roots, F.col("cls") == F.col("node"), "left").select("h", "cls", "n", "p", F.coalesce("root", "cls").alias("root"))
    mixed = scratch.keep(at.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h"), "mixing")
    at = scratch.keep(at.join(mixed, "h", "left_semi"), "mixed")
    fewer = at.where(F.expr(f"(p + 1) * {num + den} <= n * {den - num} + {num + den}")).select("h", F.col("cls").alias("a"), "n", "p", F.col("root").alias("ra"))
    more = at.select("h", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("root").alias("rb"))
    rest = fewer.join(more, "h").where("ra <> rb and (n < m or n = m and a < b)").where(_room(num, den))
    rest = rest.select("a", "n", "b", "m").distinct()
    known = star.select("a", "b").union(star.select("b", "a"))
    links = scratch.keep(first.union(_linked(rest.join(known, ["a", "b"], "left_anti"), segments, num, den)), "links")
    roots = connected_components(links, scratch, "all")

    # The smallest id of each component, back to every row.
    degree = link_counts(roots, segments, num, den) if count_links else roots.select("node", F.lit(0).cast("long").alias("links"))
    heads = classes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    heads = heads.join(roots.join(degree, "node"), F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    best = heads.groupBy("root").agg(F.min("least").alias("best"))
    heads = scratch.keep(heads.join(best, "root").select("cls", "root", "best", "links"), "heads")
    scratch.drop("several", "chosen", "segments", "df", "prefix", "leaders", "star", "first", "mixing", "mixed", "links")
    out = classes.join(heads, "cls", "left")
    empty = F.col("n") == 0
    n_links = [F.when(empty, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links")] if count_links else []
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("best")).alias("component_id"),
        F.when(~empty, F.col("cls")).alias("class_id"),
        F.when(~empty, F.col("root")).alias("group_id"),
        *n_links,
    )

"""Ranked lexical search in a K2-treap over the grid of terms and documents.

A block of documents is a grid: a row for each term that is asked for, a column for each
document, and in the cells the impact of a term on a document's score.  The grid is a
quadtree in which only cells that are not empty exist: a node has a bit for each of its
quadrants, the place of its first child and the greatest impact below it.  Rows are
halved as often as columns until a node has a single row; from there only columns are.

An item follows the paths of its rows together.  A range of documents is bounded by the
sum of the maxima of the nodes that hold the rows there; the ranges of greatest bound are
halved first, and the search ends when no bound reaches the kth score found.

Spark partitions the documents: each task builds the treaps of its own blocks, one after
another, and carries an item's best scores from block to block.  What tasks find is ranked
in one window an item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import Scratch

#: A term in UTF-8: digits, letters and all that is not ASCII; only A-Z have another case.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A block ends at so many documents or postings; so many ranges of documents are halved at a time.
BLOCK_DOCS, BLOCK_POSTINGS, AT_ONCE = 1 << 15, 1 << 21, 256
#: Items are asked in slices of about so many bytes, as their terms travel to every task.
SLICE_BYTES = 8 << 20
#: Texts of more bytes are counted piece by piece, so that no list of all their words is made.
PIECE = 1 << 20
#: The set bits below each quadrant's, for every set of quadrants.
BELOW = np.array([[bin(bits & ((1 << q) - 1)).count("1") for q in range(4)] for bits in range(16)], np.int8)


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    found: Counter = Counter()
    low = 0
    while low < len(text):
        high = low + PIECE
        if high < len(text):
            while high < len(text) and TERM.match(text, high - 1, high) and TERM.match(text, high, high + 1):
                high += 1  # a piece ends where no term goes on
        found.update(TERM.findall(text[low:high].lower()))
        low = high
    return found


def _post(rows: dict[bytes, int]):
    """Batches of ``(doc_id, text)`` to each document's number of terms and its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            texts = batch.column("text").cast(pa.large_binary())
            for i in range(len(texts)):
                found = term_counts(texts[i].as_py() or b"")
                own = [(rows[t], n) for t, n in found.items() if t in rows]
                terms.extend(r for r, _ in own)
                counts.extend(n for _, n in own)
                sizes.append(found.total())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Treap:
    """The quadtree of the postings ``(row, column, impact)`` of a block."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int) -> None:
        self.row_bits = max(1, (n_rows - 1).bit_length())
        self.depth = max(self.row_bits, (n_columns - 1).bit_length(), 1)
        code = np.zeros(len(rows), np.int64)
        for level in range(1, self.depth + 1):
            if level <= self.row_bits:
                code = code << 1 | rows >> (self.row_bits - level) & 1
            code = code << 1 | columns >> (self.depth - level) & 1
        order = np.argsort(code)
        code, best = code[order], impacts[order]
        levels = [(best, np.zeros(len(code), np.int32), np.zeros(len(code), np.uint8))]
        for level in range(self.depth, 0, -1):
            shift = 2 if level <= self.row_bits else 1
            above = code >> shift
            first = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(above) else np.zeros(0, np.int64)
            bits = np.left_shift(1, code & ((1 << shift) - 1)).astype(np.uint8)
            bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            best = np.maximum.reduceat(best, first) if len(first) else best
            code = above[first]
            levels.append((best, first.astype(np.int32), bits))
        levels.reverse()
        starts = np.cumsum([0] + [len(x[0]) for x in levels])
        self.best = np.concatenate([x[0] for x in levels])
        self.first = np.concatenate([x[1] + at for x, at in zip(levels, starts[1:], strict=True)]).astype(np.int32)
        self.bits = np.concatenate([x[2] for x in levels])

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """The half of each row at every level; once a node has a single row there is none."""
        at = np.arange(1, self.depth + 1)[:, None]
        return np.where(at <= self.row_bits, rows[None] >> np.maximum(self.row_bits - at, 0) & 1, 0)

    def halves(self, nodes: np.ndarray, levels: np.ndarray, paths: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the rows in one half of ranges of documents, -1 where a row has none, and the bounds."""
        quadrant = paths[levels] * 2 + side
        bits = np.where(nodes >= 0, self.bits[nodes], 0)
        child = np.where(bits >> quadrant & 1, self.first[nodes] + BELOW[bits, quadrant], -1)
        return child, np.where(child >= 0, self.best[child], 0).sum(1)

    def search(self, rows: np.ndarray, k: int, keys: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and keys of the ``k`` best columns and of those ``held`` before, smaller keys first on ties.

        A column's key orders it among all documents of a score; ``keys`` has those of this block.
        """
        scores, found = held
        if not len(self.best):
            return held
        paths = self.paths(rows)
        nodes, levels, at = np.zeros((1, len(rows)), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bounds = np.array([self.best[0] * len(rows)], np.int64)
        while True:
            least = max(1, int(scores[-1])) if len(scores) == k else 1
            open_ = bounds >= least
            if not open_.all():
                nodes, levels, at, bounds = nodes[open_], levels[open_], at[open_], bounds[open_]
            if not len(bounds):
                return scores, found
            take = np.argpartition(bounds, -AT_ONCE)[-AT_ONCE:] if len(bounds) > AT_ONCE else np.arange(len(bounds))
            parts = [self.halves(nodes[take], levels[take], paths, side) for side in (0, 1)]
            new, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            deeper, places = np.tile(levels[take] + 1, 2), np.concatenate([at[take] * 2, at[take] * 2 + 1])
            near = sums >= least
            done = near & (deeper == self.depth)
            if done.any():
                scores, found = best_of(np.concatenate([scores, sums[done]]), np.concatenate([found, keys[places[done]]]), k)
            rest, more = np.ones(len(bounds), bool), near & ~done
            rest[take] = False
            nodes, levels = np.concatenate([nodes[rest], new[more]]), np.concatenate([levels[rest], deeper[more]])
            at, bounds = np.concatenate([at[rest], places[more]]), np.concatenate([bounds[rest], sums[more]])


def best_of(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, greatest first, and smaller keys first among equal ones."""
    order = np.lexsort((keys[:, 1], keys[:, 0], -scores))[:k]
    return scores[order], keys[order]


def _rank(items: list[tuple[int, np.ndarray]], place: np.ndarray, weight: np.ndarray, total: int, length: int, k: int):
    """Batches of postings to each item's best documents of the task; ``place`` is the row of each term's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        best = {i: none for i, _ in items}
        for ids, absent, sizes, ends, terms, counts in _blocks(batches):
            terms = place[terms]
            column = np.repeat(np.arange(len(sizes)), np.diff(ends))
            m = 100 - 50 + (50 * sizes * total) // length
            impacts = weight[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[column]))
            # Documents whose most frequent term is the same are neighbours, the shorter first: ranges then hold alike ones.
            heads = np.zeros(len(sizes), np.int64)
            most = np.lexsort((counts, column))
            full = np.diff(ends) > 0
            heads[full] = terms[most[ends[1:][full] - 1]]
            spot = np.empty(len(sizes), np.int64)
            order = np.lexsort((m, heads))
            spot[order] = np.arange(len(order))
            some = impacts > 0
            grid = Treap(terms[some], spot[column[some]], impacts[some], len(weight), len(sizes))
            keys = np.stack([absent, ids], 1)[order]
            for i, rows in items:
                best[i] = grid.search(rows, k, keys, best[i])
        out = [(i, s, key[1], key[0]) for i, (scores, keys) in best.items() for s, key in zip(scores.tolist(), keys.tolist(), strict=True)]
        cols = [pa.array([x[0] for x in out], pa.int32()), pa.array([None if x[3] else x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["item", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, whether they are null, sizes, and postings by document of up to a block's documents."""
    held: list[tuple[np.ndarray, ...]] = []

    def block() -> tuple[np.ndarray, ...]:
        ids, absent, sizes, per, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return ids, absent, sizes, np.append(0, np.cumsum(per)), terms, counts

    for batch in batches:
        lists = batch.column("terms")
        ids = batch.column("doc_id")
        absent = np.asarray(ids.is_null()).astype(np.int64)
        ids, sizes = np.asarray(ids.fill_null(0)), np.asarray(batch.column("n"))
        per = np.diff(np.asarray(lists.offsets))
        terms, counts = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "counts"))
        held.append((ids, absent, sizes, per, terms, counts))
        if sum(len(x[0]) for x in held) >= BLOCK_DOCS or sum(len(x[4]) for x in held) >= BLOCK_POSTINGS:
            yield block()
    if held:
        yield block()


def _slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The rows of the items, in slices of bounded size that are dealt by hash; one slice is read at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    count = max(1, -(-size // SLICE_BYTES))
    for i in range(count):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i) if count > 1 else rows
        yield own.collect()


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of greatest score above 0.

    Terms are maximal runs of digits, letters and characters beyond ASCII, A-Z in lower
    case.  ``N`` counts documents with a term, ``L`` their terms, ``n`` those of one
    document, ``df`` the documents with a term; a term weighs
    ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and adds that times
    ``(10**9 * tf) div (1000 * tf + 20 * m)`` once, with ``m = 50 + (50 * n * N) div L``.
    Equal scores go by id, null ids last.  Null and empty texts, and texts without a term
    are no documents and ask for nothing; documents that repeat an id are ranked each by
    itself, and so are items.  Other columns are not read; empty tables give no rows.

    Items travel to every task, in slices of bounded size: all documents are searched once a slice.
    """
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for asked in _slices(items, item_col, item_text_col):
        own = [sorted(term_counts(r["text"].encode())) for r in asked]
        rows = {t: i for i, t in enumerate(sorted({t for terms in own for t in terms}))}
        scratch = Scratch(spark, "treap")
        posted = scratch.keep(texts.mapInArrow(_post(rows), "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0"), "postings")
        total, length = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        seen = {r[0]: r[1] for r in posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        # Rows by the number of their documents: neighbours weigh alike, which keeps the maxima of shared nodes close.
        order = np.array(sorted(rows.values(), key=lambda r: (-seen.get(r, 0), r)), np.int64)
        place = np.argsort(order)
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * seen.get(r, 0) + 1))) for r in order.tolist()], np.int64)
        known = [(i, place[[rows[t] for t in terms]]) for i, terms in enumerate(own) if terms]
        known = [(i, r[weight[r] > 0]) for i, r in known if (weight[r] > 0).any()]
        found = posted.mapInArrow(_rank(known, place, weight, total, max(1, length), k), "item int, doc_id long, score long")
        by = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], "item int, item_id long")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


#: The same over ``documents`` and ``benchmark``, for DuckDB.
SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), size AS (SELECT count(*)::BIGINT AS total, sum(len(terms))::BIGINT AS length FROM t WHERE len(terms) > 0),
tf AS (SELECT d, doc_id, len(terms)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, terms, unnest(terms) AS term FROM t) GROUP BY ALL),
asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, * FROM benchmark WHERE text IS NOT NULL)
), weights AS (SELECT term, floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size WHERE term IN (SELECT term FROM asked) GROUP BY term, total),
scores AS (
  SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // length))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), size GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""

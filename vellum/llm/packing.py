"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: each task streams its documents past a fixed number
of open sequences.  Their free spaces are the bits of one integer, so the fullest
sequence that still takes a piece is one shift and one lowest-set-bit.  When a new
sequence would exceed the number allowed open, the fullest closes first.  A piece
has its place as soon as it is read: no text is shuffled, nothing but the open
counts is held, and a task that is run again gives the same sequences.  What the
tasks leave part full is then packed the same way, whole sequences as pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import Scratch, small

#: Open sequences in a task; more than a window of documents can open at once.
OPEN_BINS = 4096
#: Documents are placed longest first within windows of so many, or of so many tokens.
WINDOW_DOCS, WINDOW_TOKENS = 2048, 4_000_000
#: Sequences filled to at most this share are packed again, in groups of about so many.
PART_FULL, TAIL_GROUP = 0.75, 16_384

SCHEMA = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, sequence_id long, offset long"

#: White space as the split pattern of :func:`byte_level_encoder` understands it, in long runs.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")


class OpenBins:
    """Open sequences by free space, at most ``capacity`` of them."""

    def __init__(self, size: int, capacity: int = OPEN_BINS) -> None:
        self.size, self.capacity = size, capacity
        self.free, self.open, self.count, self.made = 0, {}, 0, 0

    def _take(self, space: int) -> int:
        held = self.open[space]
        found = held.pop()
        if not held:
            del self.open[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that a piece of ``length`` goes to, and its offset there."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if length < self.size and self.count >= self.capacity:
                self._take((self.free & -self.free).bit_length() - 1)
            space, found = self.size, self.made
            self.made += 1
        if left := space - length:
            self.open.setdefault(left, []).append(found)
            self.free |= 1 << left
            self.count += 1
        return found, self.size - space


@lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """A tiktoken encoder with the vocabulary, merges and special tokens of a byte-level
    BPE file of the tokenizers library; it gives the same ids several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # The printable stand-ins of the byte-level alphabet, back to bytes.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tuple(tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special) for pattern in (split, r"\s+"))


def encode(path: str, text: str) -> np.ndarray:
    """The ids of one text of any length.

    The split pattern backtracks over a run of white space, which fails on very long
    ones.  There the text is cut: the run up to its last blank is a pre-token of its
    own, or the whole run at the text's end, and what precedes it ends before it.
    """
    usual, blanks = byte_level_encoder(path)
    try:
        return usual.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        parts, at = [], 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts += [usual.encode_to_numpy(text[at : run.start()], allowed_special="all"), blanks.encode_to_numpy(text[run.start() : end])]
            at = end
        return np.concatenate([*parts, usual.encode_to_numpy(text[at:], allowed_special="all")])


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document: full ones, after a shorter first one."""
    first = length % limit or min(length, limit)
    return [(0, first), *((s, limit) for s in range(first, length, limit))]


def _pack(path: str, limit: int, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(limit, capacity)
        base = TaskContext.get().partitionId() << 36

        def flush(window: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
            pieces = [(size, d, k, start) for d, (_, ids) in enumerate(window) for k, (start, size) in enumerate(cut(len(ids), limit))]
            pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
            places = [bins.place(p[0]) for p in pieces]
            parts = [window[d][1][start : start + size] for size, d, _, start in pieces]
            columns = {
                "doc_id": pa.array([window[p[1]][0] for p in pieces], pa.int64()),
                "piece": pa.array([p[2] for p in pieces], pa.int32()),
                "start": pa.array([p[3] for p in pieces], pa.int64()),
                "length": pa.array([p[0] for p in pieces], pa.int64()),
            }
            if with_ids:
                ends = np.append(0, np.cumsum([p[0] for p in pieces])).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            columns["ids_crc32"] = pa.array([zlib.crc32(part.astype("<u4").tobytes()) for part in parts], pa.int64())
            columns["sequence_id"] = pa.array([base + s for s, _ in places], pa.int64())
            columns["offset"] = pa.array([o for _, o in places], pa.int64())
            return pa.RecordBatch.from_pydict(columns)

        window, tokens = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(path, text.as_py() or "").astype(np.int32)
                window.append((doc, np.append(ids, np.int32(end_id))))
                tokens += len(ids) + 1
                if len(window) == WINDOW_DOCS or tokens >= WINDOW_TOKENS:
                    yield flush(window)
                    window, tokens = [], 0
        if window:
            yield flush(window)

    return run


def _merge(limit: int, capacity: int):
    """One group of part full sequences ``(sequence_id, used)``, the fullest first, to ``(old, new, moved)``."""

    def run(table: pa.Table) -> pa.Table:
        ids, used = table.column("sequence_id").to_numpy(), table.column("used").to_numpy()
        order = np.lexsort((ids, -used))
        bins, names, new, moved = OpenBins(limit, capacity), {}, [], []
        for i in order.tolist():
            found, offset = bins.place(int(used[i]))
            new.append(names.setdefault(found, int(ids[i])))
            moved.append(offset)
        return pa.table({"old": pa.array(ids[order]), "new": pa.array(new, pa.int64()), "moved": pa.array(moved, pa.int64())})

    return run


def _join_tails(pieces: DataFrame, limit: int, capacity: int) -> DataFrame:
    """``pieces`` with the sequences that tasks left part full packed into common ones."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") <= PART_FULL * limit)
    groups = max(1, -(-used.count() // TAIL_GROUP))
    merged = used.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("g")).applyInArrow(_merge(limit, capacity), "old long, new long, moved long")
    merged = small(Scratch(pieces.sparkSession, "packing").keep(merged.where("old <> new"), "merged"), 24)
    found = pieces.join(merged, F.col("sequence_id") == F.col("old"), "left")
    placed = {"sequence_id": F.coalesce("new", "sequence_id"), "offset": F.col("offset") + F.coalesce("moved", F.lit(0))}
    return found.withColumns(placed).select(*pieces.columns)


def pack_documents(docs: DataFrame, tokenizer: str, *, limit: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents, each with its place in a sequence, its token ids and
    the CRC-32 of these as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is the path of a byte-level BPE ``.json`` file on every worker.  A
    document is its ids followed by ``end_id``; only longer ones than ``limit`` are
    cut, into full pieces after a possibly shorter first one.  A null or empty text
    is the end id alone.  Repeated rows and ids are packed once a row.  Without ``ids``
    the ids stay in the task and only their digest is returned.  Other columns are not
    read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA if ids else SCHEMA.replace("ids array<int>, ", "")
    pieces = rows.mapInArrow(_pack(tokenizer, limit, end_id, open_bins, ids), schema)
    return _join_tails(Scratch(docs.sparkSession, "packing").keep(pieces, "pieces"), limit, open_bins)

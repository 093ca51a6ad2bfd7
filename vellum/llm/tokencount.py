"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge document is encoded in overlapping chunks with offsets.  Two neighbouring
chunks are spliced where both start a token just after an ASCII blank and agree on
the tokens that follow: tokenizers that split at white space cannot see across
such a place, so the tokens on either side are those of the whole text.  Where the
overlap has no such place it is widened, and at last the chunk itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of the first overlap; texts up to two chunks are encoded whole.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
#: Texts that are encoded in one call hold about so many characters.
CALL_CHARS = 500_000


@lru_cache(maxsize=2)
def counter(path: str):
    """``(count of many texts, (ids, starts) of one)`` for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def one(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = model.encode(text, add_special_tokens=False)
        return np.array(found.ids), np.array([s for s, _ in found.offsets], np.int64)

    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)], one


def splice(text: str, low: int, left: tuple, right: tuple) -> int | None:
    """The first place from ``low`` where the tokens of both chunks can be joined."""
    (a, at), (b, bt) = left, right
    common = np.intersect1d(at[at > low], bt[bt > low])
    stable = [int(p) for p in common if text[p - 1] in " \t\n\r" and text[p] not in " \t\n\r"]
    if len(stable) < 2:
        return None
    first, last = stable[0], stable[-1]
    same = np.array_equal(a[(at >= first) & (at < last)], b[(bt >= first) & (bt < last)])
    return first if same else None


def count_spliced(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, from chunks of ``chunk`` characters that overlap."""
    ids, starts = encode(text[:chunk])
    end, begin, total = min(chunk, len(text)), 0, 0
    while end < len(text):
        wide = overlap
        while True:
            low = max(begin, end - wide)
            high = min(len(text), low + max(chunk, 2 * wide))
            more, places = encode(text[low:high])
            places = places + low
            at = splice(text, low, (ids, starts), (more, places))
            if at is not None:
                break
            if low == begin:  # the chunk as a whole has no stable place: lengthen it
                end = min(len(text), begin + 2 * (end - begin))
                ids, starts = encode(text[begin:end])
                starts = starts + begin
                if end == len(text):
                    return total + len(ids)
            wide *= 2
        total += int((starts < at).sum())
        keep = places >= at
        ids, starts, begin, end = more[keep], places[keep], at, high
    return total + len(ids)


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, one = counter(path)
        for batch in batches:
            texts = batch.column(1)
            out, group, held = [0] * len(texts), [], 0
            for i, scalar in enumerate(texts):
                text = scalar.as_py() or ""
                if one is not None and len(text) > 2 * chunk:
                    out[i] = count_spliced(text, one, chunk, overlap)
                    continue
                group.append((i, text))
                held += len(text)
                if held >= CALL_CHARS:
                    for (j, _), n in zip(group, many([t for _, t in group]), strict=True):
                        out[j] = n
                    group, held = [], 0
            if group:
                for (j, _), n in zip(group, many([t for _, t in group]), strict=True):
                    out[j] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Tokens are those the library of the file gives (tokenizers for .json,
    sentencepiece for .model, whose pieces see the whole text and are not chunked),
    without begin, end or added special tokens, truncation or padding.  A null text
    counts as empty: no bytes, no tokens.  Repeated rows are counted each.  Other
    columns are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_count(tokenizer, chunk_chars, overlap_chars), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

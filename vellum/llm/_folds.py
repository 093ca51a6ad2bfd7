"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int = 5) -> Column:
    """CRC-32 of the id's decimal text, modulo ``folds``; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, key: str, by: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each value of ``by`` at most, chosen by the hash of ``key``.

    The counts a value are taken over all rows; the choice needs no shuffle of the
    rows themselves and is the same in every run.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for value, n in counts.items() for x in (value, min(1.0, bound / n))])
    spot = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000_007)) / 1_000_000_007
    return rows.where(spot < F.try_element_at(share, F.col(by)))

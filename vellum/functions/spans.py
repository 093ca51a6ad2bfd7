"""Spans of pattern matches in code points, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.scan import let, pieces, running, window

SPAN = "array<struct<start:int,end:int,value:string>>"


#: A noncharacter that marks the ends of matches, and one that stands for it where a text has it.
MARK, OTHER = "\ufdd0", "\ufdd1"


def marked(text: Column, pattern: str, group: int = 0) -> Column:
    """``parts, odd``: what is between and in the matches of ``pattern``, in turn, and whether the text has marks of its own.

    A ``group`` must end where the match ends, and what precedes it is the group before it.
    """
    clean = F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)
    found = F.regexp_replace(clean, pattern, f"${group - 1}{MARK}${group}{MARK}" if group else f"{MARK}$0{MARK}")
    return F.struct(F.split(found, MARK, -1).alias("parts"), text.contains(MARK).alias("odd"))


def placed(found: Column, text: Column) -> Column:
    """The matches of a ``marked`` text: running sums of the lengths of its parts are their offsets."""
    parts = found["parts"]

    def of(at: Column) -> Column:
        def one(i: Column) -> Column:
            start, end = F.get(at, i), F.get(at, i + 1)
            own = F.when(found["odd"], F.substring(text, start + 1, end - start)).otherwise(F.get(parts, i))
            return F.struct(start.alias("start"), end.alias("end"), own.alias("value"))

        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)

    starts = running(F.transform(parts, F.length), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(parts) > 2, let(starts, of)).otherwise(F.array().cast(SPAN))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` in order, as ``start, end, value``.

    One pass marks the matches, one split at the marks gives what is in and between them.
    """
    return let(marked(text, pattern, group), lambda found: placed(found, text))


def replace_spans(text: Column, items: Column) -> Column:
    """``text`` with disjoint spans ``start, end, text`` replaced."""
    ordered = F.array_sort(F.transform(items, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["text"].alias("text"))))

    def of(held: Column) -> Column:
        parts, spans = held["parts"], held["spans"]
        before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        out = F.transform(spans, lambda s, i: F.concat(window(parts, before(i), s["start"]), s["text"]))
        rest = window(parts, before(F.size(spans)), held["length"])
        return F.concat(F.array_join(out, ""), rest)

    return let(F.struct(pieces(text).alias("parts"), ordered.alias("spans"), F.length(text).alias("length")), of)

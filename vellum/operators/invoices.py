"""Invoices from page texts by declarative profiles, and their lines' life after that."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.numbers import comma_decimal, decimal_es
from vellum.functions.scan import let
from vellum.functions.text import edged, trimmed
from vellum.sources.profiles import java_pattern
from vellum.sources.scratch import BROADCAST_BYTES, Scratch

HEADER = ("invoice_number", "invoice_date", "customer_code", "customer_name", "taxable_base", "tax_rate", "tax_amount", "invoice_total")
NUMBERS = ("taxable_base", "tax_rate", "tax_amount", "invoice_total")
MISMATCH = "El detalle no coincide con el resumen del servicio."
NOT_EXACT = "La suma extraída no coincide exactamente con la base imponible."


#: A profile as a row: its patterns in the JVM's syntax, with the numbers of their groups.
_CAPTURE = "struct<pattern:string,`group`:int,after:int,required:boolean,following:boolean>"
_PATTERN = "struct<pattern:string,fields:string>"
_AMOUNTS = ("quantity", "unit_price", "amount")
#: The patterns of lines, with the fields that count of each.
_PATTERNS = {
    "user_pattern": ("user",), "summary_pattern": ("service", "quantity", "amount", "project_reference"), "detail_pattern": (*_AMOUNTS, "project_reference"),
    "row_pattern": ("user", "service", *_AMOUNTS, "project_reference"), "project_reference_pattern": ("project_reference",),
}
SPEC = (
    f"struct<name:string,header_page:int,{','.join(f'{f}:{_CAPTURE}' for f in HEADER)},flat:boolean,line_page:int,"
    f"{','.join(f'{p}:{_PATTERN}' for p in _PATTERNS)},service_names:array<string>>"
)
#: Bytes of a row of a table of profiles that may be broadcast.
SPEC_BYTES = 16 << 10


def _capture_spec(capture: dict | None) -> dict | None:
    if capture is None:
        return None
    pattern, names = java_pattern(capture["pattern"])
    group = capture.get("group", "value")
    return {
        "pattern": pattern, "group": int(group) if group.isdigit() else names[group], "after": re.compile(capture["pattern"]).groups + 1,
        "required": capture.get("required", True), "following": bool(capture.get("join_following_line")),
    }


def _line_spec(regex: str, names: tuple[str, ...]) -> dict:
    """A pattern, and what stands for its match: its fields, each in a row of its own."""
    pattern, groups = java_pattern(regex)
    return {"pattern": pattern, "fields": "".join(f"\n${groups[n]}" if n in groups else "\n" for n in names) + "\n"}


def _spec(profile: dict) -> dict:
    lines = profile["lines"]
    made = {p: _line_spec(lines[p], names) if lines.get(p) else None for p, names in _PATTERNS.items()}
    header = {f: _capture_spec(profile["header"].get(f)) for f in HEADER}
    flat = lines["mode"] != "grouped_detail"
    return {"name": profile["name"], "header_page": profile["header"]["page"], "flat": flat, "line_page": lines["page"], "service_names": [s.lower() for s in lines["service_names"]]} | header | made


def profile_table(spark: SparkSession, profiles: list[dict]) -> DataFrame:
    """``profile_id, spec``: profiles as data, so that a plan is as large for a thousand as for one."""
    return spark.createDataFrame([(p["id"], _spec(p)) for p in profiles], f"profile_id string, spec {SPEC}")


def _with_specs(pages: DataFrame, profiles: list[dict]):
    """Adds ``spec`` to rows that have a ``profile_id``: of one profile as constants, of several by a join."""
    if len(profiles) == 1:
        spec = F.from_json(F.lit(json.dumps(_spec(profiles[0]))), SPEC)
        return lambda rows: rows.withColumn("spec", spec)
    table = profile_table(pages.sparkSession, profiles)
    if len(profiles) * SPEC_BYTES <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return lambda rows: rows.join(table, "profile_id")


def _find_profiles(profiles: list[dict]):
    """Front pages to the first profile by name whose terms are all there.

    The terms of all profiles are one automaton, which reads a text once and gives the
    first end of each term; a term counts for a profile if it ends within its pages.
    """
    ordered = sorted(profiles, key=lambda p: p["name"].lower())
    owners: dict[str, list[int]] = {}
    needs = []
    for n, p in enumerate(ordered):
        terms = {t.strip().lower() for t in p["detection"]["all_terms"]}
        needs.append((len(terms), p["detection"]["page_limit"], p["id"]))
        for t in terms:
            owners.setdefault(t, []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in owners:
            if t:
                automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for pages in batch.column("pages").to_pylist():
                ends, at = [], -1  # where each page ends in the text of all, and its number
                for page in pages:
                    at += 1 + len(page["text"])
                    ends.append((page["page_index"], at))
                first = {"": 0}
                for end, term in automaton.iter("\n".join(p["text"] for p in pages)) if len(automaton) else ():
                    first.setdefault(term, end + 1)
                counts: Counter = Counter()
                for term, end in first.items():
                    for n in owners.get(term, ()):
                        counts[n] += end <= max((e for i, e in ends if i < needs[n][1]), default=0)
                found.append(next((needs[n][2] for n in sorted(counts) if counts[n] == needs[n][0]), None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "profile_id"])

    return run


def match_provider(pages: DataFrame, profiles: list[dict]) -> tuple[DataFrame, DataFrame]:
    """``doc_id, profile_id`` of the first profile by name whose terms are all on the first
    pages, and the ``doc_id`` of documents that no profile fits."""
    furthest = max([p["detection"]["page_limit"] for p in profiles], default=1)
    front_page = F.when(F.col("page_index") < furthest, F.struct("page_index", F.lower(F.coalesce("text", F.lit(""))).alias("text")))
    texts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(front_page)).alias("pages"))
    rows = texts.mapInArrow(_find_profiles(profiles), f"doc_id {dict(pages.dtypes)['doc_id']}, profile_id string")
    return rows.where("profile_id is not null"), rows.where("profile_id is null").select("doc_id")


def _extract(text: Column, pattern: Column, group: Column) -> Column:
    return trimmed(F.call_function("regexp_extract", text, pattern, group))


def _captured(text: Column, spec: Column) -> Column:
    pattern = spec["pattern"]
    following = F.when(spec["following"], _extract(text, F.concat(pattern, F.lit(r"[\r\n]*([^\r\n]*)")), spec["after"]))
    both = F.struct(_extract(text, pattern, spec["group"]).alias("value"), following.alias("following"))
    value = let(both, lambda x: F.when(x["following"] != "", F.concat_ws(" ", x["value"], x["following"])).otherwise(x["value"]))
    missing = F.when(spec["required"], F.lit(None).cast("string")).otherwise("")
    return F.when(pattern.isNull(), "").when(F.regexp_instr(F.coalesce(text, F.lit("")), pattern) > 0, value).otherwise(missing)


def capture_field(text: Column, capture: dict | None) -> Column:
    """The captured value, ``''`` if an optional one is not there, null if a required one is not."""
    return _captured(text, F.from_json(F.lit(json.dumps(_capture_spec(capture))), _CAPTURE))


def _headers(pages: DataFrame, add_spec) -> DataFrame:
    """One row a document of ``pages`` that have a ``profile_id``."""
    page = F.col("spec.header_page")
    rows = add_spec(pages.select("doc_id", "profile_id", "page_index", "text")).withColumn("text", F.when(F.col("page_index") == page, F.coalesce("text", F.lit(""))))
    rows = add_spec(rows.groupBy("profile_id", "doc_id").agg(F.max("text").alias("text")))  # sorted by profile first
    out = rows.select("doc_id", F.col("text").isNull().alias("_gone"), F.col("spec.name").alias("provider"), *[_captured(F.col("text"), F.col(f"spec.{f}")).alias(f) for f in HEADER])
    lost = [F.when(F.col(f).isNull(), f) for f in HEADER] + [F.when((F.col(f) != "") & decimal_es(F.col(f)).isNull(), f) for f in NUMBERS]
    missing = F.when(F.col("_gone"), F.array(F.lit("page"))).otherwise(F.array_distinct(F.filter(F.array(*lost), lambda x: x.isNotNull())))
    numbers = {f: F.when(F.col(f) == "", F.lit(0).cast("decimal(18,6)")).otherwise(decimal_es(F.col(f))) for f in NUMBERS}
    return out.withColumn("missing", missing).withColumns(numbers).select("doc_id", *HEADER, "missing", "provider")


def _of(pages: DataFrame, profile: dict) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    return pages.withColumn("profile_id", F.lit(profile["id"])), _with_specs(pages, [profile])


def invoice_header(pages: DataFrame, profile: dict) -> DataFrame:
    """One row a document: the header's fields, numbers parsed, and what is ``missing``."""
    return _headers(*_of(pages, profile))


_LINE = ["doc_id", "row", "user", "service", "quantity", "unit_price", "amount", "confidence", "project_reference", "comment"]


def _said(rows: DataFrame) -> DataFrame:
    """Rows of a ``line`` and ``spec`` with the ``kind`` of the line, the fields it ``said`` and the project reference in it, its ``mark``.

    A pattern is asked once for all its fields: they replace its match, each behind an end of
    line, which no line has within.  Steps are columns of their own, so that none is repeated
    where another needs it and each is short enough to be compiled.
    """
    spec, line, wide = F.col("spec"), F.col("line"), F.col("line") != ""
    asked = lambda p: F.call_function("regexp_replace", line, spec[p]["pattern"], spec[p]["fields"])
    fits = lambda c: F.coalesce(F.col(c).contains("\n"), F.lit(False))
    first = lambda c: trimmed(F.get(F.split(F.col(c), "\n"), 1))
    allowed = (F.size(spec["service_names"]) == 0) | F.array_contains(spec["service_names"], F.lower(first("_summary")))
    rows = rows.withColumns({"_mark": F.when(wide, asked("project_reference_pattern")), "_flat": F.when(wide & spec["flat"], asked("row_pattern")), "_user": F.when(wide & ~spec["flat"], asked("user_pattern"))})
    rows = rows.withColumn("_summary", F.when(wide & ~spec["flat"] & ~fits("_user"), asked("summary_pattern")))
    rows = rows.withColumn("_allowed", F.when(fits("_summary"), allowed).otherwise(False))
    rows = rows.withColumn("_detail", F.when(wide & ~spec["flat"] & ~fits("_user") & ~F.col("_allowed"), asked("detail_pattern")))
    kind = F.when(fits("_flat"), "flat").when(fits("_user"), "user").when(F.col("_allowed"), "summary").when(fits("_detail"), "detail")
    rows = rows.withColumns({"kind": kind, "mark": F.when(fits("_mark"), first("_mark"))})
    text = reduce(lambda a, k: a.when(F.col("kind") == k, F.col(f"_{k}")), ("user", "summary", "detail"), F.when(F.col("kind") == "flat", F.col("_flat")))
    return rows.select("doc_id", "row", "kind", "mark", F.split(text, "\n").alias("said"))


def _fields(rows: DataFrame) -> DataFrame:
    """Rows with the fields that their lines ``said``, numbers parsed; null where a kind has no such field."""

    def part(name: str) -> Column:
        own = [(p, names.index(name) + 1) for p, names in _PATTERNS.items() if name in names and p != "project_reference_pattern"]
        return reduce(lambda out, x: out.when(F.col("kind") == ("flat" if x[0] == "row_pattern" else x[0].removesuffix("_pattern")), F.get("said", x[1])), own, F.when(F.lit(False), F.lit("")))

    rows = rows.withColumns({f"_{n}": part(n) for n in _AMOUNTS} | {f"_{n}_bare": F.replace(part(n), F.lit(" "), F.lit("")) for n in _AMOUNTS})
    numbers = {n: F.coalesce(comma_decimal(F.col(f"_{n}_bare")), F.when(F.col(f"_{n}") != "", decimal_es(F.col(f"_{n}")))) for n in _AMOUNTS}
    return rows.withColumns(numbers | {n: trimmed(part(n)) for n in ("user", "service", "project_reference")}).drop("said", *[f"_{n}{t}" for n in _AMOUNTS for t in ("", "_bare")])


def _lines(pages: DataFrame, add_spec) -> DataFrame:
    """The lines of documents by the form of their profiles, in one pass over the rows of their line pages.

    Flat forms give a line for each row that the row pattern matches.  In grouped forms
    rows are users, summaries of allowed services, or details; other rows do not count,
    and a detail gives a line if the last event before it is a summary and a user is known.
    A row without a project reference takes the last one seen above or in it.

    Numbers are parsed below a window, as a filter on them would else be moved below the parsing
    and repeat it; for the same reason no filter drops other rows before it.
    """
    at_page = add_spec(pages.select("doc_id", "profile_id", "page_index", "text")).where(F.col("page_index") == F.col("spec.line_page"))
    rows = at_page.select("doc_id", "profile_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0B\f\x85]")).alias("row", "line"))
    rows = _fields(_said(add_spec(rows.withColumn("line", F.when(edged(F.col("line")), F.col("line")).otherwise(trimmed(F.col("line")))))))
    by, kind = W.partitionBy("doc_id").orderBy("row"), F.col("kind")
    above = by.rowsBetween(W.unboundedPreceding, -1)
    last = lambda value, frame: F.last(value, ignorenulls=True).over(frame)
    rows = rows.withColumns({
        "seen": F.coalesce(last("mark", by.rowsBetween(W.unboundedPreceding, 0)), F.lit("")), "holder": last(F.when(kind == "user", F.col("user")), above),
        "before": last(F.when(kind.isNotNull(), F.struct("kind", "quantity", "amount")), above),
    })
    flat, named = kind == "flat", F.when(F.col("project_reference") != "", F.col("project_reference"))
    rows = rows.withColumn("named", last(F.when(kind.isNotNull(), F.struct("service", F.coalesce(named, "seen").alias("ref"))), above))
    rows = rows.where("kind = 'flat' or kind = 'detail' and before.kind = 'summary' and holder is not null and holder <> ''")
    rows = rows.withColumns({
        "user": F.when(flat, F.col("user")).otherwise(F.col("holder")), "service": F.when(flat, F.col("service")).otherwise(F.col("named.service")),
        "project_reference": F.coalesce(named, F.when(flat, F.col("seen")).otherwise(F.col("named.ref"))),
    })
    rows = detail_vs_summary(rows, F.col("before.quantity"), F.col("before.amount"))
    return rows.withColumns({"confidence": F.when(flat, 0.95).otherwise(F.col("confidence")), "comment": F.when(flat, "").otherwise(F.col("comment"))}).select(*_LINE)


def lines_flat(pages: DataFrame, profile: dict) -> DataFrame:
    """A line for each row that the row pattern matches."""
    return _lines(*_of(pages, profile | {"lines": profile["lines"] | {"mode": "flat"}}))


def lines_grouped(pages: DataFrame, profile: dict) -> DataFrame:
    """Lines under users: a service's summary, then its detail."""
    return _lines(*_of(pages, profile | {"lines": profile["lines"] | {"mode": "grouped_detail"}}))


def detail_vs_summary(rows: DataFrame, quantity: Column, amount: Column) -> DataFrame:
    """Lines whose detail differs from its summary are less certain and say so."""
    same = F.col("quantity").eqNullSafe(quantity) & F.col("amount").eqNullSafe(amount)
    return rows.withColumns({"confidence": F.when(same, 0.99).otherwise(0.75), "comment": F.when(same, "").otherwise(MISMATCH)})


def line_ids(lines: DataFrame) -> DataFrame:
    """Lines numbered in order, as yet pending."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("row"))
    return lines.withColumn("line_id", F.concat(F.lit("line-"), n.cast("string"))).withColumn("status", F.lit("pending")).drop("row")


def invoice_lines(pages: DataFrame, profile: dict) -> DataFrame:
    return line_ids(_lines(*_of(pages, profile)))


def line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("line_total"), F.count("*").alias("n_lines"))


def _analysed(pages: DataFrame, add_spec) -> tuple[DataFrame, DataFrame]:
    header, lines = _headers(pages, add_spec), line_ids(_lines(pages, add_spec))
    rows = header.join(line_totals(lines), "doc_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    verdict = F.when(F.size("missing") > 0, F.concat(F.lit("missing:"), F.array_join("missing", ","))).when(F.col("n_lines") == 0, "no_lines").otherwise("ok")
    warnings = F.when(F.col("line_total") != F.col("taxable_base"), F.array(F.lit(NOT_EXACT))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"verdict": verdict, "warnings": warnings})
    return rows, lines.join(rows.where("verdict = 'ok'").select("doc_id"), "doc_id", "left_semi")


def invoice_analysis(pages: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """Headers with a verdict and warnings, and lines of the documents that pass."""
    return _analysed(*_of(pages, profile))


def analyse_all(pages: DataFrame, profiles: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices, lines and unsupported documents of a mixed table.

    Profiles are rows that are joined to the pages of their documents, so there is one
    plan for all of them.  Documents are matched here and now and their pages written,
    as headers and lines both read them; they are in runs of one profile, as a pattern that
    differs from that of the row before is compiled anew.
    """
    matched, unsupported = match_provider(pages, profiles)
    dealt = Scratch(pages.sparkSession, "profiles").keep(pages.join(matched, "doc_id").sortWithinPartitions("profile_id"), "pages")
    return *_analysed(dealt, _with_specs(pages, profiles)), unsupported


def profile_preview(pages: DataFrame, profile: dict) -> DataFrame:
    """What one profile makes of sample pages, and whether it would be chosen for them."""
    matched, _ = match_provider(pages, [profile])
    rows, _ = invoice_analysis(pages, profile)
    return rows.join(matched.select("doc_id", F.lit(True).alias("detected")), "doc_id", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))


def reconcile(invoices: DataFrame, lines: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Lines against the taxable base: differences, and whether they are within ``tolerance`` percent."""
    rows = invoices.select("doc_id", "taxable_base").join(line_totals(lines), "doc_id", "left")
    total = F.coalesce("line_total", F.lit(0).cast("decimal(28,6)"))
    rows = rows.select("doc_id", "taxable_base", total.alias("line_total")).withColumn("gap", F.abs(F.col("line_total") - F.col("taxable_base")))
    base = F.abs("taxable_base")
    percent = F.when(base == 0, F.when(F.col("gap") == 0, 0.0).otherwise(100.0)).otherwise((F.col("gap").cast("double") / base.cast("double")) * 100)
    within = F.when(base == 0, F.col("gap") == 0).otherwise(F.col("gap") * 100 <= base * F.lit(tolerance).cast("decimal(9,4)"))
    return rows.select("doc_id", F.bround("line_total", 2).alias("line_total"), F.bround("taxable_base", 2).alias("taxable_base"), F.bround("gap", 2).alias("absolute_difference"), percent.alias("percentage_difference"), within.alias("matches"))


PATCHED = {"user": "string", "service": "string", "quantity": "decimal(18,6)", "unit_price": "decimal(18,6)", "amount": "decimal(18,6)", "project_reference": "string", "status": "string", "comment": "string"}


def update_lines(lines: DataFrame, patches: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Lines with the non-null fields of ``patches(doc_id, line_id, ...)``, and the patches
    of unknown lines or with negative numbers, which change nothing.

    Patches of one line count one after another by their column ``order``: the last that
    names a field sets it.  Equal or absent orders go by the patch as JSON.
    """
    fields = [f for f in PATCHED if f in patches.columns]
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(f) < 0, F.lit(False)) for f in fields if PATCHED[f] != "string"], F.lit(False))
    known = patches.join(lines.select("doc_id", "line_id"), ["doc_id", "line_id"], "left_semi")
    rejects = patches.join(lines.select("doc_id", "line_id"), ["doc_id", "line_id"], "left_anti").withColumn("reject", F.lit("unknown_line"))
    rejects = rejects.unionByName(known.where(negative).withColumn("reject", F.lit("negative_number")))
    place = F.struct(*([order] if order in patches.columns else []), F.to_json(F.struct(*fields)).alias("json"))
    last = [F.max_by(F.col(f).cast(PATCHED[f]), F.when(F.col(f).isNotNull(), place)).alias(f"_{f}") for f in fields]
    new = known.where(~negative).groupBy("doc_id", "line_id").agg(*last)
    rows = lines.join(new, ["doc_id", "line_id"], "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields})
    return rows.drop(*[f"_{f}" for f in fields]), rejects


def accept_all(lines: DataFrame) -> DataFrame:
    return lines.withColumn("status", F.lit("accepted"))


def pending_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "pending").alias("pending"))


def export_gate(lines: DataFrame, confirmed: bool) -> DataFrame:
    """Invoices with pending lines need confirmation; one line at least must be accepted."""
    verdict = F.when((F.col("pending") > 0) & ~F.lit(confirmed), "confirmation_needed").when(F.col("accepted") == 0, "nothing_accepted").otherwise("ok")
    return pending_counts(lines).select("doc_id", verdict.alias("verdict"))


def accepted_total(lines: DataFrame) -> DataFrame:
    return lines.where("status = 'accepted'").groupBy("doc_id").agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("total"))


def export_accepted(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """The accepted lines in nine columns, and each invoice's total row."""
    rows = lines.where("status = 'accepted'").join(invoices.select("doc_id", "invoice_date"), "doc_id")
    rows = rows.withColumn("amount", F.col("amount").cast("decimal(28,6)"))
    body = rows.select("doc_id", "line_id", "invoice_date", "user", "project_reference", "service", "quantity", "unit_price", "amount", "status", "comment", F.lit(0).alias("is_total"))
    totals = rows.groupBy("doc_id").agg(F.sum("amount").cast("decimal(28,6)").alias("amount")).select("doc_id", F.lit("total").alias("line_id"), "amount", F.lit(1).alias("is_total"))
    return body.unionByName(totals, allowMissingColumns=True)


def write_export(exported: DataFrame, path: str, form: str = "csv") -> None:
    """Write exported lines by invoice order, as CSV with a header or as Parquet."""
    rows = exported.sortWithinPartitions("doc_id", "is_total", "line_id")
    (rows.write.mode("overwrite").option("header", True).csv if form == "csv" else rows.write.mode("overwrite").parquet)(path)

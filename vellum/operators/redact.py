"""Review decisions, redaction and verification."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.scan import cut, let
from vellum.functions.spans import replace_spans
from vellum.operators import resolve as rs
from vellum.operators.detect import as_findings, candidates, detect_rules, filter_candidates
from vellum.operators.rules import GAZETTEERS, RULES
from vellum.sources.scratch import Scratch


def validate_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """A verdict a document with decisions: ``unknown_group``, ``nothing_selected`` or ``ok``."""
    known = decisions.join(groups.select("doc_id", "group_id", F.lit(1).alias("known")), ["doc_id", "group_id"], "left")
    counts = known.groupBy("doc_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("action") == "replace").alias("replaced"))
    return counts.withColumn("verdict", F.when(F.col("unknown") > 0, "unknown_group").when(F.col("replaced") == 0, "nothing_selected").otherwise("ok"))


def select_findings(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """The findings of groups to be replaced, with their replacement: the decision's, else the alias."""
    chosen = decisions.where("action = 'replace'").select("doc_id", "group_id", F.col("replacement").alias("own"))
    return findings.join(chosen, ["doc_id", "group_id"]).withColumn("replacement", F.coalesce("own", "alias")).drop("own")


def redact_blocks(blocks: DataFrame, selected: DataFrame) -> DataFrame:
    """Blocks with the selected spans replaced; characters of losing candidates outside them stay."""
    packed = selected.groupBy("doc_id", "location_id").agg(F.collect_list(F.struct("start", "end", F.col("replacement").alias("text"))).alias("_spans"))
    joined = blocks.join(packed, ["doc_id", "location_id"], "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(replace_spans(F.col("text"), F.col("_spans")))).drop("_spans")


def applied_remaining(findings: DataFrame, selected: DataFrame) -> DataFrame:
    done = selected.groupBy("doc_id").agg(F.count("*").alias("applied"))
    return findings.groupBy("doc_id").agg(F.count("*").alias("total")).join(done, "doc_id", "left").select("doc_id", F.coalesce("applied", F.lit(0)).alias("applied"), (F.col("total") - F.coalesce("applied", F.lit(0))).alias("remaining"))


def coverage_gate(issues: DataFrame, remove_unsupported: bool) -> DataFrame:
    """A verdict a document with issues: content that cannot be inspected or removed rejects it,
    content that can be removed does so unless removal is asked for."""
    flags = issues.groupBy("doc_id").agg(F.bool_or(F.col("blocking") & ~F.col("removable")).alias("stuck"), F.bool_or("blocking").alias("blocked"))
    verdict = F.when(F.col("stuck"), "rejected_not_removable").when(F.col("blocked") & ~F.lit(remove_unsupported), "rejected_not_removed").otherwise("pass")
    return flags.select("doc_id", verdict.alias("verdict"))


#: Blocks of a slice of a document that is searched for all of the document's values at once.
SLICE = 256


def _find_needles(_, blocks: pa.Table, needles: pa.Table) -> pa.Table:
    """Which values of a document stand in each block of one of its slices: an automaton of all reads each block once."""
    import ahocorasick

    automaton, found = ahocorasick.Automaton(), []
    for needle in needles["needle"].to_pylist():
        automaton.add_word(needle, needle)
    if len(automaton) and blocks.num_rows:
        automaton.make_automaton()
        for doc, place, text in zip(*(blocks[c].to_pylist() for c in ("doc_id", "location_id", "text")), strict=True):
            found += [(doc, place, needle) for needle in dict.fromkeys(n for _, n in automaton.iter(text))]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (blocks.schema.field("doc_id").type, pa.string(), pa.string()), strict=True)], names=["doc_id", "location_id", "needle"])


def verify_literal(redacted: DataFrame, selected: DataFrame) -> DataFrame:
    """Applied values that, whatever their case, are still in a block of their document.

    A document is searched in slices of ``SLICE`` blocks, each with its own copy of the
    document's values, so a document of many blocks is the work of many tasks.
    """
    needles = selected.select("doc_id", F.lower("value").alias("needle")).where("needle <> ''").distinct()
    blocks = redacted.select("doc_id", F.floor(F.col("block_index") / SLICE).cast("long").alias("slice"), "location_id", F.lower("text").alias("text")).where("text is not null")
    dealt = blocks.select("doc_id", "slice").distinct().join(needles, "doc_id").toDF("doc_id", "slice", "needle")  # columns of its own
    schema = f"doc_id {dict(redacted.dtypes)['doc_id']}, location_id string, needle string"
    return blocks.groupBy("doc_id", "slice").cogroup(dealt.groupBy("doc_id", "slice")).applyInArrow(_find_needles, schema).distinct()


#: Stands for an amount in what is searched: equal amounts may share no digit ("dos mil euros").
_AMOUNT = "€"
#: Values of a document that each of its blocks is searched for; of a document with more, all blocks are read.
VALUES = 256


def may_hold(redacted: DataFrame, selected: DataFrame) -> DataFrame:
    """The blocks in which a rule or gazetteer can find a value that equals an applied one of their document.

    Equal values have equal canonical forms, and the letters and digits of that form stand
    together among those of any text that has the value.  Values without any (of other
    alphabets) ask for all blocks of their document, as do more than ``VALUES`` values;
    amounts for blocks that name a currency.
    """
    needle = F.when(F.col("entity_type") == "MONEY", _AMOUNT).otherwise(tx.bare(tx.canonical_value(F.col("entity_type"), F.col("value"))))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("needle"))
    needles = selected.select("doc_id", needle.alias("needle")).distinct().withColumn("nth", first).where(F.col("nth") <= VALUES + 1)
    needles = needles.groupBy("doc_id").agg(F.collect_list("needle").alias("needles"))
    amount = F.when(F.col("text").rlike(RULES["money"].guard), _AMOUNT).otherwise("")
    holds = let(F.concat(tx.bare(F.col("text")), amount), lambda text: F.exists("needles", lambda n: text.contains(n)))
    return redacted.join(needles, "doc_id").where((F.size("needles") > VALUES) | holds).select(*redacted.columns)


def verify_detectors(redacted: DataFrame, selected: DataFrame) -> DataFrame:
    """Findings of a second detection that equal an applied one in type and canonical value.

    Candidates are not resolved here, so each rule and each block stands alone: only rules
    of applied types run, and only over blocks that ``may_hold`` an applied value, which
    after a good redaction are few.  The types are read at once.
    """
    kinds = {r[0] for r in selected.select("entity_type").distinct().collect()}
    rules = [name for name, rule in RULES.items() if rule.kind in kinds]
    again = rs.with_groups(as_findings(detect_rules(may_hold(redacted, selected), rules or ["email"], gazetteers=bool(kinds & {*GAZETTEERS}))))
    return again.join(selected.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_semi")


def analyse(blocks: DataFrame, categories: tuple[str, ...] = (), allowlist: tuple[str, ...] = (), gazetteers: bool = True) -> tuple[DataFrame, DataFrame]:
    """Findings with alias and band, and groups: filtered before they are resolved.

    The findings are written once: groups, aliases and redaction all read them, and
    none detects again.
    """
    found = as_findings(rs.resolve_overlaps(filter_candidates(detect_rules(blocks, gazetteers=gazetteers), categories, allowlist)))
    found = Scratch(blocks.sparkSession, "findings").keep(rs.with_groups(found), "found")
    groups = rs.assign_aliases(rs.group_findings(found))
    return rs.enrich_findings(found, groups), groups


def anonymise(blocks: DataFrame, categories: tuple[str, ...] = (), allowlist: tuple[str, ...] = ()) -> DataFrame:
    """Blocks with every finding replaced by its alias."""
    findings, _ = analyse(blocks, categories, allowlist)
    return redact_blocks(blocks, findings.withColumn("replacement", F.col("alias")))


def redact_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole documents, one a row, with their text redacted, aliases numbered within the row.

    Without a shuffle, so it serves streams: number ``n`` of a prefix is the count of
    different groups of that prefix that appear up to there.  Findings are sorted by
    group, and groups by prefix and first appearance; their places are their numbers.
    A null text stays null.
    """
    text = F.col(text_col)
    keyed = lambda c: F.struct(tx.prefix_of(c["entity_type"]).alias("prefix"), F.concat_ws(":", c["entity_type"], tx.canonical_value(c["entity_type"], c["value"])).alias("key"), c["start"].alias("start"), c["end"].alias("end"))
    changes = lambda *names: lambda v, i: reduce(lambda a, b: a | b, [F.get(v, i)[n] != F.get(v, i - 1)[n] for n in names])
    group = lambda g: F.struct(F.get(g, 0)["prefix"].alias("prefix"), F.get(g, 0)["start"].alias("first"), g.alias("items"))

    def numbered(g: Column, n: Column) -> Column:
        return F.transform(g["items"], lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), F.format_string("[%s_%02d]", g["prefix"], n + 1).alias("text")))

    out = docs.withColumn("_found", candidates(text, F.lit("")))
    out = out.withColumn("_found", rs.resolve(F.col("_found")))
    out = out.withColumn("_found", F.array_sort(F.transform("_found", keyed)))
    out = out.withColumn("_found", F.array_sort(F.transform(cut(F.col("_found"), changes("prefix", "key")), group)))
    out = out.withColumn("_found", F.flatten(F.transform(cut(F.col("_found"), changes("prefix")), lambda own: F.flatten(F.transform(own, numbered)))))
    return out.withColumn(text_col, replace_spans(text, F.col("_found"))).drop("_found")

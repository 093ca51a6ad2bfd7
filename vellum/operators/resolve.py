"""Overlaps, groups and aliases of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.scan import let
from vellum.operators.detect import NONE, bunches


def resolve(found: Column) -> Column:
    """The accepted candidates of one block, by position.

    Authority is priority, confidence, length, then position and order of emission.  A
    candidate that overlaps an accepted one only adds its evidence to the first it overlaps.
    Each bunch of overlapping candidates is resolved by itself, so time grows with the
    candidates of a block, and with the square only of those in a chain of overlaps.
    """
    alone = lambda bunch: F.when(F.size(bunch) == 1, bunch).otherwise(_resolve_bunch(bunch))
    return let(found, lambda found: F.when(F.size(found) < 2, found).otherwise(F.flatten(F.transform(bunches(found), alone))))


def _resolve_bunch(found: Column) -> Column:
    ranked = F.array_sort(
        F.transform(found, lambda c: F.struct((-c["priority"]).alias("p"), (-c["confidence"]).alias("q"), (c["start"] - c["end"]).alias("l"), c["start"].alias("s"), c["ord"].alias("o"), c.alias("c")))
    )

    def step(acc: Column, x: Column) -> Column:
        c = x["c"]
        hits = F.transform(acc, lambda a: (c["start"] < a["end"]) & (c["end"] > a["start"]))
        at = F.array_position(hits, True)

        def merge(a: Column, i: Column) -> Column:
            reason = F.when((c["reason"] == a["reason"]) | (c["reason"] == ""), a["reason"]).when(a["reason"] == "", c["reason"]).otherwise(F.concat_ws(" ", a["reason"], c["reason"]))
            more = a.withField("sources", F.array_union(a["sources"], c["sources"])).withField("reason", reason)
            more = more.withField("confidence", F.greatest(a["confidence"], c["confidence"])).withField("priority", F.greatest(a["priority"], c["priority"]))
            return F.when(i == at - 1, more).otherwise(a)

        return F.when(at == 0, F.concat(acc, F.array(c))).otherwise(F.transform(acc, merge))

    accepted = F.aggregate(ranked, F.array().cast(NONE), step)
    return F.transform(F.array_sort(F.transform(accepted, lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), c.alias("c")))), lambda x: x["c"])


def resolve_overlaps(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their ``candidates`` resolved; narrow, as only spans of one block overlap."""
    return blocks.withColumn("candidates", resolve(F.col("candidates")))


def resolve_findings(findings: DataFrame) -> DataFrame:
    """The same for findings in rows, as when manual ones join those found before."""
    fields = ["entity_type", "start", "end", "value", "confidence", "priority", "ord", "sources", "reason"]
    keys = ["doc_id", "location_id", "part", "block_index"]
    packed = findings.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).cast(NONE).alias("candidates"))
    ids = findings.select("doc_id", "location_id", "start", "end", "entity_type", "id", "context").dropDuplicates(["doc_id", "location_id", "start", "end", "entity_type"])
    kept = packed.select(*keys, F.explode(resolve(F.col("candidates"))).alias("c")).select(*keys, "c.*")
    return kept.join(ids, ["doc_id", "location_id", "start", "end", "entity_type"])


def with_groups(findings: DataFrame) -> DataFrame:
    canonical = tx.canonical_value(F.col("entity_type"), F.col("value"))
    return findings.withColumn("canonical", canonical).withColumn("group_id", tx.group_id(F.col("entity_type"), F.col("canonical")))


def group_findings(findings: DataFrame) -> DataFrame:
    """One row a document and group: its values' first form, evidence and place of first appearance.

    Findings are first summed up by document, group and evidence, of which there are few
    kinds, so what a value with millions of findings gives to a shuffle is a row or two a
    task.  Their ids are a table of their own, ``group_members``.
    """
    if "group_id" not in findings.columns:
        findings = with_groups(findings)
    place = F.struct("part", "block_index", "start", "end")
    kinds = findings.groupBy("doc_id", "group_id", "sources", "reason").agg(
        F.first("entity_type").alias("entity_type"), F.min_by("value", place).alias("value"), F.max("confidence").alias("confidence"), F.min(place).alias("first"), F.count("*").alias("n"),
    )
    out = kinds.groupBy("doc_id", "group_id").agg(
        F.first("entity_type").alias("entity_type"),
        F.min_by("value", "first").alias("value"),
        F.max("confidence").alias("confidence"),
        F.min("first").alias("first"),
        F.sum("n").alias("occurrences"),
        F.array_sort(F.collect_list(F.struct("first", "sources", "reason"))).alias("evidence"),
    )
    return out.select(
        "doc_id", "group_id", "entity_type", "value", "confidence", tx.confidence_band(F.col("confidence")).alias("band"), "first", "occurrences",
        F.array_distinct(F.flatten(F.transform("evidence", lambda i: i["sources"]))).alias("sources"),
        F.array_join(F.array_distinct(F.filter(F.transform("evidence", lambda i: i["reason"]), lambda r: r != "")), " ").alias("reason"),
    )


def group_members(findings: DataFrame) -> DataFrame:
    """``doc_id, group_id, id``: which findings make up each group, a row a finding."""
    findings = findings if "group_id" in findings.columns else with_groups(findings)
    return findings.select("doc_id", "group_id", "id")


def assign_aliases(groups: DataFrame, order: str = "appearance") -> DataFrame:
    """Number the groups of a document and alias prefix by first appearance.

    ``order='lexicographic'`` compares block positions as text, so block 10 precedes block 2.
    """
    first = F.col("first")
    place = [first["part"], first["block_index"].cast("string") if order == "lexicographic" else first["block_index"], first["start"], first["end"]]
    by = W.partitionBy("doc_id", tx.prefix_of(F.col("entity_type"))).orderBy(*place)
    return groups.withColumn("alias", tx.alias_token(F.col("entity_type"), F.row_number().over(by)))


def enrich_findings(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Findings with their group's alias, and their own band."""
    findings = findings if "group_id" in findings.columns else with_groups(findings)
    return findings.join(groups.select("doc_id", "group_id", "alias"), ["doc_id", "group_id"]).withColumn("band", tx.confidence_band(F.col("confidence")))


def entity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "entity_type").agg(F.count("*").alias("findings"))


def summary_map(findings: DataFrame) -> DataFrame:
    """One row a document, its counts as a map."""
    return entity_summary(findings).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "findings"))).alias("summary"))


def review_filter(groups: DataFrame, entity_type: str | None = None, band: str | None = None, query: str = "") -> DataFrame:
    """The groups a reviewer looks for: by type, band and part of type and value."""
    if entity_type:
        groups = groups.where(F.col("entity_type") == entity_type)
    if band:
        groups = groups.where(F.col("band") == band)
    return groups.where(F.lower(F.concat_ws(" ", "entity_type", "value")).contains(query.lower().strip()))


def selected_occurrences(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Occurrences of the groups to be replaced, a row a document."""
    chosen = decisions.where("action = 'replace'").select("doc_id", "group_id", F.lit(True).alias("chosen")).distinct()
    return groups.join(chosen, ["doc_id", "group_id"], "left").groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("chosen"), F.col("occurrences"))), F.lit(0)).alias("selected"))

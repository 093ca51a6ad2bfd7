"""Mail-merge over tables: find, check, repair and fill ``{{ variable }}`` markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.spans import replace_spans, spans

MARKER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
_WHERE = ["template_id", "location"]


def template_variables(runs: DataFrame, order: str = "sorted") -> DataFrame:
    """Distinct variables of each template: ``sorted``, or by first ``seen``.

    The runs of a paragraph are read as one text, so markers cut between runs count.
    """
    texts = paragraphs(runs)
    names = texts.select("template_id", "location", F.posexplode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))).alias("at", "variable"))
    first = names.groupBy("template_id", "variable").agg(F.min(F.struct("location", "at")).alias("first"))
    key = F.struct(F.col("variable").alias("k"), F.col("variable").alias("variable")) if order == "sorted" else F.struct(F.col("first").alias("k"), F.col("variable").alias("variable"))
    return first.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["variable"]).alias("variables"))


def paragraphs(runs: DataFrame) -> DataFrame:
    """``template_id, location, text``: the runs of each paragraph joined."""
    parts = F.array_sort(F.collect_list(F.struct("run_index", F.coalesce("text", F.lit("")).alias("text"))))
    return runs.groupBy(*_WHERE).agg(F.array_join(F.transform(parts, lambda r: r["text"]), "").alias("text"))


def run_spans(runs: DataFrame) -> DataFrame:
    """Runs with their ``start`` and ``end`` in the paragraph."""
    size = F.length(F.coalesce("text", F.lit("")))
    end = F.sum(size).over(W.partitionBy(*_WHERE).orderBy("run_index").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return runs.withColumn("end", end).withColumn("start", F.col("end") - size)


def find_run(runs: DataFrame, positions: DataFrame) -> DataFrame:
    """The run that owns each position of ``positions(template_id, location, pos)``."""
    owned = run_spans(runs).select(*_WHERE, "run_index", "start", "end")
    return positions.join(owned, _WHERE).where("pos >= start and pos < end").select(*_WHERE, "pos", "run_index")


def markers(runs: DataFrame) -> DataFrame:
    """Markers of each paragraph with the runs of their first and last character."""
    found = paragraphs(runs).withColumn("m", F.explode(spans(F.col("text"), MARKER)))
    found = found.select(*_WHERE, "text", F.col("m.start").alias("ms"), F.col("m.end").alias("me"), F.regexp_extract("m.value", MARKER, 1).alias("variable"))
    owned = run_spans(runs).select(*_WHERE, "run_index", "start", "end")
    first = owned.select(*_WHERE, F.col("run_index").alias("first_run"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    last = owned.select(*_WHERE, F.col("run_index").alias("last_run"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    found = found.join(first, _WHERE).where("ms >= s1 and ms < e1").join(last, _WHERE).where("me - 1 >= s2 and me - 1 < e2")
    return found.select(*_WHERE, "text", "ms", "me", "variable", "first_run", "last_run")


def split_placeholders(runs: DataFrame) -> DataFrame:
    """Markers whose characters lie in more than one run, with those runs' texts."""
    cut = markers(runs).where("first_run <> last_run")
    parts = cut.join(runs.select(*_WHERE, "run_index", F.col("text").alias("part")), _WHERE).where("run_index between first_run and last_run")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("run_index", "part"))), lambda r: r["part"])
    return parts.groupBy(*_WHERE, "variable", "ms").agg(tx.preview(F.first("text")).alias("preview"), texts.alias("run_texts")).withColumnRenamed("ms", "start")


def repair_split_placeholders(runs: DataFrame) -> DataFrame:
    """Runs with the text of every cut marker in its first run, and ``merges`` of its paragraph.

    Markers that share a run are joined into one interval of runs; the count is of markers.
    """
    cut = markers(runs).where("first_run <> last_run").select(*_WHERE, "first_run", "last_run")
    by = W.partitionBy(*_WHERE).orderBy("first_run", "last_run")
    reach = F.max("last_run").over(by.rowsBetween(W.unboundedPreceding, -1))
    cut = cut.withColumn("fresh", F.when(F.col("first_run") <= reach, 0).otherwise(1))
    cut = cut.withColumn("island", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)))
    islands = cut.groupBy(*_WHERE, "island").agg(F.min("first_run").alias("a"), F.max("last_run").alias("b"), F.count("*").alias("n"))
    packed = islands.groupBy(*_WHERE).agg(F.collect_list(F.struct("a", "b")).alias("_islands"), F.sum("n").alias("merges"))
    rows = runs.join(packed, _WHERE, "left").withColumn("_own", F.get(F.filter("_islands", lambda i: F.col("run_index").between(i["a"], i["b"])), F.lit(0)))
    rows = rows.withColumn("_key", F.coalesce(F.col("_own.a"), F.col("run_index")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_index", F.coalesce("text", F.lit("")).alias("t"))).over(W.partitionBy(*_WHERE, "_key"))), lambda r: r["t"]), "")
    text = F.when(F.col("_own").isNull(), F.col("text")).when(F.col("run_index") == F.col("_own.a"), joined).otherwise("")
    return rows.withColumn("fixed", text).select(*_WHERE, "run_index", F.col("fixed").alias("text"), F.coalesce("merges", F.lit(0)).alias("merges"))


def template_readiness(runs: DataFrame) -> DataFrame:
    """Ready templates have a variable and no cut marker."""
    every = runs.select("template_id").distinct()
    issues = split_placeholders(runs).groupBy("template_id").agg(F.count("*").alias("issues"))
    rows = every.join(issues, "template_id", "left").join(template_variables(runs), "template_id", "left")
    rows = rows.withColumns({"issues": F.coalesce("issues", F.lit(0)), "n_variables": F.coalesce(F.size("variables"), F.lit(0))})
    return rows.select("template_id", "issues", "n_variables", ((F.col("issues") == 0) & (F.col("n_variables") > 0)).alias("ready"))


def generation_gate(readiness: DataFrame) -> DataFrame:
    verdict = F.when(F.col("issues") > 0, "rejected_split_markers").when(F.col("n_variables") == 0, "rejected_no_variables").otherwise("ok")
    return readiness.select("template_id", verdict.alias("verdict"))


def render_templates(templates: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every paragraph of ``templates(template_id, location, text)`` filled from every row of
    ``contexts(context_id, ctx)``: a map, or keyed by ``template_id`` if contexts have it.

    Variables that the context lacks become empty.  Values are not read again, so one
    that holds a marker stays as it is.
    """
    keyed = "template_id" in contexts.columns
    pairs = templates.join(contexts, "template_id") if keyed else templates.join(contexts, how="cross")
    names = spans(F.col("text"), MARKER)
    items = F.transform(names, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(F.try_element_at(F.col("ctx"), F.regexp_extract(m["value"], MARKER, 1)), F.lit("")).alias("text")))
    return pairs.select("template_id", "location", "context_id", replace_spans(F.col("text"), items).alias("text"))


def unrendered_markers(rendered: DataFrame) -> DataFrame:
    """Markers left in each output."""
    return rendered.groupBy("template_id", "context_id").agg(F.sum(F.regexp_count("text", F.lit(MARKER))).alias("left"))

"""From blocks of text to candidate findings, in one narrow projection.

Candidates of a block are an array column until they are resolved, so detection and
resolution need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.checks import valid_passport
from vellum.functions.scan import cut, let, pieces, running, window
from vellum.functions.spans import SPAN, marked, placed, spans
from vellum.operators.rules import GAZETTEER_REASON, GAZETTEER_SOURCE, GAZETTEERS, LEGACY, MANUAL_SOURCE, PASSPORT_VALUE, RULE_SOURCE, RULES

CANDIDATE = "struct<entity_type:string,start:int,end:int,value:string,confidence:double,priority:int,ord:int,sources:array<string>,reason:string>"
NONE = f"array<{CANDIDATE}>"


def _candidates(found: Column, kind: str, confidence: float, priority: int, ord_: int, source: str, reason: str) -> Column:
    def one(s: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"), F.lit(ord_).alias("ord"),
            F.array(F.lit(source)).alias("sources"), F.lit(reason).alias("reason"),
        ).cast(CANDIDATE)

    return F.transform(found, one)


def _guarded(text: Column, guard: str, found: Column, empty: str = SPAN) -> Column:
    """Costly patterns run only where a cheap one matches."""
    return F.when(text.rlike(guard), found).otherwise(F.array().cast(empty))


def _valid(found: Column, validator: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda s: F.coalesce(validator(s["value"]), F.lit(False)))


def rule_spans(text: Column, name: str) -> Column:
    """The valid matches of one rule."""
    rule = RULES[name]
    found = spans(text, rule.pattern, rule.group)
    if rule.validator is not None:
        found = _valid(found, rule.validator)
    return _guarded(text, rule.guard, found)


def rule_candidates(text: Column, name: str) -> Column:
    return _rule_candidates(text, None, [name])


#: What candidates of each rule in order, and of passports by label, have in common.
_COMMON = [(r.kind, r.confidence, r.priority, r.reason) for r in RULES.values()] + [("PASSPORT", 0.92, 92, "Numero de pasaporte en una celda etiquetada como pasaporte.")]


def _rule_candidates(text: Column, label: Column | None, names: list[str]) -> Column:
    """Candidates of several rules: each rule only marks the text, and one expression makes candidates of all marks."""
    orders = [list(RULES).index(n) for n in names]
    entries = [F.struct(F.lit(o).alias("ord"), F.when(text.rlike(RULES[n].guard), marked(text, RULES[n].pattern, RULES[n].group)).alias("held")) for o, n in zip(orders, names, strict=True)]
    if label is not None:
        orders.append(len(RULES))
        entries.append(F.struct(F.lit(len(RULES)).alias("ord"), F.when(_asks_for_passport(label), marked(text, PASSPORT_VALUE)).alias("held")))
    common = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"), F.lit(p).alias("priority"), F.lit(why).alias("reason")) for k, c, p, why in _COMMON])

    def valid(ord_: Column, value: Column) -> Column:
        out = F.lit(True)
        for o in orders:
            check = RULES[list(RULES)[o]].validator if o < len(RULES) else valid_passport
            if check is not None:
                out = F.when(ord_ == o, F.coalesce(check(value), F.lit(False))).otherwise(out)
        return out

    def of(entry: Column) -> Column:
        about = F.get(common, entry["ord"])

        def one(s: Column) -> Column:
            return F.struct(
                about["kind"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                about["confidence"].alias("confidence"), about["priority"].alias("priority"), entry["ord"].alias("ord"),
                F.array(F.lit(RULE_SOURCE)).alias("sources"), about["reason"].alias("reason"),
            ).cast(CANDIDATE)

        return F.transform(F.filter(placed(entry["held"], text), lambda s: valid(entry["ord"], s["value"])), one)

    return F.flatten(F.transform(F.filter(F.array(*entries), lambda e: F.size(e["held"]["parts"]) > 2), of))


def _asks_for_passport(label: Column) -> Column:
    return tx.accentless(F.coalesce(label, F.lit(""))).contains("pasaporte")


def labelled_passports(text: Column, label: Column) -> Column:
    """Bare numbers in a block whose label names a passport, unless the rule found some."""
    bare = _valid(spans(text, PASSPORT_VALUE), valid_passport)
    asked = _asks_for_passport(label) & (F.size(rule_spans(text, "passport")) == 0)
    found = F.when(asked, bare).otherwise(F.array().cast(SPAN))
    return _candidates(found, "PASSPORT", 0.92, 92, len(RULES), RULE_SOURCE, "Numero de pasaporte en una celda etiquetada como pasaporte.")


def _any_of(names: Iterable[str]) -> str:
    return r"(?U)(?<!\w)(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")(?!\w)"


def gazetteer_candidates(text: Column) -> Column:
    """Places of the local gazetteers as whole words, whatever their case and marks."""
    every = _any_of(n for names, _ in GAZETTEERS.values() for n in names)
    common = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")) for kind, (_, confidence) in GAZETTEERS.items()])

    def places(held: Column) -> Column:
        folded, parts = held["folded"], held["parts"]
        entries = [F.struct(F.lit(i).alias("at"), marked(folded, _any_of(names)).alias("held")) for i, (names, _) in enumerate(GAZETTEERS.values())]

        def of(entry: Column) -> Column:
            about = F.get(common, entry["at"])
            return F.transform(
                placed(entry["held"], folded),
                lambda s: F.struct(
                    about["kind"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), window(parts, s["start"], s["end"]).alias("value"),
                    about["confidence"].alias("confidence"), F.lit(65).alias("priority"), (entry["at"] + len(RULES) + 1).alias("ord"),
                    F.array(F.lit(GAZETTEER_SOURCE)).alias("sources"), F.lit(GAZETTEER_REASON).alias("reason"),
                ).cast(CANDIDATE),
            )

        return F.flatten(F.transform(F.array(*entries), of))

    def some(folded: Column) -> Column:
        held = F.struct(folded.alias("folded"), pieces(text).alias("parts"))
        return F.when(folded.rlike(every), let(held, places)).otherwise(F.array().cast(NONE))

    return let(tx.accentless(text), some)


def candidates(text: Column, label: Column, rules: Iterable[str] = tuple(RULES), gazetteers: bool = True) -> Column:
    """Every rule's, labelled passports' and gazetteers' candidates of a block."""
    names = list(rules)
    found = _rule_candidates(text, label if "passport" in names else None, names)
    if "passport" in names:  # bare numbers count only where the rule has found none
        ruled = list(RULES).index("passport")
        found = let(found, lambda all_: F.when(F.exists(all_, lambda c: c["ord"] == ruled), F.filter(all_, lambda c: c["ord"] != len(RULES))).otherwise(all_))
    return F.coalesce(F.concat(found, gazetteer_candidates(text)) if gazetteers else found, F.array().cast(NONE))


@lru_cache(maxsize=16)
def _candidates_of(application: str, rules: tuple[str, ...], gazetteers: bool) -> Column:
    """The expression over ``text`` and ``label``: some thousand nodes, so it is built once an application."""
    return candidates(F.col("text"), F.col("label"), rules, gazetteers)


def detect_rules(blocks: DataFrame, rules: Iterable[str] = tuple(RULES), gazetteers: bool = True) -> DataFrame:
    """``blocks`` with the array column ``candidates``."""
    return blocks.withColumn("candidates", _candidates_of(blocks.sparkSession.sparkContext.applicationId, tuple(rules), gazetteers))


def filter_candidates(blocks: DataFrame, categories: Iterable[str] = (), allowlist: Iterable[str] = ()) -> DataFrame:
    """Keep the candidates of ``categories`` (all, if empty) whose value is not allowed."""
    kinds, allowed = list(categories), [a.lower().strip() for a in allowlist if a.strip()]

    def keep(c: Column) -> Column:
        fits = c["entity_type"].isin(*kinds) if kinds else F.lit(True)
        return fits & ~F.trim(F.lower(c["value"])).isin(*allowed) if allowed else fits

    return blocks.withColumn("candidates", F.filter("candidates", keep))


def filter_allowlist(findings: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Findings whose folded value is not in ``allowlist(value)``."""
    allowed = allowlist.select(F.trim(F.lower("value")).alias("_allowed")).where("_allowed <> ''").distinct()
    return findings.join(allowed, F.trim(F.lower("value")) == F.col("_allowed"), "left_anti")


def bunches(found: Column) -> Column:
    """Candidates by position, in bunches that do not overlap: those of a bunch are joined by overlaps."""
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("s"), c["end"].alias("e"), c.alias("c"))))

    def of(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda x: x["e"]), F.lit(0), lambda a, b: F.greatest(a, b))
        return let(ends, lambda ends: cut(ordered, lambda v, i: F.get(v, i)["s"] >= F.get(ends, i)))

    return F.transform(let(ordered, of), lambda bunch: F.transform(bunch, lambda x: x["c"]))


def as_findings(blocks: DataFrame, column: str = "candidates") -> DataFrame:
    """One row a finding, with its id and context.

    The outer form of explode keeps the optimiser from asking for the size of the
    candidates in a filter of its own, which would detect them twice.
    """
    found = F.explode_outer(tx.with_snippets(F.col("text"), F.col(column)))
    out = blocks.select("doc_id", "location_id", "part", "block_index", found.alias("f")).where("f is not null").select("doc_id", "location_id", "part", "block_index", "f.c.*", "f.context")
    fid = tx.finding_id(F.col("location_id"), F.col("entity_type"), F.col("start"), F.col("end"), F.col("value"), F.element_at("sources", 1))
    return out.withColumn("id", fid)


def detect_legacy5(blocks: DataFrame) -> DataFrame:
    """The five older rules: on overlap the earlier rule stays; contexts of 44 characters."""
    parts = []
    for i, (kind, (pattern, validator, confidence)) in enumerate(LEGACY.items()):
        found = spans(F.col("text"), pattern)
        if validator is not None:
            found = _valid(found, validator)
        parts.append(_candidates(found, kind, confidence, -i, i, RULE_SOURCE, ""))
    rows = blocks.withColumn("all", F.coalesce(F.concat(*parts), F.array().cast(NONE)))
    free = lambda acc, c: ~F.exists(acc, lambda a: (c["start"] < a["end"]) & (c["end"] > a["start"]))

    def earlier(bunch: Column) -> Column:
        by_rule = F.transform(F.array_sort(F.transform(bunch, lambda c: F.struct(c["ord"].alias("o"), c["start"].alias("s"), c.alias("c")))), lambda x: x["c"])
        return F.aggregate(by_rule, F.array().cast(NONE), lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(c))).otherwise(acc))

    kept = tx.with_snippets(F.col("text"), F.flatten(F.transform(bunches(F.col("all")), earlier)), 44)
    rows = rows.select("doc_id", "location_id", F.explode_outer(kept).alias("f")).where("f is not null").select("doc_id", "location_id", "f.c.*", "f.context")
    legacy_id = F.substring(F.sha2(F.concat_ws(":", "location_id", "entity_type", "start", "end", "value").cast("binary"), 256), 1, 20)
    return rows.select("doc_id", "location_id", legacy_id.alias("id"), "entity_type", "start", "end", "value", "confidence", "context")


def external_hits(blocks: DataFrame, hits: DataFrame, source: str = "external", least: float = 0.45) -> DataFrame:
    """Hits of an outside model, ``hits(doc_id, location_id, offset, start, end, entity_type, score)``,
    as candidates: moved by their chunk's offset, and ``entity`` is false for those that are labels or named projects."""
    joined = hits.select("doc_id", "location_id", (F.col("offset") + F.col("start")).cast("int").alias("start"), (F.col("offset") + F.col("end")).cast("int").alias("end"), "entity_type", F.col("score").alias("confidence")).join(blocks, ["doc_id", "location_id"])
    value = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = joined.withColumn("value", value).where((F.col("confidence") >= least) & F.col("entity_type").isin("PERSON", "ORGANIZATION", "LOCATION"))
    entity = ~tx.is_structural_label(F.col("value")) & ~tx.non_entity_context(F.col("text"), F.col("start"), F.col("end"))
    fid = tx.finding_id(F.col("location_id"), F.col("entity_type"), F.col("start"), F.col("end"), F.col("value"), F.lit(source))
    return rows.select(
        "doc_id", "location_id", "part", "block_index", "entity_type", "start", "end", "value", "confidence", F.lit(50).alias("priority"),
        F.lit(len(RULES) + 10).alias("ord"), F.array(F.lit(source)).alias("sources"), F.lit("Entidad identificada por un modelo externo.").alias("reason"),
        fid.alias("id"), tx.context_snippet(F.col("text"), F.col("start"), F.col("end")).alias("context"), entity.alias("entity"),
    )


def external_findings(blocks: DataFrame, hits: DataFrame, source: str = "external", least: float = 0.45) -> DataFrame:
    """The hits of an outside model as candidates, without labels and named projects."""
    return external_hits(blocks, hits, source, least).where("entity").drop("entity")


def manual_findings(blocks: DataFrame, manual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of ``manual(doc_id, location_id, start, end, entity_type, all_occurrences)``,
    and the requests that do not fit their block.  A request for all occurrences finds
    its value, whatever the case, in every block of the document."""
    asked = manual.alias("m").join(blocks.select("doc_id", "location_id", F.col("text").alias("own")), ["doc_id", "location_id"], "left")
    asked = asked.withColumn("value", F.substring(F.col("own"), F.col("start") + 1, F.col("end") - F.col("start")))
    fits = F.col("own").isNotNull() & (F.col("start") >= 0) & (F.col("end") <= F.length("own")) & (F.col("start") < F.col("end")) & (F.trim(F.col("value")) != "") & F.col("entity_type").isin(*tx.PREFIXES)
    fits = F.coalesce(fits, F.lit(False))
    rejects = asked.where(~fits).select("doc_id", "location_id", "start", "end", "entity_type")
    good = asked.where(fits).select("doc_id", F.col("location_id").alias("asked_at"), "start", "end", "entity_type", "all_occurrences", "value")
    spread = good.join(blocks, "doc_id").where(F.col("all_occurrences") | (F.col("asked_at") == F.col("location_id")))
    gaps = F.split(tx.same_length_lower(F.col("text")), F.concat(F.lit(r"\Q"), tx.same_length_lower(F.col("value")), F.lit(r"\E")), -1)
    size = F.length("value")
    # Each gap but the last is followed by the value: a place is the sum of the gaps before it and of as many values.
    ends = running(F.transform(gaps, F.length), F.lit(0), lambda a, b: a + b)
    places = lambda ends: F.transform(F.slice(ends, F.lit(2), F.size(ends) - 2), lambda e, i: F.struct((e + size * i).alias("start"), (e + size * (i + 1)).alias("end")))
    every = let(ends, places)
    one = F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    rows = spread.withColumn("s", F.explode(F.when(F.col("all_occurrences"), every).otherwise(one)))
    value = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    found = rows.select(
        "doc_id", "location_id", "part", "block_index", "entity_type", F.col("s.start").alias("start"), F.col("s.end").alias("end"), value.alias("value"),
        F.lit(1.0).alias("confidence"), F.lit(200).alias("priority"), F.lit(-1).alias("ord"), F.array(F.lit(MANUAL_SOURCE)).alias("sources"),
        F.lit("Hallazgo añadido manualmente durante la revisión humana.").alias("reason"),
        tx.finding_id(F.col("location_id"), F.col("entity_type"), F.col("s.start"), F.col("s.end"), value, F.lit(MANUAL_SOURCE)).alias("id"),
        tx.context_snippet(F.col("text"), F.col("s.start"), F.col("s.end")).alias("context"),
    )
    return found, rejects

"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold documents; each node has a
weight among its siblings.  A budget of tokens is propagated from the root.  A node
takes no more than its leaves can give in ``max_epochs`` epochs, and what it leaves
goes to its siblings by weight, before any of it reaches the siblings of its parent.
Each leaf then gives whole epochs and a prefix of one more, each in its own seeded
order; positions come from sums over ranges of the order, so a leaf that holds most
rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm._store import Scratch
from vellum.sources.scratch import BROADCAST_BYTES

#: White-space-separated words.
WORDS = r"[^ \t\n\x0B\f\r]+"
#: Ranges of a leaf's seeded order: one for each value of so many hex digits.
RANGE_DIGITS = 2
#: Bytes of a row of the plan of leaves, at most, where it is broadcast.
PLAN_BYTES = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children, within their ``cap``, by ``weight``.

    Children that their share would overfill take their ``cap``; they are a prefix of
    the children in order of ``cap / weight``, so the rest can be shared in one pass.
    Shares are whole: what rounding down leaves goes one each to the largest remainders,
    then by name.  Returns ``nodes`` with the children's own ``budget``.
    """
    group = W.partitionBy(*(parents or [F.lit(0)]))
    by = group.orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    big = lambda c: c.cast("decimal(19,0)")
    nodes = nodes.withColumn("given", F.least("budget", F.sum("cap").over(group)))
    nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    nodes = nodes.withColumn("full", (big(F.col("cap")) * big(F.col("open")) <= big(F.col("given") - F.col("used")) * big(F.col("weight"))).cast("int"))
    nodes = nodes.withColumn("full", F.min("full").over(by.rowsBetween(W.unboundedPreceding, 0)))
    nodes = nodes.withColumn("left", F.col("given") - F.sum(F.col("cap") * F.col("full")).over(group))
    nodes = nodes.withColumn("share", F.sum(F.col("weight") * (1 - F.col("full"))).over(group))
    product = big(F.col("left")) * big(F.col("weight"))
    nodes = nodes.withColumn("down", F.when((F.col("share") > 0) & (F.col("full") == 0), F.expr("cast(left as decimal(19,0)) * cast(weight as decimal(19,0)) div share")).otherwise(F.lit(0)).cast("long"))
    nodes = nodes.withColumn("over", F.when(F.col("full") == 0, product - big(F.col("down")) * big(F.col("share"))).otherwise(F.lit(-1)))
    nodes = nodes.withColumn("nth", F.row_number().over(group.orderBy(F.desc("over"), name)))
    nodes = nodes.withColumn("spare", F.col("left") - F.sum("down").over(group))
    extra = ((F.col("full") == 0) & (F.col("nth") <= F.col("spare"))).cast("long")
    return nodes.withColumn("budget", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.col("down") + extra).cast("long")).drop("given", "used", "open", "full", "left", "share", "down", "over", "nth", "spare")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves(levels..., total)`` with ``budget``, the tokens each leaf is to give."""
    nodes = leaves.withColumn("cap", F.col("total") * max_epochs)
    for level, table in zip(levels, weights, strict=True):
        pairs = [F.lit(x) for name, weight in table.items() for x in (name, weight)]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1)) if pairs else F.lit(1)
        nodes = nodes.withColumn(f"w_{level}", weight.cast("long")).where(F.col(f"w_{level}") > 0)
    tree = None
    for depth, level in enumerate(levels):
        above, own = list(levels[:depth]), list(levels[: depth + 1])
        here = nodes.groupBy(*own).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("weight"))
        here = here.withColumn("budget", budget) if tree is None else here.join(tree, above)
        tree = fill(here, above, level).select(*own, "budget")
    return nodes.select(*levels, "total").join(tree, list(levels))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: Sequence[dict[str, int]], *, budget: int | None = None, budget_share: float = 1.0, max_epochs: int = 2, seed: int = 1, tokens: Column | None = None, with_tie: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, <levels>, epoch, tokens, start, taken``: what each leaf gives, a row a document and epoch.

    ``levels`` names the tree's levels from the root with the column of each; ``weights``
    has the children's whole-number weights of each level, 1 where not named, and 0 to
    leave out.  The budget is ``budget`` tokens, or ``budget_share`` of all tokens.
    ``tokens`` is a count a row, by default the words of the text.  ``start`` counts the
    tokens of the epoch before the document; ``taken`` is less than ``tokens`` only for
    the last document of a prefix.  Null texts and texts without words count 0 tokens
    and go with their leaf's prefix; a leaf without tokens gives nothing.  Null levels
    are the leaf ``(none)``, null ids sort first.  Repeated rows are taken each.
    ``with_tie`` adds ``tie``, the hash of the text, which tells apart rows of one id.
    Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    count = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    named = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for n, c in levels.items()]
    # Texts are counted once; what goes on is a narrow row a document.
    rows = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), *named, count.alias("tokens"), F.xxhash64(text_col).alias("tie")), "rows")
    leaves = scratch.keep(rows.groupBy(*levels).agg(F.sum("tokens").alias("total")).where("total > 0"), "leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("total")).collect()[0][0] or 0) * budget_share)
    plan = leaf_budgets(leaves, list(levels), weights, F.lit(budget).cast("long"), max_epochs)
    plan = scratch.keep(plan.withColumns({"full": F.expr("budget div total"), "rest": F.expr("budget % total")}).where("budget > 0").drop("budget", "total"), "plan")

    # Every epoch a leaf gives some of has its own seeded order.
    plan = plan.withColumn("epoch", F.explode(F.expr("sequence(1, cast(full as int) + cast(rest > 0 as int))")))
    plan = plan.withColumn("rest", F.when(F.col("epoch") > F.col("full"), F.col("rest"))).drop("full")
    if plan.count() * PLAN_BYTES <= BROADCAST_BYTES:
        rows = _ordered(rows.join(F.broadcast(plan), list(levels)), seed)
    else:
        # A copy of the plan for each range of the order, so that no leaf's rows meet in one task.
        epochs = _ordered(rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs)))), seed)
        ranges = F.transform(F.sequence(F.lit(0), F.lit(16**RANGE_DIGITS - 1)), lambda i: F.lpad(F.lower(F.hex(i)), RANGE_DIGITS, "0"))
        rows = epochs.join(plan.withColumn("range", F.explode(ranges)), [*levels, "epoch", "range"])
    key = [*levels, "epoch", "range"]
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(W.partitionBy(*levels, "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = scratch.keep(sums.select(*key, F.coalesce(before, F.lit(0)).alias("before")), "sums")
    within = F.sum("tokens").over(W.partitionBy(*key).orderBy("place", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, key).withColumn("start", F.col("before") + F.col("within"))
    rows = rows.where("rest is null or start < rest")
    taken = F.when(F.col("rest").isNull(), F.col("tokens")).otherwise(F.least("tokens", F.col("rest") - F.col("start")))
    return rows.select("doc_id", *levels, "epoch", "tokens", "start", taken.alias("taken"), *(["tie"] if with_tie else []))


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their place in the seeded order of their ``epoch``, and its range."""
    place = F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return rows.withColumn("place", place).withColumn("range", F.substring("place", 1, RANGE_DIGITS))


#: The tree of ``documents``: sources of one number modulo 4 share a domain.
DOMAIN = "concat('domain', coalesce(cast(try_cast(substring(source, 4) as int) % 4 as string), '-'))"
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
DOMAIN_WEIGHTS = {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}


def tree() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def _level_sql(own: str, above: str, name: str, source: str) -> str:
    over = f"PARTITION BY {above}" if above else ""
    order = f"{over} ORDER BY cap::DOUBLE / weight, {name}"
    return f"""
  SELECT {own}, CASE WHEN full_ = 1 THEN cap ELSE down + (row_number() OVER ({over} ORDER BY rem DESC, {name}) <= left_ - sum(CASE WHEN full_ = 1 THEN 0 ELSE down END) OVER ({over}))::INTEGER END::BIGINT AS budget FROM (
   SELECT *, (left_ * weight) // nullif(share, 0) AS down, CASE WHEN full_ = 1 THEN -1 ELSE (left_ * weight) % nullif(share, 0) END AS rem FROM (
    SELECT *, given - sum(cap * full_) OVER ({over}) AS left_, sum(weight * (1 - full_)) OVER ({over}) AS share FROM (
      SELECT *, min(fits) OVER ({order} ROWS UNBOUNDED PRECEDING) AS full_ FROM (
        SELECT *, (cap * open_ <= (given - used) * weight)::INTEGER AS fits FROM (
          SELECT *, least(budget, sum(cap) OVER ({over})) AS given,
                 coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                 sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
          FROM ({source}))))))"""


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


#: The query op7 for DuckDB.
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('domain' || coalesce((TRY_CAST(substring(source, 4) AS INTEGER) % 4)::VARCHAR, '-'), '(none)') AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS total, sum(tokens)::BIGINT * 2 AS cap FROM d GROUP BY ALL HAVING sum(tokens) > 0
), l1 AS ({_level_sql("domain", "", "domain", f"SELECT domain, sum(cap) AS cap, {_case('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT sum(total) FROM leaves) AS budget FROM leaves GROUP BY domain")}
), l2 AS ({_level_sql("domain, lang", "domain", "lang", f"SELECT a.domain, lang, sum(cap) AS cap, {_case('lang', LANG_WEIGHTS)} AS weight, any_value(budget) AS budget FROM leaves a JOIN l1 ON a.domain = l1.domain GROUP BY a.domain, lang")}
), l3 AS ({_level_sql("domain, lang, source", "domain, lang", "source", "SELECT a.domain, a.lang, source, cap, 1 AS weight, budget FROM leaves a JOIN l2 ON a.domain = l2.domain AND a.lang = l2.lang")}
), r AS (
  SELECT d.*, l3.budget // total AS full_, l3.budget % total AS rest
  FROM d JOIN leaves l ON d.domain = l.domain AND d.lang = l.lang AND d.source = l.source
  JOIN l3 ON d.domain = l3.domain AND d.lang = l3.lang AND d.source = l3.source WHERE l3.budget > 0
), e AS (
  SELECT *, unnest(generate_series(1, full_ + (rest > 0)::BIGINT)) AS epoch FROM r
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('1:' || epoch::VARCHAR || ':' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e
)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, tokens, start,
       (CASE WHEN epoch > full_ THEN least(tokens, rest - start) ELSE tokens END)::BIGINT AS taken
FROM p WHERE epoch <= full_ OR start < rest
"""

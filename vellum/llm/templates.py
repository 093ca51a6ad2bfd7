"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes by its number of tokens, then by its
``LEAD`` leading tokens, to a leaf.  Fields that vary are generalised in steps:

1. Tokens with a digit stand for any such token.  Lines that are then equal are one
   *kind*; a kind found in ``min_docs`` documents is a template.
2. Within a leaf a token is constant where kinds of ``min_docs`` documents in sum
   have it at its position; any other is a field.  Kinds whose constants agree share a
   *form*, and so do those that agree but for one constant behind the leading tokens,
   as a field may also have common values.  A leaf can thus hold many templates.
3. A form of at least ``similarity`` constants found in ``min_docs`` documents is a
   template.

Lines of a template are dropped from all documents but the earliest that has one.
Lines without a constant, such as blank ones and bare numbers, are no templates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import Scratch, small

MIN_DOCS, LEAD, SIMILARITY = 5, 3, 0.7

#: White space within a line, and a token with a digit between single blanks.
BLANKS = r"[ \t\r\f]+"
FIELD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"
#: What a token with a digit becomes.
HOLE = "<*>"
#: Bytes of a row of the leaves and of the kinds, which may be broadcast, and of a document's dropped lines: its own and those of each.
LEAF_BYTES, KIND_BYTES, GONE_BYTES, LINE_BYTES = 24, 48, 64, 4


def masked(lines: Column) -> Column:
    """An array of lines, each with single blanks and a hole for every token with a digit."""

    def flat(raw: Column) -> Column:
        uneven = raw.contains("  ") | raw.contains("\t") | raw.contains("\r") | raw.contains("\f")
        return F.trim(F.when(uneven, F.regexp_replace(raw, BLANKS, " ")).otherwise(raw))

    # Each pattern runs only where a plainer one matches, and once: filters on what is made here stay behind the explode.
    return F.transform(F.transform(lines, flat), lambda line: F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, HOLE)).otherwise(line))


def template_lines(docs: DataFrame, *, lead: int = LEAD) -> DataFrame:
    """``doc, doc_id, line_no, line, leaf, n`` of the lines that can be templates.

    ``line`` is the masked line with single blanks; ``doc`` tells apart rows of one id.
    """
    parts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), masked(F.split("text", "\n")).alias("parts"))
    lines = parts.select("doc_id", "doc", F.posexplode_outer("parts").alias("line_no", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.where("line <> ''").withColumn("n", n)
    holes = (F.length("line") - F.length(F.replace("line", F.lit(HOLE), F.lit("")))) / len(HOLE)
    bare = (F.length("line") == F.col("n") * (len(HOLE) + 1) - 1) & (holes == F.col("n"))
    lines = lines.where(~bare)
    return lines.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", lead)))


def kind_words(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` with their ``masked`` lines, each read again from the one document of which ``kinds`` has ``doc`` and ``line_no``."""
    asked = kinds.groupBy("doc").agg(F.collect_list(F.struct("leaf", "line", "n", "docs", "first", "line_no")).alias("asked"))
    held = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "text").join(small(asked, F.size("asked") * KIND_BYTES + GONE_BYTES), "doc")

    def own(parts: Column) -> Column:
        lines = masked(F.transform("asked", lambda k: F.get(parts, k["line_no"])))
        return F.transform(F.arrays_zip(F.col("asked").alias("kind"), lines.alias("masked")), lambda x: F.struct(x["kind"].alias("kind"), x["masked"].alias("masked")))

    texts = held.select(F.explode(F.element_at(F.transform(F.array(F.split("text", "\n")), own), 1)).alias("one"))  # the text is split once
    # Rows of one id and text are read each.
    return texts.select("one.kind.leaf", "one.kind.line", "one.kind.n", "one.kind.docs", "one.kind.first", "one.masked").groupBy("leaf", "line", "n", "docs", "first").agg(F.first("masked").alias("masked"))


def form_templates(kinds: DataFrame, slim: DataFrame, pairs: DataFrame, docs: DataFrame, scratch: Scratch, *, min_docs: int = MIN_DOCS, lead: int = LEAD, similarity: float = SIMILARITY) -> DataFrame:
    """``leaf, line, first``: kinds that share a form with others, and its earliest document.

    ``kinds(leaf, line, n, docs, first)``, ``slim(leaf, line, doc, line_no)``, ``pairs(leaf, line, doc_id)``, ``docs(doc_id, text)``.
    """
    kinds = kinds.where(F.col("n") > lead)
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("total")).where((F.col("kinds") > 1) & (F.col("total") >= min_docs))
    leaves = scratch.keep(leaves.select("leaf"), "leaves")
    open_ = scratch.keep(kinds.join(leaves, "leaf", "left_semi"), "open")
    places = slim.drop("n").join(small(open_, KIND_BYTES), ["leaf", "line"]).groupBy("leaf", "line", "n", "docs", "first").agg(F.min("doc").alias("doc"), F.min_by("line_no", "doc").alias("line_no"))
    words = kind_words(docs, scratch.keep(places, "places"))
    words = words.select("leaf", "line", "n", "docs", "first", F.posexplode(F.split("masked", " ")).alias("at", "word"))
    words = scratch.keep(words.select("leaf", "line", "n", "docs", "first", "at", F.when(F.col("word") != HOLE, F.xxhash64("at", "word")).alias("token")), "words")
    constant = words.where("token is not null").groupBy("leaf", "token").agg(F.sum("docs").alias("votes")).where(F.col("votes") >= min_docs)
    constant = scratch.keep(constant.select("leaf", "token"), "constant")
    held = words.join(constant, ["leaf", "token"], "left_semi")

    # The form of a kind is the exclusive or of its constants' hashes; without one of them it is a form with one field more.
    forms = held.groupBy("leaf", "line", "n", "docs", "first").agg(F.bit_xor("token").alias("form"), F.collect_list(F.when(F.col("at") >= lead, F.col("token"))).alias("free"), F.count("*").alias("constants"))
    less = F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("constants") - 1 >= F.col("n") * similarity, F.col("free")).otherwise(F.array().cast("array<bigint>")))
    forms = forms.where(F.col("constants") >= F.col("n") * similarity).select("leaf", "line", "docs", "first", F.explode(F.transform(less, lambda t: F.col("form").bitwiseXOR(t))).alias("form"))
    forms = scratch.keep(forms, "forms")
    groups = forms.groupBy("leaf", "form").agg(F.count("*").alias("kinds"), F.sum("docs").alias("total"), F.max("docs").alias("most"), F.min("first").alias("first"))
    groups = groups.where((F.col("kinds") > 1) & (F.col("total") >= min_docs)).select("leaf", "form", "most", F.col("first").alias("earliest"))
    members = scratch.keep(forms.select("leaf", "line", "form").join(small(scratch.keep(groups, "groups"), KIND_BYTES), ["leaf", "form"]), "members")
    # A kind of enough documents settles it; otherwise the documents of kinds that are all rare are counted.
    rare = members.where(F.col("most") < min_docs)
    counted = rare.join(pairs, ["leaf", "line"]).groupBy("leaf", "form").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= min_docs)
    settled = members.where(F.col("most") >= min_docs).union(rare.join(counted.select("leaf", "form"), ["leaf", "form"], "left_semi").select(*members.columns))
    return settled.select("leaf", "line", F.col("earliest").alias("first"))


def drop_templates(docs: DataFrame, *, min_docs: int = MIN_DOCS, lead: int = LEAD, similarity: float = SIMILARITY, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every row of ``docs`` without recurring lines.

    Lines end at line feeds and keep their order and their own white space.  The
    document of smallest id keeps its lines of a template; null ids come last and do
    not count as documents.  A null text stays null, with no lines; an empty text has
    one empty line.  Rows that share an id are one document, so repeated rows keep what
    they repeat; each row keeps its own text.  ``keep`` names other columns to return
    unread; no other column is read.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "templates")
    rest = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    lines = template_lines(rows, lead=lead)
    lines = scratch.keep(lines.select("doc_id", "doc", "line_no", "leaf", F.xxhash64("line").alias("line"), "n"), "lines")
    # A leaf of fewer lines than a template has documents holds none; most lines are of such leaves.
    full = scratch.keep(lines.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs).select("leaf"), "full")
    slim = scratch.keep(lines.join(small(full, LEAF_BYTES), "leaf", "left_semi"), "slim")
    scratch.drop("lines", "full")
    pairs = scratch.keep(slim.select("leaf", "line", "n", "doc_id").distinct(), "pairs")
    kinds = scratch.keep(pairs.groupBy("leaf", "line", "n").agg(F.count("doc_id").alias("docs"), F.min("doc_id").alias("first")), "kinds")
    same = kinds.where(F.col("docs") >= min_docs).select("leaf", "line", "first")
    alike = form_templates(kinds, slim, pairs.select("leaf", "line", "doc_id"), rows.select("doc_id", "text"), scratch, min_docs=min_docs, lead=lead, similarity=similarity)
    found = scratch.keep(same.union(alike).groupBy("leaf", "line").agg(F.min("first").alias("first")), "found")
    gone = slim.join(small(found, KIND_BYTES), ["leaf", "line"]).where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    gone = scratch.keep(gone.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "gone")
    scratch.drop("slim", "pairs", "kinds", "leaves", "open", "places", "words", "constant", "forms", "groups", "members", "found")
    out = rows.withColumn("doc", F.xxhash64("doc_id", "text")).join(small(gone, F.size("gone") * LINE_BYTES + GONE_BYTES), "doc", "left")

    def others(parts: Column) -> Column:
        """What is left of a text's lines; the difference of two sets of numbers keeps their order."""
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), others), 1)  # the text is split once
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return out.select(
        "doc_id",
        F.coalesce(feeds + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        *[F.col("rest")[c].alias(c) for c in keep],
    )


#: The same over ``documents`` with the default parameters, for DuckDB.
SQL = r"""
WITH raw AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS parts FROM documents
), lines AS (
  SELECT doc_id, i AS line_no,
         regexp_replace(trim(regexp_replace(parts[i], '[ \t\r\f]+', ' ', 'g'), ' '), '[^ \t\r\f]*[0-9][^ \t\r\f]*', '<*>', 'g') AS line
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM raw)
), slim AS (
  SELECT doc_id, line_no, line, n, n::VARCHAR || '|' || array_to_string(string_split(line, ' ')[1:3], ' ') AS leaf
  FROM (SELECT *, len(string_split(line, ' ')) AS n FROM lines) WHERE line <> '' AND len(list_filter(string_split(line, ' '), lambda t: t <> '<*>')) > 0
), kinds AS (
  SELECT leaf, line, n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM slim GROUP BY ALL
), leaves AS (
  SELECT leaf FROM kinds WHERE n > 3 GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 5
), words AS (
  SELECT leaf, line, n, docs, first, pos, string_split(line, ' ')[pos] AS token
  FROM (SELECT *, unnest(generate_series(1, n)) AS pos FROM kinds WHERE n > 3 AND leaf IN (FROM leaves))
), constant AS (
  SELECT leaf, pos, token FROM words WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 5
), shaped AS (
  SELECT w.leaf, w.line, w.n, w.docs, w.first, list(w.pos || ':' || w.token ORDER BY w.pos) AS form, list(w.pos ORDER BY w.pos) AS places
  FROM words w JOIN constant c ON w.leaf = c.leaf AND w.pos = c.pos AND w.token = c.token GROUP BY ALL
), forms AS (
  SELECT leaf, line, docs, first, array_to_string(form, ' ') AS form FROM shaped WHERE len(form) >= n * 0.7
  UNION ALL
  SELECT leaf, line, docs, first, array_to_string(list_filter(form, lambda x, i: i <> j), ' ')
  FROM (SELECT *, unnest(generate_series(1, len(form))) AS j FROM shaped WHERE len(form) - 1 >= n * 0.7) WHERE places[j] > 3
), groups AS (
  SELECT f.leaf, f.form, min(f.first) AS first FROM forms f JOIN slim s ON f.leaf = s.leaf AND f.line = s.line
  GROUP BY f.leaf, f.form HAVING count(DISTINCT f.line) > 1 AND count(DISTINCT s.doc_id) >= 5
), found AS (
  SELECT line, min(first) AS first FROM (
    SELECT line, first FROM kinds WHERE docs >= 5
    UNION ALL SELECT f.line, g.first FROM forms f JOIN groups g ON f.leaf = g.leaf AND f.form = g.form) GROUP BY line
), gone AS (
  SELECT DISTINCT s.doc_id, s.line_no FROM slim s JOIN found f ON s.line = f.line WHERE s.doc_id > f.first
), dropped AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT r.doc_id, len(r.parts)::BIGINT AS n_lines, coalesce(len(d.gone), 0)::BIGINT AS n_dropped,
       CASE WHEN d.gone IS NULL THEN r.text
            ELSE coalesce(array_to_string(list_transform(list_filter(generate_series(1, len(r.parts)), lambda i: NOT list_contains(d.gone, i)), lambda i: r.parts[i]), chr(10)), '') END AS text
FROM raw r LEFT JOIN dropped d ON r.doc_id = d.doc_id
"""

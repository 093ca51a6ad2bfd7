"""Corpus preparation in five stages, each written as Parquet and reread by the next.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``; the last one packs what is left into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing
from vellum.llm._store import Scratch, small
from vellum.llm.jaccard import jaccard_components
from vellum.llm.packing import pack_documents
from vellum.llm.quality import score_quality
from vellum.llm.queries import tokenizer
from vellum.llm.templates import drop_templates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an id and a hash, where they are broadcast.
PAIR_BYTES = 16
#: Share of the words that the mix keeps.
MIX_SHARE = 0.8


def _among(docs: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are in ``pairs(other, hash)`` or, with ``left_anti``, are not; null ids are ids too."""
    same = docs["doc_id"].eqNullSafe(pairs["other"]) & (F.xxhash64(docs["text"]) == pairs["hash"])
    return docs.join(small(pairs, PAIR_BYTES), same, how).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier scores 0.3 or more.

    Null ids and empty texts are scored like others; rows of one id go by their own text,
    rows of one id and text go together.  An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, labels, threshold=0.3, metadata=("n_chars",))
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias("other"), F.col("text_hash").alias("hash")).distinct()
    return _among(docs, Scratch(spark, "quality-stage").keep(rejected, "rejected"), "left_anti")


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines of recurring templates; a document that they were all of goes.

    Every row is cleaned by itself, whatever ids repeat.  Null, empty and blank texts
    that lost no line stay as they are.  An empty table stays empty.
    """
    clean = drop_templates(docs, keep=["lang", "source", "n_chars"]).where("n_dropped = 0 or trim(text) <> ''")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of smallest id, of each group whose five-word shingle sets reach Jaccard 0.8.

    Copies that share an id, and repeated rows, are one document too.  Documents without
    words and null ids are in no group and stay.  An empty table stays empty.
    """
    docs, scratch = docs.select(*COLUMNS), Scratch(spark, "near-stage")
    found = jaccard_components(docs, k=5, num=80, den=100, count_links=False).where("doc_id is not null and group_id is not null")
    found = scratch.keep(found.groupBy("group_id", F.col("doc_id").alias("other"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("rows")), "found")
    first = found.groupBy("group_id").agg(F.min(F.struct("other", "hash", "rows")).alias("first"))
    copies = found.join(scratch.keep(first, "first"), "group_id").where("other <> first.other or hash <> first.hash").select("other", "hash")
    kept = _among(docs, scratch.keep(copies, "copies"), "left_anti")
    again = scratch.keep(first.where("first.rows > 1").select("first.other", "first.hash"), "again")
    if not again.limit(1).count():
        return kept
    return _among(kept, again, "left_anti").union(_among(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that begin within their leaf's share of ``MIX_SHARE`` of all words, in one epoch.

    Null languages and sources are leaves of their own; null ids take part; rows of one id
    and text stay together; texts without words go with their leaf.  An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    chosen = mixing.mix_sources(docs, mixing.tree(), [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}], budget_share=MIX_SHARE, max_epochs=1, seed=1, with_tie=True)
    kept = chosen.select(F.col("doc_id").alias("other"), F.col("tie").alias("hash")).distinct()
    return _among(docs, Scratch(spark, "mix-stage").keep(kept, "kept"), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row a piece, with the digest of its ids; each row is packed, null and empty texts as the end id alone."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), limit=2048, end_id=0, ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_templates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The quality classifier is learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(at))
        if at:
            scratch.drop(str(at - 1))
    return docs

"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bitplanes, mixing, templates, treap
from vellum.llm.htmltext import extract
from vellum.llm.jaccard import jaccard_components
from vellum.llm.langid import identify
from vellum.llm.packing import pack_documents
from vellum.llm.passages import repeated_spans
from vellum.llm.permindex import nearest_neighbours
from vellum.llm.quality import score_quality
from vellum.llm.tokencount import count_tokens
from vellum.llm.vafile import exact_top_k


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row a piece."""
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=2048, end_id=0, ids=False)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have Jaccard 0.9 or more."""
    found = jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned outside fold 0."""
    return identify(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned outside fold 0."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_quality(docs, labels, threshold=0.3, metadata=("n_chars",)).select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text that an earlier document or an earlier place in it has, in offsets of the original text."""
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector."""
    return exact_top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared by weight among domains, languages and sources, in two epochs at most."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), mixing.tree(), [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}], budget_share=1.0, max_epochs=2, seed=1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near neighbours of every hundredth vector."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of templates that recur across documents."""
    return templates.drop_templates(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.col("text"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centroids of the vectors of 64 components, five rounds, exact."""
    return bitplanes.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, scale=256)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, sf_dir, "pages"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents of greatest score for each item of the benchmark."""
    return treap.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_counts": op8_token_counts,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_line_templates": op10_line_templates,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_html_text": op12_html_text,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 5
""",
    "op7_mix_sources": mixing.SQL,
    "op10_line_templates": templates.SQL,
    "op11_centroid_clustering": bitplanes.sql(),
    "op13_ranked_search": treap.SQL,
}

"""The pipeline's stages on a small table, each against what its input asks for."""

import random

import corpus_pipeline as pipe
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, prose


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    good = [(i, prose(rng, 60) + ".\nAviso común de la casa 7", "en", f"src{i % 5}") for i in range(80)]
    bad = [(200 + i, " ".join(w + "###" for w in prose(rng, 40).split()), "en", "src0") for i in range(40)]
    copies = [(300 + i, good[i][1].replace(".", " z."), "en", "src1") for i in range(6)]
    docs = spark.createDataFrame(good + bad + copies, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good] + [(d, 0, 0) for d, *_ in bad], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    kept = pipe.quality(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {d for d, *_ in bad} and {d for d, *_ in good} <= ids and kept.columns == pipe.COLUMNS
    lines = pipe.line_templates(spark, docs, str(tmp_path))
    rows = {r.doc_id: r for r in lines.collect()}
    assert "Aviso" in rows[0].text and "Aviso" not in rows[1].text and rows[1].n_chars == len(rows[1].text) and len(rows) == 126
    near = pipe.near_duplicates(spark, lines, str(tmp_path))
    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in rows.values()], 5, 80, 100) if d == c}
    assert {r.doc_id for r in near.collect()} == want and not want & {d for d, *_ in copies}
    mixed = pipe.mix(spark, near, str(tmp_path))
    assert 0 < mixed.count() < near.count() and mixed.columns == pipe.COLUMNS
    packed = pipe.run(spark, str(tmp_path))
    spans = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert spans.where("n <> m or n > 2048").count() == 0 and packed.count() >= 40
    assert len(pipe.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Shared ids, repeated rows, nulls in every column, a very long text and clashing extra columns."""
    rng = random.Random(16)
    notice = "Aviso común de la casa 7"
    rows = [(i, f"{prose(rng, 60)}.\n{notice}", "en", f"src{i % 5}") for i in range(40)]
    twice = prose(rng, 50)
    rows += [(50, f"FIRST {prose(rng, 30)}\n{notice}", "en", "src1"), (50, f"OTHER {prose(rng, 30)}\n{notice}", "en", "src1")]
    rows += [(51, twice, "en", "src0"), (51, twice + " fin", "en", "src0"), (52, twice, "en", "src0"), (52, twice, "en", "src0")]
    rows += [(53, rows[3][1], "en", "src1"), (54, rows[3][1], "en", "src1"), (54, rows[3][1], "en", "src1")]
    rows += [(60, None, "en", "src0"), (61, "", None, None), (62, " \n", "en", None), (63, prose(rng, 60_000), "en", "src2"), (None, prose(rng, 40), None, "src3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(["other", "hash", "rest", "kept", "gone", "tokens", "key", "group_id", "epoch", "`first`"])])
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = pipe.quality(spark, docs, str(tmp_path))
    assert kept.columns == pipe.COLUMNS and kept.count() <= docs.count()
    lines = pipe.line_templates(spark, docs, str(tmp_path)).collect()
    texts = sorted(r.text for r in lines if r.doc_id == 50)
    assert texts[0].startswith("FIRST") and texts[1].startswith("OTHER") and not any(notice in t for t in texts) and len(lines) == len(rows)
    near = pipe.near_duplicates(spark, docs, str(tmp_path)).collect()
    ids = [r.doc_id for r in near]
    assert len([i for i in ids if i == 50]) == 2 and ids.count(51) == 1 and not {52, 53, 54} & set(ids) and {60, 61, 62, 63, None} <= set(ids)
    assert len(ids) == 40 + 2 + 1 + 5
    mixed = pipe.mix(spark, docs, str(tmp_path))
    assert mixed.columns == pipe.COLUMNS and 0 < mixed.count() < docs.count()
    packed = pipe.pack(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(rows)
    nothing = docs.where("false")
    assert [stage(spark, nothing, str(tmp_path)).count() for _, stage in pipe.STAGES] == [0] * 5

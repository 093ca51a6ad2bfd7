"""Operators on literal cases: documents, templates, invoices, drafts, users."""

import hashlib
import io
import os
import re
import time
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import oracles
from vellum.operators import detect, drafts, invoices, redact, registry, resolve, templates
from vellum.operators.rules import RULES
from vellum.plans.catalog import ORACLES, QUERIES
from vellum.plans.invoice_queries import FLAT, GROUPED, payloads
from vellum.sources import blocks as bl
from vellum.sources import profiles as pf
from vellum.streaming.streams import observed_users_stream, redact_stream


def docs(spark, *texts):
    return bl.text_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def found(spark, text, **options):
    findings, _ = redact.analyse(docs(spark, text), **options)
    return sorted((r.start, r.entity_type, r.value, r.alias) for r in findings.collect())


ANONYMISED = [
    ("Cliente 12345678Z permanece activo", "Cliente [DNI_01] permanece activo"),
    ("DNI 12345678Z, email ana@example.com y teléfono 612 345 678.", "DNI [DNI_01], email [EMAIL_01] y teléfono [TEL_01]."),
    ("Pasaporte PA-123456. Documento de viaje PA123456.", "Pasaporte [PASS_01]. Documento de viaje [PASS_01]."),
    ("CONTACTO TRABAJADORA CAIXESBBXXX BBVAESMMXXX", "CONTACTO TRABAJADORA [SWIFT_01] [SWIFT_02]"),
    ("Referencia interna PA123456", "Referencia interna PA123456"),
    ("", None),
]


def test_anonymise(spark):
    texts = [t for t, _ in ANONYMISED]
    got = {r.doc_id: r.text for r in redact.anonymise(docs(spark, *texts)).collect()}
    assert [got.get(i) for i in range(len(texts))] == [w for _, w in ANONYMISED]
    whole = redact.redact_texts(spark.createDataFrame([(t, t) for t in texts if t], "t string, r string"), "r")
    assert {r.t: r.r for r in whole.collect()} == {t: w for t, w in ANONYMISED if t}


def test_groups_and_allowlist(spark):
    got = found(spark, "Cliente: Ana García. Ana García cobrará 1.234,56 €. La transferencia de EUR 1 234,56 se hará a ana@example.com.")
    assert [g[3] for g in got if g[1] == "MONEY"] == ["[IMP_01]"] * 2
    assert [g[2] for g in found(spark, "Madrid y Barcelona figuran en el contrato.", allowlist=("Madrid",))] == ["Barcelona"]
    assert found(spark, "Escribe a a@b.es desde 10.0.0.1", categories=("IP_ADDRESS",)) == [(23, "IP_ADDRESS", "10.0.0.1", "[IP_01]")]


def test_manual_findings_win(spark):
    rows = docs(spark, "Madrid aparece aquí. Madrid aparece de nuevo.")
    asked = spark.createDataFrame([(0, "text:body:block[0]", 0, 6, "PERSON", True), (0, "text:body:block[9]", 0, 6, "PERSON", True), (0, "text:body:block[0]", 3, 2, "PERSON", False)], "doc_id long, location_id string, start int, end int, entity_type string, all_occurrences boolean")
    manual, rejects = detect.manual_findings(rows, asked)
    before = detect.as_findings(resolve.resolve_overlaps(detect.detect_rules(rows)))
    got = resolve.resolve_findings(before.unionByName(manual)).collect()
    assert {(r.entity_type, r.start, tuple(r.sources)) for r in got} == {("PERSON", 0, ("Revisión manual", "Gazetteer local")), ("PERSON", 21, ("Revisión manual", "Gazetteer local"))}
    assert rejects.count() == 2


def test_hits_that_are_labels_are_set_aside_and_the_query_has_all_of_its_sql(spark, tmp_path, monkeypatch):
    hits = spark.createDataFrame([(0, "text:body:block[0]", 7, 0, n, "LOCATION", 0.9) for n in (3, 8)], "doc_id long, location_id string, offset int, start int, end int, entity_type string, score double")
    kept = detect.external_hits(docs(spark, "Gehört nie zu ihm"), hits).orderBy("end").collect()
    assert [(r.value, r.entity) for r in kept] == [("nie", False), ("nie zu i", True)]
    assert [r.value for r in detect.external_findings(docs(spark, "Gehört nie zu ihm"), hits).collect()] == ["nie zu i"]
    pd.DataFrame([(n, "\n".join(["x" * 22 + "nie, und nie wieder"] * 3)) for n in range(200)], columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(oracles, "TABLES", tmp_path)
    assert oracles.disagreement(spark, QUERIES["external_findings"], ORACLES["external_findings"]) is None


def test_rules_equal_a_search_in_python(spark):
    texts = ["Cliente: Ana García López paga 1.234,56 € y EUR 20 a Acme Hijos S.L. en Calle Mayor 3, 28001.", "nacida el 1/2/1990, edad: 33 años; www.x.es/a?b, ES91 2100 0418 4502 0005 1332 y 1234 BCD", "ñ@x.es;a.b+c@sub.dominio.com, +34 612-345-678 4111-1111-1111-1111 dos mil euros"]
    for name, rule in RULES.items():
        python = re.compile(rule.pattern.replace("(?iuU)", "(?i)").replace("(?U)", ""))
        rows = docs(spark, *texts).select("doc_id", F.explode(detect.spans(F.col("text"), rule.pattern, rule.group)).alias("s")).select("doc_id", "s.*").collect()
        assert sorted((r.doc_id, r.start, r.end, r.value) for r in rows) == sorted((i, *m.span(rule.group), m[rule.group]) for i, t in enumerate(texts) for m in python.finditer(t)), name


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="needs the test tables")
def test_rules_equal_a_search_in_python_over_a_corpus(spark):
    """Guards, marks and offsets against a plain search of every line, for rules without a control digit."""
    names = [n for n, r in RULES.items() if r.validator is None]
    rows = bl.text_blocks(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).repartition(4)
    got = rows.select("text", *[F.transform(detect.rule_spans(F.col("text"), n), lambda x: F.struct(x["start"], x["end"])).alias(n) for n in names]).collect()
    assert len(got) > 500
    for name in names:
        python = re.compile(RULES[name].pattern.replace("(?iuU)", "(?i)").replace("(?U)", ""))
        for r in got:
            assert [tuple(x) for x in r[name]] == [m.span(RULES[name].group) for m in python.finditer(r.text)], (name, r.text)


def matching_texts(n=10):
    """Texts that the patterns match, drawn from the patterns themselves with Unicode digits, blanks and letters."""
    out = []
    for rule in RULES.values():
        python = rule.pattern.replace("(?iuU)", "(?i)").replace("(?U)", "").replace("++", "+").replace("*+", "*").replace("?+", "?").replace("{1,127}", "{1,3}").replace("{0,40}", "{0,3}")
        python = re.sub(r"\(\?<?[!=](?:[^()]|\([^()]*\))*\)|\\b", "", python)

        @settings(max_examples=n, database=None, derandomize=True, suppress_health_check=list(HealthCheck), deadline=None)
        @given(st.from_regex(python, fullmatch=True))
        def draw(text):
            out.append(text)

        draw()
    return out


def test_guards_never_lose_a_match(spark):
    texts = [t for t in matching_texts() if "\n" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    lost = rows.select(*[(F.col("t").rlike(r.pattern) & ~F.col("t").rlike(r.guard)).alias(n) for n, r in RULES.items()])
    hits = rows.select(*[F.count_if(F.col("t").rlike(r.pattern)).alias(n) for n, r in RULES.items()]).first()
    assert lost.select(*[F.count_if(n).alias(n) for n in RULES]).first().asDict() == dict.fromkeys(RULES, 0)
    assert all(hits[n] >= 1 for n in RULES), hits


@pytest.mark.parametrize("name,text", [
    ("es_iban", "ES\u00a091 2100 0418 4502 0005 1332"), ("plate", "Coche \u0661\u0662\u0663\u0664 BCD"), ("es_dni", "\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18Z"),
    ("phone", "6\u0661\u0662 345 678"), ("email", "x@" + "a." * 100 + "es"),
])
def test_unicode_forms_are_found(spark, name, text):
    assert len(spark.createDataFrame([(text,)], "t string").select(detect.rule_spans(F.col("t"), name)).first()[0]) == 1


def test_places_behind_letters_that_grow(spark):
    assert [g[2] for g in found(spark, "\u0130\u0130\u0130 en Madrid hoy, C\u00e1diz")] == ["Madrid", "C\u00e1diz"]
    rows = docs(spark, "\u0130\u0130 Ana y ana")
    asked = spark.createDataFrame([(0, "text:body:block[0]", 3, 6, "PERSON", True)], "doc_id long, location_id string, start int, end int, entity_type string, all_occurrences boolean")
    manual, _ = detect.manual_findings(rows, asked)
    assert sorted((r.start, r.value) for r in manual.collect()) == [(3, "Ana"), (9, "ana")]


@pytest.mark.parametrize("text", ["x@" + "a." * 500_000, "a@" * 500_000, "nacido el" + " " * 1_000_000, "\u20ac 1" + ".123" * 250_000, "cliente" + " " * 1_000_000, "calle Aa" + " " * 1_000_000 + "x", "ab " * 333_000 + "S.L.", "edad" + " " * 1_000_000, "1." * 500_000])
def test_lines_of_a_megabyte(spark, text):
    rows = docs(spark, text)
    assert rows.select(F.size(detect.candidates(F.col("text"), F.col("label"))).alias("n")).first().n < 10


def test_fifty_thousand_matches_in_a_line(spark):
    """A line of a megabyte, through every step that reads it."""
    n = 50_000
    line, want = " ".join(f"ana{i}@x{i % 9}.com" for i in range(n)), " ".join(f"[EMAIL_{i + 1:02d}]" for i in range(n))
    steps = {
        "detect": lambda t: detect.as_findings(detect.detect_rules(docs(spark, t))).count(),
        "anonymise": lambda t: redact.anonymise(docs(spark, t)).first().text,
        "row": lambda t: redact.redact_texts(spark.createDataFrame([(t,)], "text string")).first().text,
    }
    for name, step in steps.items():
        began = time.perf_counter()
        assert step(line) == (n if name == "detect" else want)
        assert time.perf_counter() - began < 90, name  # planning included


def test_fifty_thousand_candidates_in_a_block(spark):
    """Pairs that overlap, the second of more authority: each leaves one with the evidence of both."""
    n = 25_000
    one = lambda at, end, p, src: F.struct(F.lit("X").alias("entity_type"), at.alias("start"), end.alias("end"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"), F.lit(p).alias("priority"), F.lit(0).alias("ord"), F.array(F.lit(src)).alias("sources"), F.lit("r").alias("reason"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(one(i * 10, i * 10 + 5, 1, "a"), one(i * 10 + 3, i * 10 + 8, 2, "b"))))
    rows = spark.range(1).select(F.col("id").alias("doc_id"), pairs.cast(detect.NONE).alias("candidates"))
    began = time.perf_counter()
    got = resolve.resolve_overlaps(rows).first().candidates
    assert time.perf_counter() - began < 30
    assert [(c.start, c.end, c.priority, c.sources) for c in got] == [(i * 10 + 3, i * 10 + 8, 2, ["b", "a"]) for i in range(n)]


def test_many_values_in_many_blocks(spark):
    blocks = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("location_id"), F.col("id").cast("int").alias("block_index"), F.concat(F.lit("Sin nada, salvo VALOR-"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    values = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("valor-"), (F.col("id") * 1000).cast("string"), F.lit(".")).alias("value"))
    began = time.perf_counter()
    got = redact.verify_literal(blocks, values).collect()
    assert time.perf_counter() - began < 60
    assert {(r.location_id, r.needle) for r in got} == {(f"b{i}", f"valor-{i}.") for i in range(0, 10_000, 1000)}
    odd = blocks.limit(2).union(spark.createDataFrame([(2, "x", 0, None), (3, "y", 0, "abc")], "doc_id long, location_id string, block_index int, text string"))
    asked = spark.createDataFrame([(3, "B"), (3, "bC"), (3, None), (3, ""), (2, "a"), (9, "z")], "doc_id long, value string")
    assert {tuple(r) for r in redact.verify_literal(odd, asked).collect()} == {(3, "y", "b"), (3, "y", "bc")}


def test_a_second_detection_of_applied_types_is_that_of_all(spark):
    texts = [t for t, _ in ANONYMISED if t] + ["Vive en Madrid, España, tel. 612 345 678", "Madrid y a@b.es"]
    blocks = docs(spark, *texts)
    findings, _ = redact.analyse(blocks)
    for kinds in (["LOCALITY", "ES_PHONE", "PASSPORT"], []):
        chosen = findings.where(F.col("entity_type").isin(kinds)).where("doc_id % 2 = 1 or entity_type = 'LOCALITY'")
        whole = resolve.with_groups(detect.as_findings(detect.detect_rules(blocks))).join(chosen.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_semi")
        key = lambda rows: sorted((r.doc_id, r.start, r.end, r.entity_type, r.value, r.id) for r in rows.collect())
        assert key(redact.verify_detectors(blocks, chosen)) == key(whole)


#: Texts with a value, and others with its like: the same in another form, or another.
FORMS = [
    ("NIE X1234567L", "aquí x-1234567-l"), ("tel. 612 345 678", "tel. 612.345-678\u0301"), ("tel. 612 345 678", "tel. 612 345 679"),
    ("Vive en C\u00e1diz", "vive en CA\u0301DIZ o cadiz"), ("Pagó dos mil euros", "Pagó 2.000 EUR"), ("Pagó dos mil euros", "Pagó tres mil euros"),
    ("Compra: Acme Hijos S.L.", "Vende; ACME  HIJOS LTD"), ("Cliente: Íñigo Nuñez", "cliente: I\u0301ñigo Nun\u0303ez"), ("de ﬁn@x.es", "de FIN@x.es"),
    ("IBAN ES91 2100 0418 4502 0005 1332", "IBAN ES9121000418450200051332"), ("a 1/2/1990, edad: 33 años", "Edad:  33 años"), ("\u00d1@x.es", "\u00f1@X.es"),
    ("de иван@x.es", "de ИВАН@x.es"), ("de @ы.ы y ы@ы.рф", "de Ы@ы.рф"), ("Tarjeta 4111 1111 1111 1111", "4111-1111-1111-1111"), ("nada", "nada"),
]


def test_a_second_detection_reads_only_blocks_that_may_hold_a_value(spark):
    """Whatever form a value has, none is lost; blocks without one are not read."""
    rows = [(i, f"{own}\n{other}\n" + "\n".join(f"Línea {n} sin valores, ni {n}@otros.es" for n in range(600 if i == 0 else 3))) for i, (own, other) in enumerate(FORMS)]
    odd = [(100, None), (101, ""), (102, " \n\n"), (103, "sin hallazgos")]
    blocks = bl.text_blocks(spark.createDataFrame(rows + odd, "doc_id long, text string"))
    every = resolve.with_groups(detect.as_findings(detect.detect_rules(blocks)))
    applied = every.where("block_index = 0")
    key = lambda rows: sorted((r.doc_id, r.block_index, r.start, r.end, r.entity_type, r.value, r.id) for r in rows.collect())
    whole = key(every.join(applied.select("doc_id", "group_id").distinct(), ["doc_id", "group_id"], "left_semi"))
    assert key(redact.verify_detectors(blocks, applied)) == whole
    again = {FORMS[d] for d, block, *_ in whole if block == 1}
    assert len(again) >= 9 and FORMS[6] in again and not again & {FORMS[2], FORMS[5], FORMS[-1]}
    read = redact.may_hold(blocks, applied).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in read}[0] == 2 and sum(r["count"] for r in read) <= 3 * len(FORMS)
    assert redact.verify_detectors(blocks, applied.where("false")).count() == 0


def test_a_group_of_many_findings_is_summed_up_first(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("p").alias("part"), F.col("id").cast("int").alias("block_index"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("EMAIL").alias("entity_type"), F.when(F.col("id") == 0, "A@b.es").otherwise("a@b.es").alias("value"), F.lit(0.97).alias("confidence"), F.array(F.when(F.col("id") % 2 == 0, "two").otherwise("one")).alias("sources"), F.lit("r").alias("reason"), F.col("id").cast("string").alias("id"))
    got = resolve.group_findings(rows)
    assert [(r.value, r.occurrences, r.sources, r.reason) for r in got.collect()] == [("A@b.es", 100_000, ["two", "one"], "r")]
    assert resolve.group_members(rows).count() == 100_000 and "items" not in got.columns


def test_a_thousand_profiles_in_one_plan(spark):
    profiles = [FLAT | {"id": f"flat-{i}", "name": f"Flat {i:04d}", "detection": {"all_terms": [f"emisor n{i:04d}", "factura"], "page_limit": 2}} for i in range(1000)]
    rows = [(7, 0, "Emisor N0042\nFactura FAC-7\nFecha : 01/02/2024\nCliente: 9\nBASE IMPONIBLE 10,00\nTOTAL IVA 21,00 %\nTOTAL FACTURA 12,10"), (7, 1, "SVC 3 2,00 5,00 10,00 EUR"), (8, 0, "Emisor desconocido"), (9, 2, "Emisor N0001 factura")]
    began = time.perf_counter()
    analysed, lines, rest = invoices.analyse_all(spark.createDataFrame(rows, "doc_id long, page_index int, text string"), profiles)
    got = [(r.doc_id, r.provider, r.verdict, float(r.taxable_base)) for r in analysed.collect()]
    assert got == [(7, "Flat 0042", "ok", 10.0)] and [float(r.amount) for r in lines.collect()] == [10.0] and sorted(r.doc_id for r in rest.collect()) == [8, 9]
    assert time.perf_counter() - began < 60


def test_headers_are_read_in_runs_of_one_profile(spark):
    pages = spark.createDataFrame([(1, "flat-demo", 0, "x")], "doc_id long, profile_id string, page_index int, text string")
    plan = invoices._headers(pages, invoices._with_specs(pages, [FLAT, GROUPED]))._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate(key=[profile_id" in plan


def test_made_payloads_read_their_items_once(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 1, 2.0, 10.5)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = payloads(spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert [(r.page_no, r.payload is None, r.raw_text is None, r.errors) for r in made.orderBy("page_no").collect()] == [(1, False, True, []), (2, True, False, [])]


def test_allowlist_as_a_table(spark):
    rows = detect.as_findings(detect.detect_rules(docs(spark, "Madrid, Vigo y Toledo")))
    allowed = spark.createDataFrame([(" MADRID ",), ("vigo",), (" ",), (None,)], "value string")
    assert [r.value for r in detect.filter_allowlist(rows, allowed).collect()] == ["Toledo"]


def test_aliases_by_appearance_or_text(spark):
    rows = docs(spark, "\n".join(["x"] * 2 + ["a@b.es"] + ["x"] * 7 + ["c@d.es"]))
    _, groups = redact.analyse(rows)
    by = lambda order: {r.value: r.alias for r in resolve.assign_aliases(groups.drop("alias"), order).collect()}
    assert by("appearance") == {"a@b.es": "[EMAIL_01]", "c@d.es": "[EMAIL_02]"} and by("lexicographic") == {"c@d.es": "[EMAIL_01]", "a@b.es": "[EMAIL_02]"}


def test_office_files(spark):
    def archive(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/"), text)
        return out.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hola </w:t></w:r><w:r><w:t>mundo</w:t></w:r></w:p><w:tbl><w:tr>{cell('Pasaporte')}{cell('PA-123456')}</w:tr></w:tbl></w:body></w:document>"
    files = spark.createDataFrame([("a.docx", archive(**{"word__document.xml": body, "word__media__i.png": "x"})), ("b.pdf", b"%PDF-1.7 x"), ("c.docx", b"%PDF-1.7 x"), ("d.txt", b"hola"), ("e.pptx", b"")], "name string, content binary").withColumn("size", F.length("content").cast("long"))
    parts = bl.ooxml_parts(files)
    got = sorted((r.block_index, r.label, r.text, r.location_id) for r in bl.ooxml_blocks(parts).collect())
    assert got == [(0, "Documento", "Hola mundo", "word/document.xml:paragraph[0]"), (1, "Documento", "Pasaporte", "word/document.xml:paragraph[1]"), (2, "Documento · Pasaporte", "PA-123456", "word/document.xml:paragraph[2]")]
    assert {r.name: r.verdict for r in bl.intake_audit(files, parts).collect()} == {"a.docx": "ok", "b.pdf": "ok", "c.docx": "wrong_extension", "d.txt": "unknown_format", "e.pptx": "empty"}
    assert [(r.name, r.kind) for r in bl.coverage_issues(parts, "name").collect()] == [("a.docx", "image")]
    labelled = redact.anonymise(bl.ooxml_blocks(parts).drop("name"))
    assert "[PASS_01]" in {r.text for r in labelled.collect()}


def test_parts_of_many_files_leave_a_task_together():
    def content(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("word/document.xml", text)
        return out.getvalue()

    def batches(texts):
        files = pd.DataFrame([(str(i), content(t)) for i, t in enumerate(texts)], columns=["name", "content"])
        return list(bl._unzip(bl.EXPANDED_LIMIT)(iter([files])))

    small, large = batches(["<x/>"] * 500), batches(["x" * bl._TOGETHER] * 3 + ["<x/>"])
    assert [len(b) for b in small] == [500] and [len(b) for b in large] == [1, 1, 1, 1]


def test_linked_objects_are_coverage_issues(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    part = lambda body: f"<w:document {ns}>{body}</w:document>"
    bodies = {"a": '<w:p><a:blip r:link="rId1"/></w:p>', "b": "<w:p><w:object/></w:p>", "c": "<w:altChunk/>", "d": '<w:p><a:blip r:embed="rId1"/><w:t>object</w:t></w:p>', "e": "<w:object"}
    rows = [(k, "word/document.xml", part(v)) for k, v in bodies.items()] + [("a", "word/header1.xml", part("<w:object/>")), ("f", "word/styles.xml", part("<w:object/>")), ("g", "ppt/slides/slide1.xml", part("<w:object/>"))]
    parts = spark.createDataFrame(rows, "name string, part string, xml string")
    got = {r.name: r for r in bl.coverage_issues(parts, "name").collect()}
    assert {k: (r.kind, r.blocking, r.parts) for k, r in got.items()} == {"a": ("linked_object", True, 2), "b": ("linked_object", True, 1), "c": ("linked_object", True, 1), "e": ("unreadable_part", True, 1)}
    assert got["a"].id == hashlib.sha256(b"linked_object:word/document.xml:word/header1.xml").hexdigest()[:18]


def test_templates(spark):
    rows = [("t", "p0", 0, "Hola "), ("t", "p0", 1, "{{ cli"), ("t", "p0", 2, "ente }}"), ("u", "p0", 0, "{{ b }} y {{ a"), ("u", "p0", 1, " }}{{ c"), ("u", "p0", 2, "}}"), ("v", "p0", 0, "nada")]
    runs = spark.createDataFrame(rows, "template_id string, location string, run_index int, text string")
    cut = templates.split_placeholders(runs).where("template_id = 't'").first()
    assert (cut.variable, cut.run_texts, cut.preview) == ("cliente", ["{{ cli", "ente }}"], "Hola {{ cliente }}")
    fixed = {(r.template_id, r.run_index): (r.text, r.merges) for r in templates.repair_split_placeholders(runs).collect()}
    assert fixed[("t", 1)] == ("{{ cliente }}", 1) and fixed[("t", 2)][0] == "" and fixed[("u", 0)] == ("{{ b }} y {{ a }}{{ c}}", 2)
    assert {r.template_id: (r.issues, r.n_variables, r.ready) for r in templates.template_readiness(runs).collect()} == {"t": (1, 1, False), "u": (2, 3, False), "v": (0, 0, False)}
    seen = {r.template_id: r.variables for r in templates.template_variables(runs, "seen").collect()}
    assert seen["u"] == ["b", "a", "c"]
    paragraphs = spark.createDataFrame([("t", "p", "{{a}}-{{ b }}-{{c}}")], "template_id string, location string, text string")
    contexts = spark.createDataFrame([(1, {"a": "{{ b }}", "b": None, "z": "x"})], "context_id long, ctx map<string,string>")
    assert templates.render_templates(paragraphs, contexts).first().text == "{{ b }}--"


DETAIL = "a@x.es 10,00 EUR\nSERVICIO UNO 2 1,00 EUR\nCertificado 2 0,5000 EUR 1,00 EUR\nOTRO 1 1,00 EUR\nUnidad 1 1,00 EUR 1,00 EUR\nb@x.es 2,00 EUR\nSERVICIO UNO 3 1,50 EUR\nUnidad 3 0,5000 EUR 1,40 EUR"


def test_grouped_lines(spark):
    profile = GROUPED | {"lines": GROUPED["lines"] | {"service_names": ["servicio uno"]}}
    pages = spark.createDataFrame([(1, 0, "x"), (1, 1, DETAIL)], "doc_id long, page_index int, text string")
    got = invoices.invoice_lines(pages, profile).orderBy("line_id").collect()
    assert [(r.line_id, r.user, r.quantity, r.amount, r.confidence) for r in got] == [("line-1", "a@x.es", Decimal(2), Decimal("1.00"), 0.99), ("line-2", "b@x.es", Decimal(3), Decimal("1.40"), 0.75)]
    header, _ = invoices.invoice_analysis(pages, profile)
    assert header.first().verdict.startswith("missing:invoice_number")


def test_a_pattern_is_asked_once_for_a_line_whatever_is_asked_of_the_lines(spark):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_index int, text string")
    found = invoices.lines_grouped(pages, GROUPED).where(F.col("comment") == invoices.MISMATCH).groupBy("doc_id").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Certificado") == 1 and plan.count("[^\\s]+@") == 1


def test_lines_between_blanks_marks_and_other_rows(spark):
    profile = GROUPED | {"lines": GROUPED["lines"] | {"project_reference_pattern": r"Ref: (?P<project_reference>\w+)"}}
    text = "\u2003a@x.es 1,00 EUR\u00a0\n\nRef: R1\r\nServicio 2,00 1.234,50 EUR\nRef: R2\n nada \nUnidad 2,00 10,50 EUR 1.234,50 EUR\u00a0\nOTRO 1,00 2,00 EUR\nUnidad 1,00 2,00 EUR 2,00 EUR\nServicio 1,00 ..,5 EUR\nUnidad 1,00 2,00 EUR 2,00 EUR"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, ""), (4, 0, text), (5, 1, text.partition("\n")[2])], "doc_id long, page_index int, text string")
    got = invoices.lines_grouped(pages, profile).orderBy("doc_id", "row").collect()
    assert [(r.doc_id, r.row, r.user, r.service, str(r.amount), r.confidence, r.project_reference) for r in got] == [(1, 6, "a@x.es", "Servicio", "1234.500000", 0.99, "R1"), (1, 10, "a@x.es", "Servicio", "2.000000", 0.75, "R2")]
    text = "Ref: proyecto 7\nSVC 1 1,00 2,50 2,50 EUR\nSVC 2 1,00 2,50 x EUR\nSVC 3 1,00 ,.2 1.000 EUR Ref: proyecto 8"
    got = invoices.lines_flat(spark.createDataFrame([(1, 1, text)], "doc_id long, page_index int, text string"), FLAT).collect()
    assert [(r.row, r.service, str(r.unit_price), r.project_reference, r.confidence) for r in got] == [(1, "SVC 1", "2.500000", "7", 0.95)]


def test_reconcile_and_export(spark):
    lines = spark.createDataFrame([(1, "line-1", "u", "s", Decimal("1"), Decimal("53.63"), Decimal("53.63"), "pending", ""), (2, "line-1", "u", "s", Decimal("1"), Decimal("53.63"), Decimal("53.63"), "accepted", "")], "doc_id long, line_id string, user string, service string, quantity decimal(18,6), unit_price decimal(18,6), amount decimal(18,6), status string, comment string").withColumn("project_reference", F.lit(""))
    bases = spark.createDataFrame([(1, Decimal("53.63"), "d"), (2, Decimal("54.00"), "d"), (3, Decimal("0"), "d")], "doc_id long, taxable_base decimal(18,6), invoice_date string")
    assert {r.doc_id: (float(r.absolute_difference), r.matches) for r in invoices.reconcile(bases, lines).collect()} == {1: (0.0, True), 2: (0.37, False), 3: (0.0, True)}
    assert {r.doc_id: r.verdict for r in invoices.export_gate(lines, False).collect()} == {1: "confirmation_needed", 2: "ok"}
    assert [(r.line_id, float(r.amount)) for r in invoices.export_accepted(bases, lines).orderBy("is_total").collect()] == [("line-1", 53.63), ("total", 53.63)]
    changed, rejects = invoices.update_lines(lines, spark.createDataFrame([(1, "line-1", Decimal("-1")), (2, "line-1", Decimal("2")), (2, "line-7", Decimal("2"))], "doc_id long, line_id string, amount decimal(18,6)"))
    assert {r.doc_id: float(r.amount) for r in changed.collect()} == {1: 53.63, 2: 2.0} and sorted(r.reject for r in rejects.collect()) == ["negative_number", "unknown_line"]


def test_profiles(spark, tmp_path, monkeypatch):
    import json

    for folder, profile in (("base", FLAT), ("user", FLAT | {"name": "Mío"}), ("user", GROUPED | {"id": "../fuera"})):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{len(list((tmp_path / folder).iterdir()))}.json").write_text(json.dumps(profile))
    catalog = pf.provider_catalog(spark, f"{tmp_path}/base", f"{tmp_path}/user")
    assert [(r.id, r.name, r.built_in) for r in catalog.collect()] == [("flat-demo", "Mío", False)]
    saved = pf.save_profiles(spark, catalog, f"{tmp_path}/saved")
    twice = catalog.withColumns({"name": F.lit("Otro"), "seq": F.lit(2)}).union(catalog.withColumns({"name": F.lit("Antes"), "seq": F.lit(1)}))
    again = pf.save_profiles(spark, twice, f"{tmp_path}/saved")
    assert [r.name for r in saved.collect()] == ["Mío"] and [r.name for r in again.collect()] == ["Otro"] and again.columns == saved.columns
    # A call that fails before or after it has written leaves the table as it was.
    broken = catalog.withColumn("name", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        pf.save_profiles(spark, broken, f"{tmp_path}/saved")
    monkeypatch.setattr(pf, "_point", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        pf.save_profiles(spark, catalog.withColumn("name", F.lit("Nunca")), f"{tmp_path}/saved")
    assert [r.name for r in pf.load_profiles(spark, f"{tmp_path}/saved").collect()] == ["Otro"]
    assert pf.java_pattern(r"(?P<a>x)(?P<unit_price>y)(?P=a)") == (r"(?iuU)(x)(y)\1", {"a": 1, "unit_price": 2})


def test_drafts(spark):
    head = '{"provider":"P","invoice_number":"A-1","invoice_date":"1/1/24","customer_code":"7","customer_name":"C","currency":"eur","total":"121,00","taxes":[{"tax_type":"IVA","rate":"21","base":"100","tax_amount":"21"}]}'
    body = '{"invoice_number":"a-1","lines":[{"service":"S","project":null,"reference":"r","quantity":2,"unit_price":"50,00","amount":"100,00"}]}'
    rows = [(1, 1, head, None), (1, 2, None, body), (2, 1, head.replace("A-1", "A-7"), None), (2, 2, None, body.replace('"amount":"100,00"', '"amount":"n/a"')), (3, 1, None, "no json")]
    got = {r.doc_id: r for r in drafts.invoice_draft(spark.createDataFrame([(*r, []) for r in rows], "doc_id long, page_no int, payload string, raw_text string, errors array<string>")).collect()}
    assert got[1].ready and got[1].currency == "EUR" and float(got[1].taxable_base) == 100 and float(got[1].tax_rate) == 21 and got[1].missing == []
    assert not got[2].ready and got[2].pending == 1 and got[2].warnings[0] == "Valores contradictorios para invoice_number: p.1: A-7, p.2: a-1."
    assert not got[3].ready and "lines" in got[3].missing and got[3].warnings == ["Página 1: Docling no devolvió JSON válido."]


def test_a_draft_reads_only_what_is_asked_of_it(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 1, 2.0, 10.5)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = lambda name: QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert all("Falta el importe" not in plan(name) and "contradictorios" not in plan(name) for name in ("missing_fields", "draft_checks"))
    assert "Falta el importe" in plan("ready_for_mapping")


def test_items_of_a_draft_are_those_of_its_lines(spark):
    item = '{"service": "A", "quantity": 2, "unit_price": "1.234,50", "amount": 2469.0, "x": {"y": [1]}}'
    items = ["[]", "null", "7", '"[]"', f"[{item}]", f"[{item}, 5, null, {item}]", f'["{{}}", "", {item}]', f"{item}", '[{"amount": "x"}, {"amount": " (5,25) "}, {}]', "\"[{'amount': '3'}]\"", '"[1, 2"', '"[{\\"amount\\": \\"1\\"}, NaN]"']
    rows = [(n, 1, f'{{"lines": {x}, "taxes": {x}}}', None, []) for n, x in enumerate(items)]
    raws = ["{'a': 1}", '{"a": NaN}', '{"a": 1} x', "{", "[]", "x", "", " {} ", '{"a": 1, "a": 2}', None]
    rows += [(100 + n, 1, None, x, ["roto", ""]) for n, x in enumerate(raws)]
    made = spark.createDataFrame(rows, "doc_id long, page_no int, payload string, raw_text string, errors array<string>")
    pages = drafts.parse_payload(made)
    lines = {r.doc_id: (float(r.line_total), r.complete, r.pending, r.line_warnings) for r in drafts.line_totals(drafts.draft_lines(pages)).collect()}
    got = {r.doc_id: (float(r.line_total), r.complete, r.pending, r.line_warnings) for r in drafts.invoice_draft(made).collect()}
    assert got == {n: lines.get(n, (0.0, 0, 0, 0)) for n, *_ in rows} and got[5][:3] == (4938.0, 2, 2)
    assert {r.doc_id for r in pages.where("size(page_warnings) = 2").collect()} == {103, 105} | ({100, 101} if spark.sql("select try_parse_json(\"{'a': 1}\") is null").first()[0] else set())
    assert {r.doc_id for r in drafts.invoice_draft(made).where("array_contains(missing, 'lines')").collect()} == {n for n, *_ in rows if n not in lines}


def test_registry_in_batch_and_stream(spark, tmp_path):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [("o1", "A@x.es", "Ana", True, t[0]), ("o1", "a@X.es", "", True, t[2]), ("o1", "a@x.es", "Ana B", True, t[1]), ("", "b@x.es", "B", True, t[0]), ("o9", "z@x.es", "Z", False, t[0]), ("o8", None, "N", True, t[0])]
    schema = "oid string, email string, name string, authenticated boolean, ts timestamp"
    events = spark.createDataFrame(rows, schema)
    want = {("o1", "a@x.es", "Ana B", t[0], t[2]), ("b@x.es", "b@x.es", "B", t[0], t[0])}
    assert {tuple(r) for r in registry.observed_users(events).collect()} == want
    assert [r.key for r in registry.users_by_recency(registry.observed_users(events)).collect()] == ["o1", "b@x.es"]
    events.write.parquet(f"{tmp_path}/in")
    seen = {}
    query = observed_users_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda batch, _: seen.update({r.key: tuple(r) for r in batch.collect()}), f"{tmp_path}/state")
    query.awaitTermination(120)
    assert set(seen.values()) == want


def test_identities_are_forgotten(spark, tmp_path):
    schema = "oid string, email string, name string, authenticated boolean, ts timestamp"
    start = datetime(2024, 1, 1)
    for day in range(0, 60, 10):  # each batch is ten days on, with its own twenty users and one of all batches
        own = [(f"d{day}-{i}", f"d{day}-{i}@x.es", f"N{i}", True, start + timedelta(days=day)) for i in range(20)]
        spark.createDataFrame([*own, ("all", "all@x.es", None if day else "Ana", True, start + timedelta(days=day, hours=1))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    users, sizes = {}, []
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = observed_users_stream(events, lambda batch, _: users.update({r.key: tuple(r) for r in batch.collect()}), f"{tmp_path}/state", forget_after_days=15)
    query.awaitTermination(240)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(users) == 121 and users["all"] == ("all", "all@x.es", "Ana", start + timedelta(hours=1), start + timedelta(days=50, hours=1))
    assert max(sizes) <= 81 and sizes[-1] <= 61  # of 121 identities
    frame = lambda *rows: spark.createDataFrame(rows, "key string, email string, name string, first_seen_at timestamp, last_seen_at timestamp")
    merged = registry.merge_users(frame(("k", "old@x.es", "Old", start, start)), frame(("k", "new@x.es", None, start + timedelta(1), start + timedelta(2))))
    assert [tuple(r) for r in merged.collect()] == [("k", "new@x.es", "Old", start, start + timedelta(2))]


def test_redact_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.es y c@d.es y A@b.es"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    query = redact_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "[EMAIL_01] y [EMAIL_02] y [EMAIL_01]", 2: None}


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['vellum.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op1') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0

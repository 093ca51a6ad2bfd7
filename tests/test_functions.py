"""Column functions on literal cases."""

import re
import time
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import checks, numbers
from vellum.functions import text as tx
from vellum.functions.chunks import cuts, text_chunks
from vellum.functions.spans import replace_spans, spans


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "check,value,ok",
    [
        (checks.valid_dni, "12345678-Z", True), (checks.valid_dni, "12345678-A", False), (checks.valid_dni, None, None), (checks.valid_dni, "", False),
        (checks.valid_nie, "X2482300-W", True), (checks.valid_nie, "X2482300-A", False),
        (checks.valid_iban_es, "ES91 2100 0418 4502 0005 1332", True), (checks.valid_iban_es, "ES00 2100 0418 4502 0005 1332", False),
        (checks.valid_luhn, "4111 1111 1111 1111", True), (checks.valid_luhn, "4111 1111 1111 1112", False), (checks.valid_luhn, "0000 0000 0000 0000", False),
        (checks.valid_tax_id, "A58818501", True), (checks.valid_tax_id, "A58818502", False), (checks.valid_tax_id, "12345678Z", True),
        (checks.valid_ip, "192.168.0.1", True), (checks.valid_ip, "192.168.0.256", False), (checks.valid_ip, "192.168.00.1", False),
        (checks.valid_swift, "CAIXESBBXXX", True), (checks.valid_swift, "CONTACTO", False),
        (checks.valid_passport, "PA-123456", True), (checks.valid_passport, "ABCDEF", False), (checks.valid_passport, "AAAAAA", False),
    ],
)
def test_checks(spark, check, value, ok):
    assert one(spark, check(F.lit(value).cast("string"))) is ok


@pytest.mark.parametrize("value,want", [("1.234,56 €", "1234.56"), ("$1,234.56", "1234.56"), ("0,4900 EUR", "0.49"), ("(42,50)", "-42.5"), ("21", "21"), (None, None), ("1.234", "1234"), ("0.123", "0.123"), ("1.234.567", "1234.567"), ("n/a", None), ("x", None), ("−5", "-5"), ("1'000,50", "1000.5")])
def test_parse_decimal(spark, value, want):
    assert one(spark, numbers.parse_decimal(F.lit(value).cast("string"))) == (None if want is None else Decimal(want))


def test_three_readings_of_one_number(spark):
    v = F.lit("1.234")
    assert [float(one(spark, f(v))) for f in (numbers.decimal_es, numbers.money_number, numbers.parse_decimal)] == [1.234, 1234, 1234]


def test_canonical_values(spark):
    same = [one(spark, tx.canonical_value(F.lit("MONEY"), F.lit(v))) for v in ("1.234,56 €", "EUR 1 234,56")]
    assert same == ["1234.56:eur"] * 2
    assert one(spark, tx.canonical_value(F.lit("MONEY"), F.lit("dos millones de euros"))) == "2000000:eur"
    assert {one(spark, tx.canonical_value(F.lit("ORGANIZATION"), F.lit(v))) for v in ("Ácme Consultoría, S.L.", "ACME CONSULTORIA SL", "Acme Consultoría S L")} == {"acmeconsultoria"}


def test_snippets_and_names(spark):
    assert one(spark, tx.context_snippet(F.lit("a" * 100 + "\nX" + "b" * 100), F.lit(101), F.lit(102))) == "…" + "a" * 63 + " X" + "b" * 64 + "…"
    assert one(spark, tx.output_filename(F.lit("C:\\x\\informe.final.PDF"), "anonimizado")) == "informe.final_anonimizado.pdf"
    assert one(spark, tx.alias_token(F.lit("LOCALITY"), F.lit(3))) == "[LOC_03]"
    assert one(spark, tx.accentless(F.lit("ÁÉñß"))) == "aenß"


@given(st.text(alphabet="ab1 2\nñé😀", max_size=40))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_spans_are_those_of_a_search(spark, text):
    import re

    for pattern in (r"[ab]+\d", r"ñ|😀", r"(?<![0-9])[0-9]+"):
        got = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), pattern).alias("s")).first().s
        assert [(s.start, s.end, s.value) for s in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]


@given(st.text(alphabet="ab \n", max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_chunks_cover_the_text(text, size, overlap):
    found = cuts(text, size, min(overlap, size // 3))
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(b - a <= size for a, b in found)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a < c and b <= d and (c <= b or b == len(text))
        blanks = [i for i in range(a + size // 2, a + size) if text[i] in " \n"]
        assert b == (blanks[-1] if blanks and blanks[-1] > a else a + size)


def test_chunks_of_a_table(spark):
    rows = [(1, "uno dos " * 600), (2, None), (3, ""), (4, "corto")]
    got = text_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.offset, r.chunk) for r in got} == {(d, a, t[a:b]) for d, t in rows if t is not None for a, b in cuts(t, 1800, 240)}


def test_spans_in_marked_texts_and_many_matches(spark):
    texts = ["", "1 2", "\ufdd0 12 \ufdd0\ufdd13", "7 " * 3000, "\U0001f600 5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert all([(x.start, x.end, x.value) for x in r.s] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r.t)] for r in got)


def test_folds_keep_offsets_and_unify_forms(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first().x
    assert one(tx.accentless, "İİ ÁÑ ﬁ 日本ÿ") == "ii an ﬁ 日本y" and one(tx.same_length_lower, "İÁ") == "iá"
    assert one(tx.fold, " ＡＢ１\u00a0ﬁn STRASSE straße e\u0301 ½") == "ab1 fin strasse strasse é 1⁄2" and one(tx.ascii_digits, "٣४９x") == "349x"


def test_letters_that_fold_to_several_make_no_label(spark):
    got = [one(spark, tx.is_structural_label(F.lit(v))) for v in ("nieß", "Nie\u1e9e", "\ufb01n nie", "NIE:", "Teléfono ", "\uff24\uff2e\uff29")]
    assert got == [False, False, False, True, True, True]


def test_plain_numbers_and_texts_are_read_as_others(spark):
    values = ["1.234,56", "-1.234.567,8", "1234,5", "12", "1.234", "1,234", "0,125", "1.23,45", "12.34", "1234.567,8", "1.234,5678", "(5,25)", " 7,5 ", "\u22123,5", "7.", ",5", "NA", "n/a", "", "na1"]
    got = [None if (x := one(spark, numbers.parse_decimal(F.lit(v)))) is None else str(x.normalize()) for v in values]
    assert got == ["1234.56", "-1234567.8", "1234.5", "12", "1234", "1234", "0.125", "123.45", "12.34", "1234567.8", "1234.5678", "-5.25", "7.5", "-3.5", "7", "0.5", None, None, None, "1"]
    texts = ["\u00a0None\n", "N/A", "nulo", "NULL", "Nadie ", "\ta b\u2003", "", " ", "7"]
    assert [one(spark, tx.optional_text(F.lit(v))) for v in texts] == [None, None, "nulo", None, "Nadie", "a b", None, None, "7"]


def test_lower_case_is_asked_of_no_plain_amount(spark):
    plan = spark.createDataFrame([("12,5",)], "v string").select(numbers.parse_decimal(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and plan.index("RLIKE") < plan.index("lower(")


def test_letters_that_fold_to_several_are_looked_up_in_a_table(spark):
    """Each is found wherever it stands, and text of other scripts is read at the pace of a table, not of a class of many letters."""
    rows = [(f"{a}{c}{b}",) for c, _ in tx.WIDER for a, b in (("x", ""), ("", "ñ"), ("日", "\U0001f600"))] + [(v,) for v in ("Ñandú", "", "abc", "\U0001f600", None)]
    got = spark.createDataFrame(rows, "v string").select("v", tx._wide(F.col("v")).alias("wide")).collect()
    assert all(r.wide == (None if r.v is None else any(c in r.v for c, _ in tx.WIDER)) for r in got)
    long = spark.range(1, numPartitions=1).select(F.repeat(F.format_string("Muñoz García, calle Año Ñandú %d ", "id"), 480_000).alias("v"))
    began = time.perf_counter()
    assert long.select(F.length(tx.bare(F.col("v")))).first()[0] == 25 * 480_000
    assert time.perf_counter() - began < 10

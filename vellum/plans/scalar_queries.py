"""Queries of the column functions, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import checks, numbers
from vellum.functions import text as tx
from vellum.plans.seeds import IDS, VALID, on_duckdb, on_spark

#: Printed numbers of every order, in a form that its key chooses.
NUMBERS = """
SELECT o_orderkey AS k, o_totalprice AS price,
  CASE o_orderkey % 8
    WHEN 0 THEN CAST(m AS STRING) || '.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ',' || c
    WHEN 1 THEN CAST(m AS STRING) || ',' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.' || c
    WHEN 2 THEN CAST(m AS STRING) || ',' || c
    WHEN 3 THEN CAST(m AS STRING) || '.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')
    WHEN 4 THEN CAST(m AS STRING)
    WHEN 5 THEN '0,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')
    WHEN 6 THEN ' ' || CAST(m AS STRING) || '.' || c || ' '
    ELSE 'n/a' END AS v
FROM (SELECT *, 1 + o_orderkey % 999 AS m, lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS c FROM {orders}) AS o
"""
WORDS = """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN u || ' mil ' || t || ' euros' WHEN 1 THEN u || ' euros' WHEN 2 THEN 'mil ' || u || ' dólares' ELSE u || ' millones de euros' END AS v, nu, nt
FROM (SELECT *, substring('dos   tres  cuatrocinco seis  ', CAST(o_orderkey % 5 * 6 + 1 AS INT), 6) AS u, 2 + o_orderkey % 5 AS nu,
             substring('veinte   treinta  cuarenta cincuenta', CAST(o_orderkey % 4 * 9 + 1 AS INT), 9) AS t, (2 + o_orderkey % 4) * 10 AS nt FROM {orders}) AS o
"""
TEXTS = "SELECT doc_id AS k, text AS v, CAST((length(text) - length(text) % 3) / 3 AS INT) AS s, CAST((length(text) - length(text) % 3) / 3 AS INT) + 5 AS e FROM {documents}"
NAMES = """
SELECT c_custkey AS k, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'C:' || chr(92) || 'dir' || chr(92) WHEN 1 THEN 'a/b/' ELSE '' END || c_name ||
  CASE c_custkey % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' WHEN 3 THEN '.pptx' ELSE '' END AS path,
  CASE c_custkey % 6 WHEN 0 THEN ' None ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN ' x y ' ELSE c_name END AS opt, c_custkey % 97 / 97.0 AS p
FROM {customer}
"""
KINDS = "'EMAIL', 'PERSON', 'LOCALITY', 'LOCATION', 'CUSTOMKIND', 'AGE'"
GAPS = "SELECT o_orderkey AS k, CAST(o_orderkey % 50 AS DECIMAL(18,6)) AS expected, CAST(o_orderkey % 50 + o_orderkey % 3 * 0.02 AS DECIMAL(18,6)) AS actual FROM {orders}"

def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _replaced(v: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        v = f"replace({v}, {_quoted(old)}, {_quoted(new)})"
    return v


_PLAIN = f"lower(replace(translate(v, {_quoted(tx.MARKED)}, {_quoted(tx.PLAIN)}), 'İ', 'I'))"
_USUAL = _replaced(f"translate(nfc_normalize(v), {_quoted(tx.FORMS)}, {_quoted(tx.USUAL)})", tx.WIDER)
_FOLD = rf"trim(regexp_replace(lower({_USUAL}), '[ \t\n\x0B\f\r\x85\x{{a0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"
_DEC_ES = r"TRY_CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.') ELSE t END AS DECIMAL(18,6))"
_PARSE = r"""CASE k % 8 WHEN 0 THEN m * 1000 + r + c / 100 WHEN 1 THEN m * 1000 + r + c / 100 WHEN 2 THEN m + c / 100 WHEN 3 THEN m * 1000 + r
  WHEN 4 THEN m WHEN 5 THEN r / 1000 WHEN 6 THEN m + c / 100 END"""
_MONEY = r"""CASE k % 8 WHEN 0 THEN m * 1000 + r + c / 100 WHEN 1 THEN m * 1000 + r + c / 100 WHEN 2 THEN m + c / 100 WHEN 3 THEN m * 1000 + r
  WHEN 4 THEN m WHEN 5 THEN r WHEN 6 THEN m + c / 100 END"""
_PARTS = "SELECT k, (1 + k % 999)::DECIMAL(18,6) AS m, (k % 1000)::DECIMAL(18,6) AS r, (k % 100)::DECIMAL(18,6) AS c FROM s"
_COLLAPSE = r"trim(regexp_replace(v, '[ \t\n\x0B\f\r]+', ' ', 'g'))"

Spec = tuple[str, Callable[[], dict[str, Column]], str]
c = F.col

#: Name: (seed, the columns on Spark, the SQL over the seed ``s`` on DuckDB).
SPECS: dict[str, Spec] = {
    "valid_dni": (IDS, lambda: {"value": c("dni"), "ok": checks.valid_dni(c("dni"))}, f"SELECT k, dni AS value, {VALID['dni']} AS ok FROM s"),
    "valid_nie": (IDS, lambda: {"value": c("nie"), "ok": checks.valid_nie(c("nie"))}, f"SELECT k, nie AS value, {VALID['nie']} AS ok FROM s"),
    "valid_iban_es": (IDS, lambda: {"value": c("iban"), "ok": checks.valid_iban_es(c("iban"))}, f"SELECT k, iban AS value, {VALID['iban']} AS ok FROM s"),
    "valid_luhn": (IDS, lambda: {"value": c("card"), "ok": checks.valid_luhn(c("card"))}, f"SELECT k, card AS value, {VALID['card']} AS ok FROM s"),
    "valid_nss": (IDS, lambda: {"value": c("nss"), "ok": checks.valid_nss(c("nss"))}, f"SELECT k, nss AS value, {VALID['nss']} AS ok FROM s"),
    "valid_tax_id": (IDS, lambda: {"value": c("cif"), "ok": checks.valid_tax_id(c("cif"))}, f"SELECT k, cif AS value, {VALID['cif']} AS ok FROM s"),
    "valid_ip": (IDS, lambda: {"value": c("ip"), "ok": checks.valid_ip(c("ip"))}, f"SELECT k, ip AS value, {VALID['ip']} AS ok FROM s"),
    "valid_swift": (IDS, lambda: {"value": c("swift"), "ok": checks.valid_swift(c("swift"))}, f"SELECT k, swift AS value, {VALID['swift']} AS ok FROM s"),
    "valid_passport": (IDS, lambda: {"value": c("long_passport"), "ok": checks.valid_passport(c("long_passport"))}, f"SELECT k, long_passport AS value, {VALID['long_passport']} AS ok FROM s"),
    "context_snippet": (TEXTS, lambda: {"snippet": tx.context_snippet(c("v"), c("s"), c("e"))}, """
      SELECT k, CASE WHEN s > 64 THEN '…' ELSE '' END || replace(substr(v, greatest(0, s - 64) + 1, least(length(v), e + 64) - greatest(0, s - 64)), chr(10), ' ') || CASE WHEN e + 64 < length(v) THEN '…' ELSE '' END AS snippet FROM s"""),
    "finding_id": (TEXTS, lambda: {"id": tx.finding_id(F.lit("body:0"), F.lit("EMAIL"), c("s"), c("e"), F.substring(c("v"), c("s") + 1, F.lit(5)), F.lit("rules"))}, """
      SELECT k, substr(sha256('body:0:EMAIL:' || s || ':' || e || ':' || substr(v, s + 1, 5) || ':rules'), 1, 20) AS id FROM s"""),
    "fold": (TEXTS, lambda: {"folded": tx.fold(c("v"))}, f"SELECT k, {_FOLD} AS folded FROM s"),
    "accentless": (TEXTS, lambda: {"plain": tx.accentless(c("v"))}, f"SELECT k, {_PLAIN} AS plain FROM s"),
    "money_words": (WORDS, lambda: {"v": c("v"), "n": numbers.money_words(c("v"))}, "SELECT k, v, (CASE k % 4 WHEN 0 THEN nu * 1000 + nt WHEN 1 THEN nu WHEN 2 THEN 1000 + nu ELSE nu * 1000000 END)::BIGINT AS n FROM s"),
    "money_number": (NUMBERS, lambda: {"v": c("v"), "n": numbers.money_number(c("v")).cast("double")}, f"SELECT s.k, v, n FROM s JOIN (SELECT k, ({_MONEY})::DOUBLE AS n FROM ({_PARTS})) p ON s.k = p.k"),
    "canonical_value": (IDS, lambda: {"dni_key": tx.canonical_value(F.lit("ES_DNI"), c("dni")), "company_key": tx.canonical_value(F.lit("ORGANIZATION"), c("company")), "money_key": tx.canonical_value(F.lit("MONEY"), c("money")), "person_key": tx.canonical_value(F.lit("PERSON"), c("person"))}, r"""
      SELECT k, lower(replace(dni, '-', '')) AS dni_key, 'acme' || substr('abcdefghij', k % 10 + 1, 1) || 'consultores' AS company_key,
        regexp_replace(replace(replace(replace(money, ' EUR', ''), '.', ''), ',', '.'), '\.?0+$', '') || ':eur' AS money_key, trim(lower(person)) AS person_key FROM s"""),
    "group_id": (IDS, lambda: {"gid": tx.group_id(F.lit("EMAIL"), c("email"))}, "SELECT k, substr(sha256('EMAIL:' || email), 1, 18) AS gid FROM s"),
    "confidence_band": (NAMES, lambda: {"band": tx.confidence_band(c("p").cast("double"))}, "SELECT k, CASE WHEN p >= 0.95 THEN 'validated' WHEN p >= 0.75 THEN 'probable' ELSE 'review' END AS band FROM s"),
    "alias_token": (IDS, lambda: {"alias": tx.alias_token(F.element_at(F.array(*[F.lit(x) for x in KINDS.replace("'", "").split(", ")]), (c("k") % 6 + 1).cast("int")), c("k") % 150)}, """
      SELECT k, '[' || ['EMAIL', 'PERS', 'LOC', 'LOC', 'CUSTO', 'EDAD'][k % 6 + 1] || '_' || CASE WHEN k % 150 < 10 THEN '0' ELSE '' END || (k % 150) || ']' AS alias FROM s"""),
    "is_structural_label": (IDS, lambda: {"ok": tx.is_structural_label(F.element_at(F.array(*[F.lit(x) for x in ("Teléfono:", "DNI", "Ana", "CORREO ", "código", "Dirección")]), (c("k") % 6 + 1).cast("int")))}, "SELECT k, [true, true, false, true, false, true][k % 6 + 1] AS ok FROM s"),
    "non_entity_context": (IDS, lambda: {"ok": tx.non_entity_context(F.element_at(F.array(*[F.lit(x) for x in ("El proyecto interno se denomina Victoria.", "La fase se llama Victoria; sigue.", "Vive en la ciudad de     Victoria.", "Es un caso:              Victoria son nombres de proyecto.", "Negativo ambiguo.        Victoria.", "Negativo ambiguo con     Victoria.")]), (c("k") % 6 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in (32, 17, 25, 25, 25, 25)]), (c("k") % 6 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in (40, 25, 33, 33, 33, 33)]), (c("k") % 6 + 1).cast("int")))}, "SELECT k, [true, true, false, true, false, true][k % 6 + 1] AS ok FROM s"),
    "decimal_es": (NUMBERS, lambda: {"v": c("v"), "n": numbers.decimal_es(c("v")).cast("double")}, f"SELECT k, v, ({_DEC_ES})::DOUBLE AS n FROM (SELECT *, replace(trim(v), ' ', '') AS t FROM s)"),
    "parse_decimal": (NUMBERS, lambda: {"v": c("v"), "n": numbers.parse_decimal(c("v")).cast("double")}, f"SELECT s.k, v, n FROM s JOIN (SELECT k, ({_PARSE})::DOUBLE AS n FROM ({_PARTS})) p ON s.k = p.k"),
    "optional_text": (NAMES, lambda: {"v": tx.optional_text(c("opt"))}, "SELECT k, CASE WHEN lower(trim(opt)) NOT IN ('', 'null', 'none', 'n/a', 'na') THEN trim(opt) END AS v FROM s"),
    "within_tolerance": (GAPS, lambda: {"ok": numbers.within_tolerance(c("actual"), c("expected"))}, "SELECT k, CASE WHEN expected = 0 THEN actual = 0 ELSE abs(actual - expected) * 1000 <= expected END AS ok FROM s"),
    "money_2dp": (GAPS, lambda: {"v": numbers.money_2dp((c("k") % 1000 / 8).cast("decimal(18,3)")).cast("double")}, "SELECT k, round_even((k % 1000 / 8)::DECIMAL(18,3), 2)::DOUBLE AS v FROM s"),
    "output_filename": (NAMES, lambda: {"v": tx.output_filename(c("path"), "anonimizado")}, "SELECT k, name || '_anonimizado' || ['.docx', '.pdf', '.docx', '.pptx', '.docx'][k % 5 + 1] AS v FROM s"),
    "variable_label": (NAMES, lambda: {"v": tx.variable_label(F.concat(F.lit("fecha_de_"), c("name")))}, "SELECT k, 'Fecha de ' || lower(name) AS v FROM s"),
    "preview": (TEXTS, lambda: {"v": tx.preview(c("v"))}, f"SELECT k, CASE WHEN length(f) <= 160 THEN f ELSE substr(f, 1, 159) || '…' END AS v FROM (SELECT k, {_COLLAPSE} AS f FROM s)"),
    "coverage_id": (NAMES, lambda: {"v": tx.coverage_id(F.lit("image"), F.array(c("path"), c("name")))}, "SELECT k, substr(sha256('image:' || array_to_string(list_sort([path, name]), ':')), 1, 18) AS v FROM s"),
    "safe_name": (NAMES, lambda: {"v": tx.safe_name(c("path"))}, "SELECT k, string_split(replace(path, chr(92), '/'), '/')[-1] AS v FROM s"),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    seed, columns, _ = SPECS[name]
    return lambda spark, sf_dir: on_spark(spark, sf_dir, seed).select("k", *[v.alias(n) for n, v in columns().items()])


QUERIES = {name: _query(name) for name in SPECS}
ORACLES = {name: f"WITH s AS ({on_duckdb(seed)}) {sql}" for name, (seed, _, sql) in SPECS.items()}

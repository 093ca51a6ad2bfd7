"""Texts with identifiers, built by SQL from the test tables.

The corpus has few Spanish identifiers, so these are made of key columns; the same SQL
runs on Spark (tables in braces) and on DuckDB (without), which makes the expected
answers exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vellum.sources.scratch import spread

LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs much more a row than reading it, over all cores."""
    return spread(table(spark, sf_dir, name))


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL that names its tables in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def on_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _letter(n: str) -> str:
    return f"substring('{LETTERS}', CAST(({n}) % 23 + 1 AS INT), 1)"


def _pad(n: str, width: int) -> str:
    return f"lpad(CAST({n} AS STRING), {width}, '0')"


#: One row a customer: ``k`` and an identifier of each kind, right on even keys and mostly wrong on odd ones.
IDS = f"""
SELECT k, n,
  {_pad("n", 8)} || CASE WHEN k % 5 = 0 THEN '-' ELSE '' END || {_letter("n + k % 2")} AS dni,
  substring('XYZ', CAST(n % 3 + 1 AS INT), 1) || {_pad("n % 10000000", 7)} || {_letter("(n % 3) * 10000000 + n % 10000000 + k % 2")} AS nie,
  'ES' || {_pad("98 - ((n % 97) * " + str(10**18 % 97) + " + (b % 97) * " + str(10**6 % 97) + " + " + str(142800 % 97) + ") % 97 - k % 2", 2)} || {_pad("n", 8)} || {_pad("b", 12)} AS iban,
  '4' || {_pad("n", 8)} || {_pad("k", 6)} || CAST(k % 10 AS STRING) AS card,
  {_pad("(1 + n % 60) * 100000000 + n", 10)} || {_pad("((1 + n % 60) * 100000000 + n + k % 2) % 97", 2)} AS nss,
  substring('ABPQRSNWFG', CAST(k % 10 + 1 AS INT), 1) || {_pad("n % 10000000", 7)} || substring('0123456789ABCDEFGHIJ', CAST(n % 20 + 1 AS INT), 1) AS cif,
  CAST(n % 300 AS STRING) || '.' || CAST(k % 256 AS STRING) || '.0.' || CASE WHEN k % 7 = 0 THEN '0' ELSE '' END || CAST(k % 99 AS STRING) AS ip,
  'CAIX' || substring('ESFRQQDEZZ', CAST(k % 5 * 2 + 1 AS INT), 2) || 'BB' || CASE WHEN k % 3 = 0 THEN 'XXX' ELSE '' END AS swift,
  CASE WHEN k % 4 = 0 THEN 'ABCDEFG' WHEN k % 9 = 0 THEN '1111111' ELSE 'PA' || {_pad("n", 8)} END AS long_passport,
  CASE WHEN k % 4 = 0 THEN 'ABCDEFG' ELSE 'PA' || {_pad("n % 1000000", 6)} END AS passport,
  'user' || CAST(k AS STRING) || '@example.com' AS email,
  'https://example.com/' || CAST(n AS STRING) AS url,
  CAST(600000000 + n AS STRING) AS phone,
  {_pad("n % 10000", 4)} || ' ' || substring('BCDFGHJKLM', CAST(k % 8 + 1 AS INT), 3) AS plate,
  CAST(1 + n % 999 AS STRING) || '.' || {_pad("k % 1000", 3)} || ',' || {_pad("n % 100", 2)} || ' EUR' AS money,
  'nacido el ' || {_pad("1 + n % 28", 2)} || '/' || {_pad("1 + k % 12", 2)} || '/' || CAST(1950 + n % 50 AS STRING) AS birth,
  'edad: ' || CAST(18 + n % 80 AS STRING) || ' años' AS age,
  'Calle Mayor ' || CAST(1 + n % 200 AS STRING) AS address,
  'Acme' || substring('abcdefghij', CAST(k % 10 + 1 AS INT), 1) || ' Consultores S.L' AS company,
  'Ana ' || substring('GarcíaLópezxPérezxMartín', CAST(k % 4 * 6 + 1 AS INT), 6) AS person,
  substring('Madrid   BarcelonaPortugal Galicia  Españaxxx', CAST(k % 5 * 9 + 1 AS INT), 9) AS place
FROM (SELECT c_custkey AS k, c_custkey * 7919 % 100000000 AS n, c_custkey * 104729 % 1000000000000 AS b FROM {{customer}}) AS keys
"""

#: What makes each identifier valid, for DuckDB.
VALID = {
    "dni": f"substr('{LETTERS}', (replace(dni, '-', '')[1:8]::BIGINT % 23 + 1)::BIGINT, 1) = replace(dni, '-', '')[9:9]",
    "nie": f"substr('{LETTERS}', (translate(nie[1:1], 'XYZ', '012') || nie[2:8])::BIGINT % 23 + 1, 1) = nie[9:9]",
    "iban": f"((iban[5:12]::BIGINT % 97) * {10**18 % 97} + (iban[13:24]::BIGINT % 97) * {10**6 % 97} + 142800 + iban[3:4]::BIGINT) % 97 = 1",
    "card": "list_sum(list_transform(generate_series(1, len(card)), lambda i: CASE WHEN (len(card) - i) % 2 = 0 THEN card[i:i]::INT WHEN card[i:i]::INT > 4 THEN card[i:i]::INT * 2 - 9 ELSE card[i:i]::INT * 2 END)) % 10 = 0",
    "nss": "nss[1:2]::INT BETWEEN 1 AND 53 AND nss[1:10]::BIGINT % 97 = nss[11:12]::BIGINT",
    "ip": "list_bool_and(list_transform(string_split(ip, '.'), lambda p: p::INT <= 255 AND p::INT::VARCHAR = p))",
    "swift": "swift[5:6] IN ('ES', 'FR', 'DE')",
    "passport": "regexp_matches(passport, '[0-9]')",
    "long_passport": "len(long_passport) BETWEEN 6 AND 9 AND regexp_matches(long_passport, '[0-9]') AND len(list_distinct(string_split(long_passport, ''))) > 1",
    "cif": """(SELECT CASE WHEN regexp_matches(cif, '^[PQRSNW]') THEN cif[9:9] = substr('JABCDEFGHI', c + 1, 1)
        WHEN regexp_matches(cif, '^[ABEH]') THEN cif[9:9] = c::VARCHAR ELSE cif[9:9] IN (c::VARCHAR, substr('JABCDEFGHI', c + 1, 1)) END
      FROM (SELECT ((10 - (cif[3:3]::INT + cif[5:5]::INT + cif[7:7]::INT + list_sum(list_transform([2, 4, 6, 8], lambda i: cif[i:i]::INT * 2 // 10 + cif[i:i]::INT * 2 % 10))) % 10) % 10)::BIGINT AS c))""",
}

"""Numbers in text: three conventions that read ``1.234`` differently, kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import accentless, let, optional_text, trimmed

DECIMAL = "decimal(18,6)"

# Spanish number words.
UNITS = {
    "un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "veinte": 20, "treinta": 30, "cuarenta": 40,
    "cincuenta": 50, "cien": 100, "ciento": 100,
}
SCALES = {"mil": 1_000, "millon": 1_000_000, "millones": 1_000_000}


def money_words(v: Column) -> Column:
    """The number that Spanish words say; null without such words."""
    units = F.create_map(*[F.lit(x) for k, n in UNITS.items() for x in (k, n)])
    scales = F.create_map(*[F.lit(x) for k, n in SCALES.items() for x in (k, n)])
    words = F.filter(F.regexp_extract_all(accentless(v), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(*UNITS, *SCALES))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("current"))

    def step(acc: Column, w: Column) -> Column:
        unit, scale = F.try_element_at(units, w), F.try_element_at(scales, w)
        return F.struct(
            F.when(scale.isNotNull(), acc["total"] + F.greatest(acc["current"], F.lit(1)) * scale).otherwise(acc["total"]).cast("long").alias("total"),
            F.when(scale.isNotNull(), F.lit(0)).otherwise(acc["current"] + unit).cast("long").alias("current"),
        )

    return F.when(F.size(words) > 0, F.aggregate(words, start, step, lambda acc: acc["total"] + acc["current"]))


def money_number(v: Column) -> Column:
    """The first number of an amount, in digits or else in words."""
    raw = F.regexp_replace(F.regexp_extract(v, r"(?U)\d[\d.,\s]*", 0), r"(?U)\s", "")
    comma, dot = F.length(raw) - F.locate(",", F.reverse(raw)), F.length(raw) - F.locate(".", F.reverse(raw))
    has_comma, has_dot = raw.contains(","), raw.contains(".")
    plain = (
        F.when(has_comma & has_dot & (comma > dot), F.translate(raw, ",.", "."))
        .when(has_comma & has_dot, F.replace(raw, F.lit(","), F.lit("")))
        .when(has_comma & (F.length(F.substring_index(raw, ",", -1)) <= 2), F.translate(raw, ",", "."))
        .when(has_comma, F.replace(raw, F.lit(","), F.lit("")))
        .when(has_dot & (F.length(F.substring_index(raw, ".", -1)) > 2), F.replace(raw, F.lit("."), F.lit("")))
        .otherwise(raw)
    )
    return F.when(raw == "", money_words(v).cast("decimal(38,6)")).otherwise(plain.try_cast("decimal(38,6)"))


def money_key(folded: Column) -> Column:
    """``number:currency`` in plain digits without idle zeros; null if there is no number."""
    plain = accentless(folded)
    currency = (
        F.when(folded.contains("€") | plain.contains("eur"), "eur")
        .when(folded.contains("$") | plain.contains("usd") | plain.contains("dolar"), "usd")
        .when(folded.contains("£") | plain.contains("gbp") | plain.contains("libra"), "gbp")
        .otherwise("")
    )
    digits = F.regexp_replace(money_number(folded).cast("string"), r"\.?0+$", "")
    return F.concat(F.when(money_number(folded) == 0, "0").otherwise(digits), F.lit(":"), currency)


def decimal_es(v: Column) -> Column:
    """A printed number whose comma is decimal; without a comma, a dot is; null if it is none."""

    blank = lambda v: let(F.replace(v, F.lit(" "), F.lit("")), comma_decimal)
    # A cast leaves out ASCII white space itself, so only what it can't read has to be trimmed of others.
    return let(v, lambda v: F.coalesce(blank(v), F.when(v != "", blank(trimmed(v)))))


def comma_decimal(bare: Column) -> Column:
    """A number without blanks whose comma is decimal."""
    return F.when(bare.contains(","), F.translate(bare, ",.", ".")).otherwise(bare).try_cast(DECIMAL)


def _single(v: Column, mark: str) -> Column:
    """A number with one kind of separator: thousands or decimal."""
    parts = F.split(v, rf"\{mark}", -1)
    last, first = F.element_at(parts, -1), F.element_at(parts, 1)
    lead = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "")
    thousands = (F.length(last) == 3) & ~F.regexp_replace(first, r"^-+", "").isin("", "0")
    joined = F.array_join(parts, "")
    split = F.concat(lead, F.lit("."), last)
    return F.when(F.size(parts) == 2, F.when(thousands, joined).otherwise(split)).when(F.length(last).between(1, 4), split).otherwise(joined)


#: Numbers with a decimal comma or none, and dots only between whole groups before a comma: what they say is plain.
_PLAIN = r"\A-?(?:[0-9]+(?:,[0-9]{1,2})?|[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+)\z"


def parse_decimal(v: Column) -> Column:
    """A number in the common European and international forms; null if it is none."""

    def plain(bare: Column) -> Column:
        comma, dot = F.length(bare) - F.locate(",", F.reverse(bare)), F.length(bare) - F.locate(".", F.reverse(bare))
        has_comma, has_dot = bare.contains(","), bare.contains(".")
        return (
            F.when(has_comma & has_dot & (comma > dot), F.translate(bare, ",.", "."))
            .when(has_comma & has_dot, F.replace(bare, F.lit(","), F.lit("")))
            .when(has_comma, _single(bare, ","))
            .when(has_dot, _single(bare, "."))
            .otherwise(bare)
        )

    def signed(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, r"[^0-9,.()\-]", ""), r"^[()]+|[()]+$", "")
        negative = text.startswith("(") & text.endswith(")")
        return let(let(bare, plain), lambda n: F.when(negative & ~n.startswith("-"), F.concat(F.lit("-"), n)).otherwise(n))

    other = let(F.replace(optional_text(v), F.lit("−"), F.lit("-")), signed)
    return F.when(v.rlike(_PLAIN), F.translate(v, ",.", ".")).otherwise(other).try_cast(DECIMAL)


def within_tolerance(actual: Column, expected: Column, percent: float = 0.10) -> Column:
    """Whether two amounts agree within ``percent``; against 0 they must be equal."""
    gap = F.abs(actual - expected)
    return F.when(expected == 0, gap == 0).when(expected != 0, gap * 100 <= F.abs(expected) * F.lit(percent).cast("decimal(9,4)"))


def money_2dp(v: Column) -> Column:
    return F.bround(v, 2)

"""Control digits and shapes of identifiers (null in, null out)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import ascii_digits

# Control letters of identity numbers and of company numbers.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"


def _bare(v: Column, junk: str = r"(?U)[\s.-]") -> Column:
    return F.upper(F.regexp_replace(ascii_digits(v), junk, ""))


def _number(v: Column) -> Column:
    return v.try_cast("decimal(38,0)")


def _letter(number: Column, last: Column) -> Column:
    return F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1)) == last


def _if(shape: Column, then: Column) -> Column:
    return F.when(shape, then).when(~shape, F.lit(False))


def valid_dni(v: Column) -> Column:
    """Eight digits and their control letter, whatever blanks, dots or dashes are between."""
    v = _bare(v)
    return _if(v.rlike(r"^[0-9]{8}[A-Z]$"), _letter(_number(F.substring(v, 1, 8)), F.substring(v, 9, 1)))


def valid_nie(v: Column) -> Column:
    """X, Y or Z for 0, 1 or 2, seven digits and the same control letter."""
    v = _bare(v)
    digits = F.translate(F.substring(v, 1, 8), "XYZ", "012")
    return _if(v.rlike(r"^[XYZ][0-9]{7}[A-Z]$"), _letter(_number(digits), F.substring(v, 9, 1)))


def valid_iban_es(v: Column) -> Column:
    """Spanish IBAN: the number after moving ``ES`` and the check digits behind is 1 modulo 97."""
    v = _bare(v, r"(?U)[\s-]")
    moved = F.concat(F.substring(v, 5, 20), F.lit("1428"), F.substring(v, 3, 2))
    return _if(v.rlike(r"^ES[0-9]{22}$"), _number(moved) % 97 == 1)


def valid_luhn(v: Column) -> Column:
    """13 to 19 digits, not all alike, with a Luhn checksum; other characters do not count."""
    v = F.regexp_replace(ascii_digits(v), r"[^0-9]", "")
    return _if(F.length(v).between(13, 19) & ~v.rlike(r"^(.)\1*$"), F.call_function("luhn_check", v))


def valid_nss(v: Column) -> Column:
    """Social security number: province 1 to 53, the first ten digits modulo 97 are the last two."""
    v = F.regexp_replace(ascii_digits(v), r"[^0-9]", "")
    province, ten, check = (_number(F.substring(v, *at)) for at in ((1, 2), (1, 10), (11, 2)))
    return _if(F.length(v) == 12, province.between(1, 53) & (ten % 97 == check))


def valid_tax_id(v: Column) -> Column:
    """DNI, NIE, or a company number with the control its first letter asks for."""
    v = _bare(v, r"(?U)[\s./-]")
    digit = [F.substring(v, i, 1).try_cast("int") for i in range(2, 9)]
    doubled = [F.when(digit[i] > 4, digit[i] * 2 - 9).otherwise(digit[i] * 2) for i in (0, 2, 4, 6)]
    total = digit[1] + digit[3] + digit[5] + doubled[0] + doubled[1] + doubled[2] + doubled[3]
    control = (F.lit(10) - total % 10) % 10
    first, last = F.substring(v, 1, 1), F.substring(v, 9, 1)
    letter, figure = F.substring(F.lit(CIF_LETTERS), control + 1, F.lit(1)) == last, control.cast("string") == last
    company = F.when(first.rlike("[PQRSNW]"), letter).when(first.rlike("[ABEH]"), figure).otherwise(letter | figure)
    shape = v.rlike(r"^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$")
    return valid_dni(v) | valid_nie(v) | _if(shape, company)


def valid_ip(v: Column) -> Column:
    """A dotted quad of numbers up to 255 without leading zeros."""
    part = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return v.rlike(rf"^{part}(?:\.{part}){{3}}\z")


@lru_cache(maxsize=1)
def country_codes() -> str:
    """ISO 3166 alpha-2 codes as the JVM knows them, and XK, which banks use, each between blanks."""
    jvm = SparkSession.active()._jvm
    return " ".join(["", *sorted(jvm.java.util.Locale.getISOCountries()), "XK", ""])


def valid_swift(v: Column) -> Column:
    """8 or 11 characters whose fifth and sixth are a country."""
    v = F.upper(F.regexp_replace(v, r"(?U)\s", ""))
    return _if(v.rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"), F.lit(country_codes()).contains(F.concat(F.lit(" "), F.substring(v, 5, 2), F.lit(" "))))


def valid_passport(v: Column) -> Column:
    """6 to 9 letters or digits, with a digit and more than one character."""
    v = _bare(v, r"(?U)[\s-]")
    return v.rlike(r"^[A-Z0-9]{6,9}$") & v.rlike(r"[0-9]") & ~v.rlike(r"^(.)\1*$")

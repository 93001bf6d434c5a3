"""Barcodes, licence numbers and corporate numbers (FN-4 to FN-10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as C
from .fuzzy import once

#: Digits of five Indic scripts, zero to nine each.
INDIC_DIGITS = "०१२३४५६७८९" + "௦௧௨௩௪௫௬௭௮௯" + "౦౧౨౩౪౫౬౭౮౯" + "૦૧૨૩૪૫૬૭૮૯" + "০১২৩৪৫৬৭৮৯"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def normalize_indic_digits(text: Column) -> Column:
    return F.translate(text, INDIC_DIGITS, "0123456789" * 5)


def sanitize_digits(text: Column, map_d: bool = True, digits_only: bool = True) -> Column:
    """Letters that OCR confuses with digits become digits; then, if wanted, only digits stay."""
    out = F.translate(F.trim(text), "Oo" + "D" * map_d + "Ili|ZzSsbBgq", "00" + "0" * map_d + "111122556899")
    return F.regexp_replace(out, "[^0-9]", "") if digits_only else out


def gtin_check_digit(payload: Column) -> Column:
    """Check digit of 7, 11, 12 or 13 payload digits: weights 3 and 1 from the right, modulo 10."""
    # 13 digits are exact in a double, and so is the whole part of a quotient by a power of ten
    place = lambda n, k: F.pmod(F.floor(n / float(10**k)), F.lit(10))
    total = lambda n: reduce(lambda a, b: a + b, (place(n, k) * (1 if k % 2 else 3) for k in range(13)))
    sized = payload.rlike("^[0-9]+\\z") & F.length(payload).isin(7, 11, 12, 13)
    return once(F.when(sized, payload).try_cast("double"), lambda n: F.pmod(10 - F.pmod(total(n), F.lit(10)), F.lit(10)).cast("int"))


def gtin_valid(code: Column) -> Column:
    """GTIN-8, -12, -13 or -14 with a right check digit; anything else, null too, is not valid."""
    return once(code, _right_check_digit)


def _right_check_digit(code: Column) -> Column:
    sized = code.rlike("^[0-9]+$") & F.length(code).isin(8, 12, 13, 14)
    payload = F.left(code, F.length(code) - 1)
    return F.coalesce(sized & (gtin_check_digit(payload) == F.right(code, F.lit(1)).try_cast("int")), F.lit(False))


def with_gtin_valid(rows: DataFrame, code: str, name: str = "valid") -> DataFrame:
    """``rows`` with ``gtin_valid`` of column ``code`` as column ``name``, for tables of many codes.

    The number is a column of its own and the sum has neither lambda nor branch, so both are generated code.
    """
    text = F.col(code)
    numbered = rows.withColumn("__number", F.when(F.length(text).isin(8, 12, 13, 14) & text.rlike("^[0-9]+\\z"), text).try_cast("long"))
    # of a digit only the remainder by 10 counts, which the whole part of the quotient by its power of ten shares
    places = (F.call_function("div", F.col("__number"), F.lit(10**k).cast("long")) * F.lit(3 if k % 2 else 1).cast("long") for k in range(14))
    return numbered.withColumn(name, F.coalesce(reduce(lambda a, b: a + b, places) % 10 == 0, F.lit(False))).drop("__number")


def ean13_valid(code: Column) -> Column:
    return once(sanitize_digits(code), lambda clean: F.coalesce((F.length(clean) == 13) & _right_check_digit(clean), F.lit(False)))


def upca_valid(code: Column) -> Column:
    return once(sanitize_digits(code), lambda clean: F.coalesce((F.length(clean) == 12) & _right_check_digit(clean), F.lit(False)))


def validate_gs1(code: Column) -> Column:
    """struct: barcode, format, is_valid_checksum, is_india, country."""
    clean = F.regexp_replace(F.trim(F.coalesce(code, F.lit(""))), "[^0-9]", "")
    n = F.length(clean)
    names = {8: "GTIN-8 (EAN-8)", 12: "GTIN-12 (UPC-A)", 13: "GTIN-13 (EAN-13)", 14: "GTIN-14 (ITF-14)"}
    kind = F.when(F.coalesce(code, F.lit("")) == "", "NONE")
    for length, name in names.items():
        kind = kind.when(n == length, name)
    kind = kind.otherwise(F.concat(F.lit("Custom Barcode ("), n.cast("string"), F.lit(" digits)")))
    standard = n.isin(*names)
    india = standard & clean.startswith("890")
    country = F.when(F.coalesce(code, F.lit("")) == "", "Unknown").when(~standard, "Non-Standard").when(india, "India").otherwise(F.concat(F.lit("Prefix "), F.left(clean, F.lit(3))))
    return F.struct(clean.alias("barcode"), kind.alias("format"), gtin_valid(clean).alias("is_valid_checksum"), india.alias("is_india"), country.alias("country"))


def gs1_country(code: Column) -> Column:
    prefix = F.left(code, F.lit(3))
    return F.coalesce(F.try_element_at(_map(C.GS1_COUNTRIES), prefix), F.concat(F.lit("GS1 Region Prefix ("), prefix, F.lit(")")))


def barcode_score(code: Column, format: Column) -> Column:
    """Score of a decoded payload; null or empty is undetected, 30."""
    ean = format.isin("EAN13", "EAN_13") | (F.length(code) == 13)
    upc = format.isin("UPCA", "UPC_A") | (F.length(code) == 12)
    square = format.isin("QRCODE", "QR_CODE", "DATAMATRIX")
    known = F.when(ean, F.when(ean13_valid(code), 100).otherwise(45)).when(upc, F.when(upca_valid(code), 95).otherwise(50)).when(square, 98).otherwise(80)
    return F.when(F.coalesce(code, F.lit("")) == "", 30).otherwise(known)


def parse_fssai(number: Column) -> Column:
    """struct: valid, number, kind, state, year, registrar, serial, reason."""
    clean = F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")
    kind, state = F.left(clean, F.lit(1)), F.substring(clean, 2, 2)
    year = F.substring(clean, 4, 2).try_cast("int")
    name = F.try_element_at(_map(C.STATES), state)
    reason = (
        F.when(F.coalesce(number, F.lit("")) == "", "No FSSAI number provided.")
        .when(F.length(clean) != 14, F.concat(F.lit("FSSAI license must contain exactly 14 digits (found "), F.length(clean).cast("string"), F.lit(" digits).")))
        .when(~kind.isin("1", "2", "3"), F.concat(F.lit("Invalid FSSAI leading business classification digit '"), kind, F.lit("'. Must start with 1, 2, or 3.")))
        .when(name.isNull(), F.concat(F.lit("Invalid FSSAI state census code '"), state, F.lit("'. Must be between 01 and 37.")))
    )
    ok = reason.isNull()
    only = lambda c: F.when(ok, c)
    return F.struct(
        ok.alias("valid"), clean.alias("number"), only(F.try_element_at(_map(C.LICENSE_KINDS), kind)).alias("kind"), only(name).alias("state"),
        only(F.when(year <= 40, 2000 + year).otherwise(1900 + year)).alias("year"), only(F.substring(clean, 6, 3)).alias("registrar"), only(F.substring(clean, 9, 6)).alias("serial"), reason.alias("reason"),
    )


CIN = "^([LU])([0-9]{5})([A-Z]{2})((?:18|19|20)[0-9]{2})([A-Z]{3})([0-9]{6})$"


def parse_cin(number: Column) -> Column:
    """struct: valid, cin, listing, nic, state, year, entity, serial, reason."""
    clean = F.upper(F.regexp_replace(F.coalesce(number, F.lit("")), "[^A-Za-z0-9]", ""))
    part = lambda k: F.regexp_extract(clean, CIN, k)
    entity = F.coalesce(F.try_element_at(_map(C.ENTITIES), part(5)), F.concat(F.lit("Special Entity ("), part(5), F.lit(")")))
    reason = (
        F.when(F.coalesce(number, F.lit("")) == "", "No CIN string provided.")
        .when(F.length(clean) != 21, F.concat(F.lit("CIN must contain exactly 21 alphanumeric characters (found "), F.length(clean).cast("string"), F.lit(").")))
        .when(~clean.rlike(CIN), "CIN violates MCA standard structure.")
        .when(~part(3).isin(*C.STATE_LETTERS), F.concat(F.lit("Unrecognized MCA state code '"), part(3), F.lit("' in CIN.")))
    )
    ok = reason.isNull()
    only = lambda c: F.when(ok, c)
    return F.struct(
        ok.alias("valid"), clean.alias("cin"), only(F.when(part(1) == "L", "Listed Company (Public)").otherwise("Unlisted Company")).alias("listing"), only(part(2)).alias("nic"),
        only(part(3)).alias("state"), only(part(4).try_cast("int")).alias("year"), only(entity).alias("entity"), only(part(6)).alias("serial"), reason.alias("reason"),
    )

"""Golden cases of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from packproof.functions import constants as C
from packproof.functions import geometry, ids, patterns, text


def values(spark, column, *rows):
    """One value per row of (a, b, c, ...)."""
    names = [chr(97 + k) for k in range(len(rows[0]))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ["k", *names])
    return [r[0] for r in df.select("k", column.alias("v")).orderBy("k").select("v").collect()]


def test_check_digits(spark):
    codes = ["8901262010016", "8901262010017", "036000291452", "96385074", "12345", "", "89O1262010016"]
    digit = lambda c: (10 - sum(int(d) * (3 if k % 2 == 0 else 1) for k, d in enumerate(reversed(c[:-1])))) % 10
    want = [c.isdigit() and len(c) in (8, 12, 13, 14) and digit(c) == int(c[-1]) for c in codes]
    assert values(spark, ids.gtin_valid(F.col("a")), *[(c,) for c in codes]) == want
    rng = random.Random(1)
    payloads = ["".join(rng.choices("0123456789", k=rng.choice([7, 11, 12, 13]))) for _ in range(100)]
    made = values(spark, F.concat("a", ids.gtin_check_digit(F.col("a")).cast("string")), *[(p,) for p in payloads])
    assert all(values(spark, ids.gtin_valid(F.col("a")), *[(m,) for m in made]))


def test_barcode_score_reads_a_code_once(spark):
    """A repaired code stands in the plan once for each of the two kinds, not once for each digit."""
    scored = spark.createDataFrame([("89O1262010016\n",), ("8901262010016",), ("036000291452",), ("03600029145\n",), ("890126201001\n",), ("",), (None,)], "c string").select(ids.barcode_score(F.col("c"), F.lit("CODE")).alias("s"))
    assert [r[0] for r in scored.collect()] == [80, 100, 95, 50, 45, 30, 30]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2
    assert values(spark, ids.gtin_check_digit(F.col("a")), ("123456\n",), ("96385074",), ("9638507",), (None,)) == [None, None, 4, None]


def test_crosstalk_strips_once(spark):
    pruned = spark.createDataFrame([(None,)], "t string").select(text.prune_crosstalk(F.col("t")).alias("v"))
    assert pruned._jdf.queryExecution().optimizedPlan().toString().count("[a-zA-Z]+") == 1
    assert pruned.first()[0] == ""


def test_digit_repair(spark):
    repaired = values(spark, ids.sanitize_digits(F.col("a")), ("89O12lZSbBgq",), ("no digits",))
    assert repaired == ["890121256899", "01915"]
    assert values(spark, ids.sanitize_digits(ids.sanitize_digits(F.col("a"))), ("89O12lZSbBgq",)) == [repaired[0]]
    assert values(spark, ids.sanitize_digits(F.col("a"), map_d=False, digits_only=False), ("D0O",)) == ["D00"]
    assert values(spark, ids.normalize_indic_digits(F.col("a")), ("४०",), ("௧௨௩",), ("౯",), ("૭",), ("৫",)) == ["40", "123", "9", "7", "5"]


def test_licences(spark):
    rows = values(spark, ids.parse_fssai(F.col("a")), ("10012011000168",), ("50012011000168",), ("1991201100016",), ("19912011000168",), (None,))
    assert [r["valid"] for r in rows] == [True, False, False, False, False]
    assert rows[0]["state"].startswith("Central") and rows[0]["year"] == 2012
    cin = values(spark, ids.parse_cin(F.col("a")), ("L15140MH1933PLC002030",), ("L15140ZZ1933PLC002030",), ("X15140MH1933PLC002030",))
    assert [c["valid"] for c in cin] == [True, False, False] and cin[0]["year"] == 1933 and cin[0]["entity"] == "Public Limited Company"


def test_categories(spark):
    cases = [
        ("Rs40", "mrp"), ("Net Volume: 1 L", "quantity"), ("Exp: Jan 2026", "mfg_date"), ("Recycle this pack", "other"), ("Batch No: A12", "batch_number"), ("Ingredients: wheat", "ingredients"), ("Energy 250 kcal", "nutrition"),
        ("FSSAI Lic. No. 10012011000168", "license"), ("Consumer care 1800-266-0007", "helpline"), ("Marketed by Acme Pvt Ltd", "address"), ("शुद्ध मात्रा 100", "quantity"), ("अधिकतम खुदरा मूल्य", "mrp"), ("BISCUITS", "other"),
    ]
    assert values(spark, text.classify_line(F.col("a")), *[(t,) for t, _ in cases]) == [c for _, c in cases]


def test_word_boundaries_are_pythons(spark):
    import re

    for pattern, sample in ((C.MARATHI_SUFFIX, "पुलाची प्रसिद्ध"), (C.MARATHI_SUFFIX, "पुलाचीक"), (r"\bbis\b", "a bis"), (r"\bbis\b", "abisé"), (r"\b\d{2}\b", "x १२ y")):
        assert values(spark, patterns.has(F.col("a"), pattern), (sample,)) == [bool(re.search(pattern, sample, re.I))]


def test_scripts(spark):
    rows = values(spark, text.detect_script(F.col("a")), ("Hello",), ("शुद्ध मात्रा",), ("पुणे भेळ",), ("தமிழ்",), ("తెలుగు",), ("ગુજરાતી",), ("বাংলা",), ("",))
    assert [r["language"] for r in rows] == ["en", "hi", "mr", "ta", "te", "gu", "bn", "en"]


def test_readings(spark):
    assert values(spark, text.is_latin_hallucination(F.col("a"), F.lit(0.9)), ("RRTO",), ("||||",), ("MRP",), ("Biscuit",), ("",), ("12 g",)) == [True, True, False, False, True, False]
    assert values(spark, text.prune_crosstalk(F.col("a")), ("TTध",), ("BATCH NO:",), ("plain",)) == ["ध", "BATCH NO:", "plain"]
    best = values(spark, text.arbitrate(F.col("a"), F.col("b"), F.col("c"), F.col("d")), ("RRTO", 0.5, "शुद्ध", 0.8), ("Biscuit", 0.95, "बिस", 0.4))
    assert [b["text"] for b in best] == ["शुद्ध", "Biscuit"]


def test_signatures(spark):
    assert values(spark, text.normalize_digraphs(F.col("a")), ("Phavicol",), ("Daboor",), ("Safola",)) == ["favicol", "dabur", "safola"]
    assert values(spark, text.soundex_in(F.col("a")), ("BWB",), ("Amul",), ("",), ("Philips",)) == ["B100", "A540", "0000", "F412"]
    assert values(spark, text.normalize_homoglyphs(F.col("a")), ("Par1e-G",), ("Ámul",)) == ["parleg", "amul"]
    assert values(spark, text.brand_ngrams(F.col("a")), ("Dairy Milk",)) == [["dairy milk", "dairy", "milk"]]


def test_geometry(spark):
    row = values(spark, geometry.pdp_compliance(*(F.col(c) for c in "abcde")), (1000.0, 1500.0, 100.0, 10.0, 25.0))[0]
    assert (row["area_cm2"], row["required_mm"], row["compliant"]) == (150.0, 2.0, True)
    box = values(spark, geometry.unrotate_box(F.lit(10), F.lit(20), F.lit(30), F.lit(50), F.lit(180), F.lit(100), F.lit(200)), (1,))[0]
    assert tuple(box) == (70, 150, 90, 180)

"""Composite counterfeit risk (RUL-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import parse_cin, parse_fssai


def regulatory_faults(features: DataFrame) -> DataFrame:
    """scan_id, faults and notes: licence and corporate numbers on the package, of which faults break their syntax."""
    low, up = F.lower("value"), F.upper("value")
    fssai = F.regexp_extract("value", "(?<![A-Za-z0-9_])[1-3][0-9]{13}(?![A-Za-z0-9_])", 0)
    cin = F.regexp_extract(up, "(?<![A-Z0-9_])[LU][0-9]{5}[A-Z]{2}(?:18|19|20)[0-9]{2}[A-Z]{3}[0-9]{6}(?![A-Z0-9_])", 0)
    licensed = (F.col("category") == "fssai") | F.contains(low, F.lit("fssai"))
    company = F.contains(low, F.lit("cin")) | F.contains(low, F.lit("l1")) | F.contains(low, F.lit("u1"))
    # as lambda bodies the parsers stay out of the generated code, which has a size limit; the
    # generator keeps the parsed structs from being put in wherever a field of them is read
    once = lambda parse, number: F.get(F.transform(F.array(number), parse), F.lit(0))
    parsed = F.array(F.struct(F.when(licensed & (fssai != ""), once(parse_fssai, fssai)).alias("f"), F.when(company & (cin != ""), once(parse_cin, cin)).alias("c")))
    # few lines are about numbers at all, and only those make structs; as a filter the test would
    # work the value out again wherever it reads it
    rows = features.select("scan_id", "pos", F.inline(F.when(licensed | company, parsed)))
    bad = lambda p: F.coalesce(~F.col(f"{p}.valid"), F.lit(False)).cast("int")
    said = {"f": "FSSAI licence number has a valid form.", "c": "Corporate identity number has a valid form."}
    notes = F.array_compact(F.array(*(F.when(bad(p) == 1, F.concat(F.lit("REGULATORY ANOMALY: "), F.col(f"{p}.reason"))).when(F.col(f"{p}.valid"), F.lit(good)) for p, good in said.items())))
    marked = rows.select("scan_id", (bad("f") + bad("c")).alias("n"), F.struct("pos", notes.alias("notes")).alias("x")).filter(F.size("x.notes") > 0)
    return marked.groupBy("scan_id").agg(F.sum("n").alias("faults"), F.flatten(F.array_sort(F.collect_list("x"))["notes"]).alias("notes"))


def counterfeit_risk(signals: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Score 1..100, verdict, factors and anomalies per scan.

    ``signals``: scan_id, detected, valid, country_mismatch, other_maker, is_spoof, critical,
    brand_confidence, print_score, gamut_score, hologram_score, violations, blurry, focus.
    Missing values read as: not detected, no mismatch, genuine, 78, 85, 80, 0, sharp, 200.
    """
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in signals.columns else F.lit(default)
    faults = regulatory_faults(features) if features is not None else None
    rows = signals.join(faults, "scan_id", "left") if faults is not None else signals.withColumns({"faults": F.lit(0), "notes": F.lit(None).cast("array<string>")})
    n = F.coalesce("faults", F.lit(0))
    detected, valid, mismatch, other = get("detected", False), get("valid", False), get("country_mismatch", False), get("other_maker", False)
    spoof = get("is_spoof", False)
    critical = get("critical", False) | (get("brand_confidence", 0.75) >= 0.90)
    soft = get("blurry", False) | (get("focus", 200.0) < 80.0)
    acuity, gamut, violations = get("print_score", 78), get("gamut_score", 85), get("violations", 0)
    checks = [
        (detected & ~valid, 40.0, "Barcode failed the check digit."),
        (detected & valid & mismatch, 25.0, "Barcode prefix does not match the national prefix."),
        (detected & valid & other, 20.0, "Barcode belongs to another manufacturer than the brand."),
    ]
    score = sum((F.when(test, points).otherwise(0.0) for test, points, _ in checks), F.lit(0.0))
    score += F.when(spoof, F.when(critical, 75.0).otherwise(35.0) * F.when(soft, 0.60).otherwise(1.0)).otherwise(0.0)
    score += n * 15.0
    tail = [(~soft & (acuity < 45), 10.0, "Low typographic edge acuity."), (gamut < 48, 8.0, "Colour gamut departs from the master."), (violations >= 3, 8.0, "Several statutory declarations are missing.")]
    score += sum((F.when(test, points).otherwise(0.0) for test, points, _ in tail), F.lit(0.0))
    final = F.least(F.lit(100), F.greatest(F.lit(1), F.bround(score).cast("int")))
    located = F.when(~detected, F.lit("Barcode not located on this panel; it may be on another.")).when(valid, F.lit("Barcode has a valid check digit."))
    notes = [located] + [F.when(test, note) for test, _, note in checks] + [F.when(spoof, F.lit("HIGH RISK: brand mimics a registered one."))]
    late = [F.when(soft, F.lit("Camera focus is low: print acuity does not count."))] + [F.when(test, note) for test, _, note in tail]
    barcode = F.when(~detected, 70).when(~valid, 15).when(other, 40).when(mismatch, 35).otherwise(98)
    factors = F.struct(
        barcode.alias("barcode"), F.when(~spoof, 96).when(critical, 5).otherwise(20).alias("brand"), F.greatest(F.lit(10), 95 - 30 * n).cast("int").alias("regulatory"),
        F.when(soft, F.greatest(acuity, F.lit(75))).otherwise(acuity).cast("int").alias("print"), gamut.cast("int").alias("gamut"), get("hologram_score", 80).cast("int").alias("hologram"),
    )
    out = rows.select("scan_id", final.alias("score"), factors.alias("factors"), F.array_compact(F.concat(F.array(*notes), F.coalesce("notes", F.array().cast("array<string>")), F.array(*late))).alias("anomalies"))
    verdict = F.when(F.col("score") <= 25, "AUTHENTIC").when(F.col("score") <= 55, "SUSPECTED_COUNTERFEIT").otherwise("CRITICAL_COUNTERFEIT")
    seal = F.when(F.col("score") <= 25, "INTACT").when(F.col("score") <= 55, "SUSPICIOUS").otherwise("BROKEN_TAMPERED")
    return out.withColumns({"verdict": verdict, "seal": seal})

"""Projections that build records: boxes, scans, violations, reports (PRJ, SET)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_MAKER = "Registered Packager / Importer"
NO_BARCODE = "No barcode detected"
NO_PRODUCT = "Packaged FMCG Commodity"
FINE = 25_000
BAD = ("FAIL", "ISSUE")


def flatten_boxes(scans: DataFrame) -> DataFrame:
    """One row per box of nested ``panels`` (side, boxes: array of id, label, category, value, confidence, status, script)."""
    panels = scans.select("id", F.posexplode_outer("panels").alias("panel_pos", "panel"))
    boxes = panels.select("id", "panel_pos", F.col("panel.side").alias("side"), F.posexplode("panel.boxes").alias("box_pos", "b"))
    category = F.coalesce("b.category", F.lit("other"))
    return boxes.select(
        F.col("id").alias("scan_id"), "panel_pos", "side", "box_pos",
        F.coalesce("b.id", F.concat_ws("_", F.lit("box"), "side", category, F.col("box_pos").cast("string"))).alias("box_id"),
        F.coalesce("b.label", F.when(F.col("b.category").isNotNull(), F.replace(F.upper("b.category"), F.lit("_"), F.lit(" "))), F.lit("DECLARATION")).alias("label"),
        category.alias("category"), F.coalesce("b.value", F.lit("")).alias("value"),
        F.coalesce("b.confidence", F.lit(0.95)).alias("confidence"), F.coalesce("b.status", F.lit("PASS")).alias("status"),
        F.coalesce("b.script", F.lit("Latin (English)")).alias("script"),
    )


def build_scan_records(features: DataFrame, evals: DataFrame) -> DataFrame:
    """Per scan: manufacturer (first address), batch (from the first date) and notes on failing rules."""
    first = lambda c: F.min_by("value", F.when(F.col("category") == c, F.col("pos")))
    own = features.groupBy("scan_id").agg(first("address").alias("address"), first("mfg_date").alias("date"))
    failing = evals.filter(F.col("status").isin(*BAD)).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rule_pos", "title"))).alias("bad"))
    stamp = F.regexp_replace("date", "[^A-Za-z0-9]", "")
    notes = F.array_join(F.transform("bad", lambda x: F.concat(x["title"], F.lit(" is non-compliant or missing."))), " ")
    return own.join(failing, "scan_id", "left").select(
        "scan_id", F.coalesce(F.nullif("address", F.lit("")), F.lit(NO_MAKER)).alias("manufacturer"),
        F.when(stamp != "", F.concat(F.lit("PKG-"), stamp)).alias("batch_number"),
        F.coalesce(notes, F.lit("All statutory declarations meet LMPC Rules 2011 and FSSAI schedule requirements.")).alias("notes"),
    )


def first_word(text: Column) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(1))


def first_failure(evals: DataFrame) -> DataFrame:
    """WIN-2: title and clause of the first failing rule of each scan."""
    bad = evals.filter(F.col("status").isin(*BAD))
    return bad.groupBy("scan_id").agg(F.min_by(F.struct("title", "clause", "rule_code"), "rule_pos").alias("f")).select("scan_id", "f.*")


def derive_violations(scans: DataFrame, evals: DataFrame) -> DataFrame:
    """One pending violation per non-compliant scan."""
    bad = scans.filter(F.col("verdict") == "NON-COMPLIANT")
    found = bad.join(first_failure(evals).withColumnRenamed("scan_id", "id"), "id", "left")
    return found.select(
        F.concat(F.lit("VIO-"), F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 12)).alias("id"), F.col("id").alias("scan_id"), "product_name",
        F.coalesce(F.nullif(first_word(F.col("product_name")), F.lit("")), F.lit("Packaged Commodity")).alias("brand"),
        F.coalesce("clause", F.lit("General Provision")).alias("clause"), F.coalesce("title", F.lit("Unknown Compliance Defect")).alias("title"),
        F.lit("HIGH").alias("severity"), F.lit("PENDING_NOTICE").alias("status"), F.col("scan_date").alias("detected_date"),
        F.coalesce(F.nullif(F.col("penalty").cast("long"), F.lit(0)), F.lit(FINE)).cast("long").alias("fine"),
    )


def initials(entity: Column) -> Column:
    words = F.filter(F.split(F.trim(entity), "\\s+"), lambda w: w != "")
    two = F.concat(F.substring(words[0], 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1))
    return F.upper(F.when(F.size(words) > 1, two).otherwise(F.substring(F.get(words, F.lit(0)), 1, 2)))


def location_of(maker: Column, default: str = "Northern Metrology Zone - Sector 4") -> Column:
    """The last two comma-separated parts, where there are several."""
    parts = F.split(maker, ",")
    return F.when(F.size(parts) > 1, F.trim(F.concat_ws(",", F.slice(parts, -2, 2)))).otherwise(default)


def report_id(scan_id: Column) -> Column:
    return F.concat(F.lit("REP-"), F.regexp_replace(scan_id, "^INS-", ""))


def scan_reports(scans: DataFrame) -> DataFrame:
    """Regulatory report rows made from scans."""
    bad, review = F.col("verdict") == "NON-COMPLIANT", F.col("verdict") == "UNDER_REVIEW"
    maker = F.when(F.coalesce("manufacturer", F.lit("")).isin("", NO_MAKER), F.coalesce(F.nullif("product_name", F.lit("")), F.lit("Packaged Commodity"))).otherwise(F.col("manufacturer"))
    return scans.select(
        report_id(F.col("id")).alias("id"), maker.alias("subject_entity"), initials(maker).alias("initials"), "inspector_name",
        F.when(bad, "Surprise Audit").otherwise("Routine Inspection").alias("type"),
        F.when(bad, "Violation Found").when(review, "Pending Review").otherwise("Clear").alias("status"),
        location_of(F.col("manufacturer")).alias("location"), F.when(bad, "High").otherwise("Low").alias("severity"),
        F.coalesce(F.nullif(F.col("penalty").cast("long"), F.lit(0)), F.when(bad, FINE).otherwise(0)).cast("long").alias("fine"),
        F.col("id").alias("scan_id"), F.lit("SCAN").alias("source"),
    )


def all_reports(reports: DataFrame, scans: DataFrame, source: str = "ALL") -> DataFrame:
    """SET-1: institutional and scan reports in one table."""
    own = reports.withColumn("source", F.coalesce("source", F.lit("INSTITUTIONAL")))
    if source == "INSTITUTIONAL":
        return own
    made = scan_reports(scans)
    return made if source == "SCAN" else own.unionByName(made, allowMissingColumns=True)


def combine_panels(front: DataFrame, back: DataFrame) -> DataFrame:
    """SET-2: features of all panels; ``panel_pos`` keeps their order."""
    return front.withColumn("panel_pos", F.lit(0)).unionByName(back.withColumn("panel_pos", F.lit(1)), allowMissingColumns=True)


def rule_severity(rulebook: DataFrame) -> DataFrame:
    """PRJ-6: severity of a rule from its category and activity."""
    c = F.lower("category")
    level = F.when(c.rlike("price|mrp|mandatory|economy"), "CRITICAL").when(c.rlike("quantity|weight|standard|date"), "HIGH").otherwise("MEDIUM")
    return rulebook.select("code", "category", level.alias("severity"))


def register_unmatched(scans: DataFrame, matched: DataFrame) -> DataFrame:
    """PRJ-5: registry candidates for scans that match no registry row (``matched``: scan_id)."""
    fresh = scans.join(matched.select(F.col("scan_id").alias("id")), "id", "left_anti")
    return fresh.select(
        F.concat(F.lit("REG-"), "id").alias("id"), F.col("barcode").alias("sku"), "product_name", "batch_number", F.lit(1).cast("long").alias("scans_count"),
        F.when(F.col("verdict") == "NON-COMPLIANT", 0).otherwise(1).cast("long").alias("passed_count"), F.when(F.col("verdict") == "NON-COMPLIANT", "HIGH").otherwise("LOW").alias("risk"),
    )

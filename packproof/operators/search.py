"""Searches and filters over scans, violations, registry, logs, reports and people (FLT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the Indic blocks.
INDIC = "[\\u0900-\\u0D7F]"


def any_contains(columns: list[str], query: str) -> Column:
    """Some column holds ``query``, whatever its case; null columns do not."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower())), F.lit(False))
    return out


def _matches(df: DataFrame, columns: list[str], query: str, **equal: str) -> DataFrame:
    if query.strip():
        df = df.filter(any_contains(columns, query))
    for column, wanted in equal.items():
        if wanted != "ALL":
            df = df.filter(F.col(column) == wanted)
    return df


def search_scans(scans: DataFrame, verdict: str = "ALL", query: str = "") -> DataFrame:
    return _matches(scans, ["id", "product_name", "batch_number", "inspector_name", "category"], query, verdict=verdict)


def search_violations(violations: DataFrame, severity: str = "ALL", status: str = "ALL", query: str = "") -> DataFrame:
    return _matches(violations, ["product_name", "clause", "id"], query, severity=severity, status=status)


def search_registry(registry: DataFrame, query: str = "", category: str = "ALL", risk: str = "ALL", scan_status: str = "ALL") -> DataFrame:
    out = _matches(registry, ["product_name", "sku", "brand", "batch_number", "manufacturer", "id", "category"], query, category=category, risk=risk)
    count = F.coalesce(F.col("scans_count"), F.lit(0))
    if scan_status == "INSPECTED":
        out = out.filter(count > 0)
    elif scan_status == "PENDING":
        out = out.filter(count == 0)
    return out


#: A category also takes in logs whose action has one of these words.
ACTION_WORDS = {"AUTH": ["LOGIN", "AUTH"], "INSPECTION": ["SCAN"], "RULE_CHANGE": ["RULE"], "SECURITY": ["SEC", "SYS"]}


def search_audit_logs(logs: DataFrame, query: str = "", status: str = "ALL", category: str = "ALL") -> DataFrame:
    out = _matches(logs, ["action", "user_name", "target", "details"], query, status=status)
    if category != "ALL":
        own = F.coalesce(F.col("category") == category, F.lit(False))
        for word in ACTION_WORDS.get(category, []):
            own = own | F.coalesce(F.contains(F.upper("action"), F.lit(word)), F.lit(False))
        out = out.filter(own)
    return out


def search_reports(reports: DataFrame, query: str = "", type: str = "ALL", inspector: str = "ALL", source: str = "ALL") -> DataFrame:
    out = _matches(reports, ["id", "subject_entity", "inspector_name"], query, type=type, inspector_name=inspector)
    if source == "SCAN":
        out = out.filter(F.col("source") == "SCAN")
    elif source != "ALL":
        out = out.filter(F.coalesce(F.col("source"), F.lit("")) != "SCAN")
    return out


def search_inspectors(inspectors: DataFrame, query: str = "", status: str = "ALL") -> DataFrame:
    return _matches(inspectors, ["name", "id_badge", "zone"], query, current_status=status)


def search_rules(rulebook: DataFrame, query: str = "", category: str = "ALL") -> DataFrame:
    return _matches(rulebook, ["code", "title", "category"], query, category=category)


def multilingual_tokens(features: DataFrame) -> DataFrame:
    """Features flagged, labelled or written in an Indic script. Missing flag columns read as false."""
    flagged = F.col("is_multilingual") if "is_multilingual" in features.columns else F.lit(False)
    script = F.col("script") if "script" in features.columns else F.lit(None)
    labelled = F.coalesce(script.rlike("Hindi|Marathi|Tamil|Telugu|Gujarati|Bengali|Kannada|Malayalam|Gurmukhi|Odia|Devanagari"), F.lit(False))
    return features.filter(F.coalesce(flagged, F.lit(False)) | labelled | F.coalesce(F.col("value").rlike(INDIC), F.lit(False)))

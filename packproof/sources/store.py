"""Reading the nested document store and registries, and writing exports (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_ts
from ..lineage import cut
from ..operators.joins import norm_key
from .documents import array_elements, array_table

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BOX = _struct(id=_S, label=_S, category=_S, value=_S, confidence=_D, status=_S, script=_S)
#: The document's arrays, each a table.
STORE = {
    "scans": _struct(id=_S, timestamp=_S, productName=_S, category=_S, batchNumber=_S, barcode=_S, manufacturer=_S, overallVerdict=_S, complianceRate=_D, inspectorId=_S, inspectorName=_S, penaltyEstimateInr=_L, panels=T.ArrayType(_struct(side=_S, label=_S, boundingBoxes=T.ArrayType(BOX)))),
    "violations": _struct(id=_S, scanId=_S, productName=_S, clauseViolated=_S, ruleTitle=_S, severity=_S, status=_S, detectedDate=_S, fineAmountInr=_L),
    "rulebook": _struct(id=_S, code=_S, title=_S, category=_S, active=_B, minThreshold=_D, unit=_S, penaltySection=_S),
    "registry": _struct(id=_S, sku=_S, productName=_S, brand=_S, category=_S, batchNumber=_S, mfgDate=_S, expiryDate=_S, declaredMRP=_D, manufacturer=_S, riskScore=_S, complianceHistory=_struct(scansCount=_L, passedCount=_L, violationsCount=_L)),
    "inspectors": _struct(id=_S, name=_S, idBadge=_S, zone=_S, totalInspections=_L, reportsGenerated=_L, currentStatus=_S),
    "users": _struct(id=_S, name=_S, role=_S, badgeNumber=_S, jurisdiction=_S),
    "auditLogs": _struct(id=_S, timestamp=_S, userId=_S, userName=_S, action=_S, targetResource=_S, ipAddress=_S, status=_S, category=_S, details=_S),
    "reports": _struct(id=_S, subjectEntity=_S, type=_S, dateGenerated=_S, status=_S, location=_S, severityLevel=_S, fineAmountInr=_L, scanId=_S, source=_S),
}


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-1: the arrays of JSON documents as tables; absent arrays are empty, password fields are never read.

    ``list_pos`` keeps the order within an array. A document is read in pieces by many tasks.
    """
    elements = array_elements(spark, path)
    return {k: array_table(elements, k, v) for k, v in STORE.items()}


COMPANY = _struct(id=_S, name=_S, cin=_S, gs1Prefix=_S, fssaiLicense=_S, sector=_S, address=_S, customerCare=_S, brands=T.ArrayType(_S), spoofVariants=T.ArrayType(_struct(spoof=_S, target=_S, type=_S, risk=_S)))


def read_corporate_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-2: companies, company_brands and spoofs. Unusable numbers become null; a spoof text that is a genuine brand's key is left out."""
    rows = cut(array_table(array_elements(spark, path), "companies", COMPANY).withColumnRenamed("list_pos", "load_pos"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    companies = rows.select(
        F.col("id").alias("company_id"), "name", "load_pos", clean("gs1Prefix").alias("gs1_prefix"), "sector", "address", F.col("customerCare").alias("customer_care"),
        F.when(F.length(F.trim("cin")) >= 15, F.trim("cin")).alias("cin"), F.when(F.trim("fssaiLicense").rlike("^[0-9]{14}$"), F.trim("fssaiLicense")).alias("fssai"),
    )
    own = rows.select(F.col("id").alias("company_id"), "load_pos", F.explode("brands").alias("brand")).withColumn("brand", F.trim("brand")).filter("brand <> ''")
    genuine = companies.select(norm_key(F.col("name")).alias("key")).union(own.select(norm_key(F.col("brand")))).distinct()
    spoofs = rows.select(F.col("id").alias("company_id"), F.explode("spoofVariants").alias("s")).select("company_id", F.trim("s.spoof").alias("spoof"), "s.target", "s.type", F.coalesce("s.risk", F.lit("HIGH")).alias("risk"))
    spoofs = spoofs.filter("spoof <> ''").withColumn("key", norm_key(F.col("spoof"))).join(genuine, "key", "left_anti").drop("key")
    return {"companies": companies, "company_brands": own, "spoofs": spoofs}


#: Columns of a registry file, in order, and the names that they have here.
REGISTRY = {
    "SKU_Barcode": "sku", "Product_Name": "product_name", "Brand": "brand", "Category": "category", "Batch_Number": "batch_number", "Declared_MRP_INR": "declared_mrp", "Net_Quantity": "net_quantity",
    "Mfg_Date": "mfg_date", "Expiry_Date": "expiry_date", "Manufacturer_Address": "manufacturer", "FSSAI_License": "fssai", "Consumer_Care": "consumer_care", "Country_Of_Origin": "origin", "CIN": "cin",
    "Risk_Score": "risk", "Scans_Count": "scans_count", "Passed_Count": "passed_count", "Violations_Count": "violations_count", "Registered_Date": "registered_date",
}
#: What stands for missing fields of an imported row, in CSV and in JSON.
CSV_DEFAULTS = {"brand": "Imported Brand", "category": "Packaged Foods", "declared_mrp": "50", "net_quantity": "100 g", "expiry_date": "2027-12-31", "manufacturer": "Registered FMCG Packager", "origin": "India", "risk": "LOW"}
JSON_DEFAULTS = {"brand": "Registered Brand", "category": "Packaged Foods", "declared_mrp": "50", "net_quantity": "200 g", "expiry_date": "2027-12-31", "manufacturer": "Registered FMCG Packager / Importer", "origin": "India", "risk": "LOW"}
#: Names of an imported JSON item's fields.
ITEM = {"id": "id", "sku": "sku", "productName": "product_name", "brand": "brand", "category": "category", "batchNumber": "batch_number", "declaredMRP": "declared_mrp", "netQuantity": "net_quantity", "mfgDate": "mfg_date", "expiryDate": "expiry_date", "manufacturer": "manufacturer", "fssaiLicense": "fssai", "consumerCare": "consumer_care", "originCountry": "origin", "cin": "cin", "riskScore": "risk", "registeredDate": "registered_date"}


def imported(rows: DataFrame, as_of: str, defaults: dict[str, str]) -> DataFrame:
    """SRC-3: string rows with a sku and a product name, and what stands for missing fields; ``as_of`` (yyyy-MM-dd) is the day of the import.

    A price that is no number, or zero, is missing. Without a batch the row is of the day's batch.
    """
    day = {"mfg_date": as_of, "registered_date": as_of, "batch_number": "BATCH-" + as_of.replace("-", "")[-4:]}
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    filled = rows.select(*(F.coalesce(text(c), F.lit((day | defaults).get(c))).alias(c) for c in rows.columns))
    price = F.coalesce(F.nullif(F.col("declared_mrp").try_cast("double"), F.lit(0.0)), F.lit(float(defaults["declared_mrp"])))
    return filled.filter("sku is not null and product_name is not null").withColumn("declared_mrp", price).withColumns({c: F.lit(0).cast("long") for c in ("scans_count", "passed_count", "violations_count")})


def read_registry_csv(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Columns by position, as an export writes them; quoted commas are text. The corporate number of column 13 is not taken over."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in REGISTRY.values())).csv(path, header=True, enforceSchema=True, quote='"', escape='"')
    kept = [c for c in REGISTRY.values() if c not in ("cin", "scans_count", "passed_count", "violations_count", "registered_date")]
    return imported(raw.select(*kept), as_of, CSV_DEFAULTS)


def read_registry_json(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """An array of items, or one item a line; null in ``id`` where an item has none."""
    raw = spark.read.schema(", ".join(f"{k} string" for k in ITEM)).json(path, multiLine=True)
    return imported(raw.select(*(F.col(k).alias(c) for k, c in ITEM.items())), as_of, JSON_DEFAULTS)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def registry_rows(registry: DataFrame) -> DataFrame:
    """SNK-1: the nineteen columns of an export, as text; what ``registry`` lacks is empty, its origin India, counts 0."""
    absent = {"origin": "India", "scans_count": "0", "passed_count": "0", "violations_count": "0"}
    own = lambda c: F.col(c).cast("string") if c in registry.columns else F.lit(None).cast("string")
    return registry.select(*(F.coalesce(own(c), F.lit(absent.get(c, ""))).alias(name) for name, c in REGISTRY.items()))


def export_registry(registry: DataFrame, path: str) -> None:
    _csv(registry_rows(registry), path)


def export_registry_json(registry: DataFrame, path: str) -> None:
    """SNK-4."""
    registry.write.mode("overwrite").json(path)


def inspection_audit(scans: DataFrame, evals: DataFrame) -> DataFrame:
    """SNK-2: one row per scan with the price and quantity rules' statuses (NA without) and a score (5 if null)."""
    of = lambda code: F.max(F.when(F.col("rule_code") == code, F.col("status")))
    statuses = evals.groupBy(F.col("scan_id").alias("id")).agg(of("RL-MAND-007").alias("mrp_status"), of("RL-PHYS-012").alias("qty_status"))
    score = F.coalesce("counterfeit_score", F.lit(5)) if "counterfeit_score" in scans.columns else F.lit(5)
    joined = scans.join(statuses, "id", "left")
    return joined.select("id", "scan_date", "product_name", "verdict", F.coalesce("mrp_status", F.lit("NA")).alias("mrp_status"), F.coalesce("qty_status", F.lit("NA")).alias("qty_status"), score.alias("score"))


#: Columns of the other exports (SNK-3), and where they come from.
AUDIT_TRAIL = {"Log ID": "id", "Formatted Date & Time": "formatted", "Raw Timestamp": "ts_text", "User / Principal": "user_name", "Action Taken": "action", "Target Resource": "target", "Source IP": "ip_address", "Status": "status", "Details": "details"}
ROSTER = {"Name": "name", "Badge ID": "id_badge", "Total Inspections": "total_inspections", "Reports Generated": "reports_generated", "Current Status": "current_status", "Jurisdiction": "zone", "Email": "email", "Phone": "phone"}
REPORTS = {"Report ID": "id", "Origin": "source", "Subject Entity": "subject_entity", "Assessed Product": "product_name", "Type": "type", "Date Generated": "date_generated", "Inspector": "inspector_name", "Status": "status", "Fine INR": "fine", "Scan Ref": "scan_id"}


def _renamed(rows: DataFrame, names: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    own = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(*(F.coalesce(own(c), F.lit((defaults or {}).get(c, ""))).alias(name) for name, c in names.items()))


def audit_trail(logs: DataFrame) -> DataFrame:
    """The audit trail's export: times also as day, month and year with a twelve-hour clock."""
    return _renamed(logs.withColumn("formatted", F.date_format(parse_ts(F.col("ts_text")), "dd MMM yyyy, hh:mm:ss a")), AUDIT_TRAIL)


def roster(inspectors: DataFrame) -> DataFrame:
    return _renamed(inspectors, ROSTER)


def report_rows(reports: DataFrame) -> DataFrame:
    return _renamed(reports, REPORTS, {"source": "INSTITUTIONAL", "fine": "0"})


def export_audit_trail(logs: DataFrame, path: str) -> None:
    """SNK-3, as are the next two."""
    _csv(audit_trail(logs), path)


def export_roster(inspectors: DataFrame, path: str) -> None:
    _csv(roster(inspectors), path)


def export_reports(reports: DataFrame, path: str) -> None:
    _csv(report_rows(reports), path)

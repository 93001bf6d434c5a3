"""Library tables derived from the driver's star schema.

Each is one SELECT that Spark and DuckDB both understand, so a query and its oracle start
from the same rows. ``{name}`` stands for a source or another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PAD = "lpad(CAST(p_partkey AS STRING), 9, '0')"
_DIGITS = " + ".join(f"{3 if k % 2 else 1} * CAST(substr({_PAD}, {k}, 1) AS INT)" for k in range(1, 10))
_QTY = "CAST(CAST(l_quantity AS INT) AS STRING)"
_SHIP = "CAST(l_shipdate AS STRING)"

TABLES = {
    # one row per inspected package
    "scans": """
        SELECT 'INS-' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS scan_no, substr(CAST(o_orderdate AS STRING), 1, 10) AS scan_date,
          CASE o_orderstatus WHEN 'F' THEN 'NON-COMPLIANT' WHEN 'O' THEN 'COMPLIANT' ELSE 'UNDER_REVIEW' END AS verdict,
          p_name AS product_name, p_type AS category, 'B' || CAST(o_orderkey % 31 AS STRING) AS batch_number,
          CASE WHEN o_orderkey % 7 = 0 THEN 'No barcode detected' ELSE '890' || lpad(CAST(p_partkey AS STRING), 9, '0') || CAST(o_orderkey % 10 AS STRING) END AS barcode,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Registered Packager / Importer' WHEN o_orderkey % 4 = 1 THEN 'Acme Foods'
               ELSE 'Plot ' || CAST(o_orderkey % 13 AS STRING) || ', Sector ' || CAST(o_orderkey % 9 AS STRING) || ', City ' || CAST(o_custkey % 11 AS STRING) END AS manufacturer,
          p_brand AS brand, CASE WHEN o_custkey % 17 = 0 THEN 'SYSTEM-AUTO' ELSE 'IN-' || CAST(o_custkey AS STRING) END AS inspector_id,
          'Inspector ' || CAST(o_custkey AS STRING) AS inspector_name,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN (o_orderkey % 5) * 5000 ELSE 0 END AS penalty
        FROM {orders} JOIN {part} ON p_partkey = o_orderkey % (SELECT max(p_partkey) + 1 FROM {part})""",
    # classified lines; pos numbers the lines of a scan
    "features": f"""
        SELECT 'INS-' || CAST(l_orderkey AS STRING) AS scan_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
          CASE WHEN l_linestatus = 'F' THEN 'front' ELSE 'back_0' END AS side,
          CASE l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'quantity' WHEN 3 THEN 'address' WHEN 4 THEN 'mfg_date' WHEN 5 THEN 'helpline' WHEN 6 THEN 'license' ELSE 'other' END AS category,
          CASE
            WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'MRP Rs. ' || {_QTY} || '.00 (incl. of all taxes)'
            WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN 'MRP Rs. ' || {_QTY} || '.00'
            WHEN l_linenumber = 1 THEN 'printed on the seal'
            WHEN l_linenumber = 2 AND l_returnflag <> 'N' THEN 'Net Wt ' || {_QTY} || ' g'
            WHEN l_linenumber = 2 THEN 'one pack'
            WHEN l_linenumber = 3 AND l_returnflag <> 'N' THEN 'Packed by Acme Foods Pvt Ltd, Delhi 11000' || CAST(l_suppkey % 10 AS STRING)
            WHEN l_linenumber = 3 THEN 'somewhere'
            WHEN l_linenumber = 4 AND l_returnflag <> 'N' THEN 'PKD: ' || substr({_SHIP}, 6, 2) || '/' || substr({_SHIP}, 1, 4)
            WHEN l_linenumber = 4 THEN 'no stamp'
            WHEN l_linenumber = 5 AND l_returnflag <> 'N' THEN 'Customer care 1800 266 000' || CAST(l_suppkey % 10 AS STRING)
            WHEN l_linenumber = 5 THEN 'write to us'
            WHEN l_linenumber = 6 AND l_returnflag <> 'N' THEN 'Lic No 1' || lpad(CAST(l_partkey AS STRING), 13, '0')
            WHEN l_linenumber = 6 THEN 'approved'
            WHEN l_returnflag = 'R' THEN 'Ingredients: sugar, salt' WHEN l_returnflag = 'A' THEN 'Net Wt ' || {_QTY} || ' kg' ELSE 'Recycle this pack' END AS value,
          CASE WHEN l_tax < 0.01 THEN NULL ELSE 0.5 + l_discount * 4 END AS confidence
        FROM {{lineitem}}""",
    # outcome of one rule for one scan
    "evals": """
        SELECT 'INS-' || CAST(l_orderkey AS STRING) AS scan_id, min(l_linenumber) AS rule_pos,
          CASE l_linenumber WHEN 1 THEN 'RL-MAND-007' WHEN 2 THEN 'RL-PHYS-012' WHEN 3 THEN 'RL-AUTH-001' WHEN 4 THEN 'RL-MAND-003' WHEN 5 THEN 'RL-MAND-004' WHEN 6 THEN 'RL-LIC-005' ELSE 'RL-MAND-002' END AS rule_code,
          'Rule ' || CAST(l_linenumber AS STRING) AS title, 'Clause ' || CAST(l_linenumber AS STRING) AS clause,
          CASE min(l_returnflag) WHEN 'A' THEN 'FAIL' WHEN 'N' THEN 'PASS' ELSE 'ISSUE' END AS status
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "rulebook": """
        SELECT 'RL-' || CAST(p_partkey AS STRING) AS id, CASE p_partkey WHEN 0 THEN 'RL-MAND-007' WHEN 1 THEN 'RL-PHYS-012' WHEN 2 THEN 'RL-AUTH-001' WHEN 3 THEN 'RL-MAND-003' WHEN 4 THEN 'RL-MAND-004' ELSE 'RL-X-' || CAST(p_partkey AS STRING) END AS code,
          p_name AS title, p_type AS category, p_size % 3 > 0 AS active, CAST(p_size AS DOUBLE) AS min_threshold
        FROM {part}""",
    "registry": f"""
        SELECT 'REG-' || CAST(p_partkey AS STRING) AS id, p_partkey AS pos,
          '890' || {_PAD} || CAST((10 - (35 + {_DIGITS}) % 10) % 10 AS STRING) AS sku,
          p_name AS product_name, p_brand AS brand, p_type AS category, 'B' || CAST(p_partkey % 31 AS STRING) AS batch_number,
          '20' || lpad(CAST(20 + p_partkey % 6 AS STRING), 2, '0') || '-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15' AS mfg_date,
          '20' || lpad(CAST(22 + p_partkey % 6 AS STRING), 2, '0') || '-0' || CAST(1 + p_partkey % 9 AS STRING) || '-15' AS expiry_date,
          p_retailprice AS declared_mrp, 'Maker ' || CAST(p_partkey % 23 AS STRING) AS manufacturer,
          CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
          CAST(p_size % 6 AS BIGINT) AS scans_count, CAST(p_size % 4 AS BIGINT) AS passed_count
        FROM {{part}}""",
    "companies": """
        SELECT s_suppkey AS load_pos, 'C' || CAST(s_suppkey AS STRING) AS company_id, 'Company ' || n_name || ' ' || CAST(s_suppkey AS STRING) AS name,
          '890' || lpad(CAST(s_suppkey AS STRING), 4, '0') AS gs1_prefix,
          CASE WHEN s_suppkey % 3 = 0 THEN 'X' ELSE 'L' END || lpad(CAST(s_suppkey AS STRING), 5, '1') || CASE s_nationkey % 3 WHEN 0 THEN 'MH' WHEN 1 THEN 'DL' ELSE 'QQ' END || '19' || CAST(30 + s_suppkey % 60 AS STRING) || CASE s_nationkey % 2 WHEN 0 THEN 'PLC' ELSE 'ZZZ' END || lpad(CAST(s_suppkey AS STRING), 6, '0') AS cin,
          CAST(1 + s_suppkey % 4 AS STRING) || lpad(CAST(s_suppkey % 41 AS STRING), 2, '0') || lpad(CAST(s_suppkey % 99 AS STRING), 2, '0') || lpad(CAST(s_suppkey AS STRING), 9, '0') AS fssai
        FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey""",
    # barcode payloads per panel; every third check digit is wrong
    "barcodes": """
        SELECT 'INS-' || CAST(l_orderkey AS STRING) AS scan_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS panel_pos,
          l_quantity > 10 AS detected,
          CASE l_partkey % 5 WHEN 0 THEN '890' || lpad(CAST(l_suppkey AS STRING), 4, '0') || lpad(CAST(l_partkey AS STRING), 6, '0') WHEN 1 THEN '501234567890' WHEN 2 THEN '890123456789' ELSE '89O' || lpad(CAST(l_partkey AS STRING), 9, '0') END || CASE l_partkey % 7 WHEN 0 THEN '' ELSE CAST(l_suppkey % 10 AS STRING) END AS payload
        FROM {lineitem}""",
    "audit_logs": """
        SELECT 'LOG-' || CAST(event_id AS STRING) AS id, event_id AS log_no, substr(CAST(ts AS STRING), 1, 19) AS ts_text, CAST(user_id AS STRING) AS user_id, 'User ' || CAST(user_id AS STRING) AS user_name,
          upper(event_type) || CASE event_id % 5 WHEN 0 THEN '_LOGIN' WHEN 1 THEN '_SCAN' WHEN 2 THEN '_RULE' WHEN 3 THEN '_SYS' ELSE '' END AS action,
          CASE event_id % 3 WHEN 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS status, CASE event_id % 4 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'SECURITY' ELSE 'INSPECTION' END AS category,
          'res-' || CAST(event_id % 13 AS STRING) AS target, props AS details
        FROM {events}""",
    "frames": """
        SELECT CAST(user_id AS STRING) AS session, event_id AS frame_no, ts, value AS focus, CAST(event_id % 4 AS INT) AS categories FROM {events}""",
    "inspectors": """
        SELECT 'IN-' || CAST(c_custkey AS STRING) AS id_badge, c_name AS name, c_mktsegment AS zone, CAST(c_custkey % 40 AS BIGINT) AS total_inspections, CAST(c_custkey % 6 AS BIGINT) AS reports_generated,
          CASE c_custkey % 3 WHEN 0 THEN 'In Field' WHEN 1 THEN 'In Lab' ELSE 'On Leave' END AS current_status, 90.0 + c_custkey % 10 AS stored_accuracy
        FROM {customer}""",
    "reports": """
        SELECT 'REP-' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'INS-' || CAST(c_custkey AS STRING) END AS scan_id, c_name AS subject_entity,
          CASE c_custkey % 2 WHEN 0 THEN 'Surprise Audit' ELSE 'Routine Inspection' END AS type, CASE c_custkey % 3 WHEN 0 THEN 'Clear' ELSE 'Violation Found' END AS status,
          'Inspector ' || CAST(c_custkey % 50 AS STRING) AS inspector_name, CASE c_custkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity,
          CAST(c_custkey % 7 AS BIGINT) * 1000 AS fine, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'INSTITUTIONAL' END AS source
        FROM {customer}""",
    # a text per document and a predicted class from its words
    "labelled": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS expected,
          CASE WHEN text LIKE '%stupid%' OR text LIKE '%trash%' OR text LIKE '%idiot%' THEN 'toxic' WHEN length(text) > 300 THEN 'good' ELSE 'poor' END AS predicted
        FROM {documents} JOIN {labels} USING (doc_id)""",
}
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: What a derived table joins and what grows with the data: met by a merge join, for a small file may hold more rows than the driver can broadcast.
MERGED = {"scans": "part", "labelled": "labels"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source or derived table as a DataFrame."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    needed = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{([a-z]\w*)\}", text))}
    if grows := MERGED.get(name):
        needed[grows] = needed[grows].hint("merge")
    return spark.sql(text, **needed)


def oracle(body: str) -> str:
    """DuckDB SQL: ``body`` over the derived tables that it names in braces."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name in TABLES and name not in order:
                visit(TABLES[name])
                order.append(name)

    visit(body)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t)
    ctes = ", ".join(f"{n} AS ({plain(TABLES[n])})" for n in order)
    body = plain(body).strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"

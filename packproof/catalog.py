"""Registered queries of the library's operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .derive import oracle, table
from .functions import constants as C
from .functions import dates, fuzzy, geometry, ids, text
from .lineage import fresh_path
from .operators import boxes, joins, layout, metrics, ranking, records, search
from .plans import brands as brand_plans
from .plans import risk, rules, workloads
from .sources import store
from .streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (t, spark, sf_dir), t(name) being a derived or source table."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


def derived(t, sql: str) -> DataFrame:
    """Rows of a SELECT over tables named in braces, as in ``derive``."""
    named = {n: t(n) for n in set(re.findall(r"\{([a-z]\w*)\}", sql))}
    return next(iter(named.values())).sparkSession.sql(sql, **named)


#: In DuckDB the tests that the derived values can meet, in plain patterns.
_EVALS = r"""WITH fv AS (SELECT *, regexp_matches(value, '^MRP Rs') AS price, regexp_matches(value, 'incl\.') AS taxed, regexp_matches(value, '[0-9] k?g$') AS unit, regexp_matches(value, '^Packed by') AS place, (regexp_matches(value, '^PKD:') OR regexp_matches(value, '^MRP Rs')) AS dated, regexp_matches(value, '^Customer care') AS care, regexp_matches(value, '^Lic No') AS licence, regexp_matches(value, '^Ingredients') AS contents FROM {features}),
 tiers AS (
  SELECT 'eval_mrp' AS eval_id, 1 AS rule_pos, 25000 AS money, *, CASE WHEN category IN ('mrp', 'other') AND price AND taxed THEN 0 WHEN category IN ('mrp', 'other') AND price THEN 1 WHEN category = 'mrp' THEN 2 END AS tier, list_position(['mrp', 'other'], category) AS place_no FROM fv
  UNION ALL SELECT 'eval_qty', 2, 20000, *, CASE WHEN category IN ('quantity', 'mrp', 'other') AND unit THEN 0 WHEN category = 'quantity' THEN 2 END, list_position(['quantity', 'mrp', 'other'], category) FROM fv
  UNION ALL SELECT 'eval_addr', 3, 15000, *, CASE WHEN category IN ('address', 'other') AND place THEN 0 WHEN category = 'address' THEN 1 END, list_position(['address', 'other'], category) FROM fv
  UNION ALL SELECT 'eval_date', 4, 10000, *, CASE WHEN category IN ('mfg_date', 'mrp', 'other') AND dated THEN 0 WHEN category = 'mfg_date' THEN 1 END, list_position(['mfg_date', 'mrp', 'other'], category) FROM fv
  UNION ALL SELECT 'eval_care', 5, 10000, *, CASE WHEN category IN ('helpline', 'address', 'other') AND care THEN 0 WHEN category = 'helpline' THEN 1 END, list_position(['helpline', 'address', 'other'], category) FROM fv
  UNION ALL SELECT 'eval_fssai', 6, 0, *, CASE WHEN category IN ('license', 'address', 'other') AND licence THEN 0 WHEN category = 'license' THEN 1 END, list_position(['license', 'fssai', 'address', 'other'], category) FROM fv
  UNION ALL SELECT 'eval_ingredients', 7, 0, *, CASE WHEN category = 'other' AND contents THEN 0 END, 1 FROM fv),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, eval_id ORDER BY tier, coalesce(confidence, 0.5) DESC, place_no, pos) AS rn FROM tiers WHERE tier IS NOT NULL) WHERE rn = 1),
 grid AS (SELECT scan_id, eval_id, rule_pos, money FROM (SELECT DISTINCT scan_id FROM {features}), (SELECT DISTINCT eval_id, rule_pos, money FROM tiers)),
 ev AS (SELECT g.scan_id, g.eval_id, g.rule_pos, CASE WHEN b.value IS NULL THEN CASE g.eval_id WHEN 'eval_fssai' THEN 'ISSUE' WHEN 'eval_ingredients' THEN NULL ELSE 'FAIL' END
   WHEN g.eval_id = 'eval_mrp' AND price AND NOT taxed THEN 'ISSUE' WHEN g.eval_id = 'eval_qty' AND NOT unit THEN 'ISSUE' WHEN g.eval_id = 'eval_date' AND NOT dated THEN 'ISSUE' ELSE 'PASS' END AS status, g.money, b.value
  FROM grid g LEFT JOIN best b ON b.scan_id = g.scan_id AND b.eval_id = g.eval_id)
"""


# --- searches -------------------------------------------------------------------------------


@query("SELECT id, verdict, product_name FROM {scans} WHERE verdict = 'NON-COMPLIANT' AND (id ILIKE '%ring%' OR product_name ILIKE '%ring%' OR batch_number ILIKE '%ring%' OR inspector_name ILIKE '%ring%' OR category ILIKE '%ring%')")
def flt1_search_scans(t):
    return search.search_scans(t("scans"), "NON-COMPLIANT", "Ring").select("id", "verdict", "product_name")


_VIOLATIONS = """WITH ff AS (SELECT scan_id, min(rule_pos) AS p FROM {evals} WHERE status IN ('FAIL', 'ISSUE') GROUP BY scan_id),
 f AS (SELECT e.scan_id, e.title, e.clause FROM {evals} e JOIN ff ON ff.scan_id = e.scan_id AND ff.p = e.rule_pos),
 v AS (SELECT s.id AS scan_id, product_name, split_part(product_name, ' ', 1) AS brand, coalesce(clause, 'General Provision') AS clause, coalesce(title, 'Unknown Compliance Defect') AS title,
   'HIGH' AS severity, 'PENDING_NOTICE' AS status, scan_date AS detected_date, CASE WHEN penalty = 0 THEN 25000 ELSE penalty END::BIGINT AS fine,
   'VIO-' || substr(sha256(s.id), 1, 12) AS id
  FROM {scans} s LEFT JOIN f ON f.scan_id = s.id WHERE verdict = 'NON-COMPLIANT')
"""


def _violations(t):
    return records.derive_violations(t("scans"), t("evals"))


@query(_VIOLATIONS + "SELECT * FROM v")
def prj3_violations(t):
    return _violations(t)


@query(_VIOLATIONS + "SELECT id, clause FROM v WHERE clause ILIKE '%clause 2%' OR product_name ILIKE '%clause 2%' OR id ILIKE '%clause 2%'")
def flt2_search_violations(t):
    return search.search_violations(_violations(t), "HIGH", "PENDING_NOTICE", "Clause 2").select("id", "clause")


@query("SELECT id, sku, risk, scans_count FROM {registry} WHERE risk = 'HIGH' AND scans_count > 0 AND (product_name || ' ' || sku || ' ' || brand || ' ' || batch_number || ' ' || manufacturer || ' ' || id || ' ' || category) ILIKE '%maker 1%'")
def flt3_search_registry(t):
    return search.search_registry(t("registry"), "maker 1", risk="HIGH", scan_status="INSPECTED").select("id", "sku", "risk", "scans_count")


@query("SELECT id, action, category FROM {audit_logs} WHERE status = 'SUCCESS' AND (category = 'SECURITY' OR action LIKE '%SEC%' OR action LIKE '%SYS%')")
def flt4_search_logs(t):
    return search.search_audit_logs(t("audit_logs"), status="SUCCESS", category="SECURITY").select("id", "action", "category")


@query("SELECT id, type, source FROM {reports} WHERE type = 'Surprise Audit' AND coalesce(source, '') <> 'SCAN'")
def flt5_search_reports(t):
    return search.search_reports(t("reports"), type="Surprise Audit", source="INSTITUTIONAL").select("id", "type", "source")


@query("SELECT id_badge AS key, current_status AS kind FROM {inspectors} WHERE current_status = 'In Field' UNION ALL SELECT code, category FROM {rulebook} WHERE code ILIKE '%mand%' OR title ILIKE '%mand%' OR category ILIKE '%mand%'")
def flt6_search_people_and_rules(t):
    people = search.search_inspectors(t("inspectors"), status="In Field").select(F.col("id_badge").alias("key"), F.col("current_status").alias("kind"))
    return people.union(search.search_rules(t("rulebook"), "mand").select("code", "category"))


_INDIC = "CASE WHEN pos % 5 = 0 THEN value || ' मूल्य' ELSE value END"


@query(f"SELECT scan_id, pos, value FROM (SELECT scan_id, pos, {_INDIC} AS value FROM {{features}}) WHERE regexp_matches(value, '[ऀ-ൿ]')")
def flt7_multilingual(t):
    marked = t("features").withColumn("value", F.when(F.col("pos") % 5 == 0, F.concat("value", F.lit(" मूल्य"))).otherwise(F.col("value")))
    return search.multilingual_tokens(marked).select("scan_id", "pos", "value")


# --- records --------------------------------------------------------------------------------


@query("""SELECT scan_id, 0::INT AS panel_pos, 'front' AS side, (pos - 1)::INT AS box_pos, 'box_front_' || category || '_' || (pos - 1) AS box_id, upper(replace(category, '_', ' ')) AS label,
 category, value, coalesce(confidence, 0.95) AS confidence, 'PASS' AS status, 'Latin (English)' AS script FROM {features}""")
def prj1_boxes(t):
    box = F.struct("pos", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("label"), "category", "value", "confidence", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("script"))
    nested = t("features").groupBy(F.col("scan_id").alias("id")).agg(F.array(F.struct(F.lit("front").alias("side"), F.array_sort(F.collect_list(box)).alias("boxes"))).alias("panels"))
    return records.flatten_boxes(nested)


@query("""WITH a AS (SELECT scan_id, arg_min(value, pos) AS v FROM {features} WHERE category = 'address' GROUP BY scan_id), d AS (SELECT scan_id, arg_min(value, pos) AS v FROM {features} WHERE category = 'mfg_date' GROUP BY scan_id),
 n AS (SELECT scan_id, string_agg(title || ' is non-compliant or missing.', ' ' ORDER BY rule_pos) AS notes FROM {evals} WHERE status IN ('FAIL', 'ISSUE') GROUP BY scan_id)
 SELECT s.scan_id, coalesce(a.v, 'Registered Packager / Importer') AS manufacturer, 'PKG-' || regexp_replace(d.v, '[^A-Za-z0-9]', '', 'g') AS batch_number,
  coalesce(notes, 'All statutory declarations meet LMPC Rules 2011 and FSSAI schedule requirements.') AS notes
 FROM (SELECT DISTINCT scan_id FROM {features}) s LEFT JOIN a USING (scan_id) LEFT JOIN d USING (scan_id) LEFT JOIN n USING (scan_id)""")
def prj2_scan_records(t):
    return records.build_scan_records(t("features"), t("evals"))


_REPORTS = """made AS (SELECT 'REP-' || scan_no AS id, CASE WHEN manufacturer = 'Registered Packager / Importer' THEN product_name ELSE manufacturer END AS subject_entity, inspector_name,
  CASE verdict WHEN 'NON-COMPLIANT' THEN 'Surprise Audit' ELSE 'Routine Inspection' END AS type, CASE verdict WHEN 'NON-COMPLIANT' THEN 'Violation Found' WHEN 'UNDER_REVIEW' THEN 'Pending Review' ELSE 'Clear' END AS status,
  CASE WHEN manufacturer LIKE '%,%' THEN trim(list_aggregate(string_split(manufacturer, ',')[-2:], 'string_agg', ',')) ELSE 'Northern Metrology Zone - Sector 4' END AS location,
  CASE verdict WHEN 'NON-COMPLIANT' THEN 'High' ELSE 'Low' END AS severity, CASE WHEN penalty > 0 THEN penalty WHEN verdict = 'NON-COMPLIANT' THEN 25000 ELSE 0 END::BIGINT AS fine, id AS scan_id, 'SCAN' AS source FROM {scans})"""


@query(f"WITH {_REPORTS} SELECT *, upper(CASE WHEN contains(subject_entity, ' ') THEN subject_entity[1] || split_part(subject_entity, ' ', 2)[1] ELSE subject_entity[1:2] END) AS initials FROM made")
def prj4_scan_reports(t):
    return records.scan_reports(t("scans"))


_MATCH = """WITH hit AS (SELECT s.id AS scan_id, min(r.pos) AS pos FROM {scans} s JOIN {registry} r ON (s.barcode <> 'No barcode detected' AND r.sku = s.barcode) OR contains(lower(s.product_name), lower(r.product_name)) OR contains(lower(r.product_name), lower(s.product_name)) OR r.brand = s.brand GROUP BY s.id)
"""
#: Scans whose product and brand the registry may not know.
_ODD = "SELECT id, scan_no, scan_date, verdict, CASE WHEN scan_no % 3 = 0 THEN 'new ' || scan_no ELSE product_name END AS product_name, category, batch_number, barcode, manufacturer, CASE WHEN scan_no % 2 = 0 THEN 'none' ELSE brand END AS brand FROM {scans}"


def _odd(t) -> DataFrame:
    n = F.col("scan_no")
    return t("scans").withColumns({"product_name": F.when(n % 3 == 0, F.concat(F.lit("new "), n.cast("string"))).otherwise(F.col("product_name")), "brand": F.when(n % 2 == 0, "none").otherwise(F.col("brand"))})


@query(f"""WITH s AS MATERIALIZED ({_ODD}), reg AS MATERIALIZED (SELECT sku, product_name, brand FROM {{registry}}),
 names AS MATERIALIZED (SELECT DISTINCT a.n FROM (SELECT DISTINCT product_name AS n FROM s) a JOIN (SELECT DISTINCT product_name AS n FROM reg) b ON contains(a.n, b.n) OR contains(b.n, a.n)),
 hit AS (SELECT id FROM s JOIN (SELECT DISTINCT sku FROM reg) r ON r.sku = s.barcode WHERE s.barcode <> 'No barcode detected' UNION SELECT id FROM s JOIN (SELECT DISTINCT brand FROM reg) r ON r.brand = s.brand UNION SELECT id FROM s JOIN names ON names.n = s.product_name)
 SELECT 'REG-' || id AS id, barcode AS sku, product_name, batch_number, 1::BIGINT AS scans_count, CASE verdict WHEN 'NON-COMPLIANT' THEN 0 ELSE 1 END::BIGINT AS passed_count, CASE verdict WHEN 'NON-COMPLIANT' THEN 'HIGH' ELSE 'LOW' END AS risk FROM s ANTI JOIN hit USING (id)""")
def prj5_register_unmatched(t):
    scans = _odd(t)
    return records.register_unmatched(scans, joins.matched_scans(scans, t("registry")))


@query("SELECT code, category, CASE WHEN regexp_matches(lower(category), 'price|mrp|mandatory|economy') THEN 'CRITICAL' WHEN regexp_matches(lower(category), 'quantity|weight|standard|date') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM {rulebook}")
def prj6_rule_severity(t):
    return records.rule_severity(t("rulebook"))


@query(f"WITH {_REPORTS} SELECT source, status, count(*) AS n, sum(fine)::BIGINT AS fines FROM (SELECT coalesce(source, 'INSTITUTIONAL') AS source, status, fine FROM {{reports}} UNION ALL SELECT source, status, fine FROM made) GROUP BY ALL")
def set1_all_reports(t):
    return records.all_reports(t("reports"), t("scans")).groupBy("source", "status").agg(F.count("*").alias("n"), F.sum("fine").alias("fines"))


@query("SELECT scan_id, pos, category, CASE side WHEN 'front' THEN 0 ELSE 1 END AS panel_pos FROM {features}")
def set2_combine_panels(t):
    f = t("features").select("scan_id", "pos", "category", "side")
    return records.combine_panels(f.filter("side = 'front'"), f.filter("side <> 'front'")).select("scan_id", "pos", "category", "panel_pos")


# --- joins ----------------------------------------------------------------------------------

_CODE = "regexp_replace(payload, '[^0-9]', '', 'g')"


@query(f"""WITH g AS (SELECT gs1_prefix, arg_max(company_id, load_pos) AS company_id FROM {{companies}} WHERE gs1_prefix <> '' GROUP BY gs1_prefix)
 SELECT scan_id, panel_pos, payload, CASE WHEN {_CODE} LIKE '890%' AND length({_CODE}) >= 13 THEN coalesce(seven.company_id, eight.company_id) END AS company_id
 FROM {{barcodes}} LEFT JOIN g seven ON seven.gs1_prefix = substr({_CODE}, 1, 7) LEFT JOIN g eight ON eight.gs1_prefix = substr({_CODE}, 1, 8)""")
def jn1_gs1(t):
    return joins.match_gs1(t("barcodes"), t("companies")).select("scan_id", "panel_pos", "payload", "company_id")


@query("""SELECT 'L-' || f.company_id AS k, f.fssai AS text, g.company_id FROM {companies} f LEFT JOIN {companies} g ON g.fssai = f.fssai
 UNION ALL SELECT 'C-' || f.company_id, lower(f.cin), g.company_id FROM {companies} f LEFT JOIN {companies} g ON g.cin = f.cin""")
def jn2_licences(t):
    own = t("companies").select(F.concat(F.lit("L-"), "company_id").alias("k"), F.col("fssai").alias("text"))
    cins = t("companies").select(F.concat(F.lit("C-"), "company_id").alias("k"), F.lower("cin").alias("text"))
    found = [joins.match_license(rows, t("companies"), "text", kind).select("k", "text", "company_id") for rows, kind in ((own, "fssai"), (cins, "cin"))]
    return found[0].union(found[1])


@query("""WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN c.name WHEN 1 THEN 'the Nation_' || n_nationkey WHEN 2 THEN 'LABEL-' || (p_partkey % 10) ELSE 'zz ' || p_partkey END AS brand FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {companies} c ON c.load_pos = p_partkey % 10),
 known AS (SELECT company_id, load_pos, name AS text, 1 AS part FROM {companies} UNION ALL SELECT company_id, load_pos, 'Label ' || load_pos, 0 FROM {companies}),
 exact AS (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, arg_max(company_id, (load_pos, 1 - part)) AS company_id FROM known GROUP BY 1),
 tok AS (SELECT company_id, load_pos, part, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM known),
 first AS (SELECT token, arg_min(company_id, (load_pos, 1 - part)) AS company_id FROM tok WHERE length(token) >= 3 GROUP BY token),
 words AS (SELECT brand, unnest(regexp_extract_all(lower(brand), '[a-z0-9]+')) AS token, unnest(range(len(regexp_extract_all(lower(brand), '[a-z0-9]+')))) AS p FROM (SELECT DISTINCT brand FROM b)),
 back AS (SELECT brand, arg_min(first.company_id, p) AS company_id FROM words JOIN first USING (token) WHERE length(token) >= 3 GROUP BY brand)
 SELECT p_partkey, b.brand, coalesce(e.company_id, back.company_id) AS company_id FROM b LEFT JOIN exact e ON e.key = regexp_replace(lower(b.brand), '[^a-z0-9]', '', 'g') LEFT JOIN back ON back.brand = b.brand""")
def jn3_company_by_brand(t):
    p = t("part").join(t("nation"), F.col("n_nationkey") == F.col("p_partkey") % 25).join(t("companies"), F.col("load_pos") == F.col("p_partkey") % 10)
    k = F.col("p_partkey")
    brand = F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, F.concat(F.lit("the Nation_"), F.col("n_nationkey").cast("string"))).when(k % 4 == 2, F.concat(F.lit("LABEL-"), (k % 10).cast("string"))).otherwise(F.concat(F.lit("zz "), k.cast("string")))
    rows = p.select("p_partkey", brand.alias("brand"))
    own = t("companies").select("company_id", F.concat(F.lit("Label "), F.col("load_pos").cast("string")).alias("brand"), "load_pos")
    return joins.match_company(rows, t("companies"), own).select("p_partkey", "brand", "company_id")


@query(_MATCH + "SELECT scan_id, r.id AS registry_id FROM hit JOIN {registry} r USING (pos)")
def jn4_match_registry(t):
    return joins.match_registry(t("scans"), t("registry"))


@query("""SELECT r.id AS registry_id, count(DISTINCT s.id) AS n FROM {registry} r JOIN {scans} s ON contains(lower(s.product_name), lower(r.product_name)) OR contains(lower(r.product_name), lower(s.product_name))
 OR (s.barcode <> 'No barcode detected' AND contains(s.barcode, r.sku)) OR s.brand = r.brand OR s.batch_number = r.batch_number GROUP BY r.id""")
def jn5_linked_scans(t):
    return joins.linked_counts(t("registry"), t("scans"))


_LOOKUP = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' || r.sku WHEN 1 THEN 'b' || (p_partkey % 40) WHEN 2 THEN substr(p_name, 2, 5) ELSE 'none such' END AS query FROM {part} JOIN {registry} r ON r.pos = p_partkey"


@query(f"""WITH q AS ({_LOOKUP}), d AS (SELECT DISTINCT query, regexp_replace(query, '[^0-9]', '', 'g') AS n FROM q),
 hit AS (SELECT query, min(r.pos) AS pos FROM d JOIN {{registry}} r ON (n <> '' AND r.sku = n) OR lower(r.batch_number) = lower(query) OR contains(lower(r.product_name), lower(query)) GROUP BY query)
 SELECT p_partkey, q.query, r.id AS registry_id, CASE WHEN r.id IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM q LEFT JOIN hit ON hit.query = q.query LEFT JOIN {{registry}} r ON r.pos = hit.pos""")
def jn6_lookup(t):
    k = F.col("p_partkey")
    own = t("part").join(t("registry").select("pos", "sku"), F.col("pos") == k)
    asked = F.when(k % 4 == 0, F.concat(F.lit("x"), "sku")).when(k % 4 == 1, F.concat(F.lit("b"), (k % 40).cast("string"))).when(k % 4 == 2, F.substring("p_name", 2, 5)).otherwise("none such")
    return joins.lookup_products(own.select("p_partkey", asked.alias("query")), t("registry")).select("p_partkey", "query", "registry_id", "status")


@query("SELECT e.* FROM {evals} e WHERE rule_code IN (SELECT code FROM {rulebook} WHERE active)")
def jn7_active_rules(t):
    return joins.apply_rulebook(t("evals"), t("rulebook"))


@query("SELECT id, verdict FROM {scans} WHERE id NOT IN (SELECT scan_id FROM {reports} WHERE scan_id IS NOT NULL)")
def jn8_unreported(t):
    return joins.unreported_scans(t("scans"), t("reports")).select("id", "verdict")


@query(_VIOLATIONS + ", gone AS (SELECT scan_id AS id FROM {reports} WHERE scan_id IS NOT NULL) SELECT 'scan' AS kind, count(*) AS n FROM {scans} WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'violation', count(*) FROM v WHERE scan_id NOT IN (SELECT id FROM gone)")
def jn9_delete(t):
    ids_ = t("reports").filter("scan_id is not null").select(F.col("scan_id").alias("id"))
    scans, violations = joins.delete_scans(t("scans"), _violations(t), ids_)
    return scans.agg(F.count("*").alias("n")).select(F.lit("scan").alias("kind"), "n").union(violations.agg(F.count("*")).select(F.lit("violation"), "*"))


@query("""WITH u AS (SELECT 'IN-' || (c_custkey - c_custkey % 3) AS id_badge, arg_max(c_mktsegment, c_custkey) AS zone FROM {customer} GROUP BY 1)
 SELECT i.id_badge, name, coalesce(u.zone, i.zone) AS zone FROM {inspectors} i LEFT JOIN u USING (id_badge)
 UNION ALL SELECT 'NEW-' || n_nationkey, n_name, 'seed' FROM {nation}""")
def jn10_patch_and_merge(t):
    c = t("customer").select(F.concat(F.lit("IN-"), (F.col("c_custkey") - F.col("c_custkey") % 3).cast("string")).alias("id_badge"), F.col("c_mktsegment").alias("zone"), F.col("c_custkey").alias("ts"))
    own = t("inspectors").select("id_badge", "name", "zone")
    seed = t("nation").select(F.concat(F.lit("NEW-"), F.col("n_nationkey").cast("string")).alias("id_badge"), F.col("n_name").alias("name"), F.lit("seed").alias("zone")).union(own)
    return joins.merge_missing(joins.patch(own, c, "id_badge"), seed, "id_badge")


@query("""WITH b AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'REG-' || p_partkey ELSE 'NEW-' || (p_partkey % 90) END AS id, p_partkey AS row_no FROM {part}),
 m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS nth, id IN (SELECT id FROM {registry}) AS taken FROM b)
 SELECT CASE WHEN p = 1 THEN id WHEN taken OR nth > 1 THEN id || '-' || substr(sha256('s' || row_no || '|' || row_no), 1, 8) ELSE id END AS id, p AS part, row_no AS list_pos
 FROM (SELECT id, row_no, nth, taken, 0 AS p FROM m UNION ALL SELECT id, pos, 1, false, 1 FROM {registry})""")
def jn11_import(t):
    k = F.col("p_partkey")
    batch = t("part").select(F.when(k % 3 == 0, F.concat(F.lit("REG-"), k.cast("string"))).otherwise(F.concat(F.lit("NEW-"), (k % 90).cast("string"))).alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("sku"), F.col("p_name").alias("product_name"), k.alias("row_no"))
    return joins.import_registry(t("registry"), batch).select("id", "part", "list_pos")


#: Two readings of the panels of eight orders each; every third token of the second is far from the first's.
_FIRST = """SELECT 'INS-' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS scan_id, CASE WHEN l_linestatus = 'F' THEN 'front' ELSE 'back_0' END AS panel,
 CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 8), l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS token_pos,
 CASE WHEN l_returnflag = 'A' THEN 'शुद्ध ' ELSE 'word ' END || CAST(l_partkey AS STRING) AS text, 0.55 + CAST(CAST(l_quantity AS INT) % 9 AS DOUBLE) / 20 AS conf,
 CAST((l_partkey * 37) % 300 AS DOUBLE) AS xmin, CAST((l_suppkey * 53) % 120 AS DOUBLE) AS ymin, CAST((l_partkey * 37) % 300 + 20 + l_partkey % 70 AS DOUBLE) AS xmax, CAST((l_suppkey * 53) % 120 + 8 + l_suppkey % 30 AS DOUBLE) AS ymax,
 l_returnflag = 'A' AS indic, l_returnflag = 'R' AND l_linenumber % 2 = 0 AS garbled FROM {lineitem}"""
_AGAIN = {"text": "'नया ' || CAST(token_pos AS STRING)", "conf": "0.45 + CAST(token_pos % 10 AS DOUBLE) / 20", "xmin": "xmin + dx", "ymin": "ymin + dy", "xmax": "xmax + dx", "ymax": "ymax + dy + token_pos % 2"}
_SHIFTED = """SELECT *, CASE WHEN token_pos % 3 = 0 THEN 150.0::DOUBLE ELSE token_pos % 9 END AS dx, CASE WHEN token_pos % 3 = 0 THEN 60.0::DOUBLE ELSE token_pos % 4 END AS dy FROM (""" + _FIRST + """) f"""
_SECOND = f"""SELECT scan_id, panel, token_pos, {_AGAIN['text']} AS text, {_AGAIN['conf']} AS conf,
 {_AGAIN['xmin']} AS xmin, {_AGAIN['ymin']} AS ymin, {_AGAIN['xmax']} AS xmax, {_AGAIN['ymax']} AS ymax FROM ({_SHIFTED}) g"""
#: Overlap of boxes a and b as intersection over union.
_IOU = "(greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))) / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) + 1e-6)"
_NTH = "row_number() OVER (PARTITION BY scan_id, panel ORDER BY token_pos, xmin, ymin, xmax, ymax, text, conf)"


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, {_NTH} AS n FROM ({_FIRST})), s AS MATERIALIZED (SELECT *, {_NTH} AS n FROM ({_SECOND})),
 goes AS MATERIALIZED (SELECT a.scan_id, a.panel, a.n, min(b.n) AS m FROM s a JOIN p b ON b.scan_id = a.scan_id AND b.panel = a.panel WHERE {_IOU} > 0.25 GROUP BY ALL),
 taker AS (SELECT scan_id, panel, m, min(n) AS n FROM goes GROUP BY ALL), offer AS (SELECT taker.scan_id, taker.panel, taker.m, s.text, s.conf FROM taker JOIN s USING (scan_id, panel, n)),
 free AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY scan_id, panel ORDER BY n) AS k FROM s ANTI JOIN goes USING (scan_id, panel, n)),
 fold(scan_id, panel, k, kept) AS (SELECT scan_id, panel, 0::BIGINT, CAST([] AS STRUCT(n BIGINT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE)[]) FROM (SELECT DISTINCT scan_id, panel FROM free)
  UNION ALL SELECT f.scan_id, f.panel, a.k, CASE WHEN len(list_filter(f.kept, lambda b: {_IOU} > 0.25)) > 0 THEN f.kept ELSE list_append(f.kept, {{'n': a.n, 'xmin': a.xmin, 'ymin': a.ymin, 'xmax': a.xmax, 'ymax': a.ymax}}) END FROM fold f JOIN free a ON a.scan_id = f.scan_id AND a.panel = f.panel AND a.k = f.k + 1),
 done AS (SELECT scan_id, panel, arg_max(kept, k) AS kept FROM fold GROUP BY ALL), app AS (SELECT scan_id, panel, unnest(kept).n AS n FROM done),
 last AS (SELECT scan_id, panel, max(token_pos) AS last FROM p GROUP BY ALL)
 SELECT p.scan_id, p.panel, p.token_pos, CASE WHEN o.text IS NOT NULL AND NOT indic AND (garbled OR p.conf < 0.7) THEN o.text ELSE p.text END AS text, CASE WHEN o.text IS NOT NULL AND NOT indic AND (garbled OR p.conf < 0.7) THEN greatest(p.conf, o.conf) ELSE p.conf END AS conf, p.xmin, p.ymin FROM p LEFT JOIN offer o ON o.scan_id = p.scan_id AND o.panel = p.panel AND o.m = p.n
 UNION ALL SELECT s.scan_id, s.panel, (coalesce(last, -1) + row_number() OVER (PARTITION BY s.scan_id, s.panel ORDER BY s.n))::INT, s.text, s.conf, s.xmin, s.ymin FROM app JOIN s USING (scan_id, panel, n) LEFT JOIN last ON last.scan_id = s.scan_id AND last.panel = s.panel""")
def jn12_fused(t):
    # both readings come from the same rows, so these are sorted and sent once; where panels are large, they are so in both
    first, own = derived(t, _FIRST), [*boxes.TOKEN, "indic", "garbled"]
    unknown = F.lit(None).cast("boolean")
    readings = F.array(F.struct(*own, F.lit(True).alias("first")), F.struct(*(F.expr(_AGAIN.get(c, c)).alias(c) for c in boxes.TOKEN), unknown.alias("indic"), unknown.alias("garbled"), F.lit(False).alias("first")))
    rows = derived(t, _SHIFTED).select(F.inline(readings))
    return boxes.fuse_readings(rows, 0.25, boxes._large(first), first.schema["token_pos"].dataType.simpleString()).select("scan_id", "panel", "token_pos", "text", "conf", "xmin", "ymin")


@query("SELECT DISTINCT f.value AS text, a.entity, a.alias, 100.0::DOUBLE AS score FROM {features} f JOIN (SELECT * FROM (VALUES ('mrp', 'mrp'), ('mrp', 'incl. of all taxes'), ('net_qty', 'net wt'), ('mfg_date', 'pkd'), ('manufacturer', 'packed by'), ('manufacturer', 'customer care')) v(entity, alias)) a ON contains(lower(value), alias) WHERE NOT (alias = 'incl. of all taxes' AND contains(lower(value), 'mrp'))")
def jn13_entities(t):
    return brand_plans.extract_entities(t("features").select(F.col("value").alias("text")).distinct())


@query()
def jn13_fuzzy(t):
    """Nearest alias of each entity by partial ratio (no SQL; tested against brute force)."""
    return brand_plans.extract_entities(t("features").select(F.col("value").alias("text")).distinct(), method="fuzzy")


@query("SELECT r.id, r.scan_id, s.product_name, s.verdict FROM {reports} r LEFT JOIN {scans} s ON s.id = r.scan_id")
def jn14_dossier(t):
    return joins.report_dossier(t("reports"), t("scans")).select("id", "scan_id", "product_name", "verdict")


# --- aggregates -----------------------------------------------------------------------------

_VERDICTS = """WITH vd AS (SELECT s.id, CASE WHEN count(e.status) > 0 THEN round_even(100.0::DOUBLE * count(*) FILTER (e.status = 'PASS') / count(e.status), 1) ELSE 100.0 END AS rate, CASE WHEN count(*) FILTER (e.status IN ('FAIL', 'ISSUE')) > 0 THEN 'NON-COMPLIANT' ELSE 'COMPLIANT' END AS verdict, count(*) FILTER (e.status IN ('FAIL', 'ISSUE')) AS violations
 FROM {scans} s LEFT JOIN {evals} e ON e.scan_id = s.id GROUP BY s.id) """


@query(_VERDICTS + "SELECT * FROM vd")
def agg1_verdicts(t):
    return metrics.scan_verdicts(t("evals"), t("scans"))


@query("SELECT count(*) AS total, count(*) FILTER (verdict = 'COMPLIANT') AS compliant, count(*) FILTER (verdict = 'NON-COMPLIANT') AS non_compliant, round(100.0::DOUBLE * count(*) FILTER (verdict = 'COMPLIANT') / count(*), 1) AS rate FROM {scans}")
def agg2_overview(t):
    return metrics.overview_kpis(t("scans"))


@query("""WITH o AS (SELECT inspector_id AS id_badge, count(*) AS n, count(*) FILTER (verdict = 'COMPLIANT') AS ok FROM {scans} WHERE inspector_id <> 'SYSTEM-AUTO' GROUP BY 1)
 SELECT id_badge, total_inspections + coalesce(n, 0) AS inspections, CASE WHEN n > 0 THEN round(100.0::DOUBLE * ok / n, 1) ELSE stored_accuracy::DOUBLE END AS accuracy, least(100, round(100.0::DOUBLE * (total_inspections + coalesce(n, 0)) / 50))::BIGINT AS progress FROM {inspectors} LEFT JOIN o USING (id_badge)""")
def agg3_inspectors(t):
    return metrics.inspector_performance(t("scans"), t("inspectors").withColumn("stored_accuracy", F.col("stored_accuracy").cast("double")))


@query("SELECT count(*) AS total, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, count(*) FILTER (risk = 'LOW') AS low, sum(scans_count)::BIGINT AS scans, sum(passed_count)::BIGINT AS passed, round(100.0::DOUBLE * sum(passed_count) / sum(scans_count), 1) AS pass_rate FROM {registry}")
def agg4_registry(t):
    return metrics.registry_metrics(t("registry"))


@query("SELECT id, CASE WHEN scans_count > 0 THEN round(100.0::DOUBLE * passed_count / scans_count, 0) ELSE 100.0 END AS pass_rate FROM {registry}")
def agg4_pass_rates(t):
    return metrics.pass_rates(t("registry"))


@query("SELECT coalesce(category, 'ALL') AS category, count(*) AS n FROM {registry} GROUP BY ROLLUP (category)")
def agg5_categories(t):
    return metrics.category_counts(t("registry"))


@query(_VIOLATIONS + "SELECT severity, status, count(*) AS n, sum(fine)::BIGINT AS fines FROM v GROUP BY ALL")
def agg6_fines(t):
    return metrics.fine_totals(_violations(t))


@query(_VIOLATIONS + "SELECT ((SELECT sum(total_inspections) FROM {inspectors}) + (SELECT count(*) FROM {scans}))::BIGINT AS inspections, (SELECT count(*) FROM {inspectors} WHERE current_status IN ('In Field', 'In Lab')) AS active, (SELECT count(*) FROM v) + (SELECT count(*) FROM {reports}) AS pending, (SELECT count(*) FROM {reports} WHERE severity IN ('CRITICAL', 'HIGH')) AS critical")
def agg7_oversight(t):
    return metrics.oversight_kpis(t("inspectors"), t("scans"), _violations(t), t("reports"))


@query("SELECT coalesce(source, 'INSTITUTIONAL') AS source, status, count(*) AS n FROM {reports} GROUP BY ALL")
def agg8_reports(t):
    return metrics.report_counts(t("reports"))


@query("SELECT count(*) AS total, count(*) FILTER (active) AS active, count(DISTINCT category) AS categories FROM {rulebook}")
def agg8_rules(t):
    return metrics.rulebook_counts(t("rulebook"))


@query(f"SELECT scan_id, count(DISTINCT script) AS n, max(script) AS last FROM (SELECT scan_id, CASE WHEN regexp_matches({_INDIC}, '[ऀ-ॿ]') THEN 'Hindi (हिंदी)' ELSE 'Latin (English)' END AS script FROM {{features}}) GROUP BY scan_id")
def agg9_languages(t):
    marked = t("features").withColumn("value", F.when(F.col("pos") % 5 == 0, F.concat("value", F.lit(" मूल्य"))).otherwise(F.col("value")))
    named = marked.withColumn("script", text.detect_script(F.col("value"))["script"])
    return metrics.detected_languages(named).select("scan_id", F.size("languages").cast("long").alias("n"), F.array_max("languages").alias("last"))


@query("SELECT scan_id, count(DISTINCT category) AS categories FROM (SELECT scan_id, category FROM {features} WHERE category <> 'other' UNION ALL SELECT scan_id, 'barcode' FROM {barcodes} WHERE detected) GROUP BY scan_id")
def agg9_coverage(t):
    return metrics.statutory_coverage(t("features"), t("barcodes").filter("detected"))


@query("""WITH c AS (SELECT unnest(['good', 'poor', 'toxic', 'none']) AS class), s AS (SELECT class, (SELECT count(*) FROM {labelled} WHERE expected = class) AS total, (SELECT count(*) FROM {labelled} WHERE expected = class AND predicted = class) AS correct, (SELECT count(*) FROM {labelled} WHERE predicted = class) AS guessed FROM c),
 p AS (SELECT class, total, correct, CASE WHEN guessed > 0 THEN round(100.0::DOUBLE * correct / guessed, 2) ELSE 100.0 END AS precision, CASE WHEN total > 0 THEN round(100.0::DOUBLE * correct / total, 2) ELSE 100.0 END AS recall FROM s)
 SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 2) ELSE 0.0 END AS f1 FROM p""")
def agg10_classification(t):
    return metrics.classification_report(t("labelled"), ["good", "poor", "toxic", "none"])


@query("SELECT expected, predicted, count(*) AS n FROM {labelled} WHERE expected <> predicted GROUP BY ALL")
def agg10_confusion(t):
    return metrics.confusion(t("labelled"))


@query("""WITH s AS (SELECT count(*) FILTER (expected = 'toxic' AND predicted = 'toxic') AS tp, count(*) FILTER (expected <> 'toxic' AND predicted <> 'toxic') AS tn, count(*) FILTER (expected <> 'toxic' AND predicted = 'toxic') AS fp, count(*) FILTER (expected = 'toxic' AND predicted <> 'toxic') AS fn FROM {labelled})
 SELECT *, round(100.0::DOUBLE * (tp + tn) / (tp + tn + fp + fn), 2) AS accuracy, CASE WHEN tp + fp > 0 THEN round(100.0::DOUBLE * tp / (tp + fp), 2) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(100.0::DOUBLE * tp / (tp + fn), 2) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(100.0::DOUBLE * 2 * tp / (2 * tp + fp + fn), 2) ELSE 0.0 END AS f1 FROM s""")
def agg11_binary(t):
    return metrics.binary_report(t("labelled").select((F.col("expected") == "toxic").alias("truth"), (F.col("predicted") == "toxic").alias("flagged")))


@query("""WITH tr AS (SELECT scan_id, 'quantity' AS field, 'NetWt ' || min(pos) AS expected FROM {features} GROUP BY scan_id UNION ALL SELECT scan_id, 'helpline', '1800-266' FROM {features} GROUP BY scan_id HAVING min(pos) + count(*) > 3),
 hit AS (SELECT tr.scan_id, tr.field, coalesce(bool_or(CASE tr.field WHEN 'quantity' THEN contains(replace(lower(value), ' ', ''), replace(lower(expected), ' ', '')) ELSE contains(regexp_replace(lower(value), '[ +-]', '', 'g'), regexp_replace(lower(expected), '[ +-]', '', 'g')) END), false) AS hit FROM tr LEFT JOIN {features} f ON f.scan_id = tr.scan_id AND f.category = tr.field GROUP BY ALL)
 SELECT field, count(*) AS expected, count(*) FILTER (hit) AS found, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 2) AS accuracy FROM hit GROUP BY field""")
def agg12_ground_truth(t):
    truth = t("features").groupBy("scan_id").agg(F.concat(F.lit("NetWt "), F.min("pos").cast("string")).alias("quantity"), F.when(F.min("pos") + F.count("*") > 3, "1800-266").alias("helpline"))
    return metrics.ground_truth_accuracy(t("features"), truth)


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.95), 9) AS p95, round(1000.0 / avg(value), 6) AS per_second FROM {events}")
def agg13_latency(t):
    out = metrics.latency_summary(t("events").select(F.col("value").alias("ms")))
    return out.select("n", F.round("mean", 6).alias("mean"), "least", "most", F.round("p95", 9).alias("p95"), F.round("per_second", 6).alias("per_second"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.95) AS nearest, round(quantile_cont(value, 0.95), 9) AS interpolated, round(quantile_cont(value, 0.5), 9) AS median FROM {events} GROUP BY event_type")
def agg13_by_type(t):
    """Percentiles of each kind of event by both rules."""
    rows = t("events").select("event_type", F.col("value").alias("ms"))
    out = rows.groupBy("event_type").agg(F.count("*").alias("n"))
    for name, share, rule in (("nearest", 0.95, "nearest"), ("interpolated", 0.95, "interpolated"), ("median", 0.5, "interpolated")):
        found = metrics.exact_percentiles(rows, "ms", share, ("event_type",), rule).withColumnRenamed("percentile", name)
        out = out.join(found, "event_type")
    return out.select("event_type", "n", "nearest", F.round("interpolated", 9).alias("interpolated"), F.round("median", 9).alias("median"))


@query("SELECT category, count(DISTINCT scan_id) AS n, round(100.0::DOUBLE * count(DISTINCT scan_id) / (SELECT count(DISTINCT scan_id) FROM {features}), 2) AS rate FROM {features} GROUP BY category")
def agg14_detection(t):
    return metrics.detection_rates(t("features"))


@query(_VERDICTS + ", f AS (SELECT scan_id, count(*) AS tokens FROM {features} GROUP BY scan_id) SELECT vd.id AS scan_id, verdict, rate, coalesce(tokens, 0) AS tokens, 0::BIGINT AS multilingual, CASE WHEN tokens > 3 THEN 'GENUINE' END AS brand_status FROM vd LEFT JOIN f ON f.scan_id = vd.id")
def agg15_summary(t):
    brands = t("features").groupBy("scan_id").agg(F.count("*").alias("n")).filter("n > 3").select("scan_id", F.lit("GENUINE").alias("brand_status"))
    return metrics.dataset_summary(t("features"), metrics.scan_verdicts(t("evals"), t("scans")), brands)


@query("SELECT scan_id, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'ISSUE') AS issue, count(*) FILTER (status = 'FAIL') AS fail FROM {evals} GROUP BY scan_id")
def agg16_matrix(t):
    return metrics.rule_matrix_counts(t("evals"))


# --- choices and orders ---------------------------------------------------------------------


@query("SELECT scan_id, arg_min(title, rule_pos) AS title, arg_min(clause, rule_pos) AS clause, arg_min(rule_code, rule_pos) AS rule_code FROM {evals} WHERE status IN ('FAIL', 'ISSUE') GROUP BY scan_id")
def win2_first_failure(t):
    return records.first_failure(t("evals"))


def _check(code: str) -> str:
    """Modulo-10 test of a GTIN in DuckDB."""
    padded = f"lpad({code}, 14, '0')"
    total = " + ".join(f"{3 if k % 2 else 1} * substr({padded}, {k}, 1)::INT" for k in range(1, 14))
    return f"(regexp_full_match({code}, '[0-9]+') AND length({code}) IN (8, 12, 13, 14) AND (10 - (CASE WHEN regexp_full_match({code}, '[0-9]+') AND length({code}) < 15 THEN {total} ELSE 0 END) % 10) % 10 = try_cast(right({code}, 1) AS INT))"


_REPAIRED = "regexp_replace(translate(trim(payload), 'OoDIli|ZzSsbBgq', '000111122556899'), '[^0-9]', '', 'g')"


@query(f"""WITH b AS (SELECT *, {_check('payload')} AS valid FROM {{barcodes}}), x AS (SELECT scan_id, min(panel_pos) FILTER (detected AND valid) AS a, max(panel_pos) FILTER (detected) AS d, min(panel_pos) AS c FROM b GROUP BY scan_id)
 SELECT b.scan_id, b.payload, b.detected, b.valid, b.panel_pos FROM b JOIN x ON x.scan_id = b.scan_id AND b.panel_pos = coalesce(a, d, c)""")
def win4_barcode(t):
    return ranking.choose_barcode(ids.with_gtin_valid(t("barcodes"), "payload"))


@query("SELECT user_id, arg_max(id, (ts_text, log_no)) AS id, max(ts_text) AS ts_text, arg_max(action, (ts_text, log_no)) AS action FROM {audit_logs} WHERE contains(action, 'LOGIN') OR category = 'AUTH' GROUP BY user_id")
def win5_latest_login(t):
    return ranking.latest_login(t("audit_logs"))


_TOKENS = "SELECT 'INS-' || CAST(l_orderkey AS STRING) AS scan_id, 'front' AS panel, l_linenumber AS token_pos, CAST(l_partkey % 300 AS INT) AS xmin, CAST(l_partkey % 300 + l_quantity AS INT) AS xmax, CAST(l_suppkey % 90 * 4 AS INT) AS ymin, CAST(l_suppkey % 90 * 4 + 5 + floor(l_quantity / 2) AS INT) AS ymax, 'w' || CAST(l_partkey % 50 AS STRING) AS text FROM {lineitem}"


def _tokens(t) -> DataFrame:
    rows = t("lineitem")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    return rows.select(F.concat(F.lit("INS-"), F.col("l_orderkey").cast("string")).alias("scan_id"), F.lit("front").alias("panel"), F.col("l_linenumber").alias("token_pos"), (p % 300).cast("int").alias("xmin"), (p % 300 + q).cast("int").alias("xmax"), (s % 90 * 4).cast("int").alias("ymin"), (s % 90 * 4 + 5 + F.floor(q / 2)).cast("int").alias("ymax"), F.concat(F.lit("w"), (p % 50).cast("string")).alias("text"))


@query(f"""WITH k AS ({_TOKENS}), m AS (SELECT *, max(xmax) OVER (PARTITION BY scan_id ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
 g AS (SELECT *, sum(CASE WHEN xmin <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id ORDER BY xmin, xmax RANGE UNBOUNDED PRECEDING) AS band FROM m)
 SELECT scan_id, panel, band::BIGINT AS band, min(xmin) AS xmin, max(xmax) AS xmax FROM g GROUP BY ALL""")
def win7_column_bands(t):
    return metrics.column_bands(_tokens(t))


@query("SELECT id, row_number() OVER (ORDER BY CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, id)::INT AS place FROM {registry} ORDER BY 2 LIMIT 40")
def srt1_registry(t):
    from pyspark.sql import Window

    top = ranking.sort_registry(t("registry"), "risk").limit(40)  # the page shows forty
    rank = F.when(F.col("risk") == "HIGH", 3).when(F.col("risk") == "MEDIUM", 2).otherwise(1)
    return top.select("id", F.row_number().over(Window.orderBy(rank.desc(), "id")).alias("place"))


@query("SELECT id, ts_text FROM {audit_logs} ORDER BY ts_text DESC, log_no DESC LIMIT 50")
def srt2_logs(t):
    return ranking.sort_logs(t("audit_logs")).limit(50).select("id", "ts_text")


@query("SELECT id, scan_date FROM {scans} ORDER BY scan_date DESC, id LIMIT 4")
def srt3_recent(t):
    return ranking.recent(t("scans"), 4, F.desc("scan_date"), F.asc("id")).select("id", "scan_date")


# --- column functions -----------------------------------------------------------------------


@query(f"SELECT scan_id, panel_pos, payload, {_check('payload')} AS gtin, length({_REPAIRED}) = 13 AND {_check(_REPAIRED)} AS ean13, {_REPAIRED} AS repaired FROM {{barcodes}}")
def fn6_check_digits(t):
    p = F.col("payload")
    return t("barcodes").select("scan_id", "panel_pos", "payload", ids.gtin_valid(p).alias("gtin"), ids.ean13_valid(p).alias("ean13"), ids.sanitize_digits(p).alias("repaired"))


@query(f"""WITH c AS (SELECT scan_id, panel_pos, {_CODE} AS code FROM {{barcodes}})
 SELECT scan_id, panel_pos, CASE length(code) WHEN 8 THEN 'GTIN-8 (EAN-8)' WHEN 12 THEN 'GTIN-12 (UPC-A)' WHEN 13 THEN 'GTIN-13 (EAN-13)' WHEN 14 THEN 'GTIN-14 (ITF-14)' ELSE 'Custom Barcode (' || length(code) || ' digits)' END AS format, {_check('code')} AS is_valid_checksum, length(code) IN (8, 12, 13, 14) AND code LIKE '890%' AS is_india FROM c""")
def fn7_gs1(t):
    return t("barcodes").select("scan_id", "panel_pos", ids.validate_gs1(F.col("payload")).alias("g")).select("scan_id", "panel_pos", "g.format", "g.is_valid_checksum", "g.is_india")


@query(f"SELECT scan_id, panel_pos, CASE WHEN length(payload) = 13 THEN CASE WHEN length({_REPAIRED}) = 13 AND {_check(_REPAIRED)} THEN 100 ELSE 45 END WHEN length(payload) = 12 THEN CASE WHEN length({_REPAIRED}) = 12 AND {_check(_REPAIRED)} THEN 95 ELSE 50 END ELSE 80 END AS score FROM {{barcodes}}")
def fn8_barcode_score(t):
    return t("barcodes").select("scan_id", "panel_pos", ids.barcode_score(F.col("payload"), F.lit("CODE")).alias("score"))


@query("SELECT company_id, fssai, length(fssai) = 14 AND fssai[1] IN ('1', '2', '3') AND substr(fssai, 2, 2)::INT <= 37 AS valid, CASE WHEN length(fssai) = 14 AND fssai[1] IN ('1', '2', '3') AND substr(fssai, 2, 2)::INT <= 37 THEN CASE WHEN substr(fssai, 4, 2)::INT <= 40 THEN 2000 ELSE 1900 END + substr(fssai, 4, 2)::INT END AS year FROM {companies}")
def fn9_fssai(t):
    return t("companies").select("company_id", "fssai", ids.parse_fssai(F.col("fssai")).alias("p")).select("company_id", "fssai", "p.valid", "p.year")


@query("WITH c AS (SELECT company_id, cin, regexp_full_match(cin, '[LU][0-9]{5}[A-Z]{2}(18|19|20)[0-9]{2}[A-Z]{3}[0-9]{6}') AND substr(cin, 7, 2) IN ('MH', 'DL') AS valid FROM {companies}) SELECT *, CASE WHEN valid THEN substr(cin, 9, 4)::INT END AS year, CASE WHEN valid THEN CASE substr(cin, 13, 3) WHEN 'PLC' THEN 'Public Limited Company' ELSE 'Special Entity (' || substr(cin, 13, 3) || ')' END END AS entity FROM c")
def fn10_cin(t):
    return t("companies").select("company_id", "cin", ids.parse_cin(F.col("cin")).alias("p")).select("company_id", "cin", "p.valid", "p.year", "p.entity")


@query("""SELECT scan_id, pos, CASE WHEN regexp_matches(value, '^Ingredients') THEN 'ingredients' WHEN regexp_matches(value, '^MRP Rs') THEN 'mrp' WHEN regexp_matches(value, '^Net Wt') THEN 'quantity' WHEN regexp_matches(value, '^PKD:') THEN 'mfg_date'
 WHEN regexp_matches(value, '^Lic No') THEN 'license' WHEN regexp_matches(value, '^Customer care') THEN 'helpline' WHEN regexp_matches(value, '^Packed by') THEN 'address' ELSE 'other' END AS category FROM {features}""")
def fn1_classify(t):
    return text.classify_lines(t("features").select("scan_id", "pos", "value")).select("scan_id", "pos", "category")


def _sql_replace(sql: str, pairs) -> str:
    for x, y in pairs:
        sql = f"replace({sql}, '{x}', '{y}')"
    return sql


def _sql_single(sql: str, letters: str) -> str:
    """Runs of each letter become one letter."""
    for c in letters:
        sql = f"regexp_replace({sql}, '{c}{c}+', '{c}', 'g')"
    return sql


_AZ = "abcdefghijklmnopqrstuvwxyz"
_NAME = "CASE p_partkey % 3 WHEN 0 THEN 'Daboor ' || p_name WHEN 1 THEN 'Phavicol ' || p_type ELSE 'B1sleri Knorr ' || p_name END"
_NAMED = f"SELECT DISTINCT {_NAME} AS n FROM {{part}}"


def _named(t) -> DataFrame:
    k = F.col("p_partkey") % 3
    return t("part").select(F.when(k == 0, F.concat(F.lit("Daboor "), "p_name")).when(k == 1, F.concat(F.lit("Phavicol "), "p_type")).otherwise(F.concat(F.lit("B1sleri Knorr "), "p_name")).alias("n")).distinct()


@query(f"SELECT n, trim(regexp_replace({_sql_replace('translate(lower(n), ' + repr(''.join(C.HOMOGLYPHS)) + ', ' + repr(''.join(C.HOMOGLYPHS.values())) + ')', C.HOMOGLYPH_PAIRS)}, '[^a-z0-9 ]', '', 'g')) AS h FROM ({_NAMED})")
def fn16_homoglyphs(t):
    return _named(t).select("n", text.normalize_homoglyphs(F.col("n"), plain=True).alias("h"))


@query(f"SELECT n, regexp_replace({_sql_single(_sql_replace('lower(n)', C.DIGRAPHS), _AZ)}, '[^a-z0-9]', '', 'g') AS d FROM ({_NAMED})")
def fn17_digraphs(t):
    return _named(t).select("n", text.normalize_digraphs(F.col("n")).alias("d"))


_SDX = _sql_replace("regexp_replace(regexp_replace(regexp_replace(upper(n), '^PH', 'F'), '^WR', 'R'), '^KN', 'N')", [("PH", "F"), ("GH", "G"), ("SH", "S"), ("CH", "C"), ("BH", "B"), ("KH", "K"), ("TH", "T"), ("DH", "D")])


@query(f"""WITH w AS (SELECT n, regexp_replace({_SDX}, '[^A-Z]', '', 'g') AS w FROM ({_NAMED})), c AS (SELECT n, w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c FROM w)
 SELECT n, rpad(w[1] || replace(substr({_sql_single('c', '0123456')}, 2), '0', ''), 4, '0') AS s FROM c""")
def fn18_soundex(t):
    return _named(t).select("n", text.soundex_in(F.col("n")).alias("s"))


_LETTERS = "regexp_replace(upper(n), '[^A-Z]', '', 'g')"
_MET = _sql_replace(f"CASE WHEN regexp_matches({_LETTERS}, '^(KN|GN|PN|AE|WR)') THEN substr({_LETTERS}, 2) ELSE {_LETTERS} END", [("PH", "F"), ("BH", "B"), ("KH", "K"), ("DH", "D")])
_MET = _sql_replace(f"regexp_replace({_MET}, 'MB$', 'M')", [("SCH", "SK"), ("CIA", "X"), ("TCH", "CH"), ("CH", "X"), ("SH", "X"), ("TH", "0")])
_MET = _sql_replace(f"replace(regexp_replace({_MET}, 'C([EIY])', 'S\\1', 'g'), 'C', 'K')", [])
_MET = _sql_replace(f"regexp_replace({_MET}, 'G([EIY])', 'J\\1', 'g')", [("Q", "K"), ("X", "KS"), ("Z", "S"), ("V", "F"), ("W", "F")])


@query(f"""WITH w AS (SELECT n, {_MET} AS w FROM ({_NAMED})), j AS (SELECT n, w[1] || regexp_replace(substr(w, 2), '[AEIOU]', '', 'g') AS j FROM w)
 SELECT n, substr({_sql_single('j', _AZ.upper() + '0')}, 1, 6) AS m FROM j""")
def fn19_metaphone(t):
    return _named(t).select("n", text.metaphone_in(F.col("n")).alias("m"))


@query(f"""WITH k AS (SELECT n, regexp_extract_all(lower(n), '[a-z0-9]+') AS w FROM ({_NAMED}))
 SELECT n, array_to_string(list_concat([lower(n)], list_filter(flatten(list_transform(range(1, len(w) + 1), lambda i: list_concat([w[i]], list_concat(CASE WHEN i < len(w) THEN [w[i] || ' ' || w[i + 1]] ELSE [] END, CASE WHEN i + 1 < len(w) THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]] ELSE [] END)))), lambda x: x <> lower(n) AND length(x) > 1)), '|') AS g FROM k""")
def fn20_ngrams(t):
    return _named(t).select("n", F.array_join(text.brand_ngrams(F.col("n")), "|").alias("g"))


@query("SELECT scan_id, pos, regexp_full_match(v, '[0-9]{1,5}') AND coalesce(try_cast(v AS BIGINT), 0) BETWEEN 1 AND 9999 AND pos % 10 < 3 AND pos % 20 < 9 AS price FROM (SELECT scan_id, pos, regexp_extract(value, '[0-9]+') AS v FROM {features})")
def fn2_price_tag(t):
    number = F.regexp_extract("value", "[0-9]+", 0)
    return t("features").select("scan_id", "pos", text.price_tag(number, F.col("pos") % 20, F.col("pos") % 10, F.lit(20), F.lit(10)).alias("price"))


@query("SELECT scan_id, pos, pos % 3 = 0 AS counterfeit_spelling, coalesce(confidence, 0.5) < 0.70 AS tampering_suspected, 'RL-' || upper(category) || '-001' AS rule_id FROM {features}")
def fn3_flags(t):
    # every third line is misspelled
    value = F.when(F.col("pos") % 3 == 0, F.concat("value", F.element_at(F.array(*map(F.lit, (" Net  Weigt", " packd", " BEST BEFOR"))), (F.col("pos") % 2 + 1).cast("int")))).otherwise(F.col("value"))
    flags = text.feature_flags(value, F.coalesce("confidence", F.lit(0.5)), F.col("category"))
    return t("features").select("scan_id", "pos", flags.alias("f")).select("scan_id", "pos", "f.*")


@query("SELECT scan_id, pos, value AS v FROM {features}")
def fn4_indic_digits(t):
    # digits are written in one of five scripts first, so the round trip gives the value back
    scripts = [F.translate("value", "0123456789", d) for d in ("०१२३४५६७८९", "௦௧௨௩௪௫௬௭௮௯", "౦౧౨౩౪౫౬౭౮౯", "૦૧૨૩૪૫૬૭૮૯", "০১২৩৪৫৬৭৮৯")]
    written = F.element_at(F.array(*scripts), (F.col("pos") % 5 + 1).cast("int"))
    return t("features").select("scan_id", "pos", ids.normalize_indic_digits(written).alias("v"))


#: Letters only, short, doubled or vowelless readings, and what they are taken for.
_READ = "CASE pos % 5 WHEN 0 THEN value WHEN 1 THEN '||l' WHEN 2 THEN 'brrt' WHEN 3 THEN substr(value, 1, 2) ELSE '--' END"
_CONSONANTS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"


@query(f"""WITH r AS (SELECT scan_id, pos, coalesce(confidence, 0.5) AS c, {_READ} AS v FROM {{features}}), l AS (SELECT *, regexp_replace(v, '[^a-zA-Z]', '', 'g') AS l FROM r)
 SELECT scan_id, pos, CASE WHEN NOT regexp_matches(v, '[a-zA-Z0-9]') THEN true WHEN regexp_full_match(v, '[lI1|:;~_.iL-]{{2,}}') THEN true WHEN l = '' THEN false WHEN lower(l) IN ({", ".join(repr(a) for a in C.ACRONYMS)}) OR regexp_matches(v, '[0-9]') THEN false
  WHEN regexp_matches(l, '(?i){C.GARBLED.replace("'", "''")}') THEN true WHEN NOT regexp_matches(l, '[aeiouyAEIOUY]') AND length(l) >= 2 THEN true WHEN length(l) <= 2 AND c < 0.75 THEN true
  WHEN c < 0.88 AND len(list_filter(range(1, length(l)), lambda i: l[i] = l[i + 1] AND contains('{_CONSONANTS}', l[i]))) > 0 THEN true WHEN c < 0.85 AND regexp_matches(l, '^[{_CONSONANTS}]{{2,}}') THEN true ELSE false END AS h FROM l""")
def fn13_hallucination(t):
    rows = derived(t, f"SELECT scan_id, pos, coalesce(confidence, 0.5) AS c, {_READ} AS v FROM {{features}}")
    return rows.select("scan_id", "pos", text.is_latin_hallucination(F.col("v"), F.col("c")).alias("h"))


_DEVANAGARI = "CASE pos % 4 WHEN 0 THEN 'शुद्ध मात्रा ' || value WHEN 1 THEN 'प्रसिद्ध भेळ' WHEN 2 THEN 'दिल्ली में' ELSE 'निव्वळ चव' END"


@query(f"SELECT scan_id, pos, CASE WHEN pos % 4 IN (1, 3) THEN 'mr' ELSE 'hi' END AS language FROM {{features}}")
def fn12_devanagari(t):
    rows = derived(t, f"SELECT scan_id, pos, {_DEVANAGARI} AS v FROM {{features}}")
    return rows.select("scan_id", "pos", text.devanagari_language(F.col("v")).alias("language"))


_MIXED = "CASE pos % 3 WHEN 0 THEN 'मूल्य ab, वजन!' WHEN 1 THEN value || '  abcd क' ELSE value END"


@query(rf"""WITH m AS (SELECT scan_id, pos, {_MIXED} AS t FROM {{features}}), c AS (SELECT *, length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) AS signs, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters FROM m),
 f AS (SELECT *, trim(regexp_replace(CASE WHEN signs > 0 THEN coalesce(nullif(trim(regexp_replace(regexp_replace(t, '[A-Za-z]+|[,|._~`''"!?:-]', '', 'g'), '\s+', ' ', 'g')), ''), t) ELSE t END, '\s+', ' ', 'g')) AS g FROM c)
 SELECT scan_id, pos, CASE WHEN letters >= 4 AND signs <= 1 THEN coalesce(nullif(trim(regexp_replace(regexp_replace(g, '[ऀ-ॿ]', '', 'g'), '\s+', ' ', 'g')), ''), g) ELSE g END AS v FROM f""")
def fn14_crosstalk(t):
    """Stray Latin in Devanagari texts, a stray sign in Latin ones, and lines as they are."""
    rows = derived(t, f"SELECT scan_id, pos, {_MIXED} AS t FROM {{features}}")
    return rows.select("scan_id", "pos", text.prune_crosstalk(F.col("t")).alias("v"))


@query(f"""WITH k AS ({_TOKENS}) SELECT scan_id, token_pos, xmin, ymin, xmax, ymax, CASE WHEN w * h > 0 THEN w * h / ((xmax - xmin) * (ymax - ymin) + 2500 - w * h) ELSE 0.0 END::DOUBLE AS iou
 FROM (SELECT *, greatest(0, least(xmax, 60) - greatest(xmin, 10))::DOUBLE AS w, greatest(0, least(ymax, 60) - greatest(ymin, 10))::DOUBLE AS h FROM k)""")
def fn23_iou(t):
    own = tuple(F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax"))
    fixed = tuple(F.lit(float(v)) for v in (10, 10, 60, 60))
    return _tokens(t).select("scan_id", "token_pos", "xmin", "ymin", "xmax", "ymax", geometry.iou(own, fixed).alias("iou"))


@query("SELECT DISTINCT category, CASE category WHEN 'mrp' THEN 'Retail Price (MRP)' WHEN 'quantity' THEN 'Net Quantity' WHEN 'address' THEN 'Manufacturer Address' WHEN 'mfg_date' THEN 'Date of Mfg & Expiry' WHEN 'helpline' THEN 'Consumer Helpline' WHEN 'license' THEN 'FSSAI / BIS License' ELSE 'OTHER' END AS label FROM {features}")
def fn27_labels(t):
    return t("features").select("category").distinct().withColumn("label", text.category_label(F.col("category")))


@query("""WITH l AS (SELECT scan_id, pos, value, category, lag(lower(value)) OVER (PARTITION BY scan_id ORDER BY pos) AS before FROM {features})
 SELECT scan_id, pos, CASE WHEN category = 'other' AND regexp_matches(before, 'net content|net wt|net qty|net volume') THEN CASE WHEN regexp_matches(value, '[0-9] kg$') THEN 'quantity' ELSE 'other' END
  WHEN category = 'other' AND regexp_matches(before, 'mrp|price') THEN CASE WHEN regexp_matches(value, '[0-9]') THEN 'mrp' ELSE 'other' END
  WHEN category = 'other' AND regexp_matches(before, 'mfg|pkd|packed|exp') THEN 'other' ELSE category END AS category FROM l""")
def win3_context(t):
    lines = t("features").select("scan_id", F.lit("front").alias("panel"), F.col("pos").alias("line_pos"), F.col("value").alias("text"), "category", (F.col("pos") * 20).alias("ymin"), (F.col("pos") * 20 + 15).alias("ymax"))
    return ranking.contextual_category(lines).select("scan_id", F.col("line_pos").alias("pos"), "category")


@query(f"""WITH k AS ({_TOKENS}), p AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ymin, (xmin + xmax) / 2.0, text) - 1 AS line_pos FROM k) SELECT scan_id, ymin, xmin, xmax, text, line_pos::INT AS line_pos FROM p""")
def srt4_reading_order(t):
    return ranking.reading_order(_tokens(t)).select("scan_id", "ymin", "xmin", "xmax", "text", "line_pos")


@query(_EVALS + """, own AS MATERIALIZED (SELECT ev.scan_id, ev.eval_id, CASE WHEN ev.eval_id = 'eval_mrp' AND status = 'ISSUE' THEN NULL WHEN ev.eval_id = 'eval_qty' AND status = 'PASS' THEN NULL ELSE ev.value END AS value FROM ev WHERE status IS NOT NULL),
 f AS MATERIALIZED (SELECT scan_id, pos, side, category, value FROM {features}), backs AS (SELECT scan_id, bool_or(side <> 'front') AS b FROM f GROUP BY scan_id),
 ec AS MATERIALIZED (SELECT eval_id, category FROM (SELECT DISTINCT eval_id FROM own) e JOIN (SELECT DISTINCT category FROM f) c ON contains(eval_id, category)),
 hits AS (SELECT scan_id, eval_id, arg_min(side, pos) AS side FROM (SELECT own.scan_id, own.eval_id, f.side, f.pos FROM own JOIN f ON f.scan_id = own.scan_id AND f.value = own.value UNION ALL SELECT own.scan_id, own.eval_id, f.side, f.pos FROM own JOIN ec ON ec.eval_id = own.eval_id JOIN f ON f.scan_id = own.scan_id AND f.category = ec.category) GROUP BY ALL)
 SELECT own.scan_id, own.eval_id, coalesce(h.side, CASE WHEN b THEN 'back_0' ELSE 'front' END) AS side FROM own LEFT JOIN hits h ON h.scan_id = own.scan_id AND h.eval_id = own.eval_id JOIN backs ON backs.scan_id = own.scan_id""")
def rul2_side(t):
    return rules.tag_side(rules.evaluate_rules(t("features")), t("features")).select("scan_id", "eval_id", "side")


@query("""SELECT scan_id, coalesce(arg_min(value, pos) FILTER (category = 'mrp' AND side = 'front'), 'Packaged FMCG Commodity') AS product_name,
 CASE WHEN count(*) FILTER (category = 'mrp' AND side = 'front') = 0 THEN 'GENUINE' WHEN coalesce(arg_min(coalesce(confidence, 0), pos) FILTER (category = 'mrp' AND side = 'front'), 0) < 0.85 THEN 'BRAND_UNCLEAR' ELSE 'CHECK' END AS gate FROM {features} GROUP BY scan_id""")
def rul3_gate(t):
    # price lines stand in for brand features
    return rules.brand_gate(t("features").withColumn("category", F.when(F.col("category") == "mrp", "brand_logo").otherwise(F.col("category"))))


#: Two readings of one crop for every order line, with every branch of the arbitration among them.
_CROPS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 7 WHEN 0 THEN 'RRTO' WHEN 1 THEN 'Biscuit' WHEN 2 THEN '||||' WHEN 3 THEN '' WHEN 4 THEN 'ab' WHEN 5 THEN 'Butter' ELSE 'word ' || CAST(l_partkey AS STRING) END AS latin,
 CAST(CAST(l_quantity AS INT) % 11 AS DOUBLE) / 20 + 0.45 AS latin_conf, CASE l_suppkey % 5 WHEN 0 THEN 'शुद्ध' WHEN 1 THEN 'न' WHEN 2 THEN '' WHEN 3 THEN 'शुद्ध abc, घी' ELSE 'घी 12' END AS dev, CAST(l_orderkey % 13 AS DOUBLE) / 13 AS dev_conf FROM {lineitem}"""


@query(f"""WITH x AS (SELECT *, CASE WHEN dev = 'शुद्ध abc, घी' THEN 'शुद्ध घी' ELSE dev END AS d, dev <> '' AS indic, CASE l_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 7 ELSE 2 END AS signs, length(regexp_replace(latin, '[^A-Za-z0-9]', '', 'g')) AS letters,
  CASE WHEN latin IN ('RRTO', '||||', '') THEN true WHEN latin = 'ab' THEN latin_conf < 0.75 WHEN latin = 'Butter' THEN latin_conf < 0.88 ELSE false END AS garbled FROM ({_CROPS})),
 y AS (SELECT *, CASE WHEN NOT garbled AND latin_conf >= 0.7 AND letters >= 2 THEN CASE WHEN indic AND signs >= 3 AND dev_conf > 0.85 AND latin_conf < 0.8 THEN 'dev' ELSE 'latin' END
  WHEN garbled AND indic AND signs >= 1 AND dev_conf >= 0.25 THEN 'both' WHEN garbled AND d <> '' AND dev_conf > latin_conf THEN 'dev' WHEN indic AND signs >= 2 AND dev_conf >= 0.35 AND (latin_conf < 0.7 OR dev_conf >= latin_conf) THEN 'both'
  WHEN indic AND signs <= 1 AND letters >= 1 THEN 'latin' WHEN indic AND signs >= 2 AND dev_conf >= 0.4 THEN 'dev' ELSE 'latin' END AS taken FROM x)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE taken WHEN 'latin' THEN latin ELSE d END AS text, CASE taken WHEN 'latin' THEN latin_conf WHEN 'dev' THEN dev_conf ELSE greatest(latin_conf, dev_conf) END AS confidence FROM y""")
def fn15_arbitrate(t):
    best = text.arbitrate(*map(F.col, ("latin", "latin_conf", "dev", "dev_conf")))
    return derived(t, _CROPS).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", best.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b.*")


#: Every part name with the next one's, and with itself cut short: equal, near and far texts.
_NAME_PAIRS = """SELECT a.p_partkey, 0 AS kind, a.p_name AS a, b.p_name AS b FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT p_partkey, 1, p_name, substr(p_name, 2, 6) || p_type FROM {part}
 UNION ALL SELECT a.p_partkey, 2, a.p_name || ' ' || a.p_type || ' ' || a.p_brand || ' ' || a.p_name || ' ' || a.p_type || ' ' || a.p_type, b.p_name || b.p_name || ' ' || b.p_brand || ' ' || b.p_type || b.p_type || b.p_type || b.p_type FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1"""


@query(f"""WITH RECURSIVE p AS MATERIALIZED ({_NAME_PAIRS}), d AS MATERIALIZED (SELECT DISTINCT a, b FROM p),
 lcs(a, b, i, line) AS (SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) FROM d
  UNION ALL SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, j::INT, 1) THEN line[j] + 1 ELSE greatest(line[j + 1], acc[j]) END), [0]) FROM lcs WHERE i < length(a)),
 done AS (SELECT a, b, line[length(b) + 1] AS n FROM lcs WHERE i = length(a))
 SELECT p_partkey, kind, n::INT AS common, round(200.0::DOUBLE * n / (length(p.a) + length(p.b)), 9) AS ratio FROM p JOIN done ON done.a = p.a AND done.b = p.b""")
def fn21_ratio(t):
    a, b = F.col("a"), F.col("b")
    # a small file of names is one split: pairs are dealt before they are compared, and compared once for both columns
    pairs = derived(t, _NAME_PAIRS).repartition("p_partkey", "kind").withColumn("common", fuzzy.lcs_length(a, b))
    return pairs.select("p_partkey", "kind", "common", F.round(fuzzy.ratio_of(F.col("common"), a, b), 9).alias("ratio"))


@query("SELECT id, expiry_date, CASE WHEN expiry_date::DATE < DATE '2025-01-01' THEN 'EXPIRED' WHEN expiry_date::DATE - DATE '2025-01-01' <= 60 THEN 'Expires in ' || (expiry_date::DATE - DATE '2025-01-01') || 'd' ELSE 'Active Batch' END AS state FROM {registry}")
def fn24_expiry(t):
    return t("registry").select("id", "expiry_date", dates.expiry_status(F.col("expiry_date"), F.lit("2025-01-01").cast("date")).alias("state"))


@query("SELECT id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' WHEN s < 604800 THEN floor(s / 86400)::BIGINT || 'd ago' ELSE substr(ts_text, 1, 10) END AS age FROM (SELECT id, ts_text, epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - epoch(ts_text::TIMESTAMP)::BIGINT AS s FROM {audit_logs})")
def fn25_relative_time(t):
    return t("audit_logs").select("id", dates.relative_time(dates.parse_ts(F.col("ts_text")), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@query("SELECT p_partkey, CASE WHEN a <= 50 THEN 1.0 WHEN a <= 200 THEN 2.0 WHEN a <= 500 THEN 4.0 ELSE 6.0 END::DOUBLE AS full_mm, CASE WHEN a <= 200 THEN 2.0 WHEN a <= 500 THEN 4.0 ELSE 6.0 END::DOUBLE AS short_mm FROM (SELECT p_partkey, p_size * 15 AS a FROM {part})")
def fn22_required_height(t):
    area = F.col("p_size") * 15
    return t("part").select("p_partkey", geometry.required_height(area).cast("double").alias("full_mm"), geometry.required_height(area, "short").cast("double").alias("short_mm"))


# --- composite plans ------------------------------------------------------------------------

@query(_EVALS + "SELECT scan_id, eval_id, rule_pos, status, CASE WHEN status <> 'PASS' THEN money ELSE 0 END::BIGINT AS penalty FROM ev WHERE status IS NOT NULL")
def rul1_evaluate(t):
    return rules.evaluate_rules(t("features")).select("scan_id", "eval_id", "rule_pos", "status", "penalty")


@query(_EVALS + "SELECT scan_id, CASE WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'NON-COMPLIANT' ELSE 'COMPLIANT' END AS verdict, round_even(100.0::DOUBLE * count(*) FILTER (status = 'PASS') / count(*), 1) AS rate, sum(CASE WHEN status <> 'PASS' THEN money ELSE 0 END)::BIGINT AS penalty FROM ev WHERE status IS NOT NULL GROUP BY scan_id")
def w1_compliance(t):
    """Workload 1 in one plan: features to verdicts."""
    return rules.summarise(rules.evaluate_rules(t("features"))).select("scan_id", "verdict", "rate", "penalty")


@query("""WITH s AS (SELECT scan_id, arg_min(detected, panel_pos) AS detected, arg_min(payload, panel_pos) AS payload FROM {barcodes} GROUP BY scan_id), v AS (SELECT *, """ + _check("payload") + """ AS valid FROM s), o AS (SELECT v.*, (hash_no % 5 = 0) AS is_spoof, hash_no % 4 AS violations FROM (SELECT *, substr(scan_id, 5)::BIGINT AS hash_no FROM v) v),
 p AS (SELECT scan_id, CASE WHEN detected AND NOT valid THEN 40 ELSE 0 END + CASE WHEN is_spoof THEN 35 ELSE 0 END + CASE WHEN violations >= 3 THEN 8 ELSE 0 END AS raw FROM o)
 SELECT scan_id, greatest(1, least(100, raw))::INT AS score, CASE WHEN raw <= 25 THEN 'AUTHENTIC' WHEN raw <= 55 THEN 'SUSPECTED_COUNTERFEIT' ELSE 'CRITICAL_COUNTERFEIT' END AS verdict FROM p""")
def rul6_risk(t):
    first = t("barcodes").groupBy("scan_id").agg(F.min_by(F.struct("detected", "payload"), "panel_pos").alias("b")).select("scan_id", "b.*")
    n = F.substring("scan_id", 5, 20).cast("long")
    signals = first.select("scan_id", "detected", ids.gtin_valid(F.col("payload")).alias("valid"), (n % 5 == 0).alias("is_spoof"), (n % 4).alias("violations"))
    return risk.counterfeit_risk(signals).select("scan_id", "score", "verdict")


@query()
def rul4_spoofing(t):
    """Brand texts from part names and brands against company names (no SQL: fuzzy scoring; tested by cases)."""
    k = F.col("p_partkey")
    seen = t("part").select("p_partkey", F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.concat(F.lit("Br0nd#"), (k % 25).cast("string"))).otherwise(F.col("p_name")).alias("brand"))
    owned = t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("load_pos")).withColumn("company_id", F.concat(F.lit("C"), (F.col("load_pos") % 10).cast("string")))
    spoofs = t("part").select(F.concat(F.lit("Brnd"), k.cast("string")).alias("spoof"), F.col("p_brand").alias("target"), F.lit("Typographic").alias("type"))
    return brand_plans.detect_spoofing(seen, t("companies"), owned, spoofs).select("p_partkey", "brand", "status", "matched_brand", "score", "company_id")


_TYPES = "SELECT p_type AS n FROM {part} UNION SELECT p_name || ' Foods' FROM {part}"


@query(f"""WITH b AS ({_TYPES}), w AS (SELECT DISTINCT n AS brand, unnest(regexp_extract_all(lower(n), '[a-z0-9]+')) AS token FROM b),
 e AS (SELECT n AS brand, NULL AS token, n FROM b UNION ALL SELECT brand, token, token FROM w WHERE length(token) >= 3 AND token NOT IN ({", ".join(repr(g) for g in C.GENERIC)})),
 x AS (SELECT brand, token, n, regexp_replace({_SDX}, '[^A-Z]', '', 'g') AS w, {_MET} AS m FROM e), y AS (SELECT *, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202') AS c, m[1] || regexp_replace(substr(m, 2), '[AEIOU]', '', 'g') AS j FROM x)
 SELECT brand, token, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace({_sql_replace('translate(lower(n), ' + repr(''.join(C.HOMOGLYPHS)) + ', ' + repr(''.join(C.HOMOGLYPHS.values())) + ')', C.HOMOGLYPH_PAIRS)}, '[^a-z0-9 ]', '', 'g')) AS homoglyph,
  regexp_replace({_sql_single(_sql_replace('lower(n)', C.DIGRAPHS), _AZ + '0123456789 ')}, '[^a-z0-9]', '', 'g') AS digraph, CASE WHEN w = '' THEN '0000' ELSE rpad(w[1] || replace(substr({_sql_single('c', '0123456')}, 2), '0', ''), 4, '0') END AS soundex, substr({_sql_single('j', _AZ.upper() + '0')}, 1, 6) AS metaphone FROM y""")
def rul5_signatures(t):
    names = derived(t, _TYPES.replace(" UNION ", " UNION ALL ")).select(F.col("n").alias("brand"))
    return brand_plans.brand_signatures(names, plain=True)


# --- streams by their batch twins, and sinks --------------------------------------------------


@query("SELECT session, frame_no, focus, categories FROM {frames} WHERE focus > 40")
def str1_gate(t):
    return frames.gate_frames(t("frames")).select("session", "frame_no", "focus", "categories")


@query("SELECT session, arg_min(frame_no, (ts, frame_no)) AS frame_no FROM {frames} WHERE focus > 40 AND categories >= 2 GROUP BY session")
def str2_capture(t):
    return frames.auto_capture(t("frames")).select("session", "frame_no")


@query("SELECT session, CAST(time_bucket(INTERVAL '6 hours', ts) AS VARCHAR) AS start, arg_max(frame_no, (focus, frame_no)) AS frame_no, max(focus) AS focus FROM {frames} GROUP BY ALL")
def str3_sample(t):
    return frames.sample_frames(t("frames"), "6 hours").withColumn("start", F.col("start").cast("string"))


@query("SELECT CAST(date_trunc('day', o_orderdate) AS VARCHAR)[1:10] AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS compliant FROM {orders} GROUP BY 1")
def str4_kpis(t):
    rows = t("orders").select(F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderstatus") == "O", "COMPLIANT").otherwise("NON-COMPLIANT").alias("verdict"))
    return frames.stream_kpis(rows).withColumn("day", F.substring(F.col("day").cast("string"), 1, 10))


@query("""WITH f AS (SELECT scan_id, arg_min(title, rule_pos) AS title, arg_min(clause, rule_pos) AS clause FROM {evals} WHERE status <> 'PASS' GROUP BY scan_id)
 SELECT s.id AS scan_id, product_name, coalesce(title, 'Unknown Compliance Defect') AS title, coalesce(clause, 'General Provision') AS clause, CASE WHEN coalesce(penalty, 0) = 0 THEN 25000 ELSE penalty END::BIGINT AS fine, scan_date AS day FROM {scans} s LEFT JOIN f ON f.scan_id = s.id WHERE verdict = 'NON-COMPLIANT'""")
def str4_violations(t):
    first = t("evals").filter("status <> 'PASS'").groupBy("scan_id").agg(F.min_by(F.struct("title", "clause"), "rule_pos").alias("f")).select("scan_id", "f.*")
    return frames.stream_violations(t("scans"), first)


@query("SELECT DISTINCT id, action FROM {audit_logs}")
def str5_audit(t):
    logs = t("audit_logs").select("id", "action")
    return frames.append_audit(logs.union(logs))


@query("SELECT s.id, scan_date, product_name, verdict, coalesce(max(status) FILTER (rule_code = 'RL-MAND-007'), 'NA') AS mrp_status, coalesce(max(status) FILTER (rule_code = 'RL-PHYS-012'), 'NA') AS qty_status, 5::INT AS score FROM {scans} s LEFT JOIN {evals} e ON e.scan_id = s.id GROUP BY ALL")
def snk2_audit(t):
    return store.inspection_audit(t("scans"), t("evals"))


@query("""SELECT sku AS "SKU_Barcode", product_name AS "Product_Name", brand AS "Brand", category AS "Category", batch_number AS "Batch_Number", CAST(declared_mrp AS VARCHAR) AS "Declared_MRP_INR", '' AS "Net_Quantity", mfg_date AS "Mfg_Date", expiry_date AS "Expiry_Date", manufacturer AS "Manufacturer_Address",
 '' AS "FSSAI_License", '' AS "Consumer_Care", 'India' AS "Country_Of_Origin", '' AS "CIN", risk AS "Risk_Score", CAST(scans_count AS VARCHAR) AS "Scans_Count", CAST(passed_count AS VARCHAR) AS "Passed_Count", '0' AS "Violations_Count", '' AS "Registered_Date" FROM {registry}""")
def snk1_registry(t):
    return store.registry_rows(t("registry"))


@query("""SELECT scan_no AS number, row_number() OVER (PARTITION BY substr(scan_date, 1, 7) ORDER BY scan_no) - 1 AS list_pos, id, scan_date AS timestamp, product_name AS "productName", batch_number AS "batchNumber", barcode, verdict AS "overallVerdict", CAST(penalty AS BIGINT) AS "penaltyEstimateInr" FROM {scans}""")
def src1_store(t):
    """Scans as one document a month, written and read again in pieces."""
    scans = t("scans")
    own = F.struct("scan_no", "id", F.col("scan_date").alias("timestamp"), F.col("product_name").alias("productName"), F.col("batch_number").alias("batchNumber"), "barcode", F.col("verdict").alias("overallVerdict"), F.col("penalty").alias("penaltyEstimateInr"))
    items = scans.select(F.substring("scan_date", 1, 7).alias("month"), "scan_no", F.to_json(own).alias("item"))
    order = Window.partitionBy("month").orderBy("scan_no", "item")
    begin, end = F.when(F.row_number().over(order) == 1, '{"scans":[').otherwise(""), F.when(F.lead(F.lit(1)).over(order).isNull(), "]}").otherwise(",")
    path = fresh_path(scans.sparkSession, "store")
    items.select("month", F.concat(begin, "item", end).alias("value")).write.partitionBy("month").text(path)
    back = store.read_store(scans.sparkSession, path)["scans"]
    return back.select(F.substring("id", 5, 20).cast("long").alias("number"), "list_pos", "id", "timestamp", "productName", "batchNumber", "barcode", "overallVerdict", "penaltyEstimateInr")


@query("""SELECT s_suppkey AS load_pos, 'C' || s_suppkey AS company_id, s_name AS name, '890' || lpad(s_suppkey::VARCHAR, 4, '0') AS gs1_prefix, CASE WHEN s_suppkey % 3 > 0 THEN lpad(s_suppkey::VARCHAR, 14, '1') END AS fssai, 'Brand ' || s_suppkey AS brand, CASE WHEN s_suppkey % 2 = 0 THEN 'Brnd ' || s_suppkey END AS spoof FROM {supplier}""")
def src2_corporate(t):
    """A corporate registry written as one document and read in pieces: companies with their brands and spoofs."""
    k = F.col("s_suppkey")
    text_ = k.cast("string")
    spoofs = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit(" Brnd "), text_).alias("spoof"), F.lit("x, [y]").alias("target")))).when(k % 5 == 1, F.array(F.struct(F.concat(F.lit("brand-"), text_).alias("spoof"), F.lit("x").alias("target"))))
    fssai = F.when(k % 3 > 0, F.lpad(text_, 14, "1")).otherwise("none")
    company = F.struct(k.alias("order"), F.concat(F.lit("C"), text_).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("890"), F.lpad(text_, 4, "0")).alias("gs1Prefix"), fssai.alias("fssaiLicense"), F.array(F.concat(F.lit(" Brand "), text_), F.lit("")).alias("brands"), spoofs.alias("spoofVariants"))
    # one element a line, from a bracket to a bracket, in the order of the keys
    lines = t("supplier").select(k.alias("order"), F.concat(F.when(k == 0, "").otherwise(","), F.to_json(company)).alias("value"))
    ends = lines.limit(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("order"), F.lit('{"version": 1, "companies": [').alias("value")), F.struct(F.lit(2**62).alias("order"), F.lit("]}").alias("value")))).alias("x")).select("x.*")
    spark = lines.sparkSession
    path = fresh_path(spark, "corporate")
    lines.union(ends).coalesce(1).sortWithinPartitions("order").select("value").write.text(path)
    read = store.read_corporate_registry(spark, path)
    own = read["companies"].join(read["company_brands"].select("company_id", "brand"), "company_id", "left").join(read["spoofs"].select("company_id", "spoof"), "company_id", "left")
    return own.select(F.col("load_pos").cast("long").alias("load_pos"), "company_id", "name", "gs1_prefix", "fssai", "brand", "spoof")


@query("SELECT id, sku, product_name, brand, category, batch_number, mfg_date, expiry_date, declared_mrp, manufacturer, risk, scans_count, passed_count FROM {registry}")
def snk4_registry_json(t):
    """The registry, written as JSON and read again."""
    rows = t("registry").drop("pos")
    path = fresh_path(rows.sparkSession, "registry-json")
    store.export_registry_json(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


@query("""SELECT id AS "Log ID", strftime(ts_text::TIMESTAMP, '%d %b %Y, %I:%M:%S %p') AS "Formatted Date & Time", ts_text AS "Raw Timestamp", user_name AS "User / Principal", action AS "Action Taken", target AS "Target Resource", '' AS "Source IP", status AS "Status", coalesce(details, '') AS "Details" FROM {audit_logs}""")
def snk3_audit_trail(t):
    return store.audit_trail(t("audit_logs"))


@query("""SELECT name AS "Name", id_badge AS "Badge ID", CAST(total_inspections AS VARCHAR) AS "Total Inspections", CAST(reports_generated AS VARCHAR) AS "Reports Generated", current_status AS "Current Status", zone AS "Jurisdiction", '' AS "Email", '' AS "Phone" FROM {inspectors}""")
def snk3_roster(t):
    return store.roster(t("inspectors"))


@query("""SELECT id AS "Report ID", coalesce(source, 'INSTITUTIONAL') AS "Origin", subject_entity AS "Subject Entity", '' AS "Assessed Product", type AS "Type", '' AS "Date Generated", inspector_name AS "Inspector", status AS "Status", CAST(fine AS VARCHAR) AS "Fine INR", coalesce(scan_id, '') AS "Scan Ref" FROM {reports}""")
def snk3_reports(t):
    return store.report_rows(t("reports"))


@query("""WITH r AS (SELECT CASE WHEN pos % 7 = 0 THEN ' ' ELSE sku END AS sku, product_name, CASE WHEN pos % 3 = 0 THEN brand END AS brand, CASE WHEN pos % 2 = 0 THEN '' ELSE category END AS category, CASE WHEN pos % 5 = 0 THEN 'x' ELSE CAST(declared_mrp AS VARCHAR) END AS declared_mrp, CASE WHEN pos % 4 > 0 THEN batch_number END AS batch_number FROM {registry})
 SELECT sku, product_name, coalesce(brand, 'Imported Brand') AS brand, coalesce(nullif(category, ''), 'Packaged Foods') AS category, coalesce(nullif(try_cast(declared_mrp AS DOUBLE), 0), 50.0)::DOUBLE AS declared_mrp, coalesce(batch_number, 'BATCH-0115') AS batch_number, 0::BIGINT AS scans_count, 0::BIGINT AS passed_count, 0::BIGINT AS violations_count FROM r WHERE trim(sku) <> ''""")
def src3_import(t):
    k = F.col("pos")
    rows = t("registry").select(F.when(k % 7 == 0, " ").otherwise(F.col("sku")).alias("sku"), "product_name", F.when(k % 3 == 0, F.col("brand")).alias("brand"), F.when(k % 2 == 0, "").otherwise(F.col("category")).alias("category"), F.when(k % 5 == 0, "x").otherwise(F.col("declared_mrp").cast("string")).alias("declared_mrp"), F.when(k % 4 > 0, F.col("batch_number")).alias("batch_number"))
    return store.imported(rows, "2024-01-15", store.CSV_DEFAULTS)


# --- layout ---------------------------------------------------------------------------------

_FITS = """s.col = w.col AND greatest(0, least(s.ymax, w.ymax) - greatest(s.ymin, w.ymin)) >= 0.45 * greatest(1, least(s.ymax - s.ymin, w.ymax - w.ymin))
 AND greatest(0, least(s.xmax, w.xmax) - greatest(s.xmin, w.xmin)) < 0.25 * greatest(1, least(s.xmax - s.xmin, w.xmax - w.xmin)) AND greatest(0, s.xmin - w.xmax, w.xmin - s.xmax) <= 3.5 * greatest(s.ymax - s.ymin, w.ymax - w.ymin)"""


@query(f"""WITH k AS ({_TOKENS}),
 sp AS (SELECT scan_id, [{{'x0': NULL::INT, 'x1': NULL::INT, 'reach': NULL::INT, 'starts': [0]}}] || list_transform(list_sort(list({{'x0': xmin, 'x1': least(400, xmax)}})), lambda e: {{'x0': e.x0, 'x1': e.x1, 'reach': 0, 'starts': [0]}}) AS sp FROM k GROUP BY scan_id),
 cs AS (SELECT scan_id, list_reduce(sp, lambda a, e: {{'x0': 0, 'x1': 0, 'reach': greatest(a.reach, e.x1), 'starts': CASE WHEN coalesce(e.x0 > a.reach, true) AND e.x0 - a.starts[-1] >= 16 THEN a.starts || [e.x0] ELSE a.starts END}}).starts AS starts FROM sp),
 pl AS (SELECT k.*, starts, len(list_filter(starts, lambda x: x <= (xmin + xmax) / 2)) AS col FROM k JOIN cs USING (scan_id)),
 ws AS (SELECT scan_id, list_sort(list({{'ymin': ymin, 'token_pos': token_pos, 'xmin': xmin, 'xmax': xmax, 'ymax': ymax, 'text': text, 'col': col}})) AS ws FROM pl WHERE col > 0 AND (xmin + xmax) / 2 <= coalesce(starts[col + 1] - 1, 400) GROUP BY scan_id),
 fd AS (SELECT scan_id, unnest(list_reduce(list_transform(ws, lambda w, i: [{{'w': w, 'line': i, 'seed': true}}]),
  lambda a, b: a || list_transform(b, lambda x: {{'w': x.w, 'line': coalesce(list_filter(a, lambda p: p.seed AND {_FITS.replace('s.', 'p.w.').replace(' w.', ' x.w.').replace('(w.', '(x.w.')})[1].line, 1 + list_max(list_transform(a, lambda p: p.line))), 'seed': len(list_filter(a, lambda p: p.seed AND {_FITS.replace('s.', 'p.w.').replace(' w.', ' x.w.').replace('(w.', '(x.w.')})) = 0}}))) AS x FROM ws),
 ln AS (SELECT scan_id, x.line AS line, x.w.col AS col, string_agg(x.w.text, ' ' ORDER BY x.w.xmin, x.w.token_pos, x.w.text) AS text, min(x.w.xmin)::DOUBLE AS xmin, min(x.w.ymin)::DOUBLE AS ymin, max(x.w.xmax)::DOUBLE AS xmax, max(x.w.ymax)::DOUBLE AS ymax FROM fd GROUP BY ALL)
 SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY ymin, xmin + xmax, col, line) - 1)::INT AS line_pos, text, xmin, ymin, xmax, ymax FROM ln""")
def grp1_lines(t):
    """Lines of the derived tokens."""
    tokens = _tokens(t).withColumns({"conf": F.lit(0.9), "page_w": F.lit(400)})
    return layout.cluster_lines(tokens).select("scan_id", "line_pos", "text", "xmin", "ymin", "xmax", "ymax")


@query(f"""WITH k AS ({_TOKENS}),
 b AS (SELECT scan_id, list_sort(list({{'m': (ymin + ymax) / 2, 'token_pos': token_pos, 'xmin': xmin, 'xmax': xmax, 'ymin': ymin, 'ymax': ymax, 'text': text}})) AS bs FROM k GROUP BY scan_id),
 f AS (SELECT scan_id, list_reduce(list_transform(bs, lambda w, i: [{{'w': w, 'line': 1}}]),
  lambda a, b: a || list_transform(b, lambda x: {{'w': x.w, 'line': coalesce(list_filter(range(1, list_max(list_transform(a, lambda p: p.line)) + 1), lambda l: abs(x.w.m - list_avg(list_transform(list_filter(a, lambda p: p.line = l), lambda p: p.w.m))) <= 15)[1], 1 + list_max(list_transform(a, lambda p: p.line)))}})) AS xs FROM b),
 o AS (SELECT scan_id, unnest(xs) AS x FROM f), m AS (SELECT scan_id, x.line AS line, avg(x.w.m) AS mean FROM o GROUP BY ALL), r AS (SELECT scan_id, line, row_number() OVER (PARTITION BY scan_id ORDER BY mean, line) - 1 AS line_pos FROM m)
 SELECT o.scan_id, x.w.token_pos AS token_pos, x.w.xmin AS xmin, x.w.ymin AS ymin, x.w.text AS text, line_pos::INT AS line_pos FROM o JOIN r ON r.scan_id = o.scan_id AND r.line = o.x.line""")
def grp2_baselines(t):
    return layout.cluster_baselines(_tokens(t)).select("scan_id", "token_pos", "xmin", "ymin", "text", "line_pos")


_LABELS = "CASE WHEN l_suppkey % 7 = 0 THEN 'Biscuits' WHEN l_suppkey % 5 = 0 THEN 'MRP 5' ELSE 'Brand' || CAST(l_partkey % 50 AS STRING) END"
_ITEMS = "SELECT 'INS-' || CAST(l_orderkey AS STRING) AS scan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos, CASE WHEN l_linenumber = 1 THEN 'mrp' ELSE 'other' END AS category, " + _LABELS + " AS value, 0.5 + CAST(l_discount AS DOUBLE) * 4 AS confidence, CAST(l_partkey % 300 AS DOUBLE) AS xmin, CAST(l_partkey % 300 + l_quantity AS DOUBLE) AS xmax, CAST(l_suppkey % 90 * 4 AS DOUBLE) AS ymin, CAST(l_suppkey % 90 * 4 + 5 + floor(l_quantity / 2) AS DOUBLE) AS ymax FROM {lineitem}"


@query(f"""WITH RECURSIVE raw AS ({_ITEMS}), it AS (SELECT *, greatest(4, ymax - ymin) AS h, greatest(4, xmax - xmin) AS w, (ymin + ymax) / 2 AS yc, (xmin + xmax) / 2 AS xc, category = 'mrp' OR value = 'MRP 5' AS declared FROM raw),
 c AS (SELECT *, pow(h, 2.2) * sqrt(length(value)) * confidence * CASE WHEN yc / 360 < 0.45 THEN 1.2 WHEN yc / 360 < 0.75 THEN 1.0 ELSE 0.4 END AS weight FROM it WHERE NOT declared),
 a AS (SELECT scan_id, arg_min(pos, (-weight, pos)) AS pos, greatest(10, arg_min(h, (-weight, pos))) AS height FROM c GROUP BY scan_id),
 able AS (SELECT c.* FROM c JOIN a USING (scan_id) WHERE c.pos <> a.pos AND c.h >= 0.40 * a.height AND value <> 'Biscuits'),
 reach AS (SELECT scan_id, pos FROM a UNION SELECT n.scan_id, n.pos FROM reach r JOIN c m ON m.scan_id = r.scan_id AND m.pos = r.pos JOIN able n ON n.scan_id = r.scan_id
  AND ((abs(n.yc - m.yc) < 0.75 * greatest(10, n.h, m.h) AND greatest(0, n.xmin - m.xmax, m.xmin - n.xmax) < 1.8 * greatest(10, n.h, m.h))
   OR (greatest(0, n.ymin - m.ymax, m.ymin - n.ymax) < 1.3 * greatest(10, n.h, m.h) AND (least(n.xmax, m.xmax) > greatest(n.xmin, m.xmin) OR abs(n.xc - m.xc) < 1.1 * greatest(n.w, m.w))))),
 own AS (SELECT c.*, a.height, row_number() OVER (PARTITION BY scan_id ORDER BY floor(ymin / greatest(1, floor(height * 0.75))), xmin, -weight, pos) AS o FROM c JOIN reach USING (scan_id, pos) JOIN a USING (scan_id)),
 words AS (SELECT scan_id, string_agg(value, ' ' ORDER BY o) AS value FROM (SELECT scan_id, value, min(o) AS o FROM own GROUP BY ALL) GROUP BY scan_id)
 SELECT scan_id, words.value, round(min(confidence), 2) AS confidence, round(max(confidence), 2) AS confidence_max, floor(max(height))::INT AS font_height, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM own JOIN words USING (scan_id) GROUP BY ALL
 UNION ALL SELECT scan_id, x.value, round(x.confidence, 2), round(x.confidence, 2), floor(x.h)::INT, x.xmin, x.ymin, x.xmax, x.ymax FROM (SELECT scan_id, arg_max(it, (ymax - ymin, -pos)) AS x, bool_and(declared) AS none FROM it GROUP BY scan_id) WHERE none AND x.category = 'other'""")
def grp3_brand_clusters(t):
    rows = derived(t, _ITEMS).withColumns({"panel": F.lit("front"), "page_h": F.lit(360.0)})
    return layout.brand_clusters(rows).select("scan_id", "value", "confidence", "confidence_max", "font_height", "xmin", "ymin", "xmax", "ymax")


@query(f"""WITH c AS (SELECT *, pow(greatest(4, ymax - ymin), 2.2) * sqrt(length(value)) * confidence * CASE WHEN (ymin + ymax) / 2 / 360 < 0.45 THEN 1.2 WHEN (ymin + ymax) / 2 / 360 < 0.75 THEN 1.0 ELSE 0.4 END AS weight FROM ({_ITEMS}))
 SELECT scan_id, arg_max(pos, (weight, -pos)) AS pos, arg_max(value, (weight, -pos)) AS value FROM c GROUP BY scan_id""")
def win6_anchor(t):
    rows = derived(t, _ITEMS).withColumns({"panel": F.lit("front"), "page_h": F.lit(360.0), "script_family": F.lit("Latin")})
    return ranking.brand_anchor(rows).select("scan_id", "pos", "value")


# --- whole workloads ------------------------------------------------------------------------

#: Words of the derived lines as tokens that touch, a line every forty pixels.
_WORDS = """SELECT scan_id, side AS panel, CAST(pos * 100 + i AS INT) AS token_pos, word AS text, CAST(0.5 + (pos % 8) / 16.0 AS DOUBLE) AS conf, CAST(10 + 8 * i AS DOUBLE) AS xmin, CAST(18 + 8 * i AS DOUBLE) AS xmax, CAST(40 * pos AS DOUBLE) AS ymin, CAST(40 * pos + 20 AS DOUBLE) AS ymax, 1000 AS page_w
 FROM {features} LATERAL VIEW posexplode(split(value, ' ')) w AS i, word"""
_LINES = """WITH f0 AS (SELECT scan_id, pos, side, 0.5 + (pos % 8) / 16.0 AS confidence, value, CASE WHEN regexp_matches(value, '^Ingredients') THEN 'ingredients' WHEN regexp_matches(value, '^MRP Rs') THEN 'mrp' WHEN regexp_matches(value, '^Net Wt') THEN 'quantity' WHEN regexp_matches(value, '^PKD:') THEN 'mfg_date'
 WHEN regexp_matches(value, '^Lic No') THEN 'license' WHEN regexp_matches(value, '^Customer care') THEN 'helpline' WHEN regexp_matches(value, '^Packed by') THEN 'address' ELSE 'other' END AS own FROM {features}),
 f1 AS (SELECT *, lag(lower(value)) OVER w AS before, lag(pos) OVER w AS last FROM f0 WINDOW w AS (PARTITION BY scan_id, side ORDER BY pos)),
 feats AS (SELECT scan_id, pos + CASE side WHEN 'front' THEN 0 ELSE 100000 END AS pos, side, confidence, value, CASE WHEN own <> 'other' OR last IS NULL OR last < pos - 1 THEN own WHEN regexp_matches(before, 'net content|net wt|net qty|net volume') THEN CASE WHEN regexp_matches(value, '[0-9] kg$') THEN 'quantity' ELSE 'other' END
  WHEN regexp_matches(before, 'mrp|price') THEN CASE WHEN regexp_matches(value, '[0-9]') THEN 'mrp' ELSE 'other' END WHEN regexp_matches(before, 'mfg|pkd|packed|exp') THEN 'other' ELSE 'other' END AS category FROM f1),
 """


@query(_LINES + _EVALS.replace("{features}", "feats")[5:].replace("list_position(['mrp', 'other'], category) AS place_no FROM fv", "list_position(['mrp', 'other'], category) AS place_no FROM fv", 1).replace("SELECT 'eval_ingredients', 7, 0, *, CASE WHEN category = 'other' AND contents THEN 0 END, 1 FROM fv", "SELECT 'eval_ingredients', 7, 0, *, CASE WHEN category IN ('ingredients', 'other') AND contents THEN 0 END, 1 FROM fv") + """
 SELECT scan_id, CASE WHEN count(*) FILTER (status <> 'PASS') > 0 THEN 'NON-COMPLIANT' ELSE 'COMPLIANT' END AS verdict, round_even(100.0::DOUBLE * count(*) FILTER (status = 'PASS') / count(*), 1) AS rate, sum(CASE WHEN status <> 'PASS' THEN money ELSE 0 END)::BIGINT AS penalty,
 CASE arg_min(eval_id, rule_pos) FILTER (status <> 'PASS') WHEN 'eval_mrp' THEN 'RL-MAND-007' WHEN 'eval_qty' THEN 'RL-PHYS-012' WHEN 'eval_addr' THEN 'RL-AUTH-001' WHEN 'eval_date' THEN 'RL-MAND-003' WHEN 'eval_care' THEN 'RL-MAND-004' WHEN 'eval_fssai' THEN 'RL-LIC-005' END AS first_failed FROM ev WHERE status IS NOT NULL GROUP BY scan_id""")
def w1_inspection(t):
    """Workload 1 from tokens: lines, categories, context, rules, sides, verdicts."""
    return workloads.inspect(derived(t, _WORDS)).select("scan_id", "verdict", "rate", "penalty", "first_failed")


@query()
def w2_risk(t):
    """Workload 2: barcodes, owners, brands, licences and violations to risk (no SQL: fuzzy scoring; parts have queries of their own)."""
    k = F.col("scan_no")
    seen = t("scans").select(F.col("id").alias("scan_id"), F.when(k % 3 == 0, F.col("brand")).when(k % 3 == 1, F.concat(F.lit("Br0nd#"), (k % 25).cast("string"))).otherwise(F.col("product_name")).alias("brand"))
    owned = t("part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_partkey").alias("load_pos")).withColumn("company_id", F.concat(F.lit("C"), (F.col("load_pos") % 10).cast("string")))
    spoofs = t("part").select(F.concat(F.lit("Brnd"), F.col("p_partkey").cast("string")).alias("spoof"), F.col("p_brand").alias("target"), F.lit("Typographic").alias("type"))
    return workloads.assess(t("barcodes"), t("features"), t("evals"), seen, t("companies"), owned, spoofs).select("scan_id", "score", "verdict", "anomalies")

"""Steps whose cost once grew faster than their tables, or was paid more than once."""

import re

from pyspark.sql import functions as F

from packproof import catalog
from packproof.functions import fuzzy, ids, lookup
from packproof.operators import joins, metrics
from packproof.plans import brands, risk, rules

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_dealt_and_compared_once(spark):
    made = catalog.QUERIES["fn21_ratio"](spark, DATA)
    text = plan(made)
    assert "RepartitionByExpression" in text and text.count("bit_count(") == 2  # short texts and long ones
    pair = spark.createDataFrame([("abc", "abd"), ("", ""), (None, "a"), ("a", "a")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert all(x == y for x, y in pair.select(fuzzy.fuzz_ratio(a, b), fuzzy.ratio_of(fuzzy.lcs_length(a, b), a, b)).collect())


def test_large_groups_are_not_shuffled_whole(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then concat('small ', id % 60) when id % 3 = 1 then 'large' end k", "cast(id % 700 as double) v")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = metrics.exact_percentiles(rows, "v", 0.5, ("k",), "nearest", 100)
        text = plan(found)
        got = {r["k"]: r["percentile"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert text.count("strategy=broadcast") == 2  # large groups: their rows are found, and kept from the others' join
    want = {}
    for i in range(3000):
        if i % 3 < 2:
            want.setdefault(f"small {i % 60}" if i % 3 == 0 else "large", []).append(float(i % 700))
    assert got == {k: sorted(v)[-(-len(v) // 2) - 1] for k, v in want.items()}


def test_matched_scans(spark, monkeypatch):
    t = lambda name: catalog.table(spark, DATA, name)
    scans = catalog._odd(t)
    want = {r[0] for r in joins.match_registry(scans, t("registry")).select("scan_id").collect()}
    assert {r[0] for r in joins.matched_scans(scans, t("registry")).collect()} == want
    # counts of runs too many to be broadcast
    monkeypatch.setattr(joins, "RUNS", 3)
    assert {r[0] for r in joins.matched_scans(scans, t("registry")).collect()} == want
    text = plan(joins.matched_scans(scans, t("registry")))
    assert "Aggregate [scan_id" not in text and "pos#" not in text.split("Relation")[0]


def test_runs_are_not_sorted(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(joins, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    one = spark.createDataFrame([("apple tree",), ("tree",)], "name string")
    assert {tuple(r) for r in joins.contains_pairs(one, one, False).collect()} == {("apple tree", "tree"), ("apple tree", "apple tree"), ("tree", "tree")}
    assert not any("SortAggregate" in p for p in plans)


def test_scans_are_evaluated_once(spark):
    text = plan(catalog.QUERIES["w1_compliance"](spark, DATA))
    assert text.count("min_by(") == len(rules.RULES)
    text = plan(catalog.QUERIES["rul2_side"](spark, DATA))
    assert text.count("min_by(") == len(rules.RULES) and not re.search(r"Contains\(eval_id", text.split("__lines")[0])


def test_lines_take_the_tests_of_their_category(spark):
    asked = rules._asked(rules.RULES)
    assert asked["licence"] == {"license", "fssai", "address", "other"} and asked["taxed"] == {"mrp", "other"}
    lines = [("s", 1, "front", "license", "MRP Rs. 50 (incl. of all taxes)", 0.9), ("s", 2, "front", "mrp", "MRP Rs. 50 (incl. of all taxes)", 0.9), ("s", 3, "back_0", None, None, None)]
    frame = spark.createDataFrame(lines, "scan_id string, pos int, side string, category string, value string, confidence double")
    best = rules.best_features(frame).first()
    assert best["eval_mrp"]["pos"] == 2 and best["eval_mrp"]["taxed"] and best["eval_fssai"]["pos"] == 1


def test_sides_of_odd_lines(spark):
    lines = [("s", None, "front", "mrp", "x", 0.9), ("s", 2, "back_1", "mrp", "x", 0.9), ("s", 1, None, "mrp", "y", 0.9), ("t", 1, "back_0", None, None, 0.9)]
    frame = spark.createDataFrame(lines, "scan_id string, pos int, side string, category string, value string, confidence double")
    evals = spark.createDataFrame([("s", "eval_mrp", "x"), ("s", "eval_qty", "x"), ("t", "eval_mrp", "x"), ("u", "eval_mrp", "x")], "scan_id string, eval_id string, detected string")
    got = {(r["scan_id"], r["eval_id"]): r["side"] for r in rules.tag_side(evals, frame).collect()}
    assert got == {("s", "eval_mrp"): "back_0", ("s", "eval_qty"): "back_1", ("t", "eval_mrp"): "back_0", ("u", "eval_mrp"): "front"}


def test_answers_are_worked_out_after_the_split(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)], "value string, k int")
    text = plan(lookup.by_value(rows, "value", {"up": F.upper("__value")}))
    assert all("upper" not in part for part in text.split("NestedLoop")[1:])
    assert {r["up"] for r in lookup.by_value(rows, "value", {"up": F.upper("__value")}).collect()} == {"A"}


def test_inspection_evaluates_once(spark):
    assert plan(catalog.QUERIES["w1_inspection"](spark, DATA)).count("min_by(") == len(rules.RULES) + 1


def test_panels_are_shuffled_once(spark):
    executed = catalog.QUERIES["grp1_lines"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


def test_check_digits_are_generated_code(spark):
    text = plan(catalog.QUERIES["win4_barcode"](spark, DATA))
    assert "lambda" not in text and text.count("try_cast") == 1
    codes = ["8901262010016", "8901262010017", "8901262010016\n", "036000291452", "96385074", "00012345678905", "00012345678906", "890126201001", "12345678901", "+901262010016", " 96385074", "89O1262010016", "٩٦٣٨٥٠٧٤", "00000000", "", None]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, code string")
    got = ids.with_gtin_valid(rows, "code").withColumn("want", ids.gtin_valid(F.col("code"))).orderBy("k").collect()
    assert [r["valid"] for r in got] == [r["want"] for r in got] == [k in (0, 3, 4, 5, 13) for k in range(len(codes))]
    assert got[0].asDict().keys() == {"k", "code", "valid", "want"}


def test_lines_without_numbers_make_no_structs(spark):
    lines = [("a", 2, "license", "FSSAI 19912011000168"), ("a", 1, "fssai", "10012011000168"), ("a", 3, "license", "10012011000168"), ("a", 4, "other", "CIN L12345MH1990PLC123456"), ("b", 1, "fssai", None), ("b", 2, None, "fssai 10012011000168"), ("c", 1, None, None), ("d", 1, "other", "one pack"), ("e", 1, "other", "u12345QQ1990PLC123456")]
    found = risk.regulatory_faults(spark.createDataFrame(lines, "scan_id string, pos int, category string, value string"))
    assert "Generate inline(CASE WHEN" in plan(found)
    fine, anomaly = "FSSAI licence number has a valid form.", "REGULATORY ANOMALY: "
    got = {r["scan_id"]: (r["faults"], [n.split(anomaly)[-1][:25] for n in r["notes"]]) for r in found.collect()}
    assert got == {"a": (1, [fine[:25], "Invalid FSSAI state census code"[:25], "Corporate identity number"]), "b": (0, [fine[:25]]), "e": (1, ["Unrecognized MCA state code"[:25]])}


def test_signatures_are_dealt_to_all_tasks(spark, monkeypatch):
    class First(Exception):
        pass

    def stop(df):
        raise First(df)

    monkeypatch.setattr(brands, "cut", stop)
    named = spark.createDataFrame([("C1", f"Company {k % 60}", k) for k in range(90)], "company_id string, name string, load_pos int")
    owned = named.withColumnRenamed("name", "brand")
    try:
        brands.detect_spoofing(owned.select("brand"), named, owned, spark.createDataFrame([], "spoof string, target string, type string"))
    except First as first:
        made = first.args[0]
    assert made.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism  # whole brands and their words
    assert made.filter("token is null").count() == 60


def test_values_are_answered_by_all_tasks(spark):
    rows = spark.createDataFrame([(f"a{k % 40}", k) for k in range(400)], "value string, k int")
    made = lookup.by_value(rows, "value", {"up": F.upper("__value")})
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["value"], r["up"]) for r in made.collect()} == {(f"a{k}", f"A{k}") for k in range(40)}


def test_arrays_are_sorted_without_a_lambda(spark):
    for name in ("grp1_lines", "rul2_side", "jn12_fused"):
        assert "array_sort(" not in plan(catalog.QUERIES[name](spark, DATA))

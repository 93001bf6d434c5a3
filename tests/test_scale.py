"""Plans and tasks of joins that grow with their tables."""

from pyspark.sql import functions as F

from packproof import catalog
from packproof.functions import lookup
from packproof.operators import boxes, joins

DATA = "/root/testdata/sf0.001"


def test_linked_counts_in_steps(spark):
    plan = catalog.QUERIES["jn5_linked_scans"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 6


def test_frequent_runs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT", 20)
    outer = spark.range(2000).selectExpr("concat('new ', id) name").unionByName(spark.createDataFrame([("a b",), ("NEW",)], "name string"))
    inner = spark.createDataFrame([("new",), ("w 19",), ("ab",), ("b",), ("zzz",), ("new 7 and more",)], "name string")
    got = {tuple(r) for r in joins.contains_pairs(outer, inner, True).collect()}
    names = [r[0] for r in outer.collect()]
    assert got == {(l, r) for l in names for r in ("new", "w 19", "ab", "b", "zzz", "new 7 and more") if l.lower() in r or r in l.lower()}


def test_by_key(spark):
    rows = spark.createDataFrame([("a", k) for k in range(3000)] + [(f"k{k}", k) for k in range(3000)] + [(None, 0), ("none", 1)], "k string, v long")
    given = spark.createDataFrame([("a", 1)] + [(f"k{k}", k) for k in range(3000)], "k string, n long")
    got = sorted(map(str, lookup.by_key(rows, "k", given).collect()))
    assert got == sorted(map(str, rows.join(given, "k", "left").select("k", "v", "n").collect()))


def test_small_panels_have_one_row_a_box(spark):
    tokens = spark.range(200).selectExpr("'s' scan_id", "'p' panel", "cast(id as int) n", "cast(id % 20 as double) xmin", "cast(id % 7 as double) ymin", "id % 20 + 9.0D xmax", "id % 7 + 5.0D ymax")
    small = boxes._cells(tokens.withColumn("large", F.lit(False)), "left", 4)
    assert small.count() == 200
    assert boxes._cells(tokens.withColumn("large", F.lit(True)), "left", 4).count() > 800
    pairs = [sorted(map(tuple, boxes.iou_pairs(tokens, tokens, 0.25, boxes._large(rows)).select("left_n", "right_n").collect())) for rows in (tokens, tokens.union(tokens))]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 200


def test_tables_do_not_pass_the_driver(spark):
    executed = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    given = spark.createDataFrame([("a", 1)], "k string, n long")
    assert executed(lookup.by_key(rows, "k", given)).count("BroadcastHashJoin") == 1  # frequent keys alone
    assert "BroadcastHashJoin" not in executed(catalog.table(spark, DATA, "scans"))


def test_long_names_meet_under_long_runs(spark, monkeypatch):
    made = []
    monkeypatch.setattr(joins, "cut", lambda df: made.append(df) or df)
    codes = [f"890{k:09d}{k % 10}" for k in range(200)]
    outer = spark.createDataFrame([(c,) for c in codes + ["abcİxyz", "890"]], "name string")
    inner = spark.createDataFrame([(c,) for c in codes + ["XYZ", "e", "90"]], "name string")
    got = sorted(map(tuple, joins.contains_pairs(outer, inner, False).collect()))
    assert got == sorted([(c, c) for c in codes] + [("abcİxyz", "XYZ"), ("890", "90")] + [(c, "90") for c in codes])
    rarest = next(df for df in made if df.columns == ["r", "r_low", "run"])
    assert {len(x["run"]) for x in rarest.collect() if len(x["r"]) == 13} == {12}

import statistics

from pyspark.sql import functions as F

from packproof.functions import lookup, text
from packproof.plans import rules


def test_answers(spark):
    rows = [("hot", k) for k in range(4000)] + [(None, k) for k in range(3000)] + [("", 1), ("rare", 2), ("rare", 3)] + [(f"v{k % 2500}", k) for k in range(5000)]
    frame = spark.createDataFrame(rows, "value string, k int").repartition(8)
    got = lookup.by_value(frame, "value", {"size": F.length("__value"), "first": F.substring("__value", 1, 1)})
    assert got.columns == ["value", "k", "size", "first"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(v, k, None if v is None else len(v), None if v is None else v[:1]) for v, k in rows], key=str)
    assert lookup.by_value(frame.limit(0), "value", {"size": F.length("__value")}).count() == 0


def test_no_task_holds_a_hot_value(spark):
    """A third of the rows share one value, another third are null: the join's largest task is near the median."""
    rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "printed on the seal").when(F.col("id") % 3 == 1, F.concat(F.lit("Net Wt "), F.col("id").cast("string"), F.lit(" g"))).alias("value"), "id")
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        made = text.classify_lines(rows)
        tasks = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("category")).collect()]
        assert sum(tasks) == 60000 and len(tasks) == 16 and max(tasks) < 1.5 * statistics.median(tasks)
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    counts = {r["category"]: r["count"] for r in made.groupBy("category").count().collect()}
    assert counts == {"quantity": 20000, "other": 40000}


def test_rules_on_hot_values(spark):
    lines = [(f"s{k}", p, "front", c, v, 0.9) for k in range(300) for p, (c, v) in enumerate([("mrp", "MRP Rs. 50.00 (incl. of all taxes)"), ("quantity", "Net Wt 100 g"), ("other", None)])]
    frame = spark.createDataFrame(lines, "scan_id string, pos int, side string, category string, value string, confidence double")
    got = rules.evaluate_rules(frame).filter("eval_id in ('eval_mrp', 'eval_qty')").groupBy("eval_id", "status").count().collect()
    assert sorted(map(tuple, got)) == [("eval_mrp", "PASS", 300), ("eval_qty", "PASS", 300)]

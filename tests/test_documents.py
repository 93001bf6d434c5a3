import json
import random

from pyspark.sql import functions as F

from packproof.sources import documents, store


def value(draw, depth=0):
    kind = draw.randint(0, 5 if depth < 3 else 2)
    if kind < 2:
        return "".join(draw.choices([*'ab,[]{}:"\\', "\n", "é", "漢", ",,"], k=draw.randint(0, 12)))
    if kind == 2:
        return draw.choice([1, -2.5, None, True])
    if kind == 3:
        return [value(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return {f"k{k}": value(draw, depth + 1) for k in range(draw.randint(0, 4))}


def written(tmp_path, name, document, indent=None):
    (tmp_path / name).write_text(json.dumps(document, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    return str(tmp_path / name)


def in_pieces(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def test_elements(spark, tmp_path):
    """Documents read in pieces of a few hundred bytes, whatever they hold, are what a parser makes of the whole."""
    draw = random.Random(12)
    held = [spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")]
    try:
        in_pieces(spark, "300")
        for n, indent in ((0, None), (1, 2)):
            document = {"first": [value(draw) or 0 for _ in range(40)], "version": 3, "none": [], "config": {"a": [1, 2], "b,": "x,]"}, 'odd "key", [': [value(draw) or 0 for _ in range(30)], "last": [[], {}, "", "a"]}
            path = written(tmp_path, f"d{n}.json", document, indent)
            rows = documents.array_elements(spark, path)
            assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 4
            got = {}
            for r in sorted(rows.collect(), key=lambda r: r["list_pos"]):
                got.setdefault(json.loads(f'"{r["key"]}"'), []).append(json.loads(r["text"]))
            assert got == {k: v for k, v in document.items() if isinstance(v, list) and v}
            path = written(tmp_path, f"l{n}.json", document["first"], indent)
            listed = [json.loads(r["text"]) for r in sorted(documents.array_elements(spark, path).collect(), key=lambda r: r["list_pos"])]
            assert listed == document["first"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    for n, empty in enumerate(([], {}, {"a": []}, {"a": 1})):
        assert documents.array_elements(spark, written(tmp_path, f"e{n}.json", empty)).count() == 0


def test_store_as_whole_reader(spark, tmp_path):
    """The store's tables, from two documents, equal those that a reader of whole documents gives."""
    scan = lambda k: {"id": f"S{k}", "productName": f"Oil, {k}", "complianceRate": k / 2, "panels": [{"side": "front", "boundingBoxes": [{"id": "b", "confidence": 0.5}]}]}
    for n in range(2):
        written(tmp_path, f"db{n}.json", {"scans": [scan(10 * n + k) for k in range(5)], "users": [{"id": f"u{n}", "name": "A", "password": "secret"}], "reports": []}, indent=n or None)
    tables = store.read_store(spark, str(tmp_path / "db*.json"))
    whole = spark.read.schema("scans array<" + store.STORE["scans"].simpleString() + ">").json(str(tmp_path / "db*.json"), multiLine=True)
    want = whole.select(F.posexplode("scans").alias("list_pos", "row")).select("list_pos", "row.*")
    assert sorted(map(str, tables["scans"].collect())) == sorted(map(str, want.collect()))
    assert tables["users"].count() == 2 and "password" not in tables["users"].columns and tables["reports"].count() == 0


def test_only_broken_elements_are_shuffled(spark, tmp_path):
    rows = documents.array_elements(spark, written(tmp_path, "d.json", {"a": [{"b": k, "c": "x,]"} for k in range(50)]}))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 1
    assert rows.count() == 50

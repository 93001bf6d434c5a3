"""Golden cases of rules, brands, risk, layout, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from packproof.operators import boxes, joins, layout
from packproof.plans import brands, risk, rules
from packproof.sources import store
from packproof.streaming import frames
from test_fuzzy import ratio

GOOD = [
    ("mrp", "MRP Rs. 50.00 (incl. of all taxes)"), ("quantity", "Net Wt 100 g"), ("address", "Packed by Acme Foods Pvt Ltd, Delhi 110001"), ("mfg_date", "PKD: 12/2024"),
    ("helpline", "Customer care 1800-266-0007"), ("license", "FSSAI Lic. No. 10012011000168"), ("ingredients", "Ingredients: sugar"), ("nutrition", "Energy 10 kcal"),
]


def features(spark, rows, scan="s"):
    return spark.createDataFrame([(scan, k, "front", c, v, 0.9) for k, (c, v) in enumerate(rows)], "scan_id string, pos int, side string, category string, value string, confidence double")


def test_rules(spark):
    good = rules.summarise(rules.evaluate_rules(features(spark, GOOD))).first()
    assert (good["verdict"], good["rate"], good["penalty"], good["font_status"]) == ("COMPLIANT", 100.0, 0, "PASS")
    bare = rules.summarise(rules.evaluate_rules(features(spark, [("other", "hello")]))).first()
    assert (bare["verdict"], bare["rate"], bare["penalty"]) == ("NON-COMPLIANT", 0.0, 80_000)
    one = rules.summarise(rules.evaluate_rules(features(spark, [("address", "Marketed by Acme Pvt Ltd")]))).first()
    assert (one["rate"], one["penalty"]) == (16.7, 65_000)
    status = {r["eval_id"]: r["status"] for r in rules.evaluate_rules(features(spark, [("mrp", "MRP Rs 40"), ("quantity", "a dozen"), ("mfg_date", "see below")])).collect()}
    assert (status["eval_mrp"], status["eval_qty"], status["eval_date"], status["eval_fssai"]) == ("ISSUE", "ISSUE", "ISSUE", "ISSUE")


def test_inactive_rules(spark):
    evals = rules.evaluate_rules(features(spark, [("other", "x")]))
    book = spark.createDataFrame([("RL-LIC-005", False), ("RL-MAND-007", True)], "code string, active boolean")
    row = rules.summarise(evals, book).first()
    assert row["penalty"] == 80_000 and row["rate"] == 0.0
    assert rules.summarise(evals, book.limit(0)).first()["rate"] == 0.0
    assert rules.summarise(evals, book.filter("false").union(spark.createDataFrame([("none", True)], book.schema))).first()["rate"] == 100.0


@pytest.fixture(scope="module")
def registry(spark):
    names = [("C1", "Gujarat Cooperative Milk Marketing Federation Ltd", ["Amul", "Amul Butter"]), ("C2", "Dabur India Ltd", ["Dabur", "Real"]), ("C3", "Parle Products Pvt Ltd", ["Parle-G", "Parle"]), ("C4", "Mondelez India Foods", ["Cadbury Dairy Milk"]), ("C5", "Pidilite Industries", ["Fevicol"])]
    companies = spark.createDataFrame([(i, n, k) for k, (i, n, _) in enumerate(names)], "company_id string, name string, load_pos int")
    own = spark.createDataFrame([(i, b, k) for k, (i, _, bs) in enumerate(names) for b in bs], "company_id string, brand string, load_pos int")
    spoofs = spark.createDataFrame([("Amool", "Amul", "Phonetic"), ("Dabur", "Dabur", "never")], "spoof string, target string, type string")
    return companies, own, spoofs


def test_spoofing(spark, registry):
    cases = {
        "Amul": ("GENUINE", "C1"), "AMUL BUTTER": ("GENUINE", "C1"), "Amool": ("COUNTERFEIT", "C1"), "Daboor": ("COUNTERFEIT", "C2"), "Par1e-G": ("COUNTERFEIT", "C3"), "Phevicol": ("COUNTERFEIT", "C5"),
        "CABBURY DAIRY MILK": ("UNREGISTERED_INDEPENDENT", None), "Sunrise Corner Shop": ("UNREGISTERED_INDEPENDENT", None), "x": ("GENUINE", None), "a b c d e f g h": ("UNREGISTERED_INDEPENDENT", None),
    }
    rows = brands.detect_spoofing(spark.createDataFrame([(b,) for b in cases] + [(None,)], "brand string"), *registry).collect()
    got = {r["brand"]: (r["status"], r["company_id"]) for r in rows}
    assert {b: got[b][0] for b in cases} == {b: s for b, (s, _) in cases.items()}
    assert all(got[b][1] == c for b, (_, c) in cases.items() if c)
    assert len(rows) == len(cases) + 1


def test_close_pairs_are_complete(spark):
    """Every pair at or above the bound is found by its rarest letter pairs."""
    rng = random.Random(6)
    names = ["".join(rng.choices("abcde ", k=rng.randint(1, 14))).strip() or "a" for _ in range(150)]
    edited = []
    for n in names:
        k = rng.randrange(len(n))
        edited.append((n[:k] + rng.choice(["", "x", "a"]) + n[k + rng.randint(0, 1) :]) or "a")
    left = spark.createDataFrame([(e, e) for e in dict.fromkeys(edited)], "seg string, form string")
    right = spark.createDataFrame([(n, n) for n in dict.fromkeys(names)], "brand string, form string")
    got = {tuple(r) for r in brands.close_pairs(left, right).collect()}
    want = {(e, n) for e in edited for n in names if ratio(e, n) >= brands.CLOSE}
    assert want <= got and len(want) > 80 and len(got) < 150 * 150 / 4


def test_entities(spark):
    lines = spark.createDataFrame([("MRP Rs. 40",), ("Mktd by Acme",), ("xx",)], "text string")
    plain = {(r["text"], r["entity"]) for r in brands.extract_entities(lines).collect()}
    fuzzy = {(r["text"], r["entity"]) for r in brands.extract_entities(lines, method="fuzzy", threshold=90.0).collect()}
    assert ("MRP Rs. 40", "mrp") in plain and ("Mktd by Acme", "manufacturer") in plain and plain <= fuzzy


def test_risk(spark):
    schema = "scan_id string, detected boolean, valid boolean, is_spoof boolean, critical boolean, print_score int, gamut_score int, violations int, blurry boolean, focus double"
    rows = [("ok", True, True, False, False, 80, 85, 0, False, 200.0), ("bad code", True, False, False, False, 80, 85, 0, False, 200.0), ("copy", True, True, True, True, 80, 85, 0, False, 200.0), ("blurred", True, True, True, True, 30, 85, 0, True, 200.0), ("all", True, False, True, True, 30, 30, 4, False, 200.0)]
    lines = spark.createDataFrame([("ok", 0, "license", "FSSAI 19912011000168")], "scan_id string, pos int, category string, value string")
    got = {r["scan_id"]: (r["score"], r["verdict"]) for r in risk.counterfeit_risk(spark.createDataFrame(rows, schema), lines).collect()}
    assert got == {"ok": (15, "AUTHENTIC"), "bad code": (40, "SUSPECTED_COUNTERFEIT"), "copy": (75, "CRITICAL_COUNTERFEIT"), "blurred": (45, "SUSPECTED_COUNTERFEIT"), "all": (100, "CRITICAL_COUNTERFEIT")}


TOKENS = "scan_id string, panel string, token_pos int, text string, conf double, xmin double, ymin double, xmax double, ymax double, page_w int"


def test_lines(spark):
    words = [("Energy", 20, 10, 70, 25), ("250", 220, 12, 250, 26), ("kcal", 255, 11, 290, 25), ("Protein", 20, 40, 75, 55)]
    rows = spark.createDataFrame([("s", "p", k, w, 0.9, *map(float, b), 400) for k, (w, *b) in enumerate(words)], TOKENS)
    assert [r["text"] for r in layout.cluster_lines(rows, "true_gap").orderBy("line_pos").collect()] == ["Energy", "250 kcal", "Protein"]
    # measured from a column's start, the second word of a column is cut off
    assert [r["text"] for r in layout.cluster_lines(rows).orderBy("line_pos").collect()] == ["Energy", "kcal", "250", "Protein"]
    spans = spark.createDataFrame([("s", [(20.0, 70.0), (80.0, 100.0), (130.0, 140.0)])], "k string, t array<struct<xmin:double,xmax:double>>")
    starts = lambda width, split: spans.select(layout.column_starts(F.col("t"), F.lit(width), split).alias("x")).first()["x"]
    assert (starts(400, "true_gap"), starts(400, "reference"), starts(0, "reference")) == ([0, 130], [0, 20, 80, 130], [0])
    base = layout.cluster_baselines(spark.createDataFrame([("s", "p", k, float(y), float(y + 10)) for k, y in enumerate([0, 4, 50, 55])], "scan_id string, panel string, k int, ymin double, ymax double"))
    assert sorted((r["k"], r["line_pos"]) for r in base.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_brand_clusters_and_fusion(spark):
    rows = [("s", "f", k, "other", v, c, *map(float, b), 1000.0) for k, (v, c, b) in enumerate([("SUPER", 0.9, (100, 100, 300, 200)), ("STAR", 0.62, (320, 100, 500, 200)), ("Biscuits", 0.9, (520, 100, 700, 160)), ("small", 0.9, (100, 220, 140, 240))])]
    got = layout.brand_clusters(spark.createDataFrame(rows, "scan_id string, panel string, pos int, category string, value string, confidence double, xmin double, ymin double, xmax double, ymax double, page_h double")).collect()
    assert [(r["value"], r["confidence"], r["tampering_suspected"]) for r in got] == [("SUPER STAR", 0.62, True)]
    # a chain of neighbours is one cluster; declarations alone leave the tallest text without a category
    chain = [("s", "f", k, "other", f"Part{k}", 0.9, 100.0 * k, 100.0, 100.0 * k + 90, 150.0, 1000.0) for k in range(5)] + [("s", "b", 0, "other", "MRP 5", 0.8, 0.0, 0.0, 50.0, 40.0, 1000.0), ("s", "b", 1, "mrp", "Rs 5", 0.9, 0.0, 50.0, 50.0, 60.0, 1000.0), ("s", "c", 0, "mrp", "Rs 5", 0.9, 0.0, 50.0, 50.0, 60.0, 1000.0)]
    made = layout.brand_clusters(spark.createDataFrame(chain, "scan_id string, panel string, pos int, category string, value string, confidence double, xmin double, ymin double, xmax double, ymax double, page_h double"))
    assert sorted((r["panel"], r["value"]) for r in made.collect()) == [("b", "MRP 5"), ("f", "Part0 Part1 Part2 Part3 Part4")]
    cols = "scan_id string, panel string, token_pos int, text string, conf double, xmin double, ymin double, xmax double, ymax double"
    first = spark.createDataFrame([("s", "p", 0, "RRTO", 0.5, 0.0, 0.0, 10.0, 10.0), ("s", "p", 1, "good", 0.95, 20.0, 0.0, 30.0, 10.0)], cols).withColumns({"indic": F.lit(False), "garbled": F.col("text") == "RRTO"})
    second = spark.createDataFrame([("s", "p", 0, "नया", 0.8, 1.0, 0.0, 10.0, 10.0), ("s", "p", 1, "x", 0.8, 20.0, 0.0, 30.0, 10.0), ("s", "p", 2, "far", 0.8, 50.0, 0.0, 60.0, 10.0)], cols)
    assert sorted(r["text"] for r in boxes.fuse_ocr_passes(first, second).collect()) == ["far", "good", "नया"]


def test_store(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"scans": [{"id": "a", "panels": [{"side": "front"}]}], "users": [{"id": "u", "password": "secret"}]}))
    tables = store.read_store(spark, str(tmp_path / "db.json"))
    assert len(tables) == 8 and tables["scans"].count() == 1 and tables["reports"].count() == 0 and "password" not in tables["users"].columns
    (tmp_path / "reg.json").write_text(json.dumps({"companies": [{"id": "C1", "name": "Acme", "cin": "short", "fssaiLicense": "10012011000168", "gs1Prefix": "8901262", "brands": [" Zed ", ""], "spoofVariants": [{"spoof": "Zedd", "target": "Zed"}, {"spoof": "acme", "target": "x"}]}]}))
    reg = store.read_corporate_registry(spark, str(tmp_path / "reg.json"))
    assert reg["companies"].first()["cin"] is None and [r["spoof"] for r in reg["spoofs"].collect()] == ["Zedd"] and [r["brand"] for r in reg["company_brands"].collect()] == ["Zed"]
    (tmp_path / "r.csv").write_text(",".join(store.REGISTRY) + '\nSKU,"Tea, black",,,,12.5,,,,,,,,L1,HIGH\n,none\nS2,Salt,Own,Salts,B7,0,1 kg,2024-02-03,2025-02-03,"A ""B"" Ltd",1,care,Nepal,,LOW,3,2,1,2020-01-01\n')
    rows = store.read_registry_csv(spark, str(tmp_path / "r.csv"), "2024-05-06")
    got = {r["sku"]: r for r in rows.collect()}
    tea, salt = got["SKU"], got["S2"]
    assert (tea["product_name"], tea["declared_mrp"], tea["risk"], tea["brand"], tea["batch_number"], tea["mfg_date"], tea["expiry_date"], tea["net_quantity"]) == ("Tea, black", 12.5, "HIGH", "Imported Brand", "BATCH-0506", "2024-05-06", "2027-12-31", "100 g")
    assert (len(got), salt["declared_mrp"], salt["manufacturer"], salt["origin"], salt["scans_count"]) == (2, 50.0, 'A "B" Ltd', "Nepal", 0) and "cin" not in rows.columns
    store.export_registry(rows, str(tmp_path / "out"))
    back = store.read_registry_csv(spark, str(tmp_path / "out"), "2024-05-06")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == list(store.REGISTRY)
    (tmp_path / "r.json").write_text(json.dumps([{"sku": 890, "productName": " Oil ", "declaredMRP": "x"}, {"productName": "no sku"}, {"id": "p1", "sku": "9", "productName": "Ghee", "declaredMRP": 7.5, "cin": "L1"}]))
    oil, ghee = sorted(store.read_registry_json(spark, str(tmp_path / "r.json"), "2024-05-06").collect(), key=lambda r: r["sku"])
    assert (oil["sku"], oil["product_name"], oil["declared_mrp"], oil["net_quantity"], oil["id"], oil["registered_date"]) == ("890", "Oil", 50.0, "200 g", None, "2024-05-06") and (ghee["declared_mrp"], ghee["cin"]) == (7.5, "L1")
    store.export_registry_json(rows, str(tmp_path / "outj"))
    assert spark.read.json(str(tmp_path / "outj")).count() == 2
    logs = spark.createDataFrame([("L1", "2024-01-31T15:04:05", "U", "LOGIN", 'say "x", y')], "id string, ts_text string, user_name string, action string, details string")
    store.export_audit_trail(logs, str(tmp_path / "logs"))
    row = spark.read.csv(str(tmp_path / "logs"), header=True, escape='"').first()
    assert (row["Formatted Date & Time"], row["Details"]) == ("31 Jan 2024, 03:04:05 PM", 'say "x", y')


def test_contained_names(spark):
    rng = random.Random(11)
    left = ["".join(rng.choices("abC ", k=rng.randint(1, 9))) for _ in range(80)]
    right = ["".join(rng.choices("aBc ", k=rng.randint(1, 5))) for _ in range(80)]
    l, r = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (left, right))
    inside = {(a, b) for a in left for b in right if b.lower() in a.lower()}
    outside = {(a, b) for a in left for b in right if a.lower() in b.lower()}
    assert {tuple(x) for x in joins.contains_pairs(l, r, False).collect()} == inside
    assert {tuple(x) for x in joins.contains_pairs(l, r, True).collect()} == inside | outside


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("frame_no"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("focus"), (F.col("event_id") % 4).cast("int").alias("categories"))
    batch.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(frames.gate_frames(stream), "gate") == sorted(map(tuple, frames.gate_frames(batch).collect()))
    assert run(frames.sample_frames(stream, "6 hours", "365 days"), "sample", "update") == sorted(map(tuple, frames.sample_frames(batch, "6 hours").collect()))
    ids = stream.select(F.col("session").alias("id"), "ts")
    assert len(run(frames.append_audit(ids, "365 days"), "audit")) == batch.select("session").distinct().count()

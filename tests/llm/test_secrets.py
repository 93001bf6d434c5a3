import dataclasses
import hashlib
import random
import re

import duckdb
import pytest

from packproof.llm import common, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
PEM = re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----")


def brute(text):
    text = text or ""
    found = [("assign", m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    every = found + [("pem", m.span()) for m in PEM.finditer(text)]
    kinds = ["assign", "access", "hex", "pem"]
    join = lambda xs: ",".join(f"{k}:{s}:{e}" for k, (s, e) in sorted(xs, key=lambda x: (x[1][0], kinds.index(x[0]))))
    return (*(sum(k == x for k, _ in found) for x in kinds[:3]), hashlib.sha256(join(found).encode()).hexdigest(), join(every), len(every) - len(found))


def texts():
    rng = random.Random(5)
    bits = ["password", "Token", "API_KEY", "apikey", "=", ": ", " ", "'", '"', "abc", "hunter2x", "AKIA", "AKIA" + "Q1" * 8, "é🙂", "0123456789abcdef" * 2, "\n", "secret", "-----BEGIN RSA PRIVATE KEY-----", "token=token:abcdefgh"]
    return [None, "", "no secrets", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)), "x" * 50_000 + " token=abcdefg"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "f") for i, t in enumerate(rows)] + [(0, rows[5], 0, "again")], "doc_id long, text string, blob int, findings string")


def test_brute(spark, tmp_path):
    rows = texts()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secrets.op1(spark, str(tmp_path)).collect()))
    assert got == sorted([(i, *brute(t)) for i, t in enumerate(rows)] + [(0, *brute(rows[5]))])


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.execute(secrets.op1_sql()).fetchall())
    assert sorted(map(tuple, secrets.op1(spark, d).collect())) == want
    assert sum(r[1] + r[2] + r[3] for r in want)


def test_ledger_is_incremental(spark):
    path = common.shared_path(spark, "ledger")
    one = spark.createDataFrame([(1, "token=abcdefg"), (2, "plain")], "doc_id long, text string")
    secrets.scan(one, path, secrets.RULES[:1])
    more = one.union(spark.createDataFrame([(3, "token=abcdefg"), (4, "f" * 24)], one.schema))
    got = {r["doc_id"]: [x["kind"] for x in r["findings"]] for r in secrets.findings(more, path).collect()}
    assert got == {1: ["assign"], 2: [], 3: ["assign"], 4: ["hex"]}
    pairs = [(bytes(r["blob"]), x) for r in secrets.read_ledger(spark, path).collect() for x in r["rules"]]
    assert len(pairs) == len(set(pairs)) == 3 * len(secrets.RULES)
    assert secrets.findings(more.limit(0), path).count() == 0


def test_rule_versions(spark):
    """A raised version replaces its rule's findings; the older version can still be asked for."""
    path = common.shared_path(spark, "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefg"), (2, "token=abcdefgh"), (3, "none")], "doc_id long, text string")
    old = (secrets.RULES[0], secrets.RULES[3])
    new = (secrets.RULES[3], dataclasses.replace(secrets.RULES[0], version=2, least=8))
    found = lambda rules: {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["findings"]] for r in secrets.findings(docs, path, rules).collect()}
    before = {1: [("assign", 0, 13)], 2: [("assign", 0, 14)], 3: []}
    assert found(old) == before
    assert found(new) == {1: [], 2: [("assign", 0, 14)], 3: []}
    assert found(old) == before
    twice = secrets.read_ledger(spark, path)
    common.materialise(twice, "copy").write.mode("append").parquet(path)  # as by two writers at once
    assert found(old) == before


def test_many_matches(spark):
    text = " ".join(f"é token=abcdef{k}" for k in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = secrets.findings(docs, common.shared_path(spark, "ledger")).first()["findings"]
    assert [(x["start"], x["end"]) for x in got] == [m.span() for m in ASSIGN.finditer(text)]


def test_damaged_ledgers_are_not_taken_for_empty(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        secrets.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(tmp_path))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefg end", 5), (2, None, None), (3, "ok", 2), (4, "f" * 24 + "api_key=abcdef x", 0)], "doc_id long, text string, n_chars long")  # overlapping spans go as one
    got = {r[0]: (r[1], r[2]) for r in secrets.redact(docs, common.shared_path(spark, "ledger")).collect()}
    assert got == {1: ("é [SECRET] end", 14), 2: (None, None), 3: ("ok", 2), 4: ("[SECRET] x", 10)}

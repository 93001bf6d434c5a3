import hashlib
import random
import re

from packproof.llm import substrings


def brute(rows):
    words = {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least = {}
    for i in sorted(k for k in words if k is not None):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and t is not None and least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, payload string, pos int").repartition(3).write.parquet(path)
    return sorted(map(tuple, substrings.op7(spark, str(tmp_path)).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    passages = [rng.choices(vocabulary, k=rng.choice([12, 13, 14, 20, 60])) for _ in range(15)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 25))
        rows.append((i * 3 + 1, "".join(w + rng.choice([" ", "\n", " \t", "  "]) for w in text)))
    return rows


def test_brute(spark, tmp_path):
    rows = corpus(1, 250)
    rows += [(2, rows[9][1]), (10**12, rows[9][1]), (5, None), (None, rows[3][1]), (8, ""), (11, "a " * 200), (14, "a " * 300), (17, rows[20][1]), (17, rows[20][1])]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_empty_and_short(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    assert run(spark, [(1, "a b"), (2, "a b")], tmp_path / "b") == brute([(1, "a b"), (2, "a b")])


def test_texts_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame(corpus(2, 20), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = substrings.op7(spark, str(tmp_path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "BroadcastHashJoin" in plan


def test_sql_agrees(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.execute(substrings.OP7_SQL).fetchall())
    assert sorted(map(tuple, substrings.op7(spark, d).collect())) == want

import base64
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from packproof.llm import bpe

with open(bpe.DEFAULT_VOCABULARY, "rb") as lines:
    ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of cat house with tree water this that from bread", "de": "der und die das haus mit baum wasser nicht brot zwischen katze"}
INSULTS = "idiot trash scum clown moron".split()


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, COLUMNS).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(160):
        lang = "de" if k % 3 == 0 else "en"
        # every document has words of its own, so no two are near copies by chance
        words = [rng.choice(WORDS[lang].split()) + (rng.choice(["", "s", "er"])) for _ in range(60)]
        toxic = k % 4 == 1
        if toxic:
            for w in INSULTS:
                words[rng.randrange(60)] = w
        rows.append([k, " ".join(words), lang, "s", 0])
        labels.append((k, 1, int(toxic)))
    secret = rows[2][1] + " token=abcdef123456 end"
    rows[2][1] = secret
    near = rows[8][1].split()
    near[30] = "changed"
    rows += [[500, rows[4][1], "en", "s", 0], [501, " ".join(near), "en", "s", 0], [502, None, "en", "s", 0], [503, "12 34 !!", "en", "s", 0], [504, "", None, None, None]]
    tables(spark, tmp_path, rows, labels)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}  # repeated by their rates
    clean = {r[0] for r in rows[:160] if r[0] % 4 != 1}
    assert clean <= set(got) and not set(got) & {500, 501, 502, 503, 504}
    assert len(set(got) - clean) <= 2  # toxic ones are gone
    for i in clean:
        text = rows[i][1] if i != 2 else re.sub(r"token=\S+", "[SECRET]", secret)
        assert got[i] == ORACLE.encode_ordinary(text)


def test_empty(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_columns_are_kept(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns, name

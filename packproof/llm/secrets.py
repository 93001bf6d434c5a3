"""Secret scans over an incremental blob ledger, with DataFrame and SQL functions only.

Every text version is addressed by its content. The ledger holds the pairs of blob and
rule version that have been scanned, with their findings and the version that made each. A
scan reads only blobs that miss a rule version, appends to the ledger, and joins findings of
the wanted versions back to every path (row) that holds the blob. Copies are therefore scanned once; map-side aggregation
leaves one row per task and blob, so a text that fills a third of the table is no hot key.

Positions come from SQL alone: ``split`` by the pattern gives the gaps between matches
and ``regexp_extract_all`` the matches; running sums of their lengths, in code points,
are the spans.

Cases: null reads as empty; an empty text has no findings; duplicated rows and ties on
``doc_id`` stay (findings join by content, not by id); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlaps; a match counts if ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
FOUND = "array<struct<start:int,kind:string,version:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, findings {FOUND}"
#: Matches of a text are numbered in blocks of this size, so that no growing array is copied for every match.
BLOCK = 256


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text, from the lengths of gaps and matches, block by block."""
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.length
    sizes = F.zip_with(F.split(text, rule.pattern), match, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), kept(m).alias("kept")))
    pieces = F.filter(sizes, lambda p: p["size"].isNotNull())  # the gap after the last match has none
    blocks = F.transform(F.sequence(F.lit(0), F.size(pieces).cast("int"), F.lit(BLOCK)), lambda k: F.slice(pieces, k + 1, F.lit(BLOCK)))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, p: s + p["gap"] + p["size"]))
    begins = F.aggregate(total, F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t)))

    def inside(block: Column, begin: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            at = state["at"] + p["gap"]
            one = F.struct(at.alias("start"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), (at + p["size"]).alias("end"))
            return F.struct((at + p["size"]).alias("at"), F.when(p["kept"] >= rule.least, F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(FOUND).alias("found")), step)["found"]

    return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), inside))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with ``docs`` and return its findings by ``rules``, one row per blob.

    Columns: blob, findings (by start, then rule order). Only unseen pairs of blob and rule
    version are scanned; the ledger may already hold others, whose findings stay out of the
    answer. Pairs that two writers have appended at the same time count once.
    """
    spark = docs.sparkSession
    wanted = F.array(*(F.lit(r.key) for r in rules))
    ledger = read_ledger(spark, ledger_path)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger.isEmpty():
        todo = texts.withColumn("todo", wanted)
    else:
        todo = texts.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    text = F.col("text")
    parts = [F.when(F.array_contains("todo", r.key) & text.rlike(r.pattern), _spans(text, r)) for r in rules]
    todo.select("blob", F.col("todo").alias("rules"), F.flatten(F.array_compact(F.array(*parts))).alias("findings")).write.mode("append").parquet(ledger_path)
    now = read_ledger(spark, ledger_path).filter(F.size("findings") > 0)
    place = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))))
    numbered = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), place[F.concat_ws(":", x["kind"], x["version"].cast("string"))].alias("kind_no"), x["kind"].alias("kind"), x["end"].alias("end")))
    current = F.filter(numbered, lambda x: x["kind_no"].isNotNull())
    return now.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(current)))).alias("findings"))


def findings(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``blob`` and ``findings`` of every row: the ledger's findings joined back to all paths."""
    found = scan(docs, ledger_path, rules)
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int>>")).alias("findings"))


def redact(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows without findings are unchanged.

    Overlapping spans of different rules are replaced as one. ``n_chars``, if there, follows the text.
    """
    columns = docs.columns
    found = scan(docs, ledger_path, rules).withColumnsRenamed({"blob": "__blob", "findings": "__findings"})
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    joined = docs.withColumn("__blob", blob_of(text)).join(found, "__blob", "left")
    state = F.aggregate("__findings", start, step)
    clean = F.when(F.size("__findings") > 0, F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)
    out = joined.withColumn("text", clean)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__findings") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of one ledger: texts whose address begins with a bit 0, then all documents, of which the others are unseen."""
    docs = common.table(spark, sf_dir, "documents")
    ledger = common.shared_path(spark, "ledger")
    scan(docs.filter(F.substring(F.hex(blob_of(F.col("text"))), 1, 1) < "8"), ledger)
    rows = findings(docs, ledger)

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"), count("pem"))


def _sql_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: list of {s, k, kind, e} of one rule, by the lengths of gaps and matches."""
    p = pattern.replace("'", "''")
    matches, gaps = f"regexp_extract_all(t, '{p}')", f"regexp_split_to_array(t, '{p}')"
    kept = f"regexp_extract_all(t, '{p}', {group})"
    at = f"list_sum(list_transform({gaps}[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform({matches}[1:i-1], lambda m: length(m))), 0)::BIGINT"
    return (
        f"list_transform(list_filter(range(1, len({matches}) + 1), lambda i: length(({kept})[i]) >= {least}), "
        f"lambda i: {{'s': {at}, 'k': {number}, 'txt': '{kind}:' || ({at}) || ':' || (({at}) + length(({matches})[i]))}})"
    )


def op1_sql() -> str:
    """Spans in DuckDB; distinct texts that match nothing are skipped early."""
    lists = [f"CASE WHEN regexp_matches(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {_sql_spans(r.kind, k, r.pattern, r.group, r.least)} ELSE [] END AS l{k}" for k, r in enumerate(RULES)]
    base = "list_sort(list_concat(l0, list_concat(l1, l2)))"
    every = "list_sort(list_concat(l0, list_concat(l1, list_concat(l2, l3))))"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
blobs AS (SELECT DISTINCT t FROM docs),
lists AS (SELECT t, {", ".join(lists)} FROM blobs),
found AS (
  SELECT t, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex, len(l3)::BIGINT AS n_pem,
    sha256(coalesce(array_to_string(list_transform({base}, lambda x: x.txt), ','), '')) AS base_sha256,
    coalesce(array_to_string(list_transform({every}, lambda x: x.txt), ','), '') AS spans
  FROM lists)
SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_pem FROM docs JOIN found USING (t)
"""

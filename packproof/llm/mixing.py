"""Mixing to target weights with soft memberships, by DataFrame and SQL functions only.

Domains come from the table of labels: toxic, else good or poor by quality. A naive Bayes
classifier over the presence of hashed words, learned from a bounded sample of labelled documents, gives
every document its domain posteriors. A document then counts towards each domain with its
tokens times that posterior. Rates r >= 0 are fitted by projected gradient least squares:

    minimise  (A r - T)' M (A r - T) / 2,   (A r)_d = sum_i tokens_i p_id r_i

starting from r = 1, with M the inverse of G = sum_i tokens_i p_i p_i'. In that metric a
step of length one is safe: r_i <- max(0, r_i - p_i' M (A r - T)). A rate is a fold over the
residuals seen since rates were last stored, which is done after every STORED steps, so a
step costs the same however many went before: each round is one map-side aggregate over a
compact table, and only as many numbers as there are domains come back.
Steps end when the targets are met or the objective falls by less than SETTLED of itself,
which is where targets cannot be met: a target of zero with soft posteriors never can be,
as every document is in part in each domain. ``residuals`` says how far each domain is off.

``apply`` keeps clean documents: those that are rather not toxic have a rate of one at least,
and the total is raised until no clean domain has to shrink for the shares of ``targets``.
A rate's fraction is settled by a keyed hash of the document, so expected totals are kept.

Cases: null and empty texts have no tokens, prior posteriors and the rate that follows from
them; without labelled documents posteriors are even; of labels that contradict each other
toxic counts before poor, and poor before good; repeated rows count each time; ties need no order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DOMAINS = ("good", "poor", "toxic")
#: Word buckets; labelled documents learned from, drawn by hash; standard errors that make a bucket telling.
BUCKETS, LABELLED, SIGNIFICANCE = 1 << 16, 4000, 5.0
STEPS, TOLERANCE, SETTLED = 100, 1e-5, 1e-3
#: Steps after which rates are stored.
STORED = 16
#: Shares of all tokens that the mix should have.
TARGETS = {"good": 0.75, "poor": 0.25, "toxic": 0.0}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def tokens_of(text: Column) -> Column:
    """Words of a text in lower case; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """text and domain of at most ``limit`` labelled documents, drawn by a hash of their ids."""
    known = labels.select(F.col("doc_id").alias("__id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("__id is not null and domain is not null")
    known = known.groupBy("__id").agg(F.max("domain").alias("domain"))
    # a little more than ``limit`` by the hash alone, so that the order is taken of few rows
    below = min(1.0, (1.2 * limit + 100) / max(known.count(), 1))
    few = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(below * (1 << 30)))
    drawn = few.orderBy(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)), "__id").limit(limit)
    rows = docs.select("doc_id", "text")
    return rows.join(F.broadcast(drawn), rows["doc_id"] == drawn["__id"]).select("text", "domain")


def learn(sample: DataFrame, domains: tuple[str, ...] = DOMAINS) -> tuple[DataFrame, list[float]]:
    """Weights of the telling word buckets (at most BUCKETS rows), and each domain's log score without any.

    A bucket tells if its document frequency in some domain differs from that in the others
    by SIGNIFICANCE standard errors; the rest would only add noise in proportion to length.
    """
    n = len(domains)
    sample = common.materialise(sample, "labelled")
    counts = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}  # one row per domain
    sizes = [counts.get(d, 0) for d in domains]
    total = sum(sizes)
    prior = [float(np.log((size + 1) / (total + n))) for size in sizes]
    heard = sample.select("domain", F.explode(F.array_distinct(F.transform(tokens_of(F.col("text")), bucket))).alias("__b"))
    found = heard.groupBy("__b").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)))
    every = reduce(lambda a, b: a + b, (F.col(f"n{k}") for k in range(n)))
    mean = (every + 1.0) / (total + 2.0)
    telling = []
    for k, size in enumerate(sizes):
        if 0 < size < total:
            error = F.sqrt(mean * (1 - mean) * (1 / size + 1 / (total - size)))
            telling.append(F.abs(F.col(f"n{k}") / size - (every - F.col(f"n{k}")) / (total - size)) >= SIGNIFICANCE * error)
    kept = found.filter(reduce(lambda a, b: a | b, telling, F.lit(False)))
    rates = kept.select("__b", *((F.col(f"n{k}") + 0.5 * mean) / (size + 0.5) for k, size in enumerate(sizes))).toDF("__b", *(f"q{k}" for k in range(n)))
    table = common.materialise(rates.select("__b", *(F.log(F.col(f"q{k}") / (1 - F.col(f"q{k}"))).alias(f"w{k}") for k in range(n)), *(F.log1p(-F.col(f"q{k}")).alias(f"z{k}") for k in range(n))), "word-buckets")
    absent = table.agg(*(F.coalesce(F.sum(f"z{k}"), F.lit(0.0)) for k in range(n))).first()
    return table.select("__b", *(f"w{k}" for k in range(n))), [a + b for a, b in zip(prior, absent)]


def posteriors(docs: DataFrame, model: DataFrame, base: list[float]) -> DataFrame:
    """doc_id, version (hash of the text), copies, tokens, p (array<double>): one row per distinct id and text."""
    n = len(base)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), tokens_of(F.col("text")).alias("__t"))
    heard = rows.select("doc_id", "version", F.size("__t").cast("long").alias("tokens"), F.posexplode_outer(F.array_distinct(F.transform("__t", bucket))).alias("__k", "__b"))
    copies = F.sum(F.when(F.coalesce("__k", F.lit(0)) == 0, 1).otherwise(0)).alias("copies")
    sums = heard.join(F.broadcast(model), "__b", "left").groupBy("doc_id", "version", "tokens").agg(copies, *(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(n)))
    logs = F.array(*(F.lit(base[k]) + F.col(f"s{k}") / F.col("copies") for k in range(n)))
    raised = sums.withColumn("logs", logs).withColumn("e", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    total = reduce(lambda a, b: a + b, (F.col("e")[k] for k in range(n)))
    return raised.select("doc_id", "version", "copies", "tokens", F.transform("e", lambda x: x / total).alias("p"))


def rate(p: Column, steps: list[list[float]], least: Column | None = None, start: Column | None = None) -> Column:
    """The rate of a document with posteriors ``p`` after the given steps from ``start`` (one), not below ``least`` (zero)."""
    least = F.lit(0.0) if least is None else least
    out = F.lit(1.0) if start is None else start
    if len(steps) <= STORED:  # one expression for generated code
        for s in steps:
            out = F.greatest(least, out - reduce(lambda a, b: a + b, (p[k] * s[k] for k in range(len(s)))))
        return out
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def move(r: Column, s: Column) -> Column:
        return F.greatest(least, r - reduce(lambda a, b: a + b, (p[k] * s[k] for k in range(len(steps[0])))))

    return F.aggregate(moves, out, move)


def totals(memberships: DataFrame, r: Column, n: int) -> np.ndarray:
    """Expected tokens of each domain at rates ``r``."""
    weighed = memberships.select("p", (F.col("tokens") * F.col("copies")).alias("__w"), r.alias("__r"))  # once a row, not once a domain
    return np.array(weighed.agg(*(F.coalesce(F.sum(F.col("__w") * F.col("p")[k] * F.col("__r")), F.lit(0.0)) for k in range(n))).first(), float)


def fitted(memberships: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, least: Column | None = None, settled: float = SETTLED) -> tuple[list[list[float]], DataFrame]:
    """Steps of the projected gradient towards ``targets``, token totals by domain, and ``memberships`` with the ``rate`` after them."""
    n = len(targets)
    p, weight = F.col("p"), F.col("tokens") * F.col("copies")
    gram = memberships.agg(*(F.coalesce(F.sum(weight * p[a] * p[b]), F.lit(0.0)) for a in range(n) for b in range(n))).first()
    gram = np.array(gram, float).reshape(n, n)
    scale = max(float(gram.max()), 1e-12)
    metric = np.linalg.inv(gram + 1e-9 * scale * np.eye(n))
    found: list[list[float]] = []
    rated, stored = memberships.withColumn("rate", F.lit(1.0)), 0
    before = np.inf
    for _ in range(steps):
        if len(found) - stored == STORED:
            rated = common.materialise(rated.withColumn("rate", rate(p, found[stored:], least, F.col("rate"))), "rates")
            stored = len(found)
        residual = totals(rated, rate(p, found[stored:], least, F.col("rate")), n) - targets
        now = float(residual @ metric @ residual)
        if np.abs(residual).max() <= tolerance * max(float(np.abs(targets).max()), 1.0) or now > (1 - settled) * before:
            break
        before = now
        found.append((metric @ residual).tolist())
    return found, rated.withColumn("rate", rate(p, found[stored:], least, F.col("rate")))


def fit(memberships: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, least: Column | None = None, settled: float = SETTLED) -> list[list[float]]:
    """The steps of ``fitted``."""
    return fitted(memberships, targets, steps, tolerance, least, settled)[0]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domains: tuple[str, ...] = DOMAINS, keep_clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rates, residuals): doc_id, version, copies, tokens, p and rate of every document; and by
    domain the tokens wanted, reached at these rates, and their difference.

    ``targets`` are shares by domain, of all present tokens. With ``keep_clean`` they are shares
    of a total so large that no domain but the last has to shrink, and a document with less than
    half its weight in the last domain has a rate of one at least.
    """
    n = len(domains)
    model, base = learn(labelled(docs, labels), domains)
    memberships = common.materialise(posteriors(docs, model, base), "memberships")
    present = totals(memberships, F.lit(1.0), n)
    wanted, total, least = np.array([targets[d] for d in domains], float), present.sum(), None
    if keep_clean:
        total = max([total, *(have / share for have, share in zip(present[:-1], wanted[:-1]) if share > 0)])
        least = F.when(F.col("p")[n - 1] < 0.5, 1.0).otherwise(0.0)
    wanted = wanted * total
    _, rates = fitted(memberships, wanted, least=least)
    return rates, residuals(rates, wanted, domains)


def residuals(rates: DataFrame, wanted: np.ndarray, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """domain, wanted, reached and residual (reached - wanted), in tokens."""
    weight = F.col("tokens") * F.col("copies") * F.col("rate")
    reached = rates.agg(*(F.coalesce(F.sum(weight * F.col("p")[k]), F.lit(0.0)).alias(f"r{k}") for k in range(len(domains))))
    rows = [F.struct(F.lit(d).alias("domain"), F.lit(float(w)).alias("wanted"), F.col(f"r{k}").alias("reached"), (F.col(f"r{k}") - float(w)).alias("residual")) for k, (d, w) in enumerate(zip(domains, wanted))]
    return reached.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def apply(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, key: str = "mix-0") -> DataFrame:
    """``docs`` with each row as often as its rate says, on average over ``key``; clean documents stay."""
    rates, _ = mix(docs, labels, targets, keep_clean=True)
    drawn = F.pmod(F.xxhash64("doc_id", "version", F.lit(key)), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    rates = rates.select(F.col("doc_id").alias("__id"), F.col("version").alias("__v"), (whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)).cast("int").alias("__times"))
    same = docs["doc_id"].cast("long").eqNullSafe(rates["__id"]) & (F.xxhash64(docs["text"]) == rates["__v"])
    joined = docs.join(rates, same).filter("__times > 0")
    return joined.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows, left = mix(docs, common.table(spark, sf_dir, "labels"))
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))  # one row for each of the table
    off = {r["domain"]: r["residual"] for r in left.collect()}  # one row per domain
    return rows.select("doc_id", "tokens", *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", *(F.lit(off[d]).alias(f"residual_{d}") for d in DOMAINS))

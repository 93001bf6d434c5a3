"""Aggregations: verdicts, KPIs, counts and evaluation metrics (AGG). All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .records import BAD


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column, empty: float = 100.0, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(empty))


def scan_verdicts(evals: DataFrame, scans: DataFrame) -> DataFrame:
    """AGG-1: rate, verdict and failures of every scan; one without evaluations is compliant at 100."""
    bad = F.col("status").isin(*BAD)
    own = evals.groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("total"), count_if(F.col("status") == "PASS").alias("passed"), count_if(bad).alias("failed"))
    full = scans.select("id").join(own, "id", "left").na.fill(0, ["total", "passed", "failed"])
    # half-even, as the rate is rounded in the rule engine
    rate = F.when(F.col("total") > 0, F.bround(100.0 * F.col("passed") / F.col("total"), 1)).otherwise(100.0)
    return full.select("id", rate.alias("rate"), F.when(F.col("failed") > 0, "NON-COMPLIANT").otherwise("COMPLIANT").alias("verdict"), F.col("failed").alias("violations"))


def overview_kpis(scans: DataFrame) -> DataFrame:
    ok = F.col("verdict") == "COMPLIANT"
    out = scans.agg(F.count("*").alias("total"), count_if(ok).alias("compliant"), count_if(F.col("verdict") == "NON-COMPLIANT").alias("non_compliant"))
    return out.withColumn("rate", percent(F.col("compliant"), F.col("total")))


def inspector_performance(scans: DataFrame, inspectors: DataFrame, target: int = 50) -> DataFrame:
    """AGG-3. The automatic inspector is a hot key without an inspector row; it never takes part."""
    own = scans.filter(F.col("inspector_id") != "SYSTEM-AUTO").groupBy(F.col("inspector_id").alias("id_badge")).agg(F.count("*").alias("n"), count_if(F.col("verdict") == "COMPLIANT").alias("ok"))
    joined = inspectors.join(own, "id_badge", "left").na.fill(0, ["n", "ok"])
    total = F.coalesce("total_inspections", F.lit(0)) + F.col("n")
    accuracy = F.when(F.col("n") > 0, F.round(100.0 * F.col("ok") / F.col("n"), 1)).otherwise(F.coalesce("stored_accuracy", F.lit(99.0)))
    return joined.select("id_badge", total.alias("inspections"), accuracy.alias("accuracy"), F.least(F.lit(100), F.round(100.0 * total / target).cast("long")).cast("long").alias("progress"))


def registry_metrics(registry: DataFrame) -> DataFrame:
    out = registry.agg(
        F.count("*").alias("total"), *(count_if(F.col("risk") == r).alias(r.lower()) for r in ("HIGH", "MEDIUM", "LOW")),
        F.coalesce(F.sum("scans_count"), F.lit(0)).alias("scans"), F.coalesce(F.sum("passed_count"), F.lit(0)).alias("passed"),
    )
    return out.withColumn("pass_rate", percent(F.col("passed"), F.col("scans")))


def pass_rates(registry: DataFrame) -> DataFrame:
    """Pass percentage of each registry row."""
    return registry.select("id", percent(F.col("passed_count"), F.col("scans_count"), digits=0).alias("pass_rate"))


def category_counts(rows: DataFrame) -> DataFrame:
    out = rows.rollup("category").agg(F.count("*").alias("n"), F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n")


def fine_totals(violations: DataFrame) -> DataFrame:
    return violations.groupBy("severity", "status").agg(F.count("*").alias("n"), F.sum("fine").alias("fines"))


def oversight_kpis(inspectors: DataFrame, scans: DataFrame, violations: DataFrame, reports: DataFrame) -> DataFrame:
    """AGG-7: four single rows side by side."""
    people = inspectors.agg(F.coalesce(F.sum("total_inspections"), F.lit(0)).alias("stored"), count_if(F.col("current_status").isin("In Field", "In Lab")).alias("active"))
    seen = scans.agg(F.count("*").alias("n_scans"))
    open_ = violations.agg(F.count("*").alias("n_violations"))
    filed = reports.agg(F.count("*").alias("n_reports"), count_if(F.upper("severity").isin("CRITICAL", "HIGH")).alias("critical"))
    row = people.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(open_)).crossJoin(F.broadcast(filed))
    return row.select((F.col("stored") + F.col("n_scans")).alias("inspections"), "active", (F.col("n_violations") + F.col("n_reports")).alias("pending"), "critical")


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.coalesce("source", F.lit("INSTITUTIONAL")).alias("source"), "status").agg(F.count("*").alias("n"))


def rulebook_counts(rulebook: DataFrame) -> DataFrame:
    return rulebook.agg(F.count("*").alias("total"), count_if(F.col("active")).alias("active"), F.countDistinct("category").alias("categories"))


def detected_languages(features: DataFrame) -> DataFrame:
    script = F.coalesce("script", F.lit("Latin (English)"))
    return features.groupBy("scan_id").agg(F.sort_array(F.collect_set(script)).alias("languages"))


def statutory_coverage(features: DataFrame, detected: DataFrame) -> DataFrame:
    """Distinct categories per scan without ``other``; ``barcode`` counts where one was detected (``detected``: scan_id)."""
    own = features.filter(F.col("category") != "other").select("scan_id", "category")
    both = own.union(detected.select("scan_id", F.lit("barcode")))
    return both.groupBy("scan_id").agg(F.countDistinct("category").alias("categories"))


def classification_report(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Total, correct, precision, recall and F1 of each class; an empty denominator gives 100, 100 and 0."""
    pairs = rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    sides = pairs.select(F.col("expected").alias("class"), "n", F.lit(0).cast("long").alias("guessed"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.union(pairs.select("predicted", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    sums = sides.groupBy("class").agg(F.sum("n").alias("total"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("correct"))
    listed = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string").join(sums, "class", "left").na.fill(0)
    p, r = percent(F.col("correct"), F.col("guessed"), digits=2), percent(F.col("correct"), F.col("total"), digits=2)
    out = listed.select("class", "total", "correct", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 2)).otherwise(0.0))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.filter("expected <> predicted").groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def binary_report(rows: DataFrame) -> DataFrame:
    """AGG-11 of boolean ``truth`` and ``flagged``; empty denominators give 0."""
    t, f = F.col("truth"), F.col("flagged")
    s = rows.agg(count_if(t & f).alias("tp"), count_if(~t & ~f).alias("tn"), count_if(~t & f).alias("fp"), count_if(t & ~f).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 2)).otherwise(0.0)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return s.select("tp", "tn", "fp", "fn", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


#: How a field is cleaned before the containment test.
CLEANED = {"quantity": "[ ]", "helpline": "[ +-]"}


def ground_truth_accuracy(features: DataFrame, truth: DataFrame) -> DataFrame:
    """AGG-12: share of expected fields found. ``truth``: scan_id and one column per field."""
    fields = [c for c in truth.columns if c != "scan_id"]
    long = truth.unpivot("scan_id", fields, "field", "expected").filter("expected is not null")

    def clean(field: Column, text: Column) -> Column:
        out = F.lower(text)
        for name, pattern in CLEANED.items():
            out = F.when(field == name, F.regexp_replace(F.lower(text), pattern, "")).otherwise(out)
        return out

    found = long.join(features.select("scan_id", F.col("category").alias("field"), "value"), ["scan_id", "field"], "left")
    hit = F.contains(clean(F.col("field"), F.col("value")), clean(F.col("field"), F.col("expected")))
    per = found.groupBy("scan_id", "field").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))
    return per.groupBy("field").agg(F.count("*").alias("expected"), count_if(F.col("hit")).alias("found")).withColumn("accuracy", percent(F.col("found"), F.col("expected"), digits=2))


#: Ranges of one counting pass; ranked at once are at most so many rows a group.
RANGES, RANKED = 4096, 100_000


def exact_percentiles(rows: DataFrame, value: str, share: float, keys: tuple[str, ...] = (), rule: str = "interpolated", ranked: int = RANKED) -> DataFrame:
    """AGG-13: ``keys`` and ``percentile``, exact, without an aggregate or a sort that holds all values.

    A pass counts the values of equal ranges between least and greatest, which says in which
    range (two, if the percentile lies between) the wanted ranks are; the next pass counts
    within these, until at most ``ranked`` rows of a group are left or they are all equal. Only
    those are ranked, as distinct values with counts. Null, NaN and infinite values are left
    out; a group without others gives no row. ``interpolated`` weighs the two values around the
    place (n - 1) x share, ``nearest`` takes the one of rank n x share, rounded up.
    """
    v = F.col(value).cast("double")
    own = rows.select(*keys, v.alias("v")).filter(F.abs("v") < float("inf"))
    place = F.lit(share) * (F.col("n") - 1)
    first, last = (F.floor(place), F.ceil(place)) if rule == "interpolated" else (F.greatest(F.lit(0), F.ceil(F.lit(share) * F.col("n")) - 1),) * 2
    state = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).filter("n > 0")
    state = cut(state.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), first.cast("long").alias("first"), last.cast("long").alias("last")))
    # groups of more than ``ranked`` rows are few (a table of n rows has at most n / ranked) and may hold a table's half:
    # they are broadcast, and only rows of smaller groups are shuffled to theirs
    large = lambda part: F.broadcast(part.filter(F.col("n") > ranked))
    met = lambda part: (own.join(large(part), list(keys)) if keys else own.crossJoin(F.broadcast(part))).filter("v between low and high")
    while state.filter((F.col("inside") > ranked) & (F.col("low") < F.col("high"))).limit(1).count():
        open_ = state.filter((F.col("inside") > ranked) & (F.col("low") < F.col("high")))
        at = F.least(F.lit(RANGES - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES).cast("int"))
        counted = met(open_).groupBy(*keys, "n", "below", "first", "last", at.alias("range")).agg(F.count("*").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy(*keys).orderBy("range") if keys else Window.orderBy("range")
        before = F.col("below") + F.sum("held").over(order) - F.col("held")
        holding = counted.withColumn("below", before).filter((F.col("below") <= F.col("last")) & (F.col("below") + F.col("held") > F.col("first")))
        narrowed = holding.groupBy(*keys, "n", "first", "last").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("below").alias("below"), F.sum("held").alias("inside"))
        done = state.filter((F.col("inside") <= ranked) | (F.col("low") >= F.col("high")))
        state = cut(done.unionByName(narrowed))
    left = met(state)
    if keys and not (small := state.filter(F.col("n") <= ranked)).isEmpty():
        left = left.unionByName(own.join(large(state).select(*keys), list(keys), "left_anti").join(small, list(keys)))
    counted = left.groupBy(*keys, "n", "below", "first", "last", "v").agg(F.count("*").alias("held"))
    order = Window.partitionBy(*keys).orderBy("v") if keys else Window.orderBy("v")
    placed = counted.withColumn("upto", F.col("below") + F.sum("held").over(order))
    value_at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
    found = placed.groupBy(*keys, "n", "first", "last").agg(value_at("first").alias("a"), value_at("last").alias("b"))
    return found.select(*keys, F.when(F.col("first") == F.col("last"), F.col("a")).otherwise((F.col("last") - place) * F.col("a") + (place - F.col("first")) * F.col("b")).alias("percentile"))


def latency_summary(rows: DataFrame, mode: str = "interpolated", keys: tuple[str, ...] = ()) -> DataFrame:
    """AGG-13 over ``ms``, for each of ``keys``: interpolated or nearest-rank 95th percentile, or an ``approximate`` one from one sketch."""
    mean = F.avg("ms")
    sketch = [F.percentile_approx("ms", 0.95, 10_000).alias("p95")] if mode == "approximate" else []
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.when(mean > 0, 1000.0 / mean).alias("per_second"), *sketch)
    if not sketch:
        p95 = exact_percentiles(rows, "ms", 0.95, keys, mode).withColumnRenamed("percentile", "p95")
        out = out.join(p95, list(keys), "left") if keys else out.join(F.broadcast(p95), F.lit(True), "left")
    return out.select(*keys, "n", "mean", "least", "most", "p95", "per_second")


def detection_rates(features: DataFrame) -> DataFrame:
    """AGG-14: share of scans with a feature of each category."""
    total = features.agg(F.countDistinct("scan_id").alias("scans"))
    own = features.groupBy("category").agg(F.countDistinct("scan_id").alias("n"))
    return own.crossJoin(F.broadcast(total)).select("category", "n", percent(F.col("n"), F.col("scans"), digits=2).alias("rate"))


def dataset_summary(features: DataFrame, verdicts: DataFrame, brands: DataFrame) -> DataFrame:
    """AGG-15: one row per scan. ``verdicts``: id, verdict, rate. ``brands``: scan_id, brand_status."""
    own = features.groupBy("scan_id").agg(F.count("*").alias("tokens"), count_if(F.col("value").rlike("[\\u0900-\\u0D7F]")).alias("multilingual"))
    return verdicts.select(F.col("id").alias("scan_id"), "verdict", "rate").join(own, "scan_id", "left").na.fill(0, ["tokens", "multilingual"]).join(brands, "scan_id", "left")


def rule_matrix_counts(evals: DataFrame) -> DataFrame:
    return evals.groupBy("scan_id").agg(*(count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "ISSUE", "FAIL")))


def column_bands(tokens: DataFrame) -> DataFrame:
    """WIN-7: merged x-intervals of a panel: scan_id, panel, band, xmin, xmax."""
    panel = Window.partitionBy("scan_id", "panel").orderBy("xmin", "xmax")
    reach = F.max("xmax").over(panel.rowsBetween(Window.unboundedPreceding, -1))
    opened = tokens.withColumn("__new", F.when(F.coalesce(F.col("xmin") <= reach, F.lit(False)), 0).otherwise(1))
    # equal spans are of one band, whichever of them comes first
    numbered = opened.withColumn("band", F.sum("__new").over(panel.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("scan_id", "panel", "band").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))

"""Joins and merges (JN). Default texts never act as keys: they are made null before equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import lookup
from ..lineage import cut
from .records import NO_BARCODE

def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def norm_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def match_gs1(barcodes: DataFrame, companies: DataFrame, min_len: int = 13) -> DataFrame:
    """``barcodes`` with company_id by the GS1 India prefix: seven digits first, then eight."""
    code = digits(F.col("payload"))
    usable = code.startswith("890") & (F.length(code) >= min_len)
    keyed = barcodes.withColumns({"__p7": F.when(usable, F.substring(code, 1, 7)), "__p8": F.when(usable, F.substring(code, 1, 8))})
    dim = companies.filter("gs1_prefix <> ''").groupBy("gs1_prefix").agg(F.max_by("company_id", "load_pos").alias("company_id"))
    seven, eight = (dim.select(F.col("gs1_prefix").alias(k), F.col("company_id").alias(f"{k}_c")) for k in ("__p7", "__p8"))
    joined = keyed.join(seven, "__p7", "left").join(eight, "__p8", "left")
    return joined.select(*barcodes.columns, F.coalesce("__p7_c", "__p8_c").alias("company_id"))


def match_license(rows: DataFrame, companies: DataFrame, column: str, kind: str) -> DataFrame:
    """company_id by FSSAI licence (``kind='fssai'``: digits) or CIN (``kind='cin'``: letters and digits, upper case)."""
    clean = digits if kind == "fssai" else lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    usable = F.col(kind).rlike("^[0-9]{14}$") if kind == "fssai" else F.length(kind) >= 15
    dim = companies.filter(usable).groupBy(F.upper(kind).alias("__k")).agg(F.max_by("company_id", "load_pos").alias("company_id"))
    return rows.withColumn("__k", F.nullif(clean(F.col(column)), F.lit(""))).join(dim, "__k", "left").drop("__k")


def match_company(brands: DataFrame, companies: DataFrame, company_brands: DataFrame) -> DataFrame:
    """brand and company_id: exact key first, else the first known token in text order, first company in load order.

    ``brands``: brand. ``companies``: company_id, name, load_pos. ``company_brands``: company_id, brand, load_pos.
    """
    names = companies.select("company_id", "load_pos", F.col("name").alias("text"), F.lit(True).alias("corporate"))
    known = names.unionByName(company_brands.select("company_id", "load_pos", F.col("brand").alias("text"), F.lit(False).alias("corporate")))
    exact = known.groupBy(norm_key(F.col("text")).alias("key")).agg(F.max_by("company_id", F.struct("load_pos", ~F.col("corporate"))).alias("exact"))
    words = known.select("company_id", "load_pos", "corporate", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    words = words.filter((F.length("token") >= 3) & ~(F.col("corporate") & F.col("token").isin(*C.CORPORATE)))
    words = words.groupBy("token").agg(F.min_by("company_id", F.struct("load_pos", ~F.col("corporate"))).alias("by_token"))
    distinct = brands.select("brand").distinct().withColumn("key", F.nullif(norm_key(F.col("brand")), F.lit("")))
    tokens = distinct.select("brand", F.posexplode(F.regexp_extract_all(F.lower("brand"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token_pos", "token"))
    fallback = tokens.filter(F.length("token") >= 3).join(words, "token").groupBy("brand").agg(F.min_by("by_token", "token_pos").alias("by_token"))
    found = distinct.join(exact, "key", "left").join(fallback, "brand", "left").select("brand", F.coalesce("exact", "by_token").alias("company_id"))
    return brands.join(found, "brand", "left")


#: Counts of runs are broadcast where no more runs than these are there.
RUNS = 1 << 16
#: Lengths of the runs under which names meet.
LENGTHS = (12, 6, 3, 2, 1)


def contains_pairs(left: DataFrame, right: DataFrame, both_ways: bool) -> DataFrame:
    """(left name, right name) of distinct names of which one holds the other, whatever the case.

    The shorter name is entered under the rarest of its runs of the longest of ``LENGTHS`` that
    it has, the longer under all of its runs of these lengths; the pairs that meet are verified.
    A name with a run that no longer name has is in none. A run that more than one in 1000 of
    the longer side's rows have is dropped there if no shorter name is entered under it;
    otherwise the longer names are dealt to parts, and the shorter one goes to each of them.
    """
    # runs are taken of the small letters, which may be more or fewer than those of the name
    named = lambda rows, c: cut(rows.select(F.col("name").alias(c)).distinct().filter(F.col(c) != "").withColumn(f"{c}_low", F.lower(c)))
    l, r = named(left, "l"), named(right, "r")

    def runs(low: str, n: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda k: F.substring(F.col(low), k, n)))

    def own_length(low: str) -> Column:
        return F.array_max(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: n <= F.length(low)))

    def meet(entered: DataFrame, held: DataFrame, counted: DataFrame) -> DataFrame:
        often = lookup.frequent(counted, "n")
        asked = entered.join(F.broadcast(often.select("run")), "run", "left_semi").select("run").distinct()  # not all that is entered
        often = often.join(F.broadcast(asked.withColumn("asked", F.lit(True))), "run", "left")
        often = cut(often.select("run", F.coalesce("asked", F.lit(False)).alias("asked"), F.ceil(F.col("n") * lookup.FREQUENT / F.col("__total")).cast("int").alias("parts")))
        dealt = held.join(F.broadcast(often), "run", "left").filter("asked is null or asked")
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*held.columns), F.col("parts")), F.lit(0)).cast("int")).drop("asked", "parts")
        copies = entered.join(F.broadcast(often), "run", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("asked", "parts")
        return copies.join(dealt.hint("merge"), ["run", "part"]).drop("run", "part")

    def inside(outer: DataFrame, o: str, inner: DataFrame, i: str) -> DataFrame:
        lengths = [n for n, in inner.select(own_length(f"{i}_low")).distinct().collect()]  # some of LENGTHS
        long_ = [F.when(F.length(f"{o}_low") >= n, runs(f"{o}_low", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths or LENGTHS[:1]]
        held = outer.select(o, f"{o}_low", F.explode(F.flatten(F.array(*long_))).alias("run"))
        common = cut(held.groupBy("run").agg(F.count("*").alias("n")))
        entries = inner.select(i, F.explode(runs(f"{i}_low", own_length(f"{i}_low"))).alias("run"))
        own = entries.join(F.broadcast(common), "run", "left") if common.limit(RUNS + 1).count() <= RUNS else lookup.by_key(entries, "run", common)
        # count and hash of a run in one long: a hash aggregate, where a struct would have every run of every name sorted
        low = lambda run: F.xxhash64(run).bitwiseAND(F.lit((1 << 32) - 1))
        least = F.least(F.coalesce("n", F.lit(0)), F.lit((1 << 31) - 1)) * F.lit(1 << 32) + low(F.col("run"))
        rare = own.groupBy(i).agg(F.min(least).alias("x")).filter(F.col("x") >= F.lit(1 << 32)).withColumns({"x": F.col("x").bitwiseAND(F.lit((1 << 32) - 1)), f"{i}_low": F.lower(i)})
        rarest = cut(rare.select(i, f"{i}_low", F.get(F.filter(runs(f"{i}_low", own_length(f"{i}_low")), lambda run: low(run) == F.col("x")), F.lit(0)).alias("run")))
        return meet(rarest, held, common).filter(F.contains(f"{o}_low", f"{i}_low")).select("l", "r")

    out = inside(l, "l", r, "r")
    return cut((out.union(inside(r, "r", l, "l")) if both_ways else out).distinct())


def matched_scans(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """scan_id of each scan that ``match_registry`` gives a row, once or more; which row is not asked for, so no positions are."""
    code = F.when(F.col("barcode") != NO_BARCODE, F.nullif("barcode", F.lit("")))
    ids = scans.select(F.col("id").alias("scan_id"), code.alias("sku"), "brand", F.col("product_name").alias("l"))
    known = registry.filter("pos is not null")
    names = contains_pairs(scans.select(F.col("product_name").alias("name")), known.select(F.col("product_name").alias("name")), True).select("l").distinct()
    of = lambda c: known.filter(F.col(c) != "").select(c).distinct()
    by_sku, by_brand, by_name = (ids.select("scan_id", c).join(table, c, "left_semi").select("scan_id") for c, table in (("sku", of("sku")), ("brand", of("brand")), ("l", names)))
    return by_sku.union(by_brand).union(by_name)


def match_registry(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """JN-4: scan_id and the first registry row (by pos) with its sku, a name that contains either way, or its brand.

    The OR is split: each leg first reduces the registry to the smallest pos of a key.
    """
    code = F.when(F.col("barcode") != NO_BARCODE, F.nullif("barcode", F.lit("")))
    ids = scans.select(F.col("id").alias("scan_id"), code.alias("sku"), "brand", F.col("product_name").alias("l"))
    first = lambda c: registry.filter(F.col(c) != "").groupBy(c).agg(F.min("pos").alias("pos"))
    by_sku = ids.join(first("sku"), "sku").select("scan_id", "pos")
    by_brand = ids.join(first("brand"), "brand").select("scan_id", "pos")
    names = contains_pairs(scans.select(F.col("product_name").alias("name")), registry.select(F.col("product_name").alias("name")), True)
    nearest = names.join(registry.groupBy(F.col("product_name").alias("r")).agg(F.min("pos").alias("pos")), "r").groupBy("l").agg(F.min("pos").alias("pos"))
    by_name = ids.join(nearest, "l").select("scan_id", "pos")
    best = by_sku.unionByName(by_brand).unionByName(by_name).groupBy("scan_id").agg(F.min("pos").alias("pos"))
    return best.join(registry.select("pos", F.col("id").alias("registry_id")), "pos").select("scan_id", "registry_id")


def _class_counts(classes: DataFrame, leg: str) -> DataFrame:
    """``n`` of classes (name, sku, brand, batch) summed by name and sku, and within them by brand, by batch and by both.

    ``within`` says which: '', 'b', 't' or 'bt'. Columns that do not count are ''.
    """
    shown = lambda c, on: F.coalesce(F.col(c), F.lit("")) if on else F.lit("")
    kinds = F.array(*(F.struct(F.lit(w).alias("within"), shown("brand", "b" in w).alias("brand"), shown("batch", "t" in w).alias("batch")) for w in ("", "b", "t", "bt")))
    rows = classes.select("name", "sku", "n", F.explode(kinds).alias("x")).select(F.lit(leg).alias("leg"), "name", "sku", "x.*", "n")
    rows = rows.filter("(instr(within, 'b') = 0 or brand <> '') and (instr(within, 't') = 0 or batch <> '')")
    return rows.groupBy("leg", "within", "name", "sku", "brand", "batch").agg(F.sum("n").alias("n"))


def linked_counts(registry: DataFrame, scans: DataFrame) -> DataFrame:
    """JN-5: registry_id and the number ``n`` of scans linked by name (either in the other), sku inside the barcode, brand or batch.

    No pair of a registry row and a scan is made. Scans are first counted by class (name,
    barcode, brand, batch), names and barcodes meet as distinct values, and the union of the
    four legs is put together from counts of intersections: brand or batch, plus what name or
    code add outside both. Each registry row asks for at most fifteen counts by one equi-join
    and adds them up by sign; the other side has one row a key. ``id`` is a key of either
    table; rows without a linked scan are left out.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    # each step is cut off, so that no plan holds all of them with what they send out, and scans are counted once
    rows = registry.select(F.col("id").alias("registry_id"), blank("product_name").alias("name"), blank("sku").alias("sku"), blank("brand").alias("brand"), blank("batch_number").alias("batch"))
    # a registry may be one small file, which one task would read and ask fifteen times as much for
    rows = cut(rows.repartition(2 * registry.sparkSession.sparkContext.defaultParallelism, "registry_id"))
    code = F.when(F.col("barcode") != NO_BARCODE, blank("barcode"))
    classes = cut(scans.groupBy(blank("product_name").alias("l"), code.alias("barcode"), blank("brand").alias("brand"), blank("batch_number").alias("batch")).agg(F.count("*").alias("n")))
    names = contains_pairs(classes.select(F.col("l").alias("name")), rows.select("name"), True).withColumnRenamed("r", "name")
    codes = contains_pairs(classes.select(F.col("barcode").alias("name")), rows.select(F.col("sku").alias("name")), False).toDF("barcode", "sku")
    no = F.lit("")
    add = lambda *keys: classes.groupBy(*keys, "brand", "batch").agg(F.sum("n").alias("n"))
    every = add().select(no.alias("name"), no.alias("sku"), "brand", "batch", "n")
    by_name = add("l").join(names, "l").select("name", no.alias("sku"), "brand", "batch", "n")
    coded = cut(add("l", "barcode").join(codes.hint("merge"), "barcode"))
    by_code = coded.select(no.alias("name"), "sku", "brand", "batch", "n")
    low = lambda c: F.lower(F.col(c))
    owners = rows.select("sku", "name").filter("sku is not null and name is not null").distinct()
    by_both = coded.join(owners.hint("merge"), "sku").filter(F.contains(low("l"), low("name")) | F.contains(low("name"), low("l"))).select("name", "sku", "brand", "batch", "n")
    counts = _class_counts(every, "all").filter("within <> ''")
    for leg, table in (("name", by_name), ("code", by_code), ("both", by_both)):
        counts = counts.unionByName(_class_counts(table, leg))
    counts = cut(counts)

    def term(leg: str, within: str) -> Column:
        """What a row asks for: its keys and the sign of the count, null where it lacks one of them."""
        sign = (-1) ** (len(within) + (leg in ("all", "both")))
        used = {"name": leg in ("name", "both"), "sku": leg in ("code", "both"), "brand": "b" in within, "batch": "t" in within}
        keys = [(F.col(c) if on else no).alias(c) for c, on in used.items()]
        whole = F.array_compact(F.array(*(F.col(c) for c, on in used.items() if on)))
        return F.when(F.size(whole) == sum(used.values()), F.struct(F.lit(leg).alias("leg"), F.lit(within).alias("within"), *keys, F.lit(sign).alias("sign")))

    terms = [term("all", w) for w in ("b", "t", "bt")] + [term(leg, w) for leg in ("name", "code", "both") for w in ("", "b", "t", "bt")]
    asked = rows.select("registry_id", F.explode(F.array_compact(F.array(*terms))).alias("x"))
    key = lambda of: F.struct(*(F.col(of + c).alias(c) for c in ("leg", "within", "name", "sku", "brand", "batch"))).alias("key")
    met = lookup.by_key(asked.select("registry_id", key("x."), "x.sign"), "key", counts.select(key(""), "n"))
    return met.groupBy("registry_id").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).filter("n > 0")


def scans_of(registry: DataFrame, scans: DataFrame, registry_id: str) -> DataFrame:
    """JN-5 for one registry row: the scans that it is linked to, in one pass over them."""
    low = lambda c: F.lower(F.col(c))
    own = registry.filter(F.col("id") == registry_id).select(*(F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in ("product_name", "sku", "brand", "batch_number"))).limit(1)
    name = (F.col("product_name") != "") & (F.contains(low("product_name"), low("__product_name")) | F.contains(low("__product_name"), low("product_name")))
    code = (F.col("barcode") != NO_BARCODE) & F.contains("barcode", F.col("__sku"))
    legs = [name, code, F.col("brand") == F.col("__brand"), F.col("batch_number") == F.col("__batch_number")]
    linked = F.greatest(*(F.coalesce(leg, F.lit(False)) for leg in legs))
    return scans.join(F.broadcast(own), linked).select(*scans.columns)


def lookup_products(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """JN-6: each ``query`` with the first registry row by digits of the sku, batch or name; NOT_FOUND without one."""
    q = queries.select("query").distinct().withColumns({"d": F.nullif(digits(F.col("query")), F.lit("")), "low": F.lower("query")})
    first = lambda key: registry.withColumn("k", key).filter("k is not null and k <> ''").groupBy("k").agg(F.min("pos").alias("pos"))
    by_digits = q.join(first(digits(F.col("sku"))), q["d"] == F.col("k")).select("query", "pos")
    by_batch = q.join(first(F.lower("batch_number")), q["low"] == F.col("k")).select("query", "pos")
    names = contains_pairs(registry.select(F.col("product_name").alias("name")), q.select(F.col("query").alias("name")), False)
    by_name = names.join(registry.groupBy(F.col("product_name").alias("l")).agg(F.min("pos").alias("pos")), "l").select(F.col("r").alias("query"), "pos")
    best = by_digits.union(by_batch).union(by_name).groupBy("query").agg(F.min("pos").alias("pos"))
    hit = best.join(registry.select("pos", F.col("id").alias("registry_id")), "pos").select("query", "registry_id")
    return queries.join(hit, "query", "left").withColumn("status", F.when(F.col("registry_id").isNull(), "NOT_FOUND").otherwise("FOUND"))


def apply_rulebook(evals: DataFrame, rulebook: DataFrame) -> DataFrame:
    """JN-7: evaluations of active rules; an empty rulebook filters nothing."""
    return mark_active(evals, rulebook, "__active").filter("__active").select(*evals.columns)


def mark_active(evals: DataFrame, rulebook: DataFrame, name: str) -> DataFrame:
    """``evals`` with a boolean column that says whether their rule is active."""
    active = rulebook.filter(F.coalesce("active", F.lit(True))).select(F.col("code").alias("rule_code")).distinct()
    given = rulebook.agg(F.count("*").alias("__rules"))
    own = evals.join(active.withColumn("__on", F.lit(True)), "rule_code", "left").crossJoin(F.broadcast(given))
    return own.select(*evals.columns, (F.col("__on").isNotNull() | (F.col("__rules") == 0)).alias(name))


def unreported_scans(scans: DataFrame, reports: DataFrame) -> DataFrame:
    """JN-8."""
    done = reports.filter("scan_id is not null").select(F.col("scan_id").alias("id")).distinct()
    return scans.join(done, "id", "left_anti")


def delete_scans(scans: DataFrame, violations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-9: scans and violations without the given ``id`` values."""
    gone = ids.select("id").distinct()
    return scans.join(gone, "id", "left_anti"), violations.join(gone.withColumnRenamed("id", "scan_id"), "scan_id", "left_anti")


def delete_reports(reports: DataFrame, scans: DataFrame, violations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports by id; an id made from a scan takes the scan and its violations along."""
    gone = ids.select("id").distinct()
    as_scan = gone.select(F.concat(F.lit("INS-"), F.regexp_replace("id", "^REP-", "")).alias("id"))
    return reports.join(gone, "id", "left_anti"), *delete_scans(scans, violations, as_scan)


def delete_inspectors(inspectors: DataFrame, users: DataFrame, badges: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = badges.select("id_badge").distinct()
    return inspectors.join(gone, "id_badge", "left_anti"), users.join(gone, "id_badge", "left_anti")


def merge_missing(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """JN-10: ``existing`` and the seed rows whose key it lacks."""
    return existing.unionByName(seed.join(existing.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def patch(rows: DataFrame, updates: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """``rows`` with the last non-null update of each field; updates of unknown keys do nothing."""
    fields = [c for c in updates.columns if c not in (key, ts)]
    last = updates.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"__{c}") for c in fields))
    joined = rows.join(last, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def import_registry(existing: DataFrame, batch: DataFrame, on_conflict: str = "rekey") -> DataFrame:
    """JN-11, SET-3: imported rows before existing ones; a taken id gets a new one (rekey) or its row is left out (drop).

    ``batch`` has ``row_no``; a first row of an id inside the batch keeps it.
    """
    known = batch.filter((F.coalesce("sku", F.lit("")) != "") & (F.coalesce("product_name", F.lit("")) != ""))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("row_no"))
    marked = known.withColumn("__nth", nth).join(existing.select("id").distinct().withColumn("__taken", F.lit(True)), "id", "left")
    clash = F.coalesce("__taken", F.lit(False)) | (F.col("__nth") > 1)
    if on_conflict == "drop":
        marked = marked.filter(~clash)
    else:
        marked = marked.withColumn("id", F.when(clash, F.concat_ws("-", "id", F.substring(F.sha2(F.concat_ws("|", "sku", F.col("row_no").cast("string")).cast("binary"), 256), 1, 8))).otherwise(F.col("id")))
    columns = [c for c in existing.columns if c in marked.columns]
    fresh = marked.select(*columns, F.col("row_no").cast("long").alias("list_pos"), F.lit(0).alias("part"))
    return fresh.unionByName(existing.withColumns({"list_pos": F.col("pos").cast("long"), "part": F.lit(1)}), allowMissingColumns=True)


def report_dossier(reports: DataFrame, scans: DataFrame) -> DataFrame:
    """JN-14: each report with its scan's fields, where it has one."""
    own = scans.select(F.col("id").alias("scan_id"), "product_name", "batch_number", "verdict", "penalty")
    return reports.join(own, "scan_id", "left")

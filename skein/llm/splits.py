"""Splits that keep related records together, over a persisted table of components.

A component is all records and groups (threads, authors, sources) joined directly or through
others. The table of components is kept between runs: a new batch is joined to it, components it
connects are merged by pointer jumping over component labels only, components that have a split
keep it, new ones fill what the splits lack, and a merge of components of different splits is put
into quarantine, where nothing is trained or tested on it until someone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import min_labels
from skein.session import Scratch

SHARES = {"train": 0.70, "dev": 0.10, "test": 0.20}
#: Components of at least this share of all rows are placed one by one, the largest first; there
#: can be no more than its inverse of them. All others are placed by hash.
LARGE = 0.005
TABLE = "key long, component long, split string, quarantined boolean, rows long, asked array<string>"


def split_name(raw: Column) -> Column:
    """train, dev or test of an unevenly spelled split; null for null and for anything else."""
    s = F.lower(F.regexp_replace(raw, r"(?U)\s", ""))
    return F.when(s.isin("val", "valid", "validation", "dev"), "dev").when(s.isin("train", "test"), s)


def keyed(golden: DataFrame, *more: str) -> DataFrame:
    """(record, thread, split): bigint keys, even ones for records and odd ones for threads.

    Rows without an id are dropped; a null thread leaves a record on its own.
    """
    return golden.where("id is not null").select((F.col("id").cast("long") * 2).alias("record"), (F.col("thread_id").cast("long") * 2 + 1).alias("thread"), split_name(F.col("split")).alias("split"), *more)


def torn(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(thread, splits) of threads whose rows name two or more splits; nulls do not count.

    Such threads lie in components of the table whose rows asked for several splits; only their
    rows are looked at, for a component may join threads that are whole each.
    """
    several = table.where(F.size("asked") > 1).select(F.col("key").alias("thread"))
    return rows.where("thread is not null and split is not null").join(several, "thread", "left_semi").groupBy("thread").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def _unit(key: Column, purpose: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(purpose)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def _ladder(u: Column, shares: dict[str, float]) -> Column:
    out, low = F.lit(list(shares)[-1]), 0.0
    steps = []
    for name, share in shares.items():
        low += share
        steps.append((low, name))
    for bound, name in reversed(steps[:-1]):
        out = F.when(u < bound, F.lit(name)).otherwise(out)
    return out


def update(rows: DataFrame, table: DataFrame | None = None, shares: dict[str, float] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The table (key, component, split, quarantined, rows, asked) after a batch (record, thread, split).

    rows counts a component's rows, asked holds the splits that they named. Components of the table that have a split keep it. In the
    batch, a split named by all rows of a component is kept as long as that split does not exceed
    its share; rows beyond it, rows without a split and torn components are assigned anew. Merges
    of components that held different splits get none and are quarantined. An empty batch returns
    the table as it is; an empty table starts one.
    """
    spark, shares = rows.sparkSession, shares or SHARES
    scratch = scratch or Scratch(spark, "splits")
    table = spark.createDataFrame([], TABLE) if table is None else table
    rows = scratch.save(rows.select("record", "thread", "split"), "rows")
    links = rows.where("thread is not null").select(F.col("record").alias("a"), F.col("thread").alias("b")).distinct()
    keys = rows.select(F.col("record").alias("key")).unionAll(rows.where("thread is not null").select(F.col("thread").alias("key"))).distinct()
    # only labels of components meet in the merge: a known key stands for its component
    known = table.select("key", "component")
    named = scratch.save(keys.join(known, "key", "left").select("key", F.coalesce("component", "key").alias("label")), "named")
    edge = links.join(named.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b")
    edge = edge.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    to = min_labels(scratch.save(edge, "merges"), scratch).select(F.col("id").alias("was"), F.col("label").alias("now"))
    fresh = named.join(known, "key", "left_anti").select("key", F.col("label").alias("was"))
    all_keys = table.select("key", F.col("component").alias("was")).unionAll(fresh).join(to, "was", "left").select("key", "was", F.coalesce("now", "was").alias("component"))
    all_keys = scratch.save(all_keys, "keys")
    old = table.select(F.col("component").alias("was"), "split", "quarantined", "rows", F.col("asked").alias("named_before")).distinct()
    relabelled = old.join(to, "was", "left").select(F.coalesce("now", "was").alias("component"), "split", "quarantined", "rows", "named_before")
    held = relabelled.groupBy("component").agg(F.collect_set("split").alias("held"), F.max("quarantined").alias("quarantined"), F.sum("rows").alias("had"), F.array_distinct(F.flatten(F.collect_list("named_before"))).alias("named_before"))
    at = all_keys.select(F.col("key").alias("record"), "component")
    batch = rows.join(at, "record").groupBy("component").agg(F.count("*").alias("n"), F.count("split").alias("named"), F.collect_set("split").alias("asked"))
    comp = all_keys.select("component").distinct().join(held, "component", "left").join(batch, "component", "left")
    comp = comp.select(
        "component", (F.coalesce("had", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("rows"),
        F.coalesce(F.col("quarantined"), F.lit(False)) | (F.coalesce(F.size("held"), F.lit(0)) > 1), F.when(F.size("held") == 1, F.col("held")[0]).alias("kept"),
        F.when((F.coalesce(F.size("held"), F.lit(0)) < 1) & (F.size("asked") == 1), F.col("asked")[0]).alias("asked"),
        F.sort_array(F.array_union(F.coalesce("named_before", F.array().cast("array<string>")), F.coalesce("asked", F.array().cast("array<string>")))).alias("all_asked"),
    ).toDF("component", "rows", "quarantined", "kept", "asked", "all_asked")
    comp = scratch.save(comp, "components")
    placed = _place(comp, shares)
    out = all_keys.select("key", "component").join(placed, "component").join(comp.select("component", F.col("all_asked").alias("asked")), "component").select("key", "component", "split", "quarantined", "rows", "asked")
    return scratch.save(out, "table")


def _place(comp: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(component, split, quarantined, rows): kept splits first, then asked ones, then what is lacking."""
    free = ~F.col("quarantined") & F.col("kept").isNull()
    sums = comp.agg(
        F.sum(F.when(~F.col("quarantined"), F.col("rows"))).alias("all"),
        *(F.sum(F.when(~F.col("quarantined") & (F.col("kept") == s), F.col("rows"))).alias(f"kept_{s}") for s in shares),
        *(F.sum(F.when(free & (F.col("asked") == s), F.col("rows"))).alias(f"asked_{s}") for s in shares),
    ).first()
    total = sums["all"] or 0
    room = {s: max(0.0, shares[s] * total - (sums[f"kept_{s}"] or 0)) for s in shares}
    take = {s: min(1.0, room[s] / sums[f"asked_{s}"]) if sums[f"asked_{s}"] else 0.0 for s in shares}
    limit = max(1.0, LARGE * total)
    grants = F.lit(False)
    for s in shares:
        grants = grants | ((F.col("asked") == s) & (_unit(F.col("component"), "keep") < take[s]))
    step = comp.withColumn("first", F.when(free, F.when((F.col("rows") < limit) & F.coalesce(grants, F.lit(False)), F.col("asked"))).otherwise(F.col("kept")))
    used = {r["first"]: r["n"] for r in step.where("not quarantined and first is not null").groupBy("first").agg(F.sum("rows").alias("n")).collect()}
    lack = {s: shares[s] * total - used.get(s, 0) for s in shares}
    # large components: at most 1 / LARGE of them, the largest first, each where most is lacking
    large = step.where(free & F.col("first").isNull() & (F.col("rows") >= limit)).orderBy(F.desc("rows"), "component").select("component", "rows", "asked").collect() if total else []
    chosen = []
    for r in large:
        s = max(lack, key=lambda k: (lack[k], k == r["asked"]))
        lack[s] -= r["rows"]
        chosen.append((r["component"], s))
    want = {s: max(0.0, v) for s, v in lack.items()}
    whole = sum(want.values())
    ratio = {s: v / whole for s, v in want.items()} if whole else dict(shares)
    big = step.sparkSession.createDataFrame(chosen, "component long, big string")
    split = F.coalesce("first", "big", F.when(free, _ladder(_unit(F.col("component"), "fill"), ratio)))
    return step.join(big, "component", "left").select("component", F.when(~F.col("quarantined"), split).alias("split"), "quarantined", "rows")


def assign(golden: DataFrame, table: DataFrame | None = None, shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits of each row, torn threads and the new table.

    The first has (id, thread_id, was, split, quarantined) for every row with an id, repeated rows
    included; the second (thread_id, splits); the third is to be kept for the next batch.
    """
    scratch = Scratch(golden.sparkSession, "splits")
    rows = scratch.save(keyed(golden), "keyed")
    new = update(rows, table, shares, scratch)
    out = rows.join(new.select(F.col("key").alias("record"), F.col("split").alias("new_split"), "quarantined"), "record")
    out = out.select(F.expr("record div 2").alias("id"), F.expr("(thread - 1) div 2").alias("thread_id"), F.col("split").alias("was"), F.col("new_split").alias("split"), "quarantined")
    return out, torn(rows, new).select(F.expr("(thread - 1) div 2").alias("thread_id"), "splits"), new


def in_batches(golden: DataFrame, batch: Column) -> DataFrame:
    """(id, thread_id, batch, split, quarantined) of golden rows that come in as two batches.

    Rows where batch holds come first; the second batch meets the table of the first, as it does on
    a later day. What the first batch was given stays, unless the second joins components of
    different splits.
    """
    scratch = Scratch(golden.sparkSession, "batches")
    rows = scratch.save(keyed(golden.withColumn("_first", F.coalesce(batch, F.lit(False))), "_first"), "keyed")
    table = None
    for first in (True, False):
        table = update(rows.where(F.col("_first") == first).drop("_first"), table)
    out = rows.join(table.select(F.col("key").alias("record"), F.col("split").alias("new_split"), "quarantined"), "record")
    return out.select(F.expr("record div 2").alias("id"), F.expr("(thread - 1) div 2").alias("thread_id"), F.when(F.col("_first"), 1).otherwise(2).alias("batch"), F.col("new_split").alias("split"), "quarantined")

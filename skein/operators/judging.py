"""Scores that a judge gives to drafts: reading them, summing them up by arm, comparing arms and judges.

Responses are replayed, never asked for. A score is a row (item, arm, one column for each dimension,
failed); every report is an aggregate over such rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.hashing import order_key
from skein.functions.stats import binomial_two_sided, ratio, wilcoxon_two_sided, wilson
from skein.functions.text import has_placeholder
from skein.operators.evaluation import agreement, paired_counts, signed_ranks, weighted_kappa
from skein.operators.replay import salvage_json

DIMENSIONS = ("addresses", "grounded", "safe", "tone")
TOP = 2
LEAST = {"safe": 2, "grounded": 2, "addresses": 1}  # what a draft needs to be sent


def scored(rows: DataFrame, dims: tuple[str, ...] = DIMENSIONS, top: int = TOP) -> DataFrame:
    """(item, arm, draft, dims..., failed) of (item, arm, draft, error, response).

    An empty draft scores nought everywhere, which is no failure. An error, a response that is no
    JSON object, one that lacks a dimension and one with a score outside 0..top have failed, and
    their scores are null.
    """
    empty = F.coalesce(F.trim("draft"), F.lit("")) == ""
    js = rows.withColumn("_js", salvage_json(F.col("response")))
    got = {d: F.get_json_object("_js", f"$.{d}").try_cast("int") for d in dims}
    fine = reduce(lambda a, b: a & b, (F.coalesce(v.between(0, top), F.lit(False)) for v in got.values())) & (F.coalesce(F.col("error"), F.lit("")) == "")
    return js.select("item", "arm", "draft", *(F.when(empty, 0).when(fine, v).alias(d) for d, v in got.items()), (~empty & ~fine).alias("failed"))


def total(dims: tuple[str, ...] = DIMENSIONS) -> Column:
    return reduce(lambda a, b: a + b, (F.col(d) for d in dims))


def sendable(least: dict[str, int] | None = None) -> Column:
    return reduce(lambda a, b: a & b, (F.col(d) >= n for d, n in (least or LEAST).items()))


def evidence_order(purpose: str, draft: Column, *keys: Column) -> Column:
    """The order evidence is shown in: shuffled by a seed that depends on the draft's length."""
    return order_key(purpose, F.length(draft), *keys)


def arms(scores: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row an arm: drafts, valid, judged, mean total, sendable with its interval, with placeholders,
    sendable as it is with its interval, and the mean of each dimension.

    Failed judgements are not judged; means and rates are over what is judged.
    """
    ok, judged = sendable(), ~F.col("failed")
    gap = F.coalesce(has_placeholder(F.col("draft")), F.lit(False))
    g = scores.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("draft"), F.lit("")) != "").alias("valid"), F.count_if(judged).alias("judged"),
        F.sum(F.when(judged, total(dims))).alias("_total"), F.count_if(judged & ok).alias("sendable"), F.count_if(gap).alias("placeholders"),
        F.count_if(judged & ok & ~gap).alias("as_is"), *(F.sum(F.when(judged, F.col(d))).alias(f"_{d}") for d in dims),
    )
    (lo, hi), (alo, ahi) = wilson(F.col("sendable"), F.col("judged")), wilson(F.col("as_is"), F.col("judged"))
    return g.select(
        "arm", "n", "valid", "judged", F.round(ratio(F.col("_total"), F.col("judged")), 6).alias("mean_total"), "sendable", F.round(lo, 6).alias("sendable_lo"), F.round(hi, 6).alias("sendable_hi"), "placeholders", "as_is",
        F.round(alo, 6).alias("as_is_lo"), F.round(ahi, 6).alias("as_is_hi"), *(F.round(ratio(F.col(f"_{d}"), F.col("judged")), 6).alias(f"mean_{d}") for d in dims),
    )


@F.pandas_udf(DoubleType())
def sign_p(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided binomial p of k of n under one half; for a row a test."""
    return pd.Series([binomial_two_sided(int(a), int(b)) for a, b in zip(k, n)])


@F.pandas_udf(DoubleType())
def wilcoxon_p(w_plus: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_two_sided(float(w), int(m), float(t)) for w, m, t in zip(w_plus, n, ties)])


def side_by_side(scores: DataFrame, a: str, b: str, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Scores of two arms for the items that both have judged."""
    pick = lambda arm, s: scores.where((F.col("arm") == arm) & ~F.col("failed")).select("item", *(F.col(d).alias(f"{s}_{d}") for d in dims), sendable().alias(f"{s}_ok"), total(dims).alias(f"{s}_total"))
    return pick(a, "a").join(pick(b, "b"), "item")


def compared(scores: DataFrame, a: str, rivals: list[str], dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """McNemar's exact test on sendable, and Wilcoxon's on each dimension, of arm a against each rival.

    (rival, measure, n, up, down, p): in how many items a is better, and worse; for Wilcoxon n, up
    and down are the items that differ and the rank sums. p is 1 where nothing differs.
    """
    out = []
    for r in rivals:
        both = side_by_side(scores, a, r, dims)
        c = paired_counts(both.select(F.col("a_ok").alias("a"), F.col("b_ok").alias("b")))
        out.append(c.select(F.lit(r).alias("rival"), F.lit("sendable").alias("measure"), (F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")).alias("n"), F.col("a_only").cast("double").alias("up"), F.col("b_only").cast("double").alias("down"), F.round(sign_p(F.least("a_only", "b_only"), F.col("a_only") + F.col("b_only")), 6).alias("p")))
        for d in dims:
            w = signed_ranks(both.select(F.col(f"a_{d}").alias("a"), F.col(f"b_{d}").alias("b")), ties=True)
            out.append(w.select(F.lit(r).alias("rival"), F.lit(d).alias("measure"), "n", F.col("w_plus").alias("up"), F.col("w_minus").alias("down"), F.round(wilcoxon_p("w_plus", "n", "ties"), 6).alias("p")))
    return reduce(DataFrame.unionAll, out)


def discordant(repeats: DataFrame) -> DataFrame:
    """(a_only, b_only, n) of (repeat, item, a, b) pooled over repeats; descriptive, as repeats share items."""
    return paired_counts(repeats).select("a_only", "b_only", (F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")).alias("n"))


def self_preference(scores: DataFrame, others: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(arm, n, own, other, up, same, down, inflation): what one judge gives more than another, by arm."""
    t = lambda s, name: s.where(~F.col("failed")).select("item", "arm", total(dims).alias(name))
    j = t(scores, "own").join(t(others, "other"), ["item", "arm"])
    g = j.groupBy("arm").agg(F.count("*").alias("n"), F.sum("own").alias("a"), F.sum("other").alias("b"), F.count_if(F.col("own") > F.col("other")).alias("up"), F.count_if(F.col("own") == F.col("other")).alias("same"), F.count_if(F.col("own") < F.col("other")).alias("down"))
    return g.select("arm", "n", F.round(F.col("a") / F.col("n"), 6).alias("own"), F.round(F.col("b") / F.col("n"), 6).alias("other"), "up", "same", "down", F.round((F.col("a") - F.col("b")) / F.col("n"), 6).alias("inflation"))


def far_apart(human: DataFrame, machine: DataFrame, least: int = 3, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(item, arm, apart) of the items whose scores differ by `least` or more over all dimensions."""
    j = human.where(~F.col("failed")).select("item", "arm", *(F.col(d).alias(f"h_{d}") for d in dims)).join(machine.where(~F.col("failed")).select("item", "arm", *dims), ["item", "arm"])
    return j.select("item", "arm", reduce(lambda a, b: a + b, (F.abs(F.col(f"h_{d}") - F.col(d)) for d in dims)).alias("apart")).where(F.col("apart") >= least)


def agreement_rows(human: DataFrame, machine: DataFrame, dims: tuple[str, ...] = DIMENSIONS, top: int = TOP) -> DataFrame:
    """(measure, n, exact, within_one, kappa, weighted_kappa, ac1) of each dimension and of sendable, over common items."""
    pick = lambda s, x: s.where(~F.col("failed")).select("item", "arm", *(F.col(d).alias(f"{x}_{d}") for d in dims), sendable().cast("int").alias(f"{x}_sendable"))
    j = pick(human, "h").join(pick(machine, "m"), ["item", "arm"])
    out = []
    for d in (*dims, "sendable"):
        p = j.select(F.col(f"h_{d}").alias("a"), F.col(f"m_{d}").alias("b"))
        near = p.agg(F.round(ratio(F.count_if(F.col("a") == F.col("b")), F.count("*")), 6).alias("exact"), F.round(ratio(F.count_if(F.abs(F.col("a") - F.col("b")) <= 1), F.count("*")), 6).alias("within_one"))
        k = agreement(p).select("n", "kappa", "ac1")
        w = weighted_kappa(p, 1 if d == "sendable" else top).select("weighted_kappa")
        out.append(near.join(k).join(w).select(F.lit(d).alias("measure"), "n", "exact", "within_one", "kappa", "weighted_kappa", "ac1"))  # one row each
    return reduce(DataFrame.unionAll, out)


def stale(items: DataFrame, sheet: DataFrame, keys: tuple[str, ...] = ("idx", "sha")) -> DataFrame:
    """Items whose keys no longer stand in a sheet."""
    return items.join(sheet.select(*keys).distinct(), list(keys), "left_anti")

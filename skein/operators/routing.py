"""Reports over decisions to handle a message or hand it on: (id, auto, correct, reason, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.stats import ratio, wilson


def by_threshold(confidence: Column, threshold: float, first: Column, second: Column) -> Column:
    """Why a message is handed on, null where it is handled: its confidence is low, between two labels.

    A null confidence is low.
    """
    low = F.coalesce(confidence < threshold, F.lit(True))
    return F.when(low, F.concat(F.format_string("confidence %.2f < %.2f: ", F.coalesce(confidence, F.lit(0.0)), F.lit(threshold)), F.coalesce(first, F.lit("none")), F.when(second.isNotNull(), F.concat(F.lit(" or "), second)).otherwise("")))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: n, handled, wrong among handled, their error with its interval, errors caught, and how
    many handing on as many at random would catch."""
    wrong = ~F.col("correct")
    g = decisions.agg(F.count("*").alias("n"), F.count_if("auto").alias("n_auto"), F.count_if(F.col("auto") & wrong).alias("auto_wrong"), F.count_if(wrong).alias("errors"), F.count_if(~F.col("auto") & wrong).alias("caught"))
    lo, hi = wilson(F.col("auto_wrong"), F.col("n_auto"))
    return g.select("n", "n_auto", F.round(ratio(F.col("n_auto"), F.col("n")), 6).alias("coverage"), "auto_wrong", F.round(ratio(F.col("auto_wrong"), F.col("n_auto")), 6).alias("error"), F.round(lo, 6).alias("error_lo"), F.round(hi, 6).alias("error_hi"), "errors", "caught", F.round(random_catches(F.col("n") - F.col("n_auto"), F.col("n"), F.col("errors")), 6).alias("caught_at_random"))


def random_catches(handed_on: Column, n: Column, errors: Column) -> Column:
    """Errors among as many messages taken at random; null where there are none."""
    return ratio(handed_on, n) * errors


def reasons(decisions: DataFrame) -> DataFrame:
    """(reason, n) of what is handed on, in order of the reason."""
    return decisions.where(~F.col("auto")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def spread_over(repeats: DataFrame, key: str = "rep") -> DataFrame:
    """The least and greatest coverage and error over repeats, with mean and population deviation."""
    g = repeats.groupBy(key).agg(F.count("*").alias("n"), F.count_if("auto").alias("k"), F.count_if(F.col("auto") & ~F.col("correct")).alias("w"))
    s = g.select(ratio(F.col("k"), F.col("n")).alias("coverage"), ratio(F.col("w"), F.col("k")).alias("error"))
    return s.agg(F.count("*").alias("repeats"), *(F.round(f(c), 6).alias(f"{c}_{name}") for c in ("coverage", "error") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop))))


def within(decisions: DataFrame, stratum: str, names: list[str]) -> DataFrame:
    """(stratum, n, n_auto, auto_wrong) of the strata named."""
    g = decisions.where(F.col(stratum).isin(*names)).groupBy(stratum)
    return g.agg(F.count("*").alias("n"), F.count_if("auto").alias("n_auto"), F.count_if(F.col("auto") & ~F.col("correct")).alias("auto_wrong"))

"""Scores of predictions: confusion, agreement, intervals, paired tests, risk and coverage.

Predictions are rows (id, y, pred); every report is one aggregate over them. Classes come from the
data or from a given list, so a class nobody predicted still counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import GLOBAL_SEED
from skein.functions.hashing import draw, poisson
from skein.functions.stats import ratio, wilson



def _all():
    """All rows as one window: only ever over a row a class, a category or a distinct value."""
    return Window.partitionBy()


def confusion(preds: DataFrame) -> DataFrame:
    """(y, pred, n) of rows with both."""
    return preds.where("y is not null and pred is not null").groupBy("y", "pred").agg(F.count("*").alias("n"))


def per_class(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1, recall interval) of every label; 0 for 0 / 0."""
    c = confusion(preds)
    long = c.select(F.col("y").alias("label"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"))
    long = long.unionAll(c.where("y <> pred").select("pred", F.lit(0), "n", F.lit(0)))
    s = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    s = labels.join(s, "label", "left").fillna(0, ["tp", "fp", "fn"])
    lo, hi = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return s.select("label", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), z(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), z(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), z(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), F.round(lo, 6).alias("recall_lo"), F.round(hi, 6).alias("recall_hi"))


def summary(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro-F1 over all labels, support-weighted F1."""
    p = per_class(preds, labels)
    return p.agg(F.sum("support").alias("n"), F.round(ratio(F.sum("tp"), F.sum("support")), 6).alias("accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 5).alias("weighted_f1"))


def weighted_macro_f1(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """Macro-F1 with each row weighed by its class's weight; classes without weight are skipped."""
    c = confusion(preds).join(F.broadcast(weights.select(F.col("label").alias("y"), "weight")), "y")  # a row a class
    long = c.select(F.col("y").alias("label"), (F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0) * F.col("weight")).alias("tp"), F.lit(0.0).alias("fp"), (F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0) * F.col("weight")).alias("fn"))
    long = long.unionAll(c.where("y <> pred").select("pred", F.lit(0.0), F.col("n") * F.col("weight"), F.lit(0.0)))
    s = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).where("tp + fn > 0")
    return s.agg(F.round(F.avg(F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))), 5).alias("weighted_macro_f1"), F.count("*").alias("n_classes"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row for (a, b): n, raw agreement, Cohen's kappa, Gwet's AC1; rows with a null are left out."""
    c = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    m = c.select(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"))
    m = m.unionAll(c.select("b", F.lit(0), "n", F.lit(0))).groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    n = F.sum("na").over(_all())
    s = m.select("same", n.alias("n"), (F.col("na") / n).alias("pa"), (F.col("nb") / n).alias("pb"), F.count("*").over(_all()).alias("q"))
    pi = (F.col("pa") + F.col("pb")) / 2
    s = s.agg(F.max("n").alias("n"), ratio(F.sum("same"), F.max("n")).alias("po"), F.sum(F.col("pa") * F.col("pb")).alias("pe"), F.sum(pi * (1 - pi)).alias("spread"), F.max("q").alias("q"))
    g = F.when(F.col("q") > 1, F.col("spread") / (F.col("q") - 1)).otherwise(0.0)
    return s.select("n", F.round("po", 6).alias("raw"), F.round(F.when(F.col("pe") >= 1, 1.0).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))), 5).alias("kappa"), F.round(F.when(F.col("q") <= 1, 1.0).otherwise(F.try_divide(F.col("po") - g, 1 - g)), 5).alias("ac1"))


def weighted_kappa(pairs: DataFrame, top: int) -> DataFrame:
    """Quadratic-weighted kappa of integer scores (a, b) from 0 to top; 1 where no disagreement is possible."""
    c = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    grid = pairs.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("a")).crossJoin(pairs.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("b")))  # (top + 1)^2 rows
    full = grid.join(c, ["a", "b"], "left").fillna(0, ["n"])
    n = F.sum("n").over(_all())
    full = full.select("a", "b", "n", n.alias("t"), F.sum("n").over(Window.partitionBy("a")).alias("ra"), F.sum("n").over(Window.partitionBy("b")).alias("cb"))
    w = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / F.lit(float(top * top))
    s = full.agg(F.sum(w * F.col("n")).alias("o"), F.sum(w * F.col("ra") * F.col("cb") / F.when(F.col("t") > 0, F.col("t"))).alias("e"), F.max("t").alias("n"))
    return s.select("n", F.round(F.when(F.coalesce(F.col("e"), F.lit(0.0)) == 0, 1.0).otherwise(1 - F.try_divide("o", "e")), 6).alias("weighted_kappa"))


def paired_counts(pairs: DataFrame) -> DataFrame:
    """McNemar's cells of boolean (a, b) over rows with both."""
    p = pairs.where("a is not null and b is not null")
    return p.agg(F.count_if(F.expr("a and b")).alias("both"), F.count_if(F.expr("a and not b")).alias("a_only"), F.count_if(F.expr("b and not a")).alias("b_only"), F.count_if(F.expr("not a and not b")).alias("neither"))


def signed_ranks(pairs: DataFrame, ties: bool = False) -> DataFrame:
    """Wilcoxon's W+ and W- of (a, b), zero differences dropped, ties with their average rank.

    With ties also the sum of t**3 - t over groups of t equal differences, which the variance needs.

    Ranks come from the counts of distinct absolute differences, so rows are pre-aggregated first.
    """
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).where("d is not null and d <> 0")
    c = d.groupBy(F.round(F.abs("d"), 9).alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a distinct difference
    r = c.select("n", "up", (before + (F.col("n") + 1) / 2.0).alias("rank"))
    more = [F.coalesce(F.sum(F.pow("n", F.lit(3)) - F.col("n")), F.lit(0.0)).alias("ties")] if ties else []
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("n") - F.col("up")) * F.col("rank")), F.lit(0.0)).alias("w_minus"), *more)


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of boolean `positive` by `score`, by average ranks over distinct scores."""
    c = rows.where("positive is not null and score is not null").groupBy("score").agg(F.count("*").alias("n"), F.count_if("positive").alias("p"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.select("n", "p", (before + (F.col("n") + 1) / 2.0).alias("rank"))
    s = r.agg(F.sum("p").alias("n1"), F.sum(F.col("n") - F.col("p")).alias("n0"), F.sum(F.col("p") * F.col("rank")).alias("rs"))
    return s.select("n1", "n0", F.round(F.try_divide(F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0, (F.col("n1") * F.col("n0")).cast("double")), 6).alias("auc"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(confidence, n, coverage, risk) down the distinct confidences of (correct, confidence)."""
    c = rows.groupBy("confidence").agg(F.count("*").alias("k"), F.count_if(~F.col("correct")).alias("wrong"))
    w = Window.orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("k").over(_all())
    return c.select("confidence", F.sum("k").over(w).alias("n"), (F.sum("k").over(w) / total).alias("coverage"), (F.sum("wrong").over(w) / F.sum("k").over(w)).alias("risk"))


def aurc(rows: DataFrame) -> DataFrame:
    """The trapezoid area under risk over coverage."""
    w = Window.orderBy("coverage")
    r = risk_coverage(rows)
    s = r.select("coverage", "risk", F.lag("coverage").over(w).alias("c0"), F.lag("risk").over(w).alias("r0"))
    return s.agg(F.round(F.coalesce(F.sum((F.col("coverage") - F.col("c0")) * (F.col("risk") + F.col("r0")) / 2), F.lit(0.0)), 6).alias("aurc"), F.count("*").alias("n_points"))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Coverage and error of handling what reaches each threshold; the error is null where nothing does.

    Thresholds are exploded beside each row, so the rows are read once and pre-aggregated.
    """
    at = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    auto = F.col("confidence") >= F.col("threshold")
    g = at.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(auto).alias("n_auto"), F.count_if(auto & ~F.col("correct")).alias("auto_wrong"), F.count_if(~auto & ~F.col("correct")).alias("errors_caught"), F.count_if(~auto & F.col("correct")).alias("wasted"))
    return g.withColumn("coverage", F.round(ratio(F.col("n_auto"), F.col("n")), 6)).withColumn("error_on_auto", F.round(ratio(F.col("auto_wrong"), F.col("n_auto")), 6))


CELLS = 100_000  # cells of a confusion table that are resampled in one task


def bootstrap(preds: DataFrame, measure, draws: int = 2000, seed: int = GLOBAL_SEED) -> DataFrame:
    """(lo, hi, draws): the 95 % percentile interval of a measure of a confusion table, rows resampled.

    Drawing n rows with replacement is drawing their cells (y, pred) by their shares, so only the
    cells, at most CELLS, go to the tasks and the cost does not depend on the rows. measure takes a
    square table of counts, labels in order, and gives a number.
    """
    cells = confusion(preds).orderBy("y", "pred").limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError(f"more than {CELLS} different pairs of labels")
    labels = sorted({x for r in cells for x in (r["y"], r["pred"])})
    at = {x: i for i, x in enumerate(labels)}
    n = np.array([r["n"] for r in cells], np.int64)
    ys, ps, k = [at[r["y"]] for r in cells], [at[r["pred"]] for r in cells], len(labels)

    def run(frames):
        for f in frames:
            out = []
            for d in f["id"]:
                table = np.zeros((k, k), np.int64)
                if len(n):
                    np.add.at(table, (ys, ps), np.random.default_rng([seed, int(d)]).multinomial(n.sum(), n / n.sum()))
                out.append(measure(table))
            yield pd.DataFrame({"v": pd.Series(out, dtype="float64")})

    v = preds.sparkSession.range(draws if len(n) else 0).mapInPandas(run, "v double")
    return v.agg(F.round(F.percentile("v", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("hi"), F.count("*").alias("draws"))


def table_accuracy(table: np.ndarray) -> float:
    return float(np.trace(table) / max(table.sum(), 1))


def table_macro_f1(table: np.ndarray) -> float:
    """Macro-F1 over the labels that the full table names; 0 for 0 / 0."""
    tp, both = np.diag(table), table.sum(0) + table.sum(1)
    return float(np.mean(np.where(both > 0, 2 * tp / np.maximum(both, 1), 0.0))) if len(table) else 0.0


def table_kappa(table: np.ndarray) -> float:
    """Cohen's kappa; 1 where no disagreement is possible."""
    n = max(table.sum(), 1)
    pe = float((table.sum(0) / n) @ (table.sum(1) / n))
    return 1.0 if pe >= 1 else (np.trace(table) / n - pe) / (1 - pe)


def clustered_kappa(pairs: DataFrame, draws: int = 2000) -> DataFrame:
    """(lo, hi, draws) of Cohen's kappa of (a, b, cluster), whole clusters resampled by Poisson(1) hash weights.

    Rows are summed up by cluster and cell first. Nulls in a or b are left out, a null cluster is
    one; fewer than two clusters give nulls.
    """
    cells = pairs.where("a is not null and b is not null").groupBy("cluster", "a", "b").agg(F.count("*").alias("n"))
    x = cells.withColumn("b_", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson(draw("cluster", F.col("b_"), F.col("cluster"))) * F.col("n"))
    c = x.groupBy("b_", "a", "b").agg(F.sum("w").alias("n")).where("n > 0")
    m = c.select("b_", F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("same"))
    m = m.unionAll(c.select("b_", "b", F.lit(0), "n", F.lit(0))).groupBy("b_", "label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    t = m.groupBy("b_").agg(F.sum("na").cast("double").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("nn"))
    pe = F.col("nn") / (F.col("n") * F.col("n"))
    k = t.select(F.when(pe >= 1, 1.0).otherwise(F.try_divide(F.col("same") / F.col("n") - pe, 1 - pe)).alias("k"))
    many = cells.select("cluster").distinct().limit(2).agg((F.count("*") > 1).alias("many"))
    s = k.agg(F.round(F.percentile("k", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("k", F.lit(0.975)), 6).alias("hi"), F.count("*").alias("draws"))
    return s.join(many).select(F.when(F.col("many"), F.col("lo")).alias("lo"), F.when(F.col("many"), F.col("hi")).alias("hi"), "draws")  # one row each


def kappa_band(kappa: Column) -> Column:
    """The usual word for a kappa; null for null."""
    bands = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))
    out = F.when(kappa.isNotNull(), F.lit("almost perfect"))
    for top, word in reversed(bands):
        out = F.when(kappa <= top, F.lit(word)).otherwise(out)
    return out


def flat_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Paths whose values differ between two flattened results (path, value); numbers within tolerance are equal."""
    j = a.select("path", F.col("value").alias("expected")).join(b.select("path", F.col("value").alias("actual")), "path", "full")
    x, y = F.col("expected").try_cast("double"), F.col("actual").try_cast("double")
    same = F.col("expected").eqNullSafe(F.col("actual")) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
    return j.where(~same)


def max_label(rows: DataFrame, key: str, label: str, weight: Column) -> DataFrame:
    """The label of greatest weight for each key; ties go to the first label."""
    s = rows.groupBy(key, label).agg(F.round(F.sum(weight), 9).alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), label)
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col(label).alias("pred"), F.col("w").alias("weight"))


def held_out_threshold(dev: DataFrame, test: DataFrame, thresholds: list[float], share: float = 1 / 3) -> DataFrame:
    """The threshold that handles most of dev at no more than `share` of its base error, scored on test.

    The first threshold wins ties; there is no row where none qualifies.
    """
    base = F.lit(dev.agg(ratio(F.count_if(~F.col("correct")), F.count("*"))).first()[0])  # one row
    ok = sweep(dev, thresholds).where((F.col("n_auto") > 0) & (ratio(F.col("auto_wrong"), F.col("n_auto")) <= base * share))
    best = ok.orderBy(F.desc("n_auto"), "threshold").limit(1).select("threshold", F.col("n_auto").alias("dev_auto"))
    return best.join(sweep(test, thresholds), "threshold").select("threshold", "dev_auto", "n", "n_auto", "auto_wrong")


def annotator_pairs(labels: DataFrame, least: int = 20) -> DataFrame:
    """(a, b, n, same, raw) of each pair of annotators with at least `least` common items, from (id, annotator, label)."""
    x = labels.where("label is not null").groupBy("id", "annotator").agg(F.min("label").alias("label"))
    a, b = x.toDF("id", "a", "la"), x.toDF("id", "b", "lb")
    g = a.join(b, "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("same"))
    return g.where(F.col("n") >= least).withColumn("raw", F.round(ratio(F.col("same"), F.col("n")), 6))


def arm_summary(drafts: DataFrame, good: Column) -> DataFrame:
    """(drafter, n, good, rate, lo, hi) of drafts with a Wilson interval."""
    g = drafts.groupBy("drafter").agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    lo, hi = wilson(F.col("good"), F.col("n"))
    return g.select("drafter", "n", "good", F.round(ratio(F.col("good"), F.col("n")), 6).alias("rate"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))

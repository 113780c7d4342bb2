"""Looking at tables: ad-hoc SQL, capped results, counts, and checks that sets of rows agree."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import cut

ROWS, CELL, CHARS = 20, 160, 12_000


def column_name(name: str, df: DataFrame) -> str:
    """A column of df named by a user: all but letters, digits and underscores is taken out."""
    plain = re.sub(r"\W", "", name, flags=re.ASCII)
    if plain not in df.columns:
        raise ValueError(f"no column {plain!r}; there are {', '.join(df.columns)}")
    return plain


def ask(spark: SparkSession, sql: str, rows: int = ROWS, **tables: DataFrame) -> DataFrame:
    """The result of a query over the tables given, and one row more than `rows` at most.

    Only queries are run; where a limit stands in the text it holds as well.
    """
    text = sql.strip().rstrip(";")
    if not re.match(r"(?is)\s*(?:select|with|values|from)\b", text):
        raise ValueError("only queries can be asked")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text).limit(rows + 1)


def capped(df: DataFrame, rows: int = ROWS, cell: int = CELL) -> DataFrame:
    """At most `rows` rows as text, cells cut to `cell` characters, with _more: whether rows were left out."""
    some = df.limit(rows + 1)
    order = F.monotonically_increasing_id()
    text = some.select(*(cut(F.col(f"`{c}`").cast("string"), cell).alias(c) for c in df.columns), order.alias("_at"))
    n = F.row_number().over(Window.orderBy("_at"))  # rows + 1 rows at most
    return text.withColumns({"_n": n, "_more": F.count("*").over(Window.partitionBy()) > rows}).where(F.col("_n") <= rows).drop("_n", "_at")


def rendered(df: DataFrame, rows: int = ROWS, cell: int = CELL, chars: int = CHARS) -> str:
    """A capped result as a Markdown table of at most `chars` characters, with a line that tells of rows left out."""
    got = capped(df, rows, cell).collect()  # at most `rows`
    flat = lambda v: re.sub(r"\s+", " ", "" if v is None else v).replace("|", "\\|").strip()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(flat(r[c]) for c in df.columns) + " |" for r in got]
    text = "\n".join(lines)
    more = any(r["_more"] for r in got) or len(text) > chars
    return text[:chars] + ("\n… more rows exist" if more else "")


def require(path: str, how: str) -> str:
    """The path, or an error that says how to get the file."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"{path} is missing. {how}")
    return path


def most_common(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """(group, value, n, rank): the k values seen most in each group; ties go to the first value."""
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def sizes(df: DataFrame, label: str) -> DataFrame:
    """One row: the numbers of rows of the classes, the largest first, with the least and greatest."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return c.agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"), F.count("*").alias("classes"), F.min("n").alias("least"), F.max("n").alias("most"))


def pearson(x: Column, y: Column) -> Column:
    """The correlation of two columns as an aggregate; null where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def spread_of(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, population and sample deviation, sample variance, least and greatest of a column, by others."""
    v = F.col(value).cast("double")
    r = lambda x: F.round(x, 6)
    return df.groupBy(*by).agg(F.count(value).alias("n"), r(F.avg(v)).alias("mean"), r(F.stddev_pop(v)).alias("sd"), r(F.var_samp(v)).alias("variance"), F.min(v).alias("least"), F.max(v).alias("most"))


def per_call(calls: DataFrame, *counters: str) -> DataFrame:
    """One row: calls, how many were not cached, and the mean of each counter over those."""
    live = ~F.coalesce(F.col("cached"), F.lit(False))
    return calls.agg(F.count("*").alias("calls"), F.count_if(live).alias("live"), *(F.round(F.avg(F.when(live, F.col(c))), 6).alias(f"mean_{c}") for c in counters))


def compared_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row on two sets of keys: in both, only in a, only in b, in either, whether a is a subset of b.

    Nulls are no keys, repeats count once; rows of the two sides are joined by key, never by place.
    """
    x = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full").agg(F.count_if(F.expr("_a = 1 and _b = 1")).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count("*").alias("either"))
    return j.withColumn("subset", F.col("only_a") == 0)


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a joined with b row by row of a key; an error where a key stands on one side only, or twice."""
    once = lambda d, s: d.groupBy(key).agg(F.count("*").alias(f"_{s}"), *(F.first(c).alias(c) for c in d.columns if c != key))
    j = once(a, "a").join(once(b, "b"), key, "full")
    fine = F.coalesce((F.col("_a") == 1) & (F.col("_b") == 1), F.lit(False))
    return j.withColumn("_ok", F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("not one row on each side for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).where("_ok").drop("_ok", "_a", "_b")


def first_rows(df: DataFrame, place: str, n: int) -> DataFrame:
    """The first n rows by place."""
    return df.orderBy(place).limit(n)


def top_of(posterior: DataFrame, k: int = 3) -> DataFrame:
    """(id, label, p, rank): the k likeliest labels of each id of (id, label, p); ties go to the first label."""
    return posterior.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "label"))).where(F.col("rank") <= k)

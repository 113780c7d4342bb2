"""Reproducible splits, folds and samples; every draw is a hash of a key, never of a row's place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import DEV_SHARE, MIN_REPLY_CHARS, TEST_SHARE
from skein.functions.hashing import draw, order_key
from skein.functions.text import private_channel


def thread_split(thread: Column) -> Column:
    """test, dev or train of a thread; threads added later change nothing for the others."""
    u = draw("split", thread)
    return F.when(u < TEST_SHARE, "test").when(u < TEST_SHARE + DEV_SHARE, "dev").otherwise("train")


def split_violations(df: DataFrame, thread: str, split: str) -> DataFrame:
    """Threads that stand in more than one split."""
    return df.where(F.col(thread).isNotNull()).groupBy(thread).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def one_per_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in the given total order; rows with a null group are all kept."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | F.col(group).isNull()).drop("_n")


def hash_sample(df: DataFrame, n: int, purpose: str, *keys: Column) -> DataFrame:
    """n rows without replacement, the same ones on every run."""
    return df.orderBy(order_key(purpose, *keys), *keys).limit(n)


def stratified_folds(df: DataFrame, y: str, key: str, k: int = 5, rep: int = 0) -> DataFrame:
    """df with a fold in 0..k-1; each class is spread evenly over the folds."""
    w = Window.partitionBy(y).orderBy(order_key("folds", F.lit(rep), F.col(key)), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def stratum_flags(text: Column, rules: dict[str, str]) -> Column:
    """The names of the rules that match the lower-case text, in rule order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(low.rlike(rx), F.lit(name)) for name, rx in rules.items()]), lambda x: x.isNotNull())


def stratified_sample(df: DataFrame, rules: dict[str, str], text: str, key: str, group: str, n: int, n_random: int) -> DataFrame:
    """n rows for each rule in turn and n_random of the rest, never two of one group.

    A stratum draws from what earlier strata left: neither taken rows nor taken groups.
    """
    taken: list[DataFrame] = []
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    for name, rx in [*rules.items(), ("random", None)]:
        pool = df if rx is None else df.where(low.rlike(rx))
        if taken:
            used = reduce(DataFrame.unionByName, [t.select(group) for t in taken]).distinct()
            pool = pool.join(used, group, "left_anti")
        one = one_per_group(pool.where(F.col(group).isNotNull()), group, order_key(name, F.col(key)), F.col(key))
        part = hash_sample(one, n if rx else n_random, name, F.col(key)).withColumn("stratum_drawn", F.lit(name))
        taken.append(part)
    return reduce(DataFrame.unionByName, taken)


def index_reason() -> Column:
    """Why an exchange does not enter the reply corpus, or `kept`."""
    return F.when(F.coalesce(F.length("brand_clean"), F.lit(0)) < MIN_REPLY_CHARS, "short_reply").when(private_channel(F.col("brand_clean")), "private_channel").otherwise("kept")


def matched_profile(df: DataFrame, y: str, key: str, sizes: list[int]) -> DataFrame:
    """The i-th class in hash order gives sizes[i] rows, so that the class profile is matched."""
    classes = df.select(y).distinct()
    ranked = classes.withColumn("place", F.row_number().over(Window.orderBy(order_key("classes", F.col(y)), y)))  # a row a class
    want = df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "place int, want int")
    w = Window.partitionBy(y).orderBy(order_key("profile", F.col(key)), key)
    return df.join(F.broadcast(ranked.join(want, "place")), y).withColumn("n", F.row_number().over(w)).where("n <= want").drop("n", "want")


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """(class, n, weight): rows / (classes * rows of the class)."""
    c = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # a row a class
    return c.select(y, "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), 6).alias("weight"))


def reply_corpus(exchanges: DataFrame, n: int) -> DataFrame:
    """n train exchanges with a reply that says something, one a thread, in order of their id."""
    kept = exchanges.where((F.col("split") == "train") & (index_reason() == "kept"))
    one = one_per_group(kept, "thread_id", order_key("corpus", F.col("customer_tweet_id")), F.col("customer_tweet_id"))
    return hash_sample(one, n, "corpus", F.col("customer_tweet_id")).orderBy("customer_tweet_id")


def shuffled(df: DataFrame, purpose: str, *keys: Column) -> DataFrame:
    """df with `place`: each row's place from 1 in a shuffle within its group (keys[0]) that repeats on every run."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy(order_key(purpose, *keys), *keys)))

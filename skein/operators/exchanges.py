"""Customer-brand exchanges from message rows, and their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import MIN_BRAND_CHARS, MIN_CUSTOMER_CHARS
from skein.functions.instants import instant
from skein.functions.text import strip_signature


def messages(twcs: DataFrame) -> DataFrame:
    """One row for each tweet: repeats merge, known values win over missing ones.

    Where repeats differ the greatest value counts, so a cut text loses to the longer one it
    begins. A tweet without an id is dropped.
    """
    return (
        twcs.where("tweet_id is not null")
        .groupBy("tweet_id")
        .agg(F.max("author_id").alias("author_id"), F.max("inbound").alias("inbound"), F.max(instant(F.col("created_at"))).alias("sec"), F.max("text").alias("text"), F.max("in_response_to_tweet_id").alias("parent_id"))
    )


def exchanges(twcs: DataFrame) -> DataFrame:
    """One row for each customer tweet that a brand answered, its replies merged in order of time.

    Replies to one tweet are split messages: each loses its signature, then they are joined by a
    blank. Replies without a time come last. Tweets whose `inbound` is null are on neither side.
    """
    m = messages(twcs)
    brand = m.where("not inbound and parent_id is not null").select(F.col("tweet_id").alias("reply_id"), "parent_id", F.col("sec").alias("reply_sec"), F.col("text").alias("reply_text"))
    customer = m.where("inbound").select(F.col("tweet_id").alias("customer_tweet_id"), F.col("author_id").alias("customer_id"), F.col("text").alias("customer_text"), F.col("sec").alias("customer_sec"), F.col("parent_id").isNull().alias("is_first_contact"))
    both = brand.join(customer, brand.parent_id == customer.customer_tweet_id)
    key = ["customer_tweet_id", "customer_id", "customer_text", "customer_sec", "is_first_contact"]
    late = F.coalesce("reply_sec", F.lit(1 << 60))
    part = F.struct(late.alias("sec"), F.col("reply_id"), strip_signature(F.coalesce("reply_text", F.lit(""))).alias("text"))
    merged = both.groupBy(*key).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("reply_sec").alias("brand_sec"))
    return merged.select(
        *key, "brand_sec", F.col("parts.reply_id").alias("brand_tweet_ids"), F.size("parts").alias("n_reply_parts"), F.array_join("parts.text", " ").alias("brand_text"),
        F.bround((F.col("brand_sec") - F.col("customer_sec")) / F.lit(60.0), 2).alias("response_minutes"),
    )


def drop_reason(lang: str = "en") -> Column:
    """The first rule an exchange fails, or `kept`; null comparisons fail."""
    long_enough = (F.length("customer_clean") >= MIN_CUSTOMER_CHARS) & (F.length("brand_clean") >= MIN_BRAND_CHARS)
    return (
        F.when(~F.coalesce(F.col("lang") == lang, F.lit(False)), "other_language")
        .when(~F.coalesce(long_enough, F.lit(False)), "too_short")
        .when(~F.coalesce(F.col("response_minutes") >= 0, F.lit(False)), "negative_latency")
        .otherwise("kept")
    )


def filter_counts(ex: DataFrame) -> DataFrame:
    """(reason, n): one pass over the exchanges; the counts add up to the input."""
    return ex.groupBy(drop_reason().alias("reason")).agg(F.count("*").alias("n"))


def kept(ex: DataFrame) -> DataFrame:
    return ex.where(drop_reason() == "kept")


def brand_profile(twcs: DataFrame, k: int = 10) -> DataFrame:
    """The k authors with most outbound messages: messages, customers answered, share of replies, first and last instant."""
    m = messages(twcs).where("not inbound and author_id is not null")
    return m.groupBy("author_id").agg(
        F.count("*").alias("n"), F.countDistinct("parent_id").alias("answered"), F.round(100.0 * F.count("parent_id") / F.count("*"), 1).alias("reply_pct"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    ).orderBy(F.desc("n"), "author_id").limit(k)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """(value, n, pct) of one column; pct is of all rows, nulls included."""
    if col not in df.columns:
        raise ValueError(f"no column {col!r}")
    n = df.groupBy(F.col(f"`{col}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return n.select("value", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2).alias("pct"))  # a row a value


def table_profile(df: DataFrame) -> DataFrame:
    """(column, rows, present, distinct) of each column in one pass."""
    aggs = [F.count("*").alias("rows")] + [x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"p{i}"), F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"))]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"p{i}").alias("present"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(df.columns)])
    return one.select(F.inline(cells))


def next_in_thread(events: DataFrame, thread: str, at: str, tie: str) -> DataFrame:
    """events with the following event's instant and tie column in the same thread."""
    w = Window.partitionBy(thread).orderBy(at, tie)
    return events.withColumn("next_at", F.lead(at).over(w)).withColumn("next_tie", F.lead(tie).over(w))


def latency_percentiles(ex: DataFrame, col: str, by: str) -> DataFrame:
    """Count, exact median and p90 (linear interpolation), mean and population deviation by group."""
    return ex.where(F.col(col).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.percentile(col, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(col, F.lit(0.9)), 4).alias("p90"), F.round(F.avg(col), 4).alias("mean"), F.round(F.stddev_pop(col), 4).alias("sd")
    )

"""Rebuilding conversations from message rows with keyed streaming state.

Messages are streamed from the folder of rows, joined with an index that names each message's
conversation, and buffered in state until the conversation closes: all rows the index counts for
it have come, or the event-time watermark has passed its timeout. On closing it is validated,
ordered and emitted. State is keyed by a bucket of conversations rather than by one conversation,
so that the cost of a state call is shared by some thousands of rows; a conversation lies wholly
in one bucket.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.functions.instants import instant
from skein.functions.speech import has_content, is_customer
from skein.operators.hierarchy import ABSENT, hierarchy
from skein.session import Scratch

BUCKET_ROWS = 4_000  # rows of a state bucket on average
LARGE_ROWS = 500_000  # conversations of more rows are never buffered in one state
SLICE_SECONDS = 3_600  # they are numbered by slices of this length
TIMEOUT_MS = 30 * 24 * 3600 * 1000  # an open conversation is closed this long after its last message
OUT = "conversation_id long, turn int, tweet_id long, role string"
COLS = ["root", "tweet_id", "at", "content", "customer", "broken", "tree_rows"]
NONE = np.iinfo(np.int64).min


def index(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(tweet_id, root, tree_rows, broken): each message's conversation and its number of rows.

    A conversation is broken if it holds a circle or its root names a parent that is absent.
    """
    h = hierarchy(rows, scratch)
    return h.select(F.col("id").alias("tweet_id"), "root", "tree_rows", ((F.col("depth") < 0) | (F.col("root_state") == ABSENT)).alias("broken"))


def close(rows: pd.DataFrame) -> pd.DataFrame:
    """Validated conversations of buffered rows, one row for each message with content, in order.

    Repeats of a message count once: it has an instant, or content, if any of its rows has. A
    conversation is dropped if it is broken, if any message has no readable instant, or if it
    lacks a customer message or a brand message with content.
    """
    if not len(rows):
        return pd.DataFrame({"conversation_id": [], "turn": [], "tweet_id": [], "role": []}).astype({"conversation_id": "int64", "turn": "int32", "tweet_id": "int64"})
    o = np.lexsort((rows["tweet_id"].to_numpy(), rows["root"].to_numpy()))
    root, tweet = rows["root"].to_numpy()[o], rows["tweet_id"].to_numpy()[o]
    new = np.flatnonzero(np.r_[True, tweet[1:] != tweet[:-1]])
    at = np.maximum.reduceat(rows["at"].to_numpy()[o], new)
    content = np.logical_or.reduceat(rows["content"].to_numpy()[o], new)
    customer = np.logical_or.reduceat(rows["customer"].to_numpy()[o], new)
    broken = np.logical_or.reduceat(rows["broken"].to_numpy()[o], new)
    root, tweet = root[new], tweet[new]
    talk = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
    sizes = np.diff(np.r_[talk, len(root)])
    good = ~np.logical_or.reduceat(broken | (at == NONE), talk) & np.logical_or.reduceat(content & customer, talk) & np.logical_or.reduceat(content & ~customer, talk)
    keep = np.repeat(good, sizes) & content
    root, tweet, at, customer = root[keep], tweet[keep], at[keep], customer[keep]
    o = np.lexsort((tweet, at, root))
    root, tweet, customer = root[o], tweet[o], customer[o]
    first = np.r_[True, root[1:] != root[:-1]] if len(root) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    turn = np.arange(len(root)) - (np.repeat(starts, np.diff(np.r_[starts, len(root)])) if len(root) else 0) + 1
    return pd.DataFrame({"conversation_id": root, "turn": turn.astype(np.int32), "tweet_id": tweet, "role": np.where(customer, "customer", "brand")})


def close_large(rows: DataFrame) -> DataFrame:
    """What close() gives, for conversations too large for one task; rows has the columns COLS.

    Repeats and validity are plain aggregates with partial sums. A turn is the number of messages
    in earlier slices of the conversation plus the place within its slice, so no task sees more
    than a slice.
    """
    once = rows.groupBy("root", "tweet_id").agg(F.max("at").alias("at"), F.max("content").alias("content"), F.max("customer").alias("customer"), F.max("broken").alias("broken"))
    good = once.groupBy("root").agg(F.max(F.col("broken") | (F.col("at") == NONE)).alias("bad"), F.max(F.col("content") & F.col("customer")).alias("asked"), F.max(F.col("content") & ~F.col("customer")).alias("answered")).where("not bad and asked and answered")
    told = once.where("content").join(good.select("root"), "root", "left_semi").withColumn("slice", F.floor(F.col("at") / SLICE_SECONDS))
    sizes = told.groupBy("root", "slice").count()
    before = sizes.select("root", "slice", (F.sum("count").over(Window.partitionBy("root").orderBy("slice")) - F.col("count")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("root", "slice").orderBy("at", "tweet_id")) + F.col("before")
    return told.join(before, ["root", "slice"]).select(F.col("root").alias("conversation_id"), turn.cast("int").alias("turn"), "tweet_id", F.when(F.col("customer"), "customer").otherwise("brand").alias("role"))


def _step(key, frames, state: GroupState):
    """Buffer a bucket's new rows; emit what is complete, or on timeout what is old enough.

    The state holds the open rows and the roots that were closed by timeout. A row that comes for
    such a root is later than the timeout allows and is left out, so that no conversation is emitted
    twice. Conversations that closed by count have no more rows to come.
    """
    kept, over = pickle.loads(state.get[0]) if state.exists else (None, set())
    parts = [] if kept is None else [kept]
    parts += [f[COLS] for f in frames]
    rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0] if parts else pd.DataFrame(columns=COLS)
    if over:
        rows = rows[~rows["root"].isin(over)]
    wm = state.getCurrentWatermarkMs()
    have = rows.groupby("root")["at"].agg(["size", "max"])
    want = rows.groupby("root")["tree_rows"].max()
    full = have["size"] >= want
    stale = (have["max"] == NONE) | (have["max"] * 1000 + state_timeout() <= wm) if state.hasTimedOut else np.zeros(len(have), bool)
    over |= set(have.index[~full & stale].tolist())
    is_closed = rows["root"].isin(have.index[full | stale])
    open_rows = rows[~is_closed]
    if len(open_rows) or over:
        state.update((pickle.dumps((open_rows if len(open_rows) else None, over), protocol=5),))
    elif state.exists:
        state.remove()
    if len(open_rows):
        newest = open_rows["at"].max()
        state.setTimeoutTimestamp(int(max(wm + 1, (newest * 1000 if newest != NONE else max(wm, 0)) + state_timeout())))
    yield close(rows[is_closed])


def state_timeout() -> int:
    return TIMEOUT_MS


def _streamable(spark: SparkSession, path: str) -> str:
    """A single file can be streamed only by a pattern that matches it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(p).isDirectory() else f"{path[:-1]}[{path[-1]}]"


def rebuild(spark: SparkSession, folder: str, scratch: Scratch | None = None, watermark_delay: str | None = None, bucket_rows: int = BUCKET_ROWS, files_per_trigger: int | None = None, large_rows: int = LARGE_ROWS) -> DataFrame:
    """(conversation_id, turn, tweet_id, role) of the message rows in a Parquet file or folder.

    turn counts from 1 by instant, then tweet_id. Null and unreadable instants, null and empty
    texts and repeated rows are handled as close() states; rows with a null tweet_id are dropped;
    an empty table gives an empty result; other columns are not read. Rows later than
    watermark_delay behind the newest are dropped; by default that is the time the rows span, as a
    replay of a whole dump, whose late rows stand anywhere, must keep all. Conversations of more than
    large_rows rows bypass the state, with the same result; see close_large().
    """
    scratch = scratch or Scratch(spark, "conversations")
    static = spark.read.parquet(folder)
    idx = scratch.save(index(static, scratch), "index")
    buckets = max(16, idx.count() // bucket_rows)
    if watermark_delay is None:
        seconds = instant(F.col("created_at"))
        lo, hi = static.agg(F.min(seconds), F.max(seconds)).first()
        watermark_delay = f"{1 + ((hi - lo) // 86_400 if lo is not None else 0)} days"
    needed = ["tweet_id", "author_id", "created_at", "text"]
    reader = spark.readStream.schema(static.select(*needed).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def joined(rows: DataFrame, watermark: bool, keep: Column) -> DataFrame:
        rows = rows.select(F.col("tweet_id").cast("long").alias("tweet_id"), instant(F.col("created_at")).alias("sec"), has_content(F.col("text")).alias("content"), is_customer(F.col("author_id")).alias("customer"))
        rows = rows.withColumn("event_time", F.timestamp_seconds("sec"))
        if watermark:
            rows = rows.withWatermark("event_time", watermark_delay)
        return rows.join(idx.where(keep), "tweet_id").select(
            F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("bucket"), "event_time", "root", "tweet_id", F.coalesce("sec", F.lit(NONE)).alias("at"), "content", "customer", "broken", "tree_rows"
        )

    large = F.col("tree_rows") > large_rows
    rows = joined(reader.parquet(_streamable(spark, folder)), True, ~large)
    out = rows.groupBy("bucket").applyInPandasWithState(_step, OUT, "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)
    sink = scratch.path("closed")
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch.path("progress")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    closed = spark.read.schema(OUT).parquet(sink)
    if not idx.where(large).limit(1).count():
        return closed
    return closed.unionByName(close_large(joined(static, False, large)))

"""Queries over messages, exchanges and their text, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.hashing import seed_for
from skein.operators import exchanges as X
from skein.operators.graph import components
from skein.plans.hierarchy_queries import TREES
from skein.session import Scratch
from skein.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: one row a tweet, as operators.exchanges.messages
MESSAGES = """
m AS (
  SELECT tweet_id, max(author_id) AS author_id, max(inbound) AS inbound, max(text) AS text, max(in_response_to_tweet_id) AS parent_id,
    max(CASE WHEN regexp_matches(trim(created_at), '^[A-Za-z]{3} [A-Za-z]{3} [0-9]{2} ') THEN epoch(try_strptime(trim(created_at), '%a %b %d %H:%M:%S %z %Y'))::BIGINT
             WHEN regexp_matches(trim(created_at), '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]') THEN epoch(try_cast(replace(trim(created_at), 'Z', '+00:00') AS TIMESTAMPTZ))::BIGINT END) AS sec
  FROM twcs WHERE tweet_id IS NOT NULL GROUP BY tweet_id
)
"""
SIG = r"(?:\s*[\^*/~\-–]\s?[A-Z]{1,3}\d?)+(?:\s*\d{1,2}\s*/\s*\d{1,2})?\s*$"


def _stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{SIG}', ''), '\\s+$', '')"


@query("WITH " + MESSAGES + f"""
, r AS (
  SELECT tweet_id AS reply_id, parent_id, sec AS reply_sec, {_stripped("coalesce(text, '')")} AS t FROM m WHERE NOT inbound AND parent_id IS NOT NULL
), c AS (SELECT tweet_id AS customer_tweet_id, author_id AS customer_id, text AS customer_text, sec AS customer_sec, parent_id IS NULL AS is_first_contact FROM m WHERE inbound)
SELECT customer_tweet_id, customer_id, customer_text, customer_sec, is_first_contact, min(reply_sec) AS brand_sec,
  list(reply_id ORDER BY coalesce(reply_sec, 1152921504606846976), reply_id) AS brand_tweet_ids, count(*)::INT AS n_reply_parts,
  array_to_string(list(t ORDER BY coalesce(reply_sec, 1152921504606846976), reply_id), ' ') AS brand_text,
  round_even((min(reply_sec) - customer_sec) / 60.0::DOUBLE, 2) AS response_minutes
FROM r JOIN c ON r.parent_id = c.customer_tweet_id GROUP BY customer_tweet_id, customer_id, customer_text, customer_sec, is_first_contact
""")
def exchanges(spark, sf_dir):
    return X.exchanges(table(spark, sf_dir, "twcs"))


@query("SELECT tweet_id, author_id, inbound, text, in_response_to_tweet_id AS parent_id FROM twcs WHERE NOT inbound AND in_response_to_tweet_id IS NOT NULL")
def brand_replies_scan(spark, sf_dir):
    return table(spark, sf_dir, "twcs").where("not inbound and in_response_to_tweet_id is not null").select("tweet_id", "author_id", "inbound", "text", F.col("in_response_to_tweet_id").alias("parent_id"))


@query("WITH " + MESSAGES + """
SELECT author_id, count(*) AS n, count(DISTINCT parent_id) AS answered, round(100.0::DOUBLE * count(parent_id) / count(*), 1) AS reply_pct, min(sec) AS first_sec, max(sec) AS last_sec
FROM m WHERE NOT inbound AND author_id IS NOT NULL GROUP BY author_id ORDER BY n DESC, author_id LIMIT 10""")
def brand_profile(spark, sf_dir):
    return X.brand_profile(table(spark, sf_dir, "twcs"))


@query("SELECT CAST(intent AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM golden GROUP BY 1")
def value_counts_share(spark, sf_dir):
    return X.value_shares(table(spark, sf_dir, "golden"), "intent")


@query("""SELECT 'customer_id' AS "column", count(*) AS rows, count(customer_id) AS present, count(DISTINCT customer_id) AS distinct_values FROM exchanges
UNION ALL SELECT 'lang', count(*), count(lang), count(DISTINCT lang) FROM exchanges
UNION ALL SELECT 'thread_id', count(*), count(thread_id), count(DISTINCT thread_id) FROM exchanges""")
def table_profile(spark, sf_dir):
    return X.table_profile(table(spark, sf_dir, "exchanges").select("customer_id", "lang", "thread_id"))


_REASON = """CASE WHEN NOT coalesce(lang = 'en', false) THEN 'other_language'
  WHEN NOT coalesce(length(customer_clean) >= 15 AND length(brand_clean) >= 20, false) THEN 'too_short'
  WHEN NOT coalesce(response_minutes >= 0, false) THEN 'negative_latency' ELSE 'kept' END"""


@query(f"SELECT {_REASON} AS reason, count(*) AS n FROM exchanges GROUP BY 1")
def exchange_filter_counts(spark, sf_dir):
    return X.filter_counts(table(spark, sf_dir, "exchanges"))


@query(f"SELECT customer_tweet_id, thread_id, split FROM exchanges WHERE {_REASON} = 'kept'")
def exchanges_kept(spark, sf_dir):
    return X.kept(table(spark, sf_dir, "exchanges")).select("customer_tweet_id", "thread_id", "split")


@query(TREES + "SELECT id AS tweet_id, root AS thread_id FROM (SELECT id, min(id) OVER (PARTITION BY root) AS root FROM (SELECT id, root FROM down UNION ALL SELECT id, root FROM low))")
def thread_components(spark, sf_dir):
    """Every tweet with the smallest tweet of its reply component."""
    t = table(spark, sf_dir, "twcs")
    scratch = Scratch(spark, "threads")
    return components(t.select(F.col("tweet_id").alias("id"), F.col("in_response_to_tweet_id").alias("link"), F.lit(0).alias("kind")), scratch).select(F.col("id").alias("tweet_id"), F.col("component").alias("thread_id"))


@query("SELECT tweet_id, in_response_to_tweet_id AS parent_id FROM twcs WHERE in_response_to_tweet_id IS NOT NULL AND in_response_to_tweet_id NOT IN (SELECT tweet_id FROM twcs WHERE tweet_id IS NOT NULL)")
def dangling_replies(spark, sf_dir):
    t = table(spark, sf_dir, "twcs")
    return t.where("in_response_to_tweet_id is not null").select("tweet_id", F.col("in_response_to_tweet_id").alias("parent_id")).join(t.select(F.col("tweet_id").alias("parent_id")).distinct(), "parent_id", "left_anti").select("tweet_id", "parent_id")


@query("SELECT DISTINCT id, thread_id FROM golden WHERE id IN (SELECT customer_tweet_id FROM exchanges)")
def golden_in_exchanges(spark, sf_dir):
    return table(spark, sf_dir, "golden").select("id", "thread_id").distinct().join(table(spark, sf_dir, "exchanges").select(F.col("customer_tweet_id").alias("id")), "id", "left_semi")


@query("SELECT DISTINCT thread_id FROM exchanges WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT thread_id FROM golden WHERE thread_id IS NOT NULL)")
def corpus_threads(spark, sf_dir):
    return table(spark, sf_dir, "exchanges").where("thread_id is not null").select("thread_id").distinct().join(table(spark, sf_dir, "golden").select("thread_id").where("thread_id is not null"), "thread_id", "left_anti")


@query("""SELECT lang, count(*) AS n, round(quantile_cont(response_minutes, 0.5), 4) AS median, round(quantile_cont(response_minutes, 0.9), 4) AS p90, round(avg(response_minutes), 4) AS mean, round(stddev_pop(response_minutes), 4) AS sd
FROM exchanges WHERE response_minutes IS NOT NULL GROUP BY lang""")
def latency_percentiles(spark, sf_dir):
    return X.latency_percentiles(table(spark, sf_dir, "exchanges"), "response_minutes", "lang")


@query("SELECT event_id, lead(ts) OVER w AS next_at, lead(event_id) OVER w AS next_tie FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_event(spark, sf_dir):
    return X.next_in_thread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id").select("event_id", "next_at", "next_tie")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# ---- text scalars


@query(f"SELECT id, {_stripped('brand_reply')} AS stripped FROM golden")
def strip_signature(spark, sf_dir):
    return table(spark, sf_dir, "golden").select("id", T.strip_signature(F.col("brand_reply")).alias("stripped"))


@query()
def mask_entities(spark, sf_dir):
    return table(spark, sf_dir, "twcs").select("tweet_id", T.clean(F.col("text")).alias("clean"))


_MASK = "text"
for _rx, _tok in T.ENTITY_SHAPES:
    if _tok != "ref":
        _MASK = f"regexp_replace({_MASK}, '{_rx}', ' <{_tok}> ', 'g')"


@query(f"SELECT tweet_id, trim(regexp_replace({_MASK}, '\\s+', ' ', 'g')) AS masked FROM twcs WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x20-\\x7e]*')")
def mask_plain_shapes(spark, sf_dir):
    """The shapes RE2 can express, on plain ASCII texts: all but booking references. mask_shapes has all texts."""
    t = F.col("text")
    for rx, tok in T.ENTITY_SHAPES:
        if tok != "ref":
            t = F.regexp_replace(t, rx, f" <{tok}> ")
    return table(spark, sf_dir, "twcs").where(F.col("text").rlike(r"\A[\x20-\x7e]*\z")).select("tweet_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("masked"))


@query()
def mask_shapes(spark, sf_dir):
    """The shapes of mask_plain_shapes on every text, whatever its characters; a null text stays null."""
    t = F.col("text")
    for rx, tok in T.ENTITY_SHAPES:
        if tok != "ref":
            t = F.regexp_replace(t, "(?U)" + rx, f" <{tok}> ")
    return table(spark, sf_dir, "twcs").select("tweet_id", F.trim(F.regexp_replace(t, r"(?U)\s+", " ")).alias("masked"))


@query("SELECT qid, rank, regexp_matches(regexp_replace(reply, '^\\s*(?:<user>\\s*)+', ''), '<(?:user|url|email|flight|ref|phone|num)>') AS placeholder FROM hits")
def placeholder_flag(spark, sf_dir):
    return table(spark, sf_dir, "hits").select("qid", "rank", T.has_placeholder(F.col("reply")).alias("placeholder"))


@query(f"SELECT split, count(*) AS n, count(*) FILTER (coalesce(regexp_matches(brand_text, '{T.PRIVATE_CHANNEL}'), false)) AS private_n FROM exchanges GROUP BY split")
def private_channel_rate(spark, sf_dir):
    return table(spark, sf_dir, "exchanges").groupBy("split").agg(F.count("*").alias("n"), F.count_if(T.private_channel(F.col("brand_text"))).alias("private_n"))


@query("SELECT tweet_id, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS plain FROM twcs")
def html_unescape(spark, sf_dir):
    return table(spark, sf_dir, "twcs").select("tweet_id", T.unescape(F.col("text")).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(text) > 160 THEN concat(substr(text, 1, 159), '…') ELSE text END AS cell FROM documents")
def cell_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cut(F.col("text"), 160).alias("cell"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n_tokens FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7f]*')")
def token_counts(spark, sf_dir):
    """The part of token_counts_unicode that SQL counts alike: documents of plain ASCII text."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[\x00-\x7f]*\z")).select("doc_id", F.size(T.tokens(F.col("text"), False)).cast("bigint").alias("n_tokens"))


@query()
def token_counts_unicode(spark, sf_dir):
    """Tokens of every document, of letters and digits of any script; null for a null text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(T.tokens(F.col("text"))).cast("bigint")).alias("n_tokens"))


@query("SELECT ('0x' || substr(sha256('20250911:golden'), 1, 8))::BIGINT AS seed, id FROM taxonomy")
def sub_seed(spark, sf_dir):
    return table(spark, sf_dir, "taxonomy").select(seed_for("golden").alias("seed"), "id")


@query("SELECT id, letter, concat(letter, ') ', name, ': ', description, ' e.g. ', positive, ' | not: ', near_miss, ' (', near_miss_is, ')') AS option_line FROM taxonomy")
def taxonomy_options(spark, sf_dir):
    return table(spark, sf_dir, "taxonomy").select("id", "letter", F.format_string("%s) %s: %s e.g. %s | not: %s (%s)", "letter", "name", "description", "positive", "near_miss", "near_miss_is").alias("option_line"))

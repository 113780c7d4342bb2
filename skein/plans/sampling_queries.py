"""Queries over splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import sampling as S
from skein.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
RULES = {"delay": "delay|cancel|stuck|tarmac|missed my connection", "baggage": r"\bbag\b|suitcase|pram|stroller|belt", "money": "charged|refund|voucher", "seat": "seat|upgrade", "praise": "thank|gracias|merci|grazie"}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _draw(purpose: str, *keys: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws(':', '20250911:{purpose}', {', '.join(f'coalesce(cast({k} as varchar), {chr(39)*2})' for k in keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _key(purpose: str, *keys: str) -> str:
    return f"sha256(concat_ws(':', '20250911:{purpose}', {', '.join(f'coalesce(cast({k} as varchar), {chr(39)*2})' for k in keys)}))"


_G = "(SELECT id, min(text) AS text, min(intent) AS intent, min(thread_id) AS thread_id FROM golden WHERE id IS NOT NULL AND coalesce(excluded, '') = '' GROUP BY id)"


def golden_once(spark, sf_dir):
    """One row for each labelled id that is not excluded."""
    g = table(spark, sf_dir, "golden").where("id is not null and coalesce(excluded, '') = ''")
    return g.groupBy("id").agg(F.min("text").alias("text"), F.min("intent").alias("intent"), F.min("thread_id").alias("thread_id"))


@query(f"SELECT thread_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'dev' ELSE 'train' END AS new_split FROM (SELECT thread_id, {_draw('split', 'thread_id')} AS u FROM (SELECT DISTINCT thread_id FROM exchanges WHERE thread_id IS NOT NULL))")
def thread_split(spark, sf_dir):
    return table(spark, sf_dir, "exchanges").where("thread_id is not null").select("thread_id").distinct().withColumn("new_split", S.thread_split(F.col("thread_id")))


@query("SELECT thread_id, count(DISTINCT split) AS n_splits FROM exchanges WHERE thread_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return S.split_violations(table(spark, sf_dir, "exchanges"), "thread_id", "split")


@query("SELECT customer_tweet_id, thread_id FROM (SELECT customer_tweet_id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY customer_tweet_id) AS n FROM (SELECT DISTINCT customer_tweet_id, thread_id FROM exchanges)) WHERE n = 1 OR thread_id IS NULL")
def one_row_per_thread(spark, sf_dir):
    return S.one_per_group(table(spark, sf_dir, "exchanges").select("customer_tweet_id", "thread_id").distinct(), "thread_id", F.col("customer_tweet_id"))


@query(f"SELECT id FROM {_G} ORDER BY {_key('draft', 'id')}, id LIMIT 60")
def hash_sample(spark, sf_dir):
    return S.hash_sample(golden_once(spark, sf_dir).select("id"), 60, "draft", F.col("id"))


@query(f"SELECT id, intent, ((row_number() OVER (PARTITION BY intent ORDER BY {_key('folds', '0', 'id')}, id) - 1) % 5)::INT AS fold FROM {_G}")
def kfold_assignment(spark, sf_dir):
    return S.stratified_folds(golden_once(spark, sf_dir).select("id", "intent"), "intent", "id")


@query("SELECT id, " + "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{rx}') THEN '{n}' END" for n, rx in RULES.items()) + f"], lambda x: x IS NOT NULL) AS strata FROM {_G}")
def stratum_rules(spark, sf_dir):
    return golden_once(spark, sf_dir).select("id", S.stratum_flags(F.col("text"), RULES).alias("strata"))


def _strata_sql() -> str:
    ctes, used = [], []
    for name, rx in [*RULES.items(), ("random", None)]:
        cond = f"regexp_matches(lower(coalesce(text, '')), '{rx}')" if rx else "true"
        for u in used:
            cond += f" AND thread_id NOT IN (SELECT thread_id FROM s_{u})"
        n = 8 if rx else 20
        ctes.append(f"s_{name} AS (SELECT id, thread_id, '{name}' AS stratum_drawn FROM (SELECT id, thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY {_key(name, 'id')}, id) AS n FROM g WHERE thread_id IS NOT NULL AND {cond}) WHERE n = 1 ORDER BY {_key(name, 'id')}, id LIMIT {n})")
        used.append(name)
    return f"WITH g AS {_G}, " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM s_{u}" for u in used)


@query(_strata_sql())
def stratified_golden_sample(spark, sf_dir):
    return S.stratified_sample(golden_once(spark, sf_dir), RULES, "text", "id", "thread_id", 8, 20).select("id", "thread_id", "stratum_drawn")


@query("""SELECT CASE WHEN coalesce(length(brand_clean), 0) < 60 THEN 'short_reply' WHEN coalesce(regexp_matches(brand_clean, '(?i)\\b(?:d\\.?m\\.?s?|direct messages?|private messages?|pm us|inbox us)\\b'), false) THEN 'private_channel' ELSE 'kept' END AS reason, count(*) AS n FROM exchanges GROUP BY 1""")
def index_filter_counts(spark, sf_dir):
    return table(spark, sf_dir, "exchanges").groupBy(S.index_reason().alias("reason")).agg(F.count("*").alias("n"))


_SIZES = [12, 8, 5, 3]


@query(f"""WITH g AS {_G}, c AS (SELECT intent, row_number() OVER (ORDER BY {_key('classes', 'intent')}, intent) AS place FROM (SELECT DISTINCT intent FROM g)),
w AS (SELECT * FROM (VALUES {', '.join(f'({i + 1}, {n})' for i, n in enumerate(_SIZES))}) v(place, want))
SELECT id, intent, place FROM (SELECT id, intent, place, want, row_number() OVER (PARTITION BY intent ORDER BY {_key('profile', 'id')}, id) AS n FROM g JOIN c USING (intent) JOIN w USING (place)) WHERE n <= want""")
def matched_profile_draw(spark, sf_dir):
    return S.matched_profile(golden_once(spark, sf_dir).select("id", "intent"), "intent", "id", _SIZES).select("id", "intent", "place")


@query(f"SELECT intent, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM {_G} WHERE intent IS NOT NULL GROUP BY intent")
def balanced_weights(spark, sf_dir):
    return S.balanced_weights(golden_once(spark, sf_dir), "intent")

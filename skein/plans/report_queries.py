"""Queries over judged drafts, decisions, replays and ad-hoc looks at tables.

No judge's scores are in the test tables, so responses are made from each draft's length and id; the
SQL reckons the scores itself and never reads the responses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.hashing import embedding_key, item_hash
from skein.operators import classify as C
from skein.operators import evaluation as E
from skein.operators import explore as Q
from skein.operators import judging as J
from skein.operators import replay as P
from skein.operators import retrieval as R
from skein.operators import routing as D
from skein.operators import sampling as S
from skein.plans.evaluation_queries import _C, _H, _P, _POST, _WHI, _WLO, _hits, _preds, _votes
from skein.plans.retrieval_queries import _dense, _labelled, _vectors
from skein.plans.sampling_queries import _G, _key, golden_once
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


#: the scores of two judges, by draft length b and id
_MARKS = {
    1: {"addresses": "b % 3", "grounded": "(b + id) % 3", "safe": "CASE WHEN b % 5 = 0 THEN 1 ELSE 2 END", "tone": "id % 3"},
    2: {"addresses": "(b + id % 2) % 3", "grounded": "(b + id) % 3", "safe": "CASE WHEN b % 4 = 0 THEN 0 ELSE 2 END", "tone": "(id + b % 2) % 3"},
}
_DIMS = J.DIMENSIONS


def _responses(spark, sf_dir, judge=1):
    d = table(spark, sf_dir, "drafts").where("id is not null and drafter is not null").groupBy("id", "drafter").agg(F.min("text").alias("text"), F.max(F.coalesce("error", F.lit(""))).alias("error"))
    d = d.withColumn("b", F.coalesce(F.length("text"), F.lit(0)))
    marks = {k: F.expr(v) for k, v in _MARKS[judge].items()}
    js = F.to_json(F.struct(*(v.cast("int").alias(k) for k, v in marks.items())))
    bad = F.when(F.col("id") % 17 == 0, "I cannot say").when(F.col("id") % 19 == 0, F.concat(F.lit('{"safe": '), marks["safe"].cast("string"), F.lit("}"))).when(F.col("id") % 23 == 0, F.regexp_replace(js, r'"tone":\d', '"tone":7'))
    response = F.coalesce(bad, F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).otherwise(F.concat(F.lit("Scores: "), js)))
    return d.select(F.col("id").alias("item"), F.col("drafter").alias("arm"), F.col("text").alias("draft"), "error", response.alias("response"))


def _scores(spark, sf_dir, judge=1):
    return J.scored(_responses(spark, sf_dir, judge))


def _s(name: str, judge: int) -> str:
    failed = "(trim(coalesce(text, '')) <> '' AND (error <> '' OR id % 17 = 0 OR id % 19 = 0 OR id % 23 = 0))"
    cols = ", ".join(f"CASE WHEN trim(coalesce(text, '')) = '' THEN 0 WHEN NOT {failed} THEN ({v})::INT END AS {k}" for k, v in _MARKS[judge].items())
    return f"""{name} AS (SELECT item, arm, draft, addresses, grounded, safe, tone, failed, safe >= 2 AND grounded >= 2 AND addresses >= 1 AS ok, addresses + grounded + safe + tone AS total FROM (
SELECT id AS item, drafter AS arm, text AS draft, {cols}, {failed} AS failed FROM (SELECT id, drafter, min(text) AS text, max(coalesce(error, '')) AS error, coalesce(length(min(text)), 0) AS b FROM drafts WHERE id IS NOT NULL AND drafter IS NOT NULL GROUP BY ALL)))"""


@query(f"WITH {_s('s', 1)} SELECT item, arm, addresses, grounded, safe, tone, failed FROM s")
def judge_scores(spark, sf_dir):
    return _scores(spark, sf_dir).drop("draft")


_GAP = "coalesce(regexp_matches(regexp_replace(draft, '^\\s*(?:<user>\\s*)+', ''), '<(?:user|url|email|flight|ref|phone|num)>'), false)"


def _interval(k: str, n: str, name: str) -> str:
    lo, hi = (x.replace("support", n).replace("tp", k) for x in (_WLO, _WHI))
    return f"CASE WHEN {n} = 0 THEN 0 ELSE {lo} END AS {name}_lo, CASE WHEN {n} = 0 THEN 0 ELSE {hi} END AS {name}_hi"


@query(f"""WITH {_s('s', 1)}, g AS (SELECT arm, count(*) AS n, count(*) FILTER (trim(coalesce(draft, '')) <> '') AS valid, count(*) FILTER (NOT failed) AS judged, sum(total) FILTER (NOT failed) AS t, count(*) FILTER (NOT failed AND ok) AS sendable,
 count(*) FILTER ({_GAP}) AS placeholders, count(*) FILTER (NOT failed AND ok AND NOT {_GAP}) AS as_is, sum(addresses) AS da, sum(grounded) AS dg, sum(safe) AS ds, sum(tone) AS dt FROM s GROUP BY arm)
SELECT arm, n, valid, judged, round(t / judged::DOUBLE, 6) AS mean_total, sendable, {_interval('sendable', 'judged', 'sendable')}, placeholders, as_is, {_interval('as_is', 'judged', 'as_is')},
 round(da / judged::DOUBLE, 6) AS mean_addresses, round(dg / judged::DOUBLE, 6) AS mean_grounded, round(ds / judged::DOUBLE, 6) AS mean_safe, round(dt / judged::DOUBLE, 6) AS mean_tone FROM g""")
def judged_arms(spark, sf_dir):
    return J.arms(_scores(spark, sf_dir))


_PAIR = """, ab AS (SELECT x.item, x.ok AS a, y.ok AS b FROM s x JOIN s y ON x.item = y.item AND x.arm = 'grounded_llm' AND y.arm = 'nearest' AND NOT x.failed AND NOT y.failed), m AS (SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM ab)"""
_BINOM = "round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(least(a_only, b_only) + 1), lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0::DOUBLE))))) END, 6)"


@query(f"""WITH {_s('s', 1)}{_PAIR} SELECT "both", a_only, b_only, neither, {_BINOM} AS p FROM m""")
def mcnemar_arms(spark, sf_dir):
    """Grounded drafts against the nearest reply, by whether they can be sent."""
    both = J.side_by_side(_scores(spark, sf_dir), "grounded_llm", "nearest")
    c = E.paired_counts(both.select(F.col("a_ok").alias("a"), F.col("b_ok").alias("b")))
    return c.withColumn("p", F.round(J.sign_p(F.least("a_only", "b_only"), F.col("a_only") + F.col("b_only")), 6))


@query()
def compared_arms(spark, sf_dir):
    """McNemar's and Wilcoxon's tests of grounded drafts against two rivals, on each dimension."""
    return J.compared(_scores(spark, sf_dir), "grounded_llm", ["nearest", "ungrounded_llm"])


@query(f"""WITH {_s('s', 1)}, {_s('o', 2)}, j AS (SELECT arm, s.total AS own, o.total AS other FROM s JOIN o USING (item, arm) WHERE NOT s.failed AND NOT o.failed)
SELECT arm, count(*) AS n, round(sum(own) / count(*)::DOUBLE, 6) AS own, round(sum(other) / count(*)::DOUBLE, 6) AS other, count(*) FILTER (own > other) AS up, count(*) FILTER (own = other) AS same, count(*) FILTER (own < other) AS down, round((sum(own) - sum(other)) / count(*)::DOUBLE, 6) AS inflation FROM j GROUP BY arm""")
def self_preference(spark, sf_dir):
    return J.self_preference(_scores(spark, sf_dir), _scores(spark, sf_dir, 2))


@query(f"""WITH {_s('s', 1)}, {_s('o', 2)} SELECT item, arm, abs(s.addresses - o.addresses) + abs(s.grounded - o.grounded) + abs(s.safe - o.safe) + abs(s.tone - o.tone) AS apart FROM s JOIN o USING (item, arm)
WHERE NOT s.failed AND NOT o.failed AND abs(s.addresses - o.addresses) + abs(s.grounded - o.grounded) + abs(s.safe - o.safe) + abs(s.tone - o.tone) >= 3""")
def judges_far_apart(spark, sf_dir):
    return J.far_apart(_scores(spark, sf_dir), _scores(spark, sf_dir, 2))


_AGREE = " UNION ALL ".join(f"SELECT '{d}' AS measure, s.{c}::INT AS a, o.{c}::INT AS b FROM s JOIN o USING (item, arm) WHERE NOT s.failed AND NOT o.failed" for d, c in [*((d, d) for d in _DIMS), ("sendable", "ok")])


@query(f"""WITH {_s('s', 1)}, {_s('o', 2)}, r AS ({_AGREE}), t AS (SELECT measure, count(*)::DOUBLE AS t, count(*) FILTER (a = b) AS same, count(*) FILTER (abs(a - b) <= 1) AS near, sum((a - b) * (a - b)) AS o FROM r GROUP BY measure),
m AS (SELECT measure, x, sum(na) AS na, sum(nb) AS nb FROM (SELECT measure, a AS x, 1 AS na, 0 AS nb FROM r UNION ALL SELECT measure, b, 0, 1 FROM r) GROUP BY ALL),
e AS (SELECT p.measure, sum((p.x - q.x) * (p.x - q.x) * p.na * q.nb::DOUBLE) AS e FROM m p JOIN m q ON p.measure = q.measure GROUP BY p.measure),
k AS (SELECT measure, sum(na / t * nb / t) AS pe, CASE WHEN count(*) > 1 THEN sum((na + nb) / t / 2 * (1 - (na + nb) / t / 2)) / (count(*) - 1) ELSE 0 END AS g, count(*) AS q FROM m JOIN t USING (measure) GROUP BY measure)
SELECT measure, t::BIGINT AS n, round(same / t, 6) AS exact, round(near / t, 6) AS within_one, round(CASE WHEN pe >= 1 THEN 1 ELSE (same / t - pe) / (1 - pe) END, 5) AS kappa, round(CASE WHEN coalesce(e, 0) = 0 THEN 1 ELSE 1 - o * t / e END, 6) AS weighted_kappa, round(CASE WHEN q <= 1 THEN 1 ELSE (same / t - g) / (1 - g) END, 5) AS ac1 FROM t JOIN e USING (measure) JOIN k USING (measure)""")
def judge_agreement(spark, sf_dir):
    return J.agreement_rows(_scores(spark, sf_dir), _scores(spark, sf_dir, 2))


@query(f"SELECT drafter AS arm, doc_id, (row_number() OVER (PARTITION BY drafter, id ORDER BY {_key('evidence', 'n', 'doc_id')}, doc_id))::INT AS place, id FROM (SELECT DISTINCT drafter, id, doc_id, length(text) AS n FROM (SELECT id, drafter, min(text) AS text FROM drafts GROUP BY ALL) JOIN (SELECT DISTINCT qid AS id, doc_id FROM hits WHERE trim(coalesce(reply, '')) <> '') USING (id))")
def judge_evidence(spark, sf_dir):
    """The order in which a judge sees the evidence of each draft."""
    d = table(spark, sf_dir, "drafts").groupBy("id", "drafter").agg(F.min("text").alias("text"))
    h = table(spark, sf_dir, "hits").where("trim(coalesce(reply, '')) <> ''").select(F.col("qid").alias("id"), "doc_id").distinct()
    w = E.Window.partitionBy("drafter", "id").orderBy(J.evidence_order("evidence", F.col("text"), F.col("doc_id")), "doc_id")
    return d.join(h, "id").select(F.col("drafter").alias("arm"), "doc_id", F.row_number().over(w).alias("place"), "id")


# ---- decisions

_DEC = _P + ", d AS (SELECT id, coalesce(y = pred, false) AS correct, weight >= 1.2::DOUBLE AS auto, pred FROM p)"


def _decisions(spark, sf_dir):
    return _preds(spark, sf_dir).select("id", F.coalesce(F.col("y") == F.col("pred"), F.lit(False)).alias("correct"), (F.col("weight") >= 1.2).alias("auto"), "pred", F.lit("low_confidence").alias("reason"))


@query(_DEC + f""", g AS (SELECT count(*) AS n, count(*) FILTER (auto) AS n_auto, count(*) FILTER (auto AND NOT correct) AS auto_wrong, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT auto AND NOT correct) AS caught FROM d)
SELECT n, n_auto, round(n_auto / n::DOUBLE, 6) AS coverage, auto_wrong, round(auto_wrong / n_auto::DOUBLE, 6) AS error, {_interval('auto_wrong', 'n_auto', 'error')}, errors, caught, round((n - n_auto) / n::DOUBLE * errors, 6) AS caught_at_random FROM g""")
def routing_summary(spark, sf_dir):
    return D.summary(_decisions(spark, sf_dir))


@query(_DEC + "SELECT 'low_confidence' AS reason, count(*) AS n FROM d WHERE NOT auto")
def routing_reasons(spark, sf_dir):
    return D.reasons(_decisions(spark, sf_dir))


@query(_DEC + """, g AS (SELECT id % 5 AS rep, count(*) AS n, count(*) FILTER (auto) AS k, count(*) FILTER (auto AND NOT correct) AS w FROM d GROUP BY 1), s AS (SELECT k / n::DOUBLE AS c, w / nullif(k, 0)::DOUBLE AS e FROM g)
SELECT count(*) AS repeats, round(min(c), 6) AS coverage_min, round(max(c), 6) AS coverage_max, round(avg(c), 6) AS coverage_mean, round(stddev_pop(c), 6) AS coverage_sd, round(min(e), 6) AS error_min, round(max(e), 6) AS error_max, round(avg(e), 6) AS error_mean, round(stddev_pop(e), 6) AS error_sd FROM s""")
def routing_spread(spark, sf_dir):
    """Coverage and error over five parts of the messages."""
    return D.spread_over(_decisions(spark, sf_dir).withColumn("rep", F.col("id") % 5))


@query(_DEC + "SELECT pred, count(*) AS n, count(*) FILTER (auto) AS n_auto, count(*) FILTER (auto AND NOT correct) AS auto_wrong FROM d WHERE pred IN (SELECT id FROM taxonomy WHERE letter IN ('A', 'B', 'C')) GROUP BY pred")
def routing_within(spark, sf_dir):
    names = [r["id"] for r in table(spark, sf_dir, "taxonomy").where("letter in ('A', 'B', 'C')").collect()]  # ten rows at most
    return D.within(_decisions(spark, sf_dir), "pred", names)


@query(_POST.rsplit(", z AS", 1)[0] + ", r AS (SELECT qid AS id, intent AS label, round(p, 6) AS p, (row_number() OVER (PARTITION BY qid ORDER BY p DESC, intent))::INT AS rank FROM q) SELECT * FROM r WHERE rank <= 3")
def posterior_top3(spark, sf_dir):
    v = _votes(spark, sf_dir).groupBy("qid", "intent").agg(F.round(F.sum("score"), 9).alias("w"))
    p = v.select(F.col("qid").alias("id"), F.col("intent").alias("label"), (F.col("w") / F.sum("w").over(E.Window.partitionBy("qid"))).alias("p"))
    return Q.top_of(p).withColumn("p", F.round("p", 6))


# ---- a look at tables


@query("WITH c AS (SELECT intent, drafter AS value, count(*) AS n FROM drafts WHERE drafter IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, (row_number() OVER (PARTITION BY intent ORDER BY n DESC, value))::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 2")
def common_drafters(spark, sf_dir):
    return Q.most_common(table(spark, sf_dir, "drafts"), "intent", "drafter", 2).withColumnRenamed("drafter", "value")


@query("WITH c AS (SELECT count(*) AS n FROM golden WHERE intent IS NOT NULL GROUP BY intent) SELECT list(n ORDER BY n DESC) AS sizes, count(*) AS classes, min(n) AS least, max(n) AS most FROM c")
def class_sizes(spark, sf_dir):
    return Q.sizes(table(spark, sf_dir, "golden"), "intent")


@query("""WITH x AS (SELECT lang, length(customer_text)::DOUBLE AS a, n_reply_parts::DOUBLE AS b FROM exchanges WHERE customer_text IS NOT NULL AND n_reply_parts IS NOT NULL)
SELECT lang, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 5) AS r FROM x GROUP BY lang""")
def length_correlation(spark, sf_dir):
    return table(spark, sf_dir, "exchanges").where("customer_text is not null and n_reply_parts is not null").groupBy("lang").agg(F.round(Q.pearson(F.length("customer_text"), F.col("n_reply_parts")), 5).alias("r"))


@query("""SELECT drafter, count(length(text)) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS sd, round(var_samp(length(text)), 6) AS variance, min(length(text))::DOUBLE AS least, max(length(text))::DOUBLE AS most FROM drafts GROUP BY drafter""")
def length_spread(spark, sf_dir):
    return Q.spread_of(table(spark, sf_dir, "drafts").withColumn("chars", F.length("text")), "chars", "drafter")


@query("""SELECT count(*) AS calls, count(*) FILTER (NOT coalesce(cached, false)) AS live, round(avg(length(text)) FILTER (NOT coalesce(cached, false)), 6) AS mean_chars FROM drafts""")
def per_call(spark, sf_dir):
    return Q.per_call(table(spark, sf_dir, "drafts").withColumn("chars", F.length("text")), "chars")


@query("""WITH a AS (SELECT DISTINCT id AS k FROM golden WHERE id IS NOT NULL), b AS (SELECT DISTINCT qid AS k FROM hits WHERE qid IS NOT NULL)
SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS common, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM a ANTI JOIN b USING (k)) = 0 AS subset""")
def id_sets(spark, sf_dir):
    return Q.compared_sets(table(spark, sf_dir, "golden").select("id"), table(spark, sf_dir, "hits").select(F.col("qid").alias("id")), "id")


@query("SELECT DISTINCT intent FROM (SELECT intent FROM golden UNION SELECT intent FROM hits UNION SELECT id FROM taxonomy) WHERE intent IS NOT NULL")
def all_labels(spark, sf_dir):
    pick = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("intent"))
    return pick("golden", "intent").unionAll(pick("hits", "intent")).unionAll(pick("taxonomy", "id")).where("intent is not null").distinct()


@query("SELECT id, text FROM golden WHERE intent IS NULL AND text IS NOT NULL AND id NOT IN (SELECT id FROM golden WHERE intent IS NOT NULL AND id IS NOT NULL)")
def unlabelled(spark, sf_dir):
    g = table(spark, sf_dir, "golden")
    return g.where("intent is null and text is not null").select("id", "text").join(g.where("intent is not null").select("id"), "id", "left_anti").where("id is not null")


@query("SELECT id, intent, stratum FROM golden WHERE intent IN (SELECT id FROM taxonomy WHERE letter IN ('A', 'D')) AND NOT coalesce(ambiguous, false)")
def membership_masks(spark, sf_dir):
    names = [r["id"] for r in table(spark, sf_dir, "taxonomy").where("letter in ('A', 'D')").collect()]  # ten rows at most
    return table(spark, sf_dir, "golden").where(F.col("intent").isin(*names) & ~F.coalesce("ambiguous", F.lit(False))).select("id", "intent", "stratum")


@query("SELECT customer_tweet_id, thread_id FROM exchanges WHERE customer_tweet_id IS NOT NULL ORDER BY customer_tweet_id, thread_id NULLS FIRST LIMIT 21")
def asked_sql(spark, sf_dir):
    return Q.ask(spark, "SELECT customer_tweet_id, thread_id FROM e WHERE customer_tweet_id IS NOT NULL ORDER BY customer_tweet_id, thread_id", e=table(spark, sf_dir, "exchanges"))


@query("""WITH x AS (SELECT tweet_id, max(text) AS text FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20)
SELECT tweet_id::VARCHAR AS tweet_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS text, true AS _more FROM x""")
def capped_rows(spark, sf_dir):
    t = table(spark, sf_dir, "twcs").where("tweet_id is not null").groupBy("tweet_id").agg(F.max("text").alias("text")).orderBy("tweet_id").limit(21)
    return Q.capped(t, 20, 40)


# ---- text


@query("SELECT tweet_id, coalesce(regexp_matches(text, '(?i)\\b(?:dm|direct message|private message)\\b'), false) AS old FROM twcs")
def old_private_channel(spark, sf_dir):
    return table(spark, sf_dir, "twcs").select("tweet_id", T.old_private_channel(F.col("text")).alias("old"))


@query("""SELECT id, drafter, coalesce(regexp_matches(text, '(?i)^\\s*(?:okay|ok|alright|let me|let''s|first,|the user|we need to|i need to|i should|hmm|so,? the)\\b') OR contains(text, '</think>'), false) AS leak FROM drafts""")
def reasoning_leaks(spark, sf_dir):
    return table(spark, sf_dir, "drafts").select("id", "drafter", T.looks_like_reasoning(F.col("text")).alias("leak"))


@query("""SELECT id, drafter, sha256('m1|-|' || coalesce(text, '')) AS embedding_key, substr(sha256(coalesce(drafter, '') || chr(10) || coalesce(text, '')), 1, 10) AS item FROM drafts""")
def text_keys(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "drafts").select("id", "drafter", embedding_key("m1", None, t).alias("embedding_key"), item_hash(F.col("drafter"), F.col("text")).alias("item"))


@query("""SELECT id, drafter, CASE WHEN coalesce(error, '') <> '' THEN 'api: ' || error WHEN trim(coalesce(text, '')) = '' THEN 'empty completion' WHEN regexp_matches(text, '(?i)^\\s*(?:okay|ok|alright|let me|let''s|first,|the user|we need to|i need to|i should|hmm|so,? the)\\b') OR contains(text, '</think>') THEN 'reasoning leak' WHEN id % 7 = 0 THEN 'truncated' ELSE '' END AS why FROM drafts""")
def completion_checks(spark, sf_dir):
    """Why a replayed completion cannot be used; every seventh is taken as stopped by its length."""
    d = table(spark, sf_dir, "drafts")
    return d.select("id", "drafter", P.completion(F.col("text"), F.col("error"), F.when(F.col("id") % 7 == 0, "length").otherwise("stop"))[1].alias("why"))


@query("""WITH x AS (SELECT id, drafter, text, (id % 10)::INT AS k, CASE WHEN id % 3 = 0 THEN 0.9::DOUBLE WHEN id % 3 = 1 THEN 0.3::DOUBLE END AS p FROM drafts WHERE id IS NOT NULL)
SELECT id, drafter, CASE WHEN p = 0.9 THEN chr(65 + k) WHEN id % 2 = 0 THEN chr(65 + k) END AS letter, round(CASE WHEN p = 0.9 THEN 0.9::DOUBLE / 0.95 WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END, 6) AS confidence FROM x""")
def letter_choices(spark, sf_dir):
    """Option letters read from made-up first-token probabilities, or from the answer where those are too small or missing."""
    d = table(spark, sf_dir, "drafts").where("id is not null").withColumn("l", F.expr("char(65 + cast(id % 10 as int))")).withColumn("o", F.expr("char(65 + cast((id + 1) % 10 as int))"))
    p = F.when(F.col("id") % 3 == 0, 0.9).when(F.col("id") % 3 == 1, 0.3)
    logs = F.when(p.isNotNull(), F.create_map(F.col("l"), F.ln(p), F.lit("?"), F.ln(F.lit(0.001)), F.col("o"), F.ln(F.lit(0.05))))
    answer = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" ("), F.col("l"), F.lit(")."))).otherwise("no idea")
    c = P.letter_choice(answer, logs, "ABCDEFGHIJ")
    return d.select("id", "drafter", c["letter"].alias("letter"), F.round(c["confidence"], 6).alias("confidence"))


@query(f"""WITH {_H}, e AS (SELECT qid, rank, text, intent FROM (SELECT qid, rank, min(text) AS text, min(intent) AS intent FROM hits WHERE text IS NOT NULL AND intent IS NOT NULL GROUP BY ALL))
SELECT qid, array_to_string(list(text || ' -> ' || intent ORDER BY rank DESC), chr(10)) AS examples FROM e GROUP BY qid""")
def few_shot_prompts(spark, sf_dir):
    """Labelled neighbours as lines of a prompt, the most similar last."""
    h = table(spark, sf_dir, "hits").where("text is not null and intent is not null").groupBy("qid", "rank").agg(F.min("text").alias("text"), F.min("intent").alias("label"))
    e = h.groupBy("qid").agg(F.collect_list(F.struct("text", "label", (-F.col("rank")).alias("score"))).alias("e"))
    return e.select("qid", T.few_shot(F.col("e")).alias("examples"))


# ---- retrieval and classes


@query("WITH c AS (SELECT count(*) AS n FROM embeddings GROUP BY label) SELECT round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS chance, sum(n)::BIGINT AS n FROM c")
def chance_level(spark, sf_dir):
    return R.chance_level(_vectors(spark, sf_dir), "label")


@query("SELECT count(*) AS queries, round(avg(score), 6) AS mean_top1 FROM (SELECT qid, min(score) AS score FROM hits WHERE rank = 1 GROUP BY qid)")
def mean_top1(spark, sf_dir):
    return R.mean_top(_hits(spark, sf_dir).where("rank = 1").groupBy("qid", "rank").agg(F.min("score").alias("score")))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), l AS (SELECT label::VARCHAR AS label, v AS lv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM e) WHERE n = 1),
s AS (SELECT id, l.label, round(list_dot_product(v, lv), 6) AS score FROM e, l) SELECT id, label AS pred, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS n FROM s) WHERE n = 1""")
def label_similarity(spark, sf_dir):
    """The label whose vector, here that of its first row, is most like each row's."""
    v = _labelled(spark, sf_dir)
    first = v.groupBy("y").agg(F.min(F.struct("id", "vector")).alias("f")).select(F.col("y").alias("label"), F.col("f.vector").alias("vector"))
    return R.by_label_text(v, first)


@query()
def near_duplicate_vectors(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.near_duplicates(v.select(F.col("vec_id").alias("id"), "vector"))


@query()
def repeated_cv(spark, sf_dir):
    """Macro-F1 of five repeats of five-fold centroids, each with folds of its own."""
    v = _labelled(spark, sf_dir)

    def predict(rows, rep):
        f = S.stratified_folds(rows, "y", "id", 5, rep)
        return C.reduce(lambda a, b: a.unionAll(b), (C.by_centroid(f.where(F.col("fold") != i).drop("fold"), f.where(F.col("fold") == i).drop("fold")) for i in range(5)))

    return C.macro_f1_by(C.repeated(v, predict), "rep")


@query()
def nested_cv(spark, sf_dir):
    """How often centroids, five and fifteen neighbours win the inner folds."""
    return C.nested(_labelled(spark, sf_dir), {"centroid": C.by_centroid, "knn5": C.by_neighbours(5), "knn15_weighted": C.by_neighbours(15, True)}, 3, 3)[1]


@query()
def challenger_heads(spark, sf_dir):
    """Macro-F1 of two heads, out of fold."""
    v = _labelled(spark, sf_dir)
    classes, width = v.select("y").distinct().count(), len(v.first()["vector"])
    h = C.heads(classes, width)
    p = [C.oof(v, h[n], 3).select(F.lit(n).alias("head"), "y", "pred") for n in ("logistic_pca32", "trees")]
    return C.macro_f1_by(C.reduce(lambda a, b: a.unionAll(b), p), "head")


@query()
def confusable_classes(spark, sf_dir):
    """The five classes that are easiest to confuse, by the cosines of their centroids."""
    from skein.plans.retrieval_queries import centroid_cosine

    return spark.createDataFrame([(i + 1, str(x)) for i, x in enumerate(C.confusable(centroid_cosine(spark, sf_dir), 5))], "place int, label string")


@query()
def cluster_terms(spark, sf_dir):
    """Vectors' clusters with the terms and first texts of documents of the same id."""
    v = _labelled(spark, sf_dir)
    return C.cluster_profile(C.clusters(v, 10), table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"]))


_CORPUS = f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY {_key('corpus', 'customer_tweet_id')}, customer_tweet_id) AS n FROM (SELECT DISTINCT customer_tweet_id, thread_id, brand_clean FROM exchanges WHERE split = 'train' AND coalesce(length(brand_clean), 0) >= 60
 AND NOT regexp_matches(brand_clean, '(?i)\\b(?:d\\.?m\\.?s?|direct messages?|private messages?|pm us|inbox us)\\b')))
SELECT customer_tweet_id, thread_id FROM k WHERE n = 1 OR thread_id IS NULL ORDER BY {_key('corpus', 'customer_tweet_id')}, customer_tweet_id LIMIT 300"""


@query(_CORPUS)
def reply_corpus(spark, sf_dir):
    """300 train replies, one a thread: the corpus that drafts are grounded in."""
    e = table(spark, sf_dir, "exchanges").select("customer_tweet_id", "thread_id", "split", "brand_clean").distinct()
    return S.reply_corpus(e, 300).select("customer_tweet_id", "thread_id")

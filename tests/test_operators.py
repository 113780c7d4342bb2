"""Core operators on small literal tables, and every SQL-checked query on the smallest data."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.functions import stats
from skein.functions import text as T
from skein.functions.instants import instant
from skein.operators import evaluation as E
from skein.operators import exchanges as X
from skein.operators import replay as P
from skein.operators import retrieval as R
from skein.operators import sampling as S

SF = "/root/testdata/sf0.001"


def one(df, col):
    return [r[col] for r in df.collect()]


def test_instants(spark):
    rows = [("Fri Apr 01 00:06:50 +0000 2022",), ("Fri Apr 01 08:06:50 +0800 2022",), ("2022-04-01T00:06:50Z",), ("2022-04-01 02:06:50+02:00",), ("NaT",), ("",), (None,), ("0000-00-00 00:00:00",)]
    got = one(spark.createDataFrame(rows, "t string").select(instant(F.col("t")).alias("s")), "s")
    assert got == [1648771610] * 4 + [None] * 4


def test_text_functions(spark):
    df = spark.createDataFrame([("bag missing *AOS 1/2",), ("we can help ^QJ",), ("no signature here",), (None,)], "t string")
    assert one(df.select(T.strip_signature(T.strip_signature(F.col("t"))).alias("x")), "x") == ["bag missing", "we can help", "no signature here", None]
    df = spark.createDataFrame([("case 0012345678",), ("call 800-555-1234",), ("@a AA 1234 ABC12X https://t.example/x",)], "t string")
    assert one(df.select(T.clean(F.col("t")).alias("x")), "x") == ["case <num>", "call <phone>", "<user> <flight> <ref> <url>"]
    df = spark.createDataFrame([("<user> <user> hi",), ("call <phone>",), ("ok <user> there",)], "t string")
    assert one(df.select(T.has_placeholder(F.col("t")).alias("x")), "x") == [False, True, True]
    df = spark.createDataFrame([("send DMs",), ("a D.M. please",), ("direct message",), ("admin",), (None,)], "t string")
    assert one(df.select(T.private_channel(F.col("t")).alias("x")), "x") == [True, True, True, False, False]


def test_exchanges_merge_split_replies(spark):
    at = "Fri Apr 01 00:0{}:00 +0000 2022"
    rows = [
        (1, "7", True, at.format(1), "help", None), (1, "7", True, at.format(1), "hel", None), (2, "B", False, at.format(4), "second ^AB 2/2", 1), (3, "B", False, at.format(3), "first *AB 1/2", 1),
        (4, "B", False, None, "late", 1), (5, "B", False, at.format(5), "lost", 99), (6, "8", None, at.format(5), "unknown side", None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "tweet_id long, author_id string, inbound boolean, created_at string, text string, in_response_to_tweet_id long")
    (r,) = X.exchanges(df).collect()
    assert (r["brand_text"], r["brand_tweet_ids"], r["n_reply_parts"], r["response_minutes"], r["is_first_contact"], r["customer_text"]) == ("first second late", [3, 2, 4], 3, 2.0, True, "help")
    assert X.exchanges(df.limit(0)).count() == 0


def test_filter_counts_add_up(spark):
    rows = [("en", "x" * 20, "y" * 30, 1.0), ("es", "x", "y", 1.0), ("en", "x", "y" * 30, 1.0), ("en", "x" * 20, "y" * 30, -1.0), (None, None, None, None)]
    got = {r["reason"]: r["n"] for r in X.filter_counts(spark.createDataFrame(rows, "lang string, customer_clean string, brand_clean string, response_minutes double")).collect()}
    assert got == {"kept": 1, "other_language": 2, "too_short": 1, "negative_latency": 1}


def test_split_is_stable_when_threads_are_added(spark):
    a = spark.range(50).select(F.col("id").alias("t")).withColumn("s", S.thread_split(F.col("t")))
    b = spark.range(80).select(F.col("id").alias("t")).withColumn("s", S.thread_split(F.col("t")))
    assert a.join(b.withColumnRenamed("s", "s2"), "t").where("s <> s2").count() == 0
    folds = S.stratified_folds(spark.range(100).select("id", (F.col("id") % 2).alias("y")), "y", "id").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}


def test_statistics():
    assert stats.binomial_two_sided(0, 0) == 1.0 and math.isclose(stats.binomial_two_sided(1, 10), 22 / 1024)
    assert math.isclose(stats.fisher_two_sided(3, 1, 1, 3), 0.485714, abs_tol=1e-5)
    assert math.isclose(stats.student_two_sided(2.0, 10), 0.073388, abs_tol=1e-5)
    mean, t, p = stats.corrected_resampled_t([0.1, 0.2, 0.3, 0.1, 0.3], 174, 44)
    assert math.isclose(t, 0.2 / math.sqrt((1 / 5 + 44 / 174) * 0.01)) and 0 < p < 1
    assert stats.corrected_resampled_t([0.0, 0.0], 10, 5)[2] == 1.0


def test_wilson_and_agreement(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 3), (3, 3), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert all(0 <= r["lo"] <= r["hi"] <= 1 for r in rows) and tuple(rows[2]) == (0.0, 0.0)
    pairs = [("y", "y")] * 38 + [("y", "n"), ("n", "y"), (None, "y")]
    (r,) = E.agreement(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert r["n"] == 40 and r["kappa"] < 0 and math.isclose(r["ac1"], (0.95 - 0.04875) / (1 - 0.04875), abs_tol=1e-5)


def test_scores(spark):
    preds = spark.createDataFrame([(i, "a", "a") for i in range(90)] + [(100 + i, "b", "a") for i in range(10)], "id int, y string, pred string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    (s,) = E.summary(preds, labels).collect()
    assert s["n"] == 100 and s["accuracy"] == 0.9 and s["macro_f1"] < 0.5
    assert E.summary(preds.limit(0), labels).first()["accuracy"] is None
    (w,) = E.signed_ranks(spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (3.0, 1.0), (2.0, 2.0)], "a double, b double")).collect()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (3, 4.5, 1.5)


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "lost bag in town"), (2, "seat and meal"), (3, "bag bag bag"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "lost bag"), (10, "zzz"), (11, None)], "qid long, query string")
    got = R.bm25(docs, q, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 3]
    assert [r["doc_id"] for r in R.fuse([R.bm25(docs, q, 5), R.tfidf(docs, q, 5)], 1).collect()] == [1]


def ranking_tables(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randint(1, 9))) for i in range(3000)] + [(3000, "w0"), (3000, "w0 w1 b")], "doc_id long, text string")
    q = spark.createDataFrame([(i, text(rng.randint(1, 6))) for i in range(60)] + [(60, "w0"), (61, "b")], "qid long, query string")
    return docs, q, R.postings(docs, "doc_id", "text"), R.query_terms(q, "qid", "query")


def ranks_as_joined(ranker, docs, q, x, w, monkeypatch):
    """Whether a ranker gives what a join of (qid, term, x) with (doc_id, term, w) does, in one block and in many."""
    rows = lambda d: sorted(d.select("qid", "rank", "doc_id", "score").collect())
    want = rows(R.top_k(x.join(w, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("x") * F.col("w")), 6).alias("score")), 7))
    got = ranker(docs, q, 7)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # pairs are scored in the tasks
    assert rows(got) == want
    for name, value in {"CELLS": 2000, "COLUMNS": 50, "QUERY_VECTORS": 20, "TASK_DOCS": 300, "DENSE": 4}.items():
        monkeypatch.setattr(R, name, value)
    assert rows(ranker(docs, q, 7)) == want
    assert ranker(docs, q.limit(0), 7).count() == ranker(docs.limit(0), q, 7).count() == 0


def test_bm25_keeps_pairs_in_a_task(spark, monkeypatch):
    docs, q, post, terms = ranking_tables(spark)
    assert post.where("doc_id = 3000 and term = 'w0'").select("tf").collect() == [(2,)]
    n, al, df = docs.count(), docs.agg(F.avg(F.size(F.split("text", " ")))).first()[0], R.term_stats(post)
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = post.join(df, "term").select("doc_id", "term", (F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / al)) * idf).alias("w"))
    ranks_as_joined(R.bm25, docs, q, terms.withColumnRenamed("qtf", "x"), w, monkeypatch)


def test_tfidf_keeps_pairs_in_a_task(spark, monkeypatch):
    docs, q, post, terms = ranking_tables(spark)
    df = R.term_stats(post)
    idf = F.ln((1 + F.lit(float(docs.count()))) / (1 + F.col("df"))) + 1
    w = post.where("length(term) > 1").join(df, "term").select("doc_id", "term", ((1 + F.ln("tf")) * idf).alias("w"))
    w = w.join(w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")), "doc_id").select("doc_id", "term", (F.col("w") / F.col("n")).alias("w"))
    x = terms.where("length(term) > 1").join(df, "term").select("qid", "term", ((1 + F.ln("qtf")) * idf).alias("x"))
    x = x.join(x.groupBy("qid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n")), "qid").select("qid", "term", (F.col("x") / F.col("n")).alias("x"))
    ranks_as_joined(R.tfidf, docs, q, x, w, monkeypatch)


def test_rrf_fuses_lists_scored_in_tasks(spark):
    plan = entry.queries()["rrf_top5"](spark, SF.replace("sf0.001", "sf0.01"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_fused_lists_share_an_index_and_move_few_candidates(spark, monkeypatch):
    docs, q, post, _ = ranking_tables(spark)
    x = R.indexed(docs)
    assert x.docs.count() == 3001 and sorted(x.docs.selectExpr("doc_id", "inline(arrays_zip(term, tf))").collect()) == sorted(post.select("doc_id", "term", "tf").collect())
    rows = lambda d: sorted(d.select("qid", "rank", "doc_id", "score").collect())
    want = [rows(r(docs, q, 50)) for r in (R.bm25, R.tfidf)]
    assert [rows(r(x, q, 50)) for r in (R.bm25, R.tfidf)] == want
    monkeypatch.setattr(R, "VOCABULARY", 1)  # lengths are joined
    assert rows(R.tfidf(x, q, 50)) == want[1]
    monkeypatch.setattr(R, "top_k", lambda scores, k: scores)
    tasks = 2 * spark.sparkContext.defaultParallelism
    for ranker in (R.bm25, R.tfidf):
        assert ranker(docs, q, 50).count() <= (math.isqrt(tasks - 1) + 1) * 50 * q.count()  # not `tasks` parts a query


def test_dense_excludes_self_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "doc_id long, vector array<double>")
    got = R.dense(v, v.withColumnRenamed("doc_id", "qid"), 2).where("qid = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [3, 2]


def test_replay(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so {"a": {"b": 2}} indeed',), ("plain",), ('{"a": ',), (None,)], "t string")
    assert one(df.select(P.salvage_json("t").alias("x")), "x") == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None]
    lines = spark.createDataFrame([("s", 1, "=== 3 (ab12) ==="), ("s", 2, "customer: hi"), ("s", 3, "draft:   yo"), ("s", 4, "=== 4 (cd34) ==="), ("s", 5, "customer: x")], "sheet string, line int, value string")
    assert {tuple(r) for r in P.blocks(lines).collect()} == {("s", 3, "ab12", "customer", "hi"), ("s", 3, "ab12", "draft", "yo"), ("s", 4, "cd34", "customer", "x")}
    s = P.score_lines(spark.createDataFrame([("# c",), ("0 3 2 2 2",), ("1 0 1 2 2",)], "value string")).orderBy("idx").collect()
    assert [r["ok"] for r in s] == [False, True]


def test_sweep_and_bootstrap_are_as_large_as_the_reference(spark):
    q = entry.queries()
    assert [r["k"] for r in q["kmeans_sweep"](spark, SF).collect()] == [6, 8, 10, 12, 15, 20, 25, 30]
    assert q["bootstrap_accuracy"](spark, SF).first()["draws"] == 2000


def test_whole_tables_are_counted_and_masked(spark, tmp_path):
    spark.createDataFrame([(1, "Où est mon café n°5 ?"), (2, "plain text"), (3, "荷物 が"), (4, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "café\u00a0😀\nsee https://a.example/x"), (2, "mail jo@mail.example"), (3, None), (4, "é123 niño@mail.example")], "tweet_id long, text string").write.parquet(f"{tmp_path}/twcs.parquet")
    q = entry.queries()
    assert {tuple(r) for r in q["token_counts_unicode"](spark, str(tmp_path)).collect()} == {(1, 6), (2, 2), (3, 2), (4, None), (5, 0)}
    assert {tuple(r) for r in q["mask_shapes"](spark, str(tmp_path)).collect()} == {(1, "café 😀 see <url>"), (2, "mail <email>"), (3, None), (4, "é123 <email>")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


CORE = [n for n in entry.oracle_sql() if n not in ("p5_found",)]


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    norm = lambda v: round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else tuple(v) if isinstance(v, list) else v
    want = sorted(repr(tuple(norm(x[cols.index(c)]) for c in sorted(cols))) for x in r.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(norm(x[c]) for c in sorted(cols))) for x in df.collect()) == want

"""Judged drafts, decisions, replays, looks at tables, significance and classes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions import text as T
from skein.operators import classify as C
from skein.operators import evaluation as E
from skein.operators import explore as Q
from skein.operators import judging as J
from skein.operators import replay as P
from skein.operators import retrieval as R
from skein.operators import routing as D
from skein.sources import files

JUDGED = "item long, arm string, draft string, error string, response string"


def reply(**k):
    return json.dumps({"addresses": 2, "grounded": 2, "safe": 2, "tone": 1} | k)


def test_scores(spark):
    rows = [(1, "a", "d", None, reply()), (2, "a", "", "x", None), (3, "a", "d", "timeout", reply()), (4, "a", "d", "", "none"), (5, "a", "d", "", '{"safe": 2}'), (6, "a", "d", "", reply(tone=3)), (7, "a", None, None, None), (8, "a", "d", None, "```json\n" + reply(safe=1) + "\n```")]
    s = J.scored(spark.createDataFrame(rows, JUDGED).withColumn("extra", F.lit(1)))
    got = {r["item"]: (r["failed"], r["safe"]) for r in s.collect()}
    assert got == {1: (False, 2), 2: (False, 0), 3: (True, None), 4: (True, None), 5: (True, None), 6: (True, None), 7: (False, 0), 8: (False, 1)}
    a = J.arms(s).first()
    assert (a["n"], a["valid"], a["judged"], a["sendable"]) == (8, 6, 4, 1) and a["mean_total"] == (7 + 6) / 4
    assert J.arms(s.limit(0)).count() == 0


def test_paired_arms(spark):
    rows = [(i, arm, "d", None, reply(safe=2 if (i < 9) == (arm == "a") else 1, tone=2 if arm == "a" else i % 2)) for i in range(12) for arm in "ab"]
    s = J.scored(spark.createDataFrame(rows, JUDGED))
    got = {(r["rival"], r["measure"]): r for r in J.compared(s, "a", ["b"]).collect()}
    m = got["b", "sendable"]
    assert (m["up"], m["down"], m["n"]) == (9, 3, 12) and m["p"] == pytest.approx(stats.binomial_two_sided(3, 12), abs=1e-6)
    assert got["b", "addresses"]["p"] == 1.0 and got["b", "tone"]["down"] == 0 and got["b", "tone"]["p"] < 0.01


def test_wilcoxon_p():
    assert stats.wilcoxon_two_sided(0, 0) == 1.0
    assert stats.wilcoxon_two_sided(27.5, 10) == pytest.approx(1.0)
    assert stats.wilcoxon_two_sided(0, 10) == pytest.approx(math.erfc(27.5 / math.sqrt(2 * 96.25)))


def test_bootstrap_covers_and_is_repeatable(spark):
    preds = spark.createDataFrame([(i, "x" if i % 2 else "y", "x" if i % 2 or i % 10 == 0 else "y") for i in range(400)] + [(999, None, "x")], "id long, y string, pred string")
    acc = E.bootstrap(preds, E.table_accuracy, 300).first()
    assert acc["lo"] < 0.9 < acc["hi"] and acc["draws"] == 300 and acc == E.bootstrap(preds.repartition(7), E.table_accuracy, 300).first()
    assert E.bootstrap(preds, E.table_macro_f1, 50).first()["hi"] <= 1 and E.bootstrap(preds.limit(0), E.table_kappa, 50).first()["lo"] is None
    assert E.table_kappa(np.array([[5, 0], [0, 0]])) == 1.0 and E.table_macro_f1(np.array([[5, 0], [5, 0]])) == pytest.approx(1 / 3)


def test_clustered_kappa(spark):
    rows = [(("u", "v")[i % 2], ("u", "v")[(i + (i % 5 == 0)) % 2], i // 4) for i in range(200)] + [(None, "u", 1)]
    df = spark.createDataFrame(rows, "a string, b string, cluster long")
    got = E.clustered_kappa(df, 200).first()
    assert got["lo"] < 0.6 < got["hi"] and got["draws"] == 200
    assert E.clustered_kappa(df.where("cluster = 0"), 20).first()["lo"] is None
    bands = [r[0] for r in spark.createDataFrame([(-0.1,), (0.2,), (0.59,), (0.81,), (None,)], "k double").select(E.kappa_band(F.col("k"))).collect()]
    assert bands == ["poor", "slight", "moderate", "almost perfect", None]


def test_routing(spark):
    d = spark.createDataFrame([(i, i < 6, i % 3 != 0, "r2" if i % 2 else "r1", i % 2) for i in range(10)], "id long, auto boolean, correct boolean, reason string, rep long")
    s = D.summary(d).first()
    assert (s["n"], s["n_auto"], s["auto_wrong"], s["errors"], s["caught"], s["caught_at_random"]) == (10, 6, 2, 4, 2, 1.6)
    assert [tuple(r) for r in D.reasons(d).collect()] == [("r1", 2), ("r2", 2)]
    assert D.spread_over(d).first()["repeats"] == 2 and D.summary(d.limit(0)).first()["n"] == 0
    why = spark.createDataFrame([(0.05, "a", "b"), (0.5, "a", "b"), (None, "a", None)], "c double, x string, y string").select(D.by_threshold(F.col("c"), 0.1, F.col("x"), F.col("y")))
    assert [r[0] for r in why.collect()] == ["confidence 0.05 < 0.10: a or b", None, "confidence 0.00 < 0.10: a"]


def test_replay(spark):
    req, cache = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "x")], "key string, response string")
    assert P.replayed(req.limit(0), cache).count() == 0
    with pytest.raises(Exception, match="no cached response"):
        P.replayed(req, cache).collect()
    with pytest.raises(RuntimeError):
        P.replayed(req, cache, offline=False, ceiling=0)
    assert {r["key"]: r["cached"] for r in P.replayed(req, cache, offline=False, ceiling=1).collect()} == {"a": True, "b": False}
    calls = spark.createDataFrame([(1, 1, 429, None), (1, 6, 503, None), (2, 2, 400, "bad"), (3, 1, None, "Connection reset")], "id long, attempt int, status int, message string")
    assert [(r["repeat"], r["wait"]) for r in P.retries(calls).collect()] == [(True, 2), (False, None), (False, None), (True, 2)]
    roles = lambda a, b: spark.createDataFrame([("drafter", "m", a), ("judge", "n", b)], "role string, model string, family string")
    assert P.assert_families(roles("p", "q")).count() == 2
    for a, b in (("p", "p"), ("p", None)):
        with pytest.raises(Exception, match="two known families"):
            P.assert_families(roles(a, b)).collect()


def test_completions_and_letters(spark):
    rows = [("ok then, we go", None, "stop"), (' "We are on it." ', "", "stop"), ("", None, "stop"), ("fine", "timeout", "stop"), ("fine </think> x", None, "stop"), ("cut", None, "length"), (None, None, None)]
    t, why = P.completion(F.col("t"), F.col("e"), F.col("f"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string, e string, f string").select(t, why).collect()]
    assert [g[1] for g in got] == ["reasoning leak", "", "empty completion", "api: timeout", "reasoning leak", "truncated", "empty completion"] and got[1][0] == "We are on it."
    c = P.letter_choice(F.col("t"), F.col("l"), "ABC")
    ans = spark.createDataFrame([("x", {"B": -0.1, "C": -3.0}), ("(C).", {"B": -9.0}), ("none", None), (None, None)], "t string, l map<string,double>").select(c["letter"], F.round(c["confidence"], 3)).collect()
    assert [tuple(a) for a in ans] == [("B", 0.948), ("C", 1.0), (None, 0.0), (None, 0.0)]
    raw = spark.createDataFrame([("a", [], None, None), ("b", [("hi", "stop", [0.1] * 30)], (3, None), None)], "key string, choices array<struct<text:string,finish:string,logprobs:array<double>>>, usage struct<prompt_tokens:int,completion_tokens:int>, error string")
    a, b = P.normalised(raw).collect()
    assert a["error"] == "no choices" and a["prompt_tokens"] == 0 and len(b["logprobs"]) == 24 and (b["prompt_tokens"], b["completion_tokens"]) == (3, 0)


def test_labels_by_place(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    letters = spark.createDataFrame([("A", "one"), ("B", "two")], "letter string, id string")
    frame = spark.createDataFrame([(0, "x"), (1, "y")], "place int, text string")
    got = P.placed_labels(frame, "place", P.label_lines(lines("# head", "0 A", "1 B ?", "")), letters).orderBy("place").collect()
    assert [(r["text"], r["label"], r["unsure"]) for r in got] == [("x", "one", False), ("y", "two", True)]
    for bad, said in (((("0 A"), ("0 B")), "labelled twice"), ((("0 A"),), "do not fit"), ((("0 A"), ("1 C")), "do not fit"), ((("0 A"), ("1 B"), ("2 A")), "do not fit")):
        with pytest.raises(Exception, match=said):
            P.placed_labels(frame, "place", P.label_lines(lines(*bad)), letters).collect()
    assert [r[0] for r in P.header_lines(lines("# a b", "x", " ## c")).collect()] == ["a b", "c"]


def test_explore(spark):
    df = spark.createDataFrame([(i, "x" * 300 if i == 0 else "a | b\nc") for i in range(30)], "id long, t string").orderBy("id")
    text = Q.rendered(df, 5, 20)
    assert text.count("\n") == 7 and text.endswith("more rows exist") and "a \\| b c" in text and "x" * 20 not in text
    assert "more rows" not in Q.rendered(df.limit(3)) and Q.column_name("t; --", df) == "t"
    assert Q.ask(spark, "SELECT * FROM d;", 4, d=df).count() == 5
    for f in (lambda: Q.ask(spark, "DROP TABLE d"), lambda: Q.column_name("no", df)):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(FileNotFoundError, match="fetch it"):
        Q.require("/no/such/file.csv", "fetch it")
    a, b = spark.createDataFrame([(1, "p"), (2, "q")], "id long, l string"), spark.createDataFrame([(2, 0.1), (1, 0.2)], "id long, m double")
    assert Q.zipped(a, b, "id").count() == 2
    with pytest.raises(Exception, match="not one row on each side"):
        Q.zipped(a, b.limit(1), "id").collect()
    assert df.agg(Q.pearson(F.col("id"), F.lit(1))).first()[0] is None and df.agg(Q.pearson(F.col("id"), -F.col("id"))).first()[0] == pytest.approx(-1)
    assert [r["id"] for r in Q.first_rows(df, "id", 2).collect()] == [0, 1] and J.stale(a.withColumn("sha", F.lit("x")), b.withColumn("sha", F.lit("x")), ("id", "sha")).count() == 0


def test_analysers(spark):
    df = spark.createDataFrame([(1, "The café, the Bar a"), (2, None), (3, "")], "id long, t string")
    w = {r["id"]: r["w"] for r in df.select("id", C.analysed(F.col("t"), stop=("the",), accents=True).alias("w")).collect()}
    assert w == {1: ["cafe", "bar", "cafe bar"], 2: None, 3: []}
    chars = df.select(C.analysed(F.col("t"), "char_wb").alias("w")).first()["w"]
    assert " ca" in chars and "café " in chars and "caf" in chars and all(3 <= len(x) <= 5 for x in chars)
    v = {r["term"]: r["df"] for r in C.vocabulary(spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa bb")], "id long, t string"), "id", C.analysed(F.col("t")), 2, 0.9).collect()}
    assert v == {"bb": 2, "aa bb": 2}


def test_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 4) + np.eye(4)[i % 3]], "abc"[i % 3]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, y string")
    preds, chosen = C.nested(v, {"centroid": C.by_centroid, "knn": C.by_neighbours(3, True)}, 2, 2)
    assert preds.count() == 60 and chosen.agg(F.sum("n")).first()[0] == 2 and C.macro_f1_by(preds, "fold").agg(F.min("macro_f1")).first()[0] > 0.8
    post = C.oof(v, C.logistic(4.0, True, 2), 2).first()["posterior"]
    assert set(post) == {"a", "b", "c"} and sum(post.values()) == pytest.approx(1, abs=1e-4)
    cos = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.2), ("a", "d", 0.5), ("b", "d", 0.1), ("c", "d", 0.0)], "a string, b string, cosine double")
    assert C.confusable(cos, 3) == ["a", "b", "d"] and C.confusable(cos.limit(0), 3) == []
    pairs = R.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.05, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0])], "id long, vector array<double>"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2), (1, 3)}


def test_dense_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "CELLS", 7)
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(12)], "doc_id long, vector array<double>")
    got = R.dense(v, v.where("doc_id < 2").withColumnRenamed("doc_id", "qid"), 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in got] == [(0, 11), (0, 10), (0, 9), (1, 11), (1, 9), (1, 7)]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "cache.jsonl")
    open(p, "w").write('{"key": "a", "response": "1"}\n\n{"key": "b", "resp\n{"key": "a", "response": "2"}\n')
    assert [tuple(r) for r in files.read_cache(spark, p).collect()] == [("a", "2")]
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "key string, response string")
    for _ in range(2):
        files.append_cache(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    files.write_parquet(df, str(tmp_path / "p"), "key")
    files.write_manifest(df, str(tmp_path / "m"), source="x")
    m = spark.read.json(str(tmp_path / "m")).first()
    assert m["rows"] == 3 and m["source"] == "x" and m["revision"]
    files.write_report(df.agg(F.count("*").alias("n")), df.distinct(), str(tmp_path / "r"))
    assert len(spark.read.json(str(tmp_path / "r")).first()["rows"]) == 2
    files.write_vectors(spark.createDataFrame([("m", "k", [0.5])], "model string, key string, vector array<double>"), str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), "m").count() == 1 and files.read_vectors(spark, str(tmp_path / "v"), "n").count() == 0


def test_text_scalars(spark):
    df = spark.createDataFrame([("Okay, the user wants",), ("We are on it",), (None,), (" (B). ",), ("a | b\n c",)], "t string")
    got = df.select(T.looks_like_reasoning(F.col("t")), T.bare_letter(F.col("t")), T.one_line(F.col("t"))).collect()
    assert [g[0] for g in got] == [True, False, False, False, False] and got[3][1] == "B" and got[1][1] is None and got[4][2] == "a \\| b c"
    assert spark.range(1).select(T.as_reason(F.lit("low"), F.lit(0.126), F.lit("x"))).first()[0] == 'low 0.13: "x"'

"""The training-data operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import consolidate, conversations, encoding, garbled, languages, leakage, private, residue, splits
from skein.session import Scratch

TWCS = "tweet_id long, author_id string, inbound boolean, created_at string, text string, response_tweet_id string, in_response_to_tweet_id long"
GOLDEN = "id long, text string, intent string, split string, thread_id long, brand_reply string"


def tweet(i, author="7", at="Fri Apr 01 00:00:00 +0000 2022", text="hello there", parent=None):
    return (i, author, author.isdigit() if author else None, at, text, None, parent)


# ---- 1

#: names that stand in no list of the repository
SAID = [f"my name is {g} {f}, {x}" for g, f in (("Quendra", "Obermoss"), ("Tiv", "Wattlescombe"), ("quendra", "hagglund"), ("priska", "haldiwell"), ("Zoe", "Wattlescombe"), ("Delia", "Obermoss"), ("Delia", "Hagglund"), ("Priska", "Obermoss"), ("Zoe", "Hagglund")) for x in ("where is my bag", "the flight is late", "please help")]
SAID += [f"thanks {g} for the help with my bag at the gate" for g in ("Quendra", "Delia", "Zoe", "Priska")] * 3 + ["my bag is still in Port Halden and my seat is taken", "the passenger in my seat was late", "dear all, the flight is late and the bag too"] * 20 + ["booked for OBERMOSS/ZOE MRS"]
NAMES = private.learn(SAID)


def test_names_are_learned_from_what_people_say():
    assert {"quendra", "delia", "zoe", "priska"} <= NAMES.given and {"obermoss", "hagglund", "wattlescombe", "haldiwell"} <= NAMES.family
    assert not (NAMES.given | NAMES.family) & {"my", "the", "passenger", "dear", "bag", "halden"}
    people = lambda t: [t[a:b] for a, b, k in private.detect(t, NAMES) if k == "person_name"]
    assert people("ask quendra wattlescombe about it") == ["quendra wattlescombe"] and people("OBERMOSS, Zoe") == ["OBERMOSS, Zoe"]
    assert people("mr hagglund is here") == ["mr hagglund"] and people("Zoe Kettleworth is here") == ["Zoe Kettleworth"]  # a word of no other use
    assert people("thanks Zoe at gate B2 - Delia") == people("thanks Zoe bag") == people("my bag, Zoe") == []
    assert NAMES.genders == {"zoe": "f"}
    assert private.learn([]).find("my name is", "my name is", {"my", "name", "is"}) == []


def test_mentions_of_a_person_share_the_family_name():
    said = [private.surrogate("person_name", v, b"k").lower().replace(".", "").split() for v in ("Mr Obermoss", "Zoe Obermoss", "OBERMOSS, ZOE")]
    assert said[0][1] == said[1][1] == said[2][0].rstrip(",") and said[1][0] == said[2][1] and said[0][1] != "obermoss"


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("my mail is jo.doe+x@mail.example now", {"email"}),
        ("write to jo.doe (at) mail (dot) example (dot) org", {"email"}),
        ("write to jo.doe at mail dot example", {"email"}),
        ("@handle we meet at gate B12 at noon.", set()),
        ("call +44 (0)20 7946 0116 or (202) 555-0147", {"phone"}),
        ("bag tag 0033562375 and case 0042826070, ticket 0167 0042542587, order no. 0090395873-16", set()),
        ("flight KW 1397 seat 12B on 2023-04-12 at 10:35 for $576.50", set()),
        ("SSN 972-19-5809", {"id_number"}),
        ("mi DNI 00017685K, por si", {"id_number"}),
        ("codice fiscale XQXZZK00A99Z059X", {"id_number"}),
        ("deliver to flat 9b, 99 cinder mill ave, eastvale", {"address"}),
        ("mándenla a C/ Brisas nº 79, Tarn Bay", {"address"}),
        ("bitte an Moorlindenstraße 30, 00851 Eastvale", {"address"}),
        ("livrez-la au 54 bis, avenue des Alizés.", {"address"}),
        ("terminal road 24 is closed, row 37 made me sick", set()),
        ("my name is ZAMMEQUIST/DELIA MR", {"person_name"}),
        ("booked for priska haldiwell", {"person_name"}),
        ("the passenger is Mr. Dunnoba", {"person_name"}),
        ("thanks Delia at gate E2 - Odette", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_private_kinds(text, kinds):
    assert {k for _, _, k in private.detect(text, NAMES)} == kinds


def test_surrogates_keep_format_and_are_distinct(spark):
    key = b"k"
    assert private.surrogate("phone", "+1 (617) 555-0166", key)[:4] == "+1 ("
    a, b = private.surrogate("person_name", "ZAMMEQUIST/DELIA MR", key, 0, {"delia": "m"}), private.surrogate("person_name", "Delia Zammequist", key, 0, {"delia": "m"})
    assert a.endswith(" MR") and a.split("/")[0].isupper()
    fam, given = a[:-3].lower().split("/")
    assert b.lower() == f"{given} {fam}" and given in private.SURROGATE_GIVEN["m"]
    rows = spark.createDataFrame([("twcs", i, f"call {200 + i % 90}-555-{i:04d} please") for i in range(1500)] + [("twcs", 1, "call 201-555-0001 please"), ("twcs", 5000, None), ("twcs", 5001, "")], "src string, record_id long, text string").withColumn("entity", F.lit(1)).withColumn("value", F.lit(2))
    out = private.replaced(rows, key)
    got = out.collect()
    assert len(got) == 1500 and len({r["surrogates"] for r in got}) == 1500 and {r["masked"] for r in got} == {"call <phone> please"}
    assert private.replaced(rows.limit(0)).count() == 0


def test_private_found_searches_every_row(spark):
    t = spark.createDataFrame([tweet(1, text="nothing"), tweet(1, text="my SSN 972-19-5809"), tweet(None, text="my SSN 972-19-5809")], TWCS)
    g = spark.createDataFrame([(5, "x", "i", "train", 1, "Dear Delia Zammequist, hi"), (6, "x", "i", "train", 1, None)], GOLDEN)
    assert {tuple(r) for r in private.found(private.records(t, g), NAMES).collect()} == {("twcs", 1, "id_number"), ("golden", 5, "person_name")}


@pytest.mark.parametrize("text, name", [("John Miller lost my case", "John Miller"), ("ask maria gonzalez", "maria gonzalez"), ("for Miller, John please", "Miller, John"), ("sono Paolo R. Rossi", "Paolo R. Rossi"), ("ich, Jürgen Müller", "Jürgen Müller")])
def test_common_names_are_found(text, name):
    assert [text[a:b] for a, b, k in private.detect(text) if k == "person_name"] == [name]
    assert private.surrogate("person_name", name, b"k").lower() != name.lower()


@pytest.mark.parametrize("text", ["the price is white and green", "John said so", "a long walk to Martin Place", "mark my words"])
def test_common_words_are_no_names(text):
    assert not [k for _, _, k in private.detect(text) if k == "person_name"]


@pytest.mark.parametrize("kind, values", [("person_name", [f"Emma {b.title()}{c}" for b in private.SURROGATE_GIVEN["f"][:60] if b != "emma" for c in ("", " Julie", " Susan")]), ("id_number", [f"A{i:02d}" for i in range(0, 100)] + [f"B{i:02d}" for i in range(100)]), ("phone", [f"+44 {i:02d} ext 1" for i in range(60)]), ("person_name", ["Mr Prof", "Dr Mr Sig", *[f"Emma {b}" for b in private.SURROGATE_GIVEN["m"][:60]]])])
def test_surrogates_are_distinct_when_the_draws_run_out(spark, kind, values):
    rows = list({private.canonical(kind, v): v for v in values}.items())
    ents = spark.createDataFrame([(kind, e, v) for e, v in rows], "pii_type string, entity string, value string")
    got = private.draws(ents, b"k", Scratch(spark, "draws"), rounds=2).collect()
    assert len(got) == len(rows) and any(r["draw"] >= private.DRAWS for r in got)
    value = dict(rows)
    made = [private.canonical(kind, private.surrogate(kind, value[r["entity"]], b"k", r["draw"])) for r in got]
    assert len(set(made)) == len(rows) and not set(made) & set(value)


MISSED = ["thanks to Zoe Smithson for help", "I live at 12 Saint-Denis Avenue now", "I live at 12  Fern\u00a0Hollow\nRoad now", "passport ABCDEF1", "Ausweisnummer L01X00T47", "12 Élysée Street please", "nothing here", "", None]


def test_private_found_equals_detect_on_every_text(spark):
    rows = spark.createDataFrame(list(enumerate(MISSED)), "record_id long, text string").withColumn("src", F.lit("twcs"))
    want = {(i, k) for i, t in enumerate(MISSED) for _, _, k in private.detect(t, NAMES)}
    assert {(r["record_id"], r["pii_type"]) for r in private.found(rows, NAMES).collect()} == want
    assert {i for i, _ in want} == {0, 1, 2, 3, 4, 5}


def test_long_text_is_searched_whole():
    assert [k for _, _, k in private.detect("word " * 20000 + "jo@mail.example")] == ["email"]


# ---- 2


@pytest.mark.parametrize("frontiers", [200, 1])
def test_groups_match_union_find(spark, frontiers):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3000) if rng.random() < 0.4 else None) for i in range(2000)] + [(2500 + i, 7) for i in range(300)] + [(3100, None), (3101, 9999), (3102, 9999)]
    gold = [(rng.randrange(4000), rng.choice([None, *range(30)])) for _ in range(60)]
    t = spark.createDataFrame([tweet(i, parent=p) for i, p in rows] * 2, TWCS).withColumn("kind", F.lit("x")).repartition(5)
    g = spark.createDataFrame([(i, None, None, None, th, None) for i, th in gold], GOLDEN).withColumn("link", F.lit(1))
    p = {i: i for i, _ in rows} | {i: i for i, _ in gold}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)

    ids, seen = {i for i, _ in rows}, {}
    for i, parent in rows:
        if parent in ids:
            union(i, parent)
    for i, th in gold:
        if th is not None:
            union(i, seen.setdefault(th, i))
    label = {x: find(x) for x in p}
    many = {v for v in label.values() if sum(1 for y in label.values() if y == v) > 1} if len(label) < 3000 else None
    counts = {}
    for v in label.values():
        counts[v] = counts.get(v, 0) + 1
    assert many is None or many == {v for v, n in counts.items() if n > 1}
    got = consolidate.groups(t, g, frontiers).collect()
    assert len(got) == len({r["tweet_id"] for r in got})
    assert {(r["tweet_id"], r["group_id"]) for r in got} == {(x, v) for x, v in label.items() if counts[v] > 1}


def test_peel_takes_the_giant_component(spark):
    rng = random.Random(5)
    links = [(i, i - 1) for i in range(1, 200)] + [(i, rng.randrange(1000, i)) for i in range(1001, 3000)] + [(4000 + i, 4000) for i in range(40)]
    rng.shuffle(links)
    rows = spark.createDataFrame([(i, p, 0) for i, p in links] + [(1000, None, 0), (0, None, 0)], "id long, link long, kind int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scratch = Scratch(spark, "peel")
        nodes, edges = consolidate.contract(rows, scratch)
        assert nodes.select(F.col("rep")).distinct().count() > 3 and edges.count() > 1
        giant, left = consolidate.peel(nodes, edges, scratch)
        peeled = {r["id"] for r in nodes.join(giant.withColumnRenamed("id", "rep"), "rep").select("id").collect()}
        assert peeled == set(range(1000, 3000))
        assert not {x for r in left.collect() for x in (r["a"], r["b"])} & peeled
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_groups_of_empty_tables(spark):
    assert consolidate.groups(spark.createDataFrame([], TWCS), spark.createDataFrame([], GOLDEN)).count() == 0


# ---- 3

PHRASES = {
    "en": ["that link just goes round in circles", "the bag is still not on the belt and nobody answers", "who do I talk to about that this is not good"],
    "es": ["nadie responde en ese teléfono desde ayer", "la maleta no ha llegado y el mostrador está cerrado", "necesito una solución hoy mismo por favor"],
    "fr": ["ce numéro sonne dans le vide depuis hier", "ma valise n'est toujours pas arrivée et le comptoir est fermé", "j'attends une solution avant ce soir"],
    "de": ["unter der Nummer geht seit gestern keiner ran", "mein Koffer ist immer noch nicht angekommen und der Schalter ist zu", "ich brauche noch heute eine Lösung"],
    "pt": ["ninguém atende esse número desde ontem", "a minha mala ainda não chegou e o balcão fechou", "preciso de uma solução ainda hoje"],
    "it": ["a quel numero non risponde nessuno da ieri", "la mia valigia non è ancora arrivata e il banco è chiuso", "mi serve una soluzione entro stasera"],
}


def language_rows(n=60):
    rng = random.Random(1)
    return [(10000 * k + i, " ".join(rng.sample(ps, 2)), l) for k, (l, ps) in enumerate(PHRASES.items()) for i in range(n)]


def test_languages(spark):
    rows = language_rows() + [(1, PHRASES["en"][0] + " " + PHRASES["de"][1], "en"), (2, PHRASES["fr"][1], "es-ES"), (3, PHRASES["it"][1], None), (4, PHRASES["pt"][1], "PT"), (5, None, "en"), (6, "", None), (7, "ok", "und"), (2, PHRASES["fr"][1], "es-ES"), (8, (PHRASES["en"][1] + ". ") * 2000, "en-US")]
    e = spark.createDataFrame(rows, "customer_tweet_id long, customer_text string, lang string").withColumn("id", F.lit(0)).withColumn("label", F.lit("x"))
    got = {tuple(r) for r in languages.mislabelled(languages.exchange_texts(e)).collect()}
    assert got == {(1, "en"), (1, "de"), (2, "fr"), (3, "it")}
    assert languages.mislabelled(languages.exchange_texts(e.limit(0))).count() == 0


def test_language_rejection_is_calibrated():
    rng = random.Random(3)
    rows = [(t, l if rng.random() > 0.1 else rng.choice(languages.LANGS)) for _, t, l in language_rows(200)]
    m = languages.train([r[0] for r in rows], [r[1] for r in rows])
    assert languages.TEMPERATURES[0] < m.temperature < languages.TEMPERATURES[-1]
    (seg,) = m.segments("nadie responde en ese teléfono desde ayer")
    assert seg[1] == "es" and seg[2] > 0.8 and seg[2] > m.reject
    assert m.segments("") == [] and m.segments("@a https://t.example/x 123") == []


def test_language_threshold_and_temperature():
    p, right = np.linspace(1, 0.2, 100), np.ones(100, bool)
    kept = lambda low: pytest.approx(low * 0.25 / (1 - low + low * 0.25))
    assert languages.threshold(p, right) == kept(0.2)
    right[50:] = False
    assert languages.threshold(p, right) == kept(p[50])  # one wrong in 51 is within two in a hundred, two in 52 are not
    assert languages.threshold(p, np.zeros(100, bool)) == 1.0
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, (20000, 4))
    q = np.exp(z / 2.0)
    t = np.array([rng.choice(4, p=r) for r in q / q.sum(1, keepdims=True)])
    assert 1.8 < languages.temperature(z, t) < 2.2


def test_language_sample_ignores_partitions(spark):
    texts = spark.createDataFrame([(i, t, l) for i, t, l in language_rows(100)] + [(1, "same text here", "en")] * 300, "id long, text string, label string")
    got = [languages.sample(texts.repartition(n), 150).collect() for n in (2, 5, 16)]
    assert got[0] == got[1] == got[2] and 50 < len(got[0]) <= 150


def test_language_segments_of_texts_without_words(spark):
    texts = spark.createDataFrame([(i, t, l) for i, t, l in language_rows(20)] + [(-1, None, "en"), (-2, "", None), (-3, "ok", "en"), (-4, "@a https://t.example/x", "en")], "id long, text string, label string")
    got = {r["id"]: (r["lang"], r["confidence"], r["n_segments"]) for r in languages.segments(texts).where("id < 0").collect()}
    assert all(got[i] == ("und", 0.0, 0) for i in (-1, -2, -3, -4))


# ---- 5


def test_splits(spark):
    rows = [(i, f"t{i}", None, ["train", " Test", "validation", "DEV", None][i % 5], i // 2, None) for i in range(2000)] + [(0, "t", None, "train", None, None), (None, "t", None, "dev", 1, None)]
    g = spark.createDataFrame([r for r in rows], "id long, text string, intent string, split string, thread_id long, brand_reply string").withColumn("key", F.lit(1)).withColumn("component", F.lit(1))
    out, torn, table = splits.assign(g)
    o = out.collect()
    assert len(o) == 2001
    by = {}
    for r in o:
        by.setdefault(r["thread_id"], set()).add(r["split"])
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    share = {s: sum(r["split"] == s for r in o) / len(o) for s in splits.SHARES}
    assert all(abs(share[s] - v) < 0.04 for s, v in splits.SHARES.items())
    want = {}
    norm = {"train": "train", " Test": "test", "validation": "dev", "DEV": "dev", None: None}
    for r in rows:
        if r[0] is not None and r[4] is not None and norm[r[3]]:
            want.setdefault(r[4], set()).add(norm[r[3]])
    assert {r["thread_id"] for r in torn.collect()} == {k for k, v in want.items() if len(v) > 1}


def test_splits_are_incremental(spark):
    rows = lambda x: spark.createDataFrame([(i * 2, t * 2 + 1, None) for i, t in x], "record long, thread long, split string")
    first = splits.update(rows([(i, i // 3) for i in range(300)]))
    second = splits.update(rows([(i, i // 3) for i in range(300, 360)]), first)
    was = {r["key"]: r["split"] for r in first.collect()}
    now = {r["key"]: r for r in second.collect()}
    assert all(now[k]["split"] == s for k, s in was.items()) and len(now) == 360 + 120
    a = next(t for t in range(100) if was[t * 2 + 1] == "train")
    b = next(t for t in range(100) if was[t * 2 + 1] == "test")
    third = {r["key"]: r for r in splits.update(rows([(900, a), (900, b)]), second).collect()}
    assert third[a * 2 + 1]["quarantined"] and third[b * 2 + 1]["quarantined"] and third[a * 2 + 1]["split"] is None
    assert all(third[k]["split"] == s for k, s in was.items() if third[k]["component"] != third[a * 2 + 1]["component"])
    assert splits.update(rows([]), second).count() == second.count() and splits.update(rows([])).count() == 0


def test_torn_threads_come_from_the_table(spark):
    g = spark.createDataFrame([(1, "train", 5), (2, "test", 5), (2, "test", 6), (3, "train", 6), (4, "dev", 7), (5, None, 7), (6, "dev", 8), (7, "DEV ", 8), (7, "test", None)], "id long, split string, thread_id long")
    out, torn, table = splits.assign(g)
    assert sorted((r["thread_id"], r["splits"]) for r in torn.collect()) == [(5, ["test", "train"]), (6, ["test", "train"])]
    asked = {r["key"]: r["asked"] for r in table.collect()}
    assert asked[11] == asked[13] == ["test", "train"] and asked[15] == ["dev"] and asked[17] == ["dev", "test"]
    later = {r["key"]: r["asked"] for r in splits.update(spark.createDataFrame([(8, 15, "train")], "record long, thread long, split string"), table).collect()}
    assert later[15] == ["dev", "train"] and later[11] == ["test", "train"]


def test_splits_in_batches_keep_threads_whole(spark):
    g = spark.createDataFrame([(i, None, i // 4) for i in range(400)], "id long, split string, thread_id long").withColumn("batch", F.lit(0))
    got = splits.in_batches(g, F.col("id") % 8 < 3).collect()
    by = {}
    for r in got:
        by.setdefault(r["thread_id"], set()).add((r["split"], r["quarantined"]))
    assert len(got) == 400 and all(len(v) == 1 for v in by.values()) and {r["batch"] for r in got} == {1, 2}


# ---- 6


@pytest.mark.parametrize(
    "text, in_drafts, in_hits",
    [
        ("<user> Hi {{first_name}}, thanks", True, True), ("Dear [insert date here],", True, True), ("More at %(form_link)s", True, True), ("See <url> please", True, False), ("<user> <user> hello", False, False), ("Hi <flight no>, x", True, True),
        ("lorem ipsum dolor sit", True, True), ("TBD", True, True), ("502 Bad Gateway", True, True), ("Traceback (most recent call last): KeyError: 'reply'", True, True), ("Please enable JavaScript to view this page", True, True),
        ("Sorry you saw error 404 on the seat page, please try the link", False, False), ("Thanks for the screenshot of the 404 message", False, False), ("please check that JavaScript is on in the phone's browser", False, False), ("a plane <3 and 50% off [1/2] {", False, False),
    ],
)
def test_residue_shapes(text, in_drafts, in_hits):
    said = lambda m: residue.slots(text, m) or any(rx.search(text) for rx in residue.WEAK.values())
    assert bool(said(True)) == in_drafts and bool(said(False)) == in_hits


def test_residue_model_and_edges(spark):
    rng = random.Random(4)
    good = ["We are looking into it and will tell you soon", "Please send us your booking code", "Thank you for letting us know about the delay"]
    bad = ["503 Service Unavailable", "lorem ipsum dolor sit amet", "Hi {{name}}, we are on it", "Please enable cookies to continue"]
    d = [(i, f"d{i % 7}", rng.choice(good) + f" {i}", None) for i in range(400)] + [(1000 + i, f"d{i % 7}", rng.choice(bad), None) for i in range(80)] + [(2000, "d1", None, "api: timeout"), (2001, "d1", "", "x"), (1000, "d0", d_text := "503 Service Unavailable", None), (2002, "d2", " ".join(f"please look{i}" for i in range(20000)), None)]
    drafts = spark.createDataFrame(d, "id long, drafter string, text string, error string").withColumn("intent", F.lit("a")).withColumn("chance", F.lit(1))
    hits = spark.createDataFrame([(1, 2, 5, "See <url> here", "a"), (2, 1, 5, "404 Not Found", "a"), (3, None, 5, None, None)], "qid long, rank int, doc_id long, reply string, intent string")
    model, figures = residue.fitted(residue.records(drafts, hits))
    assert figures["unseen"] and figures["both"] >= 0.9 * max(figures["labelled"], figures["said"]) > 0
    got = {(r["src"], r["record_id"]) for r in residue.residue(residue.records(drafts, hits), model).collect()}
    assert got == {("drafts", 1000 + i) for i in range(80)} | {("hits", 2)}
    assert residue.residue(residue.records(drafts.limit(0), hits.limit(0))).count() == 0 and d_text


def test_residue_at_the_end_of_a_long_text_is_scored():
    rng = random.Random(4)
    good = [(f"we are looking into it and will tell you soon {rng.choice('abc')}", 0, False) for _ in range(200)]
    bad = [(f"{rng.choice(['gizmo', 'wotsit', 'doodad'])} {rng.choice(['fribble', 'grommet'])} unhandled kaput", 1, False) for _ in range(60)]
    model = residue.fit(good + bad)
    head = "we are looking into it and will tell you soon " * 1000
    tail = "gizmo fribble unhandled kaput wotsit grommet unhandled kaput " * 40
    assert not residue.slots(head + tail, False) and not any(rx.search(head + tail) for rx in residue.WEAK.values())
    low, high = model.chances([(head, False), (head + tail, False)])
    assert low < residue.THRESHOLD <= high
    one, many = residue.Windows(residue.Reader(), [("few words", False)]), residue.Windows(residue.Reader(), [("word " * 70, False), ("", False)])
    assert len(one.lo) == 1 and list(many.of) == [0, 0, 0, 0, 1]
    assert list(zip(many.lo, many.hi))[:4] == [(0, 32), (16, 48), (32, 64), (48, 70)]  # no token is left out


def test_residue_model_finds_what_no_phrase_shows():
    rng = random.Random(6)
    good = [f"{a} {b}" for a in ("we are sorry for the delay", "thank you for writing to us", "please message us your code", "our desk will call you") for b in ("and we will keep you posted", "so we can check it", "at gate C7", "with the tag number")]
    errors = ["502 Bad Gateway nginx", "503 Service Unavailable nginx", "HTTP 500 - Internal Server Error nginx upstream", "Traceback (most recent call last): KeyError: 'x' in render"]
    rows = [(rng.choice(good) + f" {i}", None, f"h{i}", False) for i in range(600)] + [(rng.choice(errors) + f" {i}", None, f"h{i}", False) for i in range(150)] + [("upstream timed out in nginx worker", "api: timeout", f"h{i}", False) for i in range(20)]
    model, _ = residue.train(rows)
    planted = ["upstream failure in nginx", "nginx worker timed out", "Dear {{ guest_name }}, thank you for writing to us"]
    prose = ["we will call you at gate C7", "sorry for the delay, our desk can check it"]
    said = model.chances([(t, False) for t in planted[:2] + prose]) >= residue.THRESHOLD
    assert said.tolist() == [True, True, False, False]
    assert residue.shown(planted[0]) is None and residue.shown(planted[1]) is None and residue.slots(planted[2], False)
    assert residue.weak_label("anything", "api: timeout", False) == 1


# ---- 7


def rebuild(spark, tmp_path, rows, parts=1, **k):
    folder = str(tmp_path / "twcs.parquet")
    df = spark.createDataFrame(rows, TWCS)
    for i in range(parts):
        df.where(F.pmod(F.hash("tweet_id", "text"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(folder)
    return [tuple(r) for r in conversations.rebuild(spark, folder, **k).orderBy("conversation_id", "turn").collect()]


AT = "Fri Apr 01 00:{:02d}:00 +0000 2022"
TALKS = [
    tweet(1, "7", AT.format(1), "help"), tweet(3, "B", AT.format(5), "yes", 1), tweet(2, "7", AT.format(5), "more", 3), tweet(4, "7", AT.format(9), "@B https://x.example", 3),
    tweet(3, "B", "2022-04-01T00:05:00Z", "ye", None),  # a repeat, cut, without its link
    tweet(10, "7", AT.format(1), "q"), tweet(11, "B", None, "a", 10),  # no instant
    tweet(20, "7", AT.format(1), "q", 99), tweet(21, "B", AT.format(2), "a", 20),  # absent parent
    tweet(30, "7", AT.format(1), "q", 31), tweet(31, "B", AT.format(2), "a", 30),  # circle
    tweet(40, "7", AT.format(1), "only me"), tweet(41, "B", AT.format(2), " ​ \n", 40),  # brand without content
    tweet(50, "7", AT.format(1), None), tweet(51, "B", AT.format(2), "a", 50),
    tweet(60, "7", "NaT", "q"), tweet(60, "7", AT.format(3), None), tweet(61, None, AT.format(1), "a", 60),
]
WANT = [(1, 1, 1, "customer"), (1, 2, 2, "customer"), (1, 3, 3, "brand"), (60, 1, 61, "brand"), (60, 2, 60, "customer")]


@pytest.mark.parametrize("parts, k", [(1, {}), (4, {"files_per_trigger": 1, "bucket_rows": 3}), (2, {"large_rows": 2})])
def test_conversations(spark, tmp_path, parts, k):
    assert rebuild(spark, tmp_path, TALKS, parts, **k) == WANT


class State:
    """What _step() uses of a group's state."""

    def __init__(self):
        self.exists, self.hasTimedOut, self.wm, self.timeout = False, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.wm

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists = False

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_late_rows_of_conversations_closed_by_timeout_open_nothing():
    def feed(state, *rows):
        f = pd.DataFrame(rows, columns=conversations.COLS)
        return [tuple(r) for out in conversations._step((0,), [f] if rows else [], state) for r in out.itertuples(index=False)]

    day, s = 86_400, State()
    first, answer, late = (1, 1, 0, True, True, False, 3), (1, 2, day, True, False, False, 3), (1, 3, 2 * day, True, True, False, 3)
    assert feed(s, first, answer) == [] and s.exists and s.timeout == (day + 30 * day) * 1000
    s.wm, s.hasTimedOut = 32 * day * 1000, True
    assert feed(s) == [(1, 1, 1, "customer"), (1, 2, 2, "brand")]  # closed by timeout, in order
    s.hasTimedOut = False
    assert feed(s, late) == [] and s.exists  # the conversation is not emitted again
    other = [(5, 5, 40 * day, True, True, False, 2), (5, 6, 41 * day, True, False, False, 2)]
    assert feed(s, other[1]) == [] and feed(s, other[0]) == [(5, 1, 5, "customer"), (5, 2, 6, "brand")]  # late, and complete by count
    s = State()
    feed(s, (9, 9, conversations.NONE, True, True, False, 2))
    s.hasTimedOut, s.wm = True, 1
    assert feed(s) == []  # without any instant it is closed and dropped


def test_conversations_of_an_empty_table(spark, tmp_path):
    assert rebuild(spark, tmp_path, []) == []


# ---- 8


def test_encoding_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = encoding.default_vocabulary()
    ranks = encoding.load(path)[0]
    ref = tiktoken.Encoding("own", pat_str=encoding.PIECES, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, " ", "a" * 5000, "<|endoftext|> hello", "naïve café — 日本語テキスト 👩‍✈️", "x\n\n  y\t", "ab" * 4000, "don't we'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encoded(df).collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encoding.encoded(df.limit(0)).count() == 0
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeé日 _-") for _ in range(rng.randrange(1, 40)))
        assert encoding.encode(piece, path) == ref.encode_ordinary(piece)


# ---- 9


def test_leaks(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(80))) for i in range(20)] + [(90, None), (91, ""), (92, "two words"), (93, "more or less three"), (0, "another text of item nought with some eight words")]
    docs, want = [], set()
    for d in range(200):
        w = [rng.choice(vocab) for _ in range(60)]
        if d % 4 == 0:
            i = rng.randrange(20)
            n = rng.choice([20, 44, 60, 80])
            words = items[i][1].split()
            lo = rng.randrange(80 - n + 1)
            passage = words[lo : lo + n]
            if n >= 44:
                want.add((d, i))
                passage[n // 2] = "changed"
            w[30:30] = [x.upper() + rng.choice(["", ",", "!\n"]) for x in passage]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "two words"), (903, items[0][1]), (903, items[0][1]), (904, "x " * 50000 + items[1][1]), (905, "it is MORE, or less\u00ad: three."), (906, "more or three"), (907, "so another text of item nought with some eight words")]
    want |= {(903, 0), (904, 1), (902, 92), (905, 93), (907, 0)}
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("items", F.lit(2))
    ii = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = [tuple(r) for r in leakage.leaks(dd, ii).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaks(dd.limit(0), ii).count() == 0 and leakage.leaks(dd, ii.limit(0)).count() == 0


def test_leaks_without_broadcast_are_the_same(spark, monkeypatch):
    w = [f"w{i}" for i in range(90)]
    dd = spark.createDataFrame([(1, " ".join(w[20:70])), (2, " ".join(w[::-1])), (3, "one two")], "doc_id long, text string")
    ii = spark.createDataFrame([(1, " ".join(w)), (2, "one two")], "item_id long, text string")
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in leakage.leaks(dd, ii).collect()} == {(1, 1), (3, 2)}


def test_leak_positions_must_lie_in_one_window(spark):
    w = [f"w{i}" for i in range(80)]
    apart = " ".join(" ".join(w[k : k + 12]) + " filler" * 60 for k in range(0, 80, 12))  # all shingles but no passage
    dd = spark.createDataFrame([(1, apart), (2, " ".join(w[:60]))], "doc_id long, text string")
    got = {tuple(r) for r in leakage.leaks(dd, spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")).collect()}
    assert got == {(2, 7)}


def test_word_hashes_agree_with_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\u00ad\u200dÅA\u030a1٣_-\n𝒳語") for _ in range(rng.randrange(60))) for _ in range(300)]
    of, hashes = leakage.word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in leakage.split_words(t)]
    assert of.tolist() == [i for i, _ in words]
    by = {}
    for (_, w), h in zip(words, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


# ---- 10


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_garbled_round_trip(codec):
    text = "El niño pidió café — über 20 € ’quoted’ in Zürich."
    bad = text.encode().decode(codec, "replace") if codec != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
    flag, back, whole = garbled.examine(bad)
    assert flag and (back == text) == whole
    if "�" not in bad:
        assert back == text
    if codec == "latin-1":
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
        assert garbled.examine(twice)[1] == text


def test_garbled_many_times_is_restored():
    text = bad = "El niño pidió café en Zürich"
    for _ in range(6):
        bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
    assert garbled.examine(bad) == (True, text, True)


@pytest.mark.parametrize("text", ["", None, "plain", "été à Âgés NÃO ATENÇÃO AMANHÃ É»", "½ × µ § © ® ™ °C £5 €4", "Где мой багаж? Вітаю Гёте", "荷物がまだ 我的行李 أين حقيبتي؟ Γεια σας", "“été” — l’été … «à»", "à́̂ 👩‍✈️ ██▒ ├── └──", "a​‍﻿b"])
def test_right_characters_are_no_case(text):
    assert garbled.examine(text) == (False, text, True)


def test_garbled_table(spark):
    rows = [(1, "cafÃ©"), (1, "cafÃ©"), (2, "café"), (3, None), (4, ""), (5, "x" * 100000 + " cafÃ©"), (6, "lost l�sst")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("restored", F.lit(1))
    got = sorted((r["doc_id"], r["lossless"]) for r in garbled.garbled(df).collect())
    assert got == [(1, True), (1, True), (5, True), (6, False)]
    assert garbled.garbled(df.limit(0)).count() == 0


def test_garbled_candidates_hold_all_that_is_found():
    rng = random.Random(4)
    texts = [None, "", "plain", "Ã", "Â", "x Ã", "x Ãa", "\ufffd", "naïve café"]
    for _ in range(3000):
        t = "".join(rng.choice("aé “”à日я–ñß Ã±©€Â") for _ in range(rng.randint(1, 12)))
        codec = rng.choice(garbled.CODECS)
        raw = t.encode("utf-8")
        texts += [t, raw.decode(codec, "replace"), raw.decode("latin-1")]
    texts.append("ä" * (garbled.CHUNK + 5) + "Ã©")
    found = {i for i, t in enumerate(texts) if garbled.examine(t)[0]}
    assert found <= set(garbled.candidates(texts)) and len(texts) - 1 in found


def test_residue_reads_letters_of_whole_texts():
    reader = residue.Reader()
    form = lambda text: residue.Windows(reader, [(text, False)]).form[0][4]
    assert form("word " * 400 + "12345 " * 2000) != form("word " * 400 + "words " * 2000)


def test_names_are_learned_from_all_texts(spark):
    rows = spark.createDataFrame([(f"we waited at gate {i}",) for i in range(41_000)] + [(t,) for t in SAID] * 2, "text string")
    got, want = private.learned(rows), private.learn([r["text"] for r in rows.collect()])
    assert (got.given, got.family, got.words, got.genders) == (want.given, want.family, want.words, want.genders)
    assert got.words == private.learned(rows.repartition(7)).words and got.given


def odd_texts(n):
    rng = random.Random(8)
    parts = "my name is Zoe zoe, Obermoss OBERMOSS/ZOE MRS mr Mr. M. dr A. b John Miller, o'brien anne-marie please page bag of dear (at) (at at) dot foo@ @bar.com jo@mail.example @249726 617 555-0166 +1 (617) - 12 34 56 78 90 972-19-5809 7b Street Ave, rue de la Paix via C/ Mayor Hauptstraße weg 5 flat 3b, passport AB1 permiso Straße İzmir １２   - https://t.example/ab1 x-y . ; the seat".split(" ")
    return ["".join(rng.choice(parts) + rng.choice("       \n.") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_only_texts_that_could_hold_something_are_searched(monkeypatch):
    texts = [t for t in MISSED if t] + ["@249726 the seat at gate B12 is taken", "please help, we wait"] * 50 + odd_texts(3000)
    want, asked, detect = [(t, k) for t in texts for _, _, k in private.detect(t, NAMES)], [], private.detect
    monkeypatch.setattr(private, "detect", lambda t, names: asked.append(t) or detect(t, names))
    batch = pa.RecordBatch.from_pydict({"src": ["twcs"] * len(texts), "record_id": list(range(len(texts))), "text": texts})
    got = [(r["text"], r["pii_type"]) for b in private._scan(NAMES, b"k")([batch]) for r in b.to_pylist()]
    assert got == want and not {"@249726 the seat at gate B12 is taken", "please help, we wait"} & set(asked)


def test_words_are_counted_by_pieces_as_on_whole_texts():
    texts, want = [*SAID, *odd_texts(3000), "", "a" * 100, "Zoe A. b Obermoss", "foo (at bar"], private.Counter()
    for text in texts:
        low = private.fold(text).lower()
        pairs, cues = {m.groups() for m in private._PAIR.finditer(low)}, {m.groups() for m in private._CUE.finditer(low)}
        travel = [m.groups() for m in private._TRAVEL.finditer(low)]
        cues |= {(g, f) for f, g, _ in travel}
        titles = [m.group(1, 2) for m in private._TITLE.finditer(low)]
        want.update({("use", w, "") for w in private._USE.findall(low)} | {("seed", f, "") for _, f in cues} | {("seed", w, "") for _, w in titles})
        want.update({("pair", a, b) for a, comma, b in pairs if not comma} | {("pair", *c) for c in cues} | {("back", b, a) for a, comma, b in pairs if comma})
        want.update([("titled", w, private.TITLES[t]) for t, w in titles] + [("titled", g, private.TITLES.get(t, "")) for _, g, t in travel])
    pieces = private.Pieces()
    assert private.counted(texts, pieces) == private.counted(texts, pieces) == want
    assert len(pieces) < 3000 and {k for k, _, _ in want} == {"use", "pair", "back", "seed", "titled"}

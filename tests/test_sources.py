"""Round trips of the text-based sources and sinks, and the stateless stream."""

import json

from pyspark.sql import functions as F

from skein.sources import files
from skein.streaming.scoring import cleaned, volume


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,7,True,x,"a ""q""\nb","2,3",\n2,B,False,x,c,,1\n')
    a, b = files.read_csv(spark, str(tmp_path / "t.csv")).orderBy("tweet_id").collect()
    assert a["text"] == 'a "q"\nb' and a["response_tweet_id"] == "2,3" and a["in_response_to_tweet_id"] is None and b["inbound"] is False


def test_jsonl(spark, tmp_path):
    rows = [{"id": 1, "text": "a"}, {"id": 2, "text": "b", "excluded": "anchored"}]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"id": 3, "te\n')
    assert [r["id"] for r in files.read_jsonl(spark, str(tmp_path / "g.jsonl")).collect()] == [1]
    files.write_jsonl(spark.createDataFrame([(2, "b"), (1, "a")], "id int, a string"), str(tmp_path / "out"), ["id"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"a","id":1}', '{"a":"b","id":2}']


def test_document_prompt_lines_manifest(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": {"b": [1, "x"]}, "c": true}')
    got = {r["path"]: r["value"] for r in files.read_document(spark, str(tmp_path / "d.json")).collect()}
    assert got == {"$.a.b.0": "1", "$.a.b.1": "x", "$.c": "true"}
    (tmp_path / "p.txt").write_bytes(b"# note\r\n\r\nSay hi.\r\n# more\r\nThen stop.\r\n")
    assert files.read_prompt(spark, str(tmp_path / "p.txt")).first()["prompt"] == "Say hi.\nThen stop."
    assert [r["value"] for r in files.read_lines(spark, str(tmp_path / "p.txt")).orderBy("line").collect()][2] == "Say hi."
    m = files.manifest(spark.range(3), source="range").first()
    assert (m["rows"], m["columns"], m["source"]) == (3, "id", "range")


def test_vectors(spark, tmp_path):
    files.write_vectors(spark.createDataFrame([("m", "k", [0.5, 1.0])], "model string, key string, vector array<double>"), str(tmp_path / "v"))
    r = spark.read.parquet(str(tmp_path / "v")).first()
    assert list(r["vector"]) == [0.5, 1.0] and r["model"] == "m"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(1, "7", "Fri Apr 01 00:00:00 +0000 2022", "@B call 800-555-1234"), (2, "B", None, None)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "tweet_id long, author_id string, created_at string, text string").write.parquet(src)
    batch = spark.read.parquet(src)
    for plan, name in ((cleaned, "c"), (volume, "v")):
        q = plan(spark.readStream.schema(batch.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    assert {tuple(r) for r in spark.table("c").collect()} == {tuple(r) for r in cleaned(batch).collect()}
    whole = {tuple(r) for r in volume(batch).collect()}
    assert {r[2] for r in whole} == {1} and {tuple(r) for r in spark.table("v").collect()} <= whole  # open windows are not emitted

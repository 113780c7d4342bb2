"""Text-based sources and sinks with declared schemas."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TWCS = "tweet_id long, author_id string, inbound boolean, created_at string, text string, response_tweet_id string, in_response_to_tweet_id long"
GOLDEN = "id long, text string, intent string, ambiguous boolean, anchored boolean, excluded string, stratum string, split string, thread_id long, brand_reply string, labelled_by string, taxonomy_version string"
CACHE = "key string, response string"


def read_csv(spark: SparkSession, path: str, schema: str = TWCS) -> DataFrame:
    """Rows of a CSV with a header; quoted fields may span lines. Nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = GOLDEN, keep_excluded: bool = False) -> DataFrame:
    """One object a line; missing keys are null, torn lines are dropped, and so are excluded rows."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if keep_excluded or "excluded" not in df.columns else df.where("coalesce(excluded, '') = ''")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document as (path, value): its scalar leaves by their path."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return _leaves(doc)


def _leaves(doc: DataFrame) -> DataFrame:
    todo = doc.select(F.lit("$").alias("path"), "v")
    found = None
    while True:
        kind = F.schema_of_variant("v")
        nested = todo.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        flat = todo.where(~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select("path", F.col("v").cast("string").alias("value"))
        found = flat if found is None else found.unionAll(flat)
        nested = nested.persist()
        if not nested.limit(1).count():  # as many rounds as the document is deep
            return found
        nested.createOrReplaceTempView("_nested")
        todo = nested.sparkSession.sql("SELECT concat(n.path, '.', coalesce(e.key, cast(e.pos AS string))) AS path, e.value AS v FROM _nested n, LATERAL variant_explode(n.v) e")


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """The text of a prompt file: comment lines dropped, line ends unified, blanks stripped."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"(?m)^#.*\n?", ""), r"^\s+|\s+$", "").alias("prompt"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, line, value) of text files; lines of a file keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("sheet"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    return whole.select("sheet", F.posexplode(F.split("t", "\n")).alias("line", "value"))


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One object a line, keys in order; with `order` in one file whose bytes repeat from run to run."""
    one = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"), *(F.col(c).alias(f"_{c}") for c in order or []))
    if order:
        one = one.repartition(1).sortWithinPartitions(*(f"_{c}" for c in order))
    one.select("value").write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """(model, key, vector), a folder for each model."""
    df.select("model", "key", F.transform("vector", lambda x: x.cast("float")).alias("vector")).write.mode("overwrite").partitionBy("model").parquet(path)


def manifest(df: DataFrame, **fields: str) -> DataFrame:
    """One row that describes a table: rows, columns and free fields; written beside the table."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(",".join(df.columns)).alias("columns"), *(F.lit(v).alias(k) for k, v in sorted(fields.items())))


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(model, key, vector) written by write_vectors(), of one model or of all."""
    df = spark.read.parquet(path).select("model", "key", "vector")
    return df if model is None else df.where(F.col("model") == model)


def read_cache(spark: SparkSession, path: str, schema: str = CACHE, key: str = "key") -> DataFrame:
    """A cache of one JSON object a line: torn and blank lines are dropped, of a key's lines the last counts."""
    lines = read_lines(spark, path).withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.col(f"j.{key}").isNotNull())
    last = lines.groupBy(F.col(f"j.{key}").alias("_k")).agg(F.max(F.struct("sheet", "line", "j")).alias("m"))
    return last.select("m.j.*")


def append_cache(df: DataFrame, path: str, key: str = "key") -> None:
    """Adds the rows of df whose key a Parquet cache does not hold yet, each key once."""
    new = df.dropDuplicates([key])
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def revision(folder: str = ".") -> str:
    """The commit a folder stands at, or `unknown`."""
    try:
        got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        return got.stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def write_manifest(df: DataFrame, path: str, **fields: str) -> None:
    """manifest() with the revision of the code, as one JSON object."""
    write_jsonl(manifest(df, **{"revision": revision(), **fields}), path, ["rows"])


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A run's report: its summary, one row, with its rows nested in it, as one JSON object."""
    nested = rows.agg(F.sort_array(F.collect_list(F.struct(*sorted(rows.columns)))).alias("rows"))  # a row a class
    write_jsonl(summary.join(nested), path)

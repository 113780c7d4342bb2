"""Cached model responses: keys, lookups, parsing and validity."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.text import bare_letter, has_placeholder, looks_like_reasoning


def first_response(cache: DataFrame, key: str = "key", place: str = "line") -> DataFrame:
    """One response for each key: the last line wins, as on load of an append-only file."""
    w = Window.partitionBy(key).orderBy(F.desc(place))
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """requests with the cached columns and `cached`; a miss keeps its row."""
    return requests.join(cache.withColumn("_hit", F.lit(True)), key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def append(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of new whose key the cache does not hold, each key once."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


@F.pandas_udf(StringType())
def salvage_json(text: pd.Series) -> pd.Series:
    """The whole text, a fenced block, or the first balanced object in it, as compact JSON; else null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        decoder, t = json.JSONDecoder(), t.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
        at = 0 if t[:1] == "{" else t.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(t, at)
                return json.dumps(value, sort_keys=True) if isinstance(value, dict) else None
            except ValueError:
                at = t.find("{", at + 1) if at else -1
        return None

    return text.map(one)


def validity(text: Column, error: Column) -> Column:
    """error, empty, placeholder or valid, the first that applies."""
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(has_placeholder(text), "placeholder").otherwise("valid")


def label_lines(lines: DataFrame) -> DataFrame:
    """(idx, letter, unsure) of lines `<idx> <LETTER> [?]`; comments and blank lines are skipped.

    The query fails where an idx stands twice.
    """
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(~F.col("p")[0].startswith("#") & (F.col("p")[0] != ""))
    out = p.select(F.try_element_at("p", F.lit(1)).try_cast("int").alias("idx"), F.try_element_at("p", F.lit(2)).alias("letter"), F.coalesce(F.try_element_at("p", F.lit(3)) == "?", F.lit(False)).alias("unsure"))
    once = F.when(F.count("*").over(Window.partitionBy("idx")) == 1, True).otherwise(F.raise_error(F.concat(F.lit("labelled twice: "), F.coalesce(F.col("idx").cast("string"), F.lit("null")))).cast("boolean"))
    return out.withColumn("_once", once).where("_once").drop("_once")


def header_lines(lines: DataFrame, mark: str = "#") -> DataFrame:
    """(value) of the lines that begin with a mark, without it."""
    return lines.where(F.trim("value").startswith(mark)).select(F.trim(F.regexp_replace(F.trim("value"), "^" + mark + "+", "")).alias("value"))


def placed_labels(frame: DataFrame, place: str, labels: DataFrame, letters: DataFrame) -> DataFrame:
    """frame with the label of the line whose idx is a row's place; letters (letter, id) name the labels.

    The query fails where a place has no label, a label no place, or a letter no name.
    """
    named = labels.join(letters.withColumnRenamed("id", "label"), "letter", "left").withColumn("_l", F.lit(1))
    j = frame.withColumn("_f", F.lit(1)).join(named, F.col(place) == F.col("idx"), "full")
    fine = F.coalesce((F.col("_f") == 1) & (F.col("_l") == 1) & F.col("label").isNotNull(), F.lit(False))
    bad = F.concat(F.lit("row "), F.coalesce(F.col(place).cast("string"), F.lit("none")), F.lit(" and label "), F.coalesce(F.concat_ws(" ", F.col("idx").cast("string"), F.col("letter")), F.lit("none")), F.lit(" do not fit"))
    return j.withColumn("_ok", F.when(fine, True).otherwise(F.raise_error(bad).cast("boolean"))).where("_ok").drop("_ok", "_f", "_l", "idx")


def score_lines(lines: DataFrame, top: int = 2) -> DataFrame:
    """(idx, scores, ok) of lines `<idx> a b c d`; ok is false where a score is not in 0..top."""
    p = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(~F.col("p")[0].startswith("#") & (F.size("p") >= 5))
    s = p.select(F.col("p")[0].try_cast("int").alias("idx"), F.transform(F.slice("p", 2, 4), lambda x: x.try_cast("int")).alias("scores"))
    return s.withColumn("ok", F.forall("scores", lambda x: F.coalesce((x >= 0) & (x <= top), F.lit(False))))


def blocks(lines: DataFrame) -> DataFrame:
    """(idx, sha, field, text) of sheets whose items begin with `=== idx (sha) ===`."""
    head = r"^=== (\d+) \(([0-9a-f]+)\) ===$"
    w = Window.partitionBy("sheet").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one sheet
    x = lines.withColumn("h", F.when(F.col("value").rlike(head), F.col("value"))).withColumn("h", F.last("h", ignorenulls=True).over(w))
    x = x.where(F.col("h").isNotNull() & ~F.col("value").rlike(head) & F.col("value").rlike(r"^\w+:"))
    return x.select("sheet", F.regexp_extract("h", head, 1).cast("int").alias("idx"), F.regexp_extract("h", head, 2).alias("sha"), F.regexp_extract("value", r"^(\w+):", 1).alias("field"), F.trim(F.regexp_replace("value", r"^\w+:\s*", "")).alias("text"))


def completion(text: Column, error: Column, finish: Column) -> tuple[Column, Column]:
    """(text, error) of a replayed completion; the first of api error, empty, reasoning and truncated applies.

    The text is stripped of white space and of quotes around it; an invalid one is kept beside its error.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\"“”]+|[\s\"“”]+$", "")
    why = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("api: "), error)).when(t == "", "empty completion").when(looks_like_reasoning(t), "reasoning leak").when(finish == "length", "truncated").otherwise("")
    return t, why


def replayed(requests: DataFrame, cache: DataFrame, key: str = "key", offline: bool = True, ceiling: int | None = None) -> DataFrame:
    """requests with their cached responses; the query fails where one is missing offline, or where
    more are missing than the ceiling of calls allows.

    Cached rows have no latency. Nothing is called: without `offline` a miss keeps its row, to be asked for.
    """
    out = lookup(requests, cache, key).withColumn("latency", F.when(F.col("cached"), 0.0))
    if offline:
        return out.withColumn("cached", F.when(F.col("cached"), True).otherwise(F.raise_error(F.concat(F.lit("no cached response for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")))
    if ceiling is not None:
        misses = out.where(~F.col("cached")).select(key).distinct().limit(ceiling + 1).count()
        if misses > ceiling:
            raise RuntimeError(f"more than {ceiling} calls are needed")
    return out


WAITS = (2, 4, 8, 16, 32)  # seconds before each repeat


def is_transient(status: Column, message: Column) -> Column:
    """Whether a failed call may be repeated: by its HTTP status, or as it timed out or lost its connection."""
    return F.coalesce(status.isin(408, 409, 429) | (status >= 500), F.lit(False)) | F.coalesce(message.rlike("(?i)time(?:d )?-?out|connection"), F.lit(False))


def retries(calls: DataFrame) -> DataFrame:
    """calls (id, attempt, status, message) with `repeat` and `wait`: what is done after each attempt."""
    again = is_transient(F.col("status"), F.col("message")) & (F.col("attempt") <= len(WAITS))
    return calls.withColumn("repeat", again).withColumn("wait", F.when(again, F.element_at(F.array(*map(F.lit, WAITS)), F.col("attempt").cast("int"))))


def assert_families(roles: DataFrame) -> DataFrame:
    """roles (role, model, family) as they are; fails where the judge is of the drafter's family, or either is unknown."""
    f = roles.agg(F.max(F.when(F.col("role") == "drafter", F.col("family"))).alias("d"), F.max(F.when(F.col("role") == "judge", F.col("family"))).alias("j"))
    ok = f.select(F.coalesce(F.col("d") != F.col("j"), F.lit(False)).alias("_ok"))  # one row
    return roles.join(ok).where(F.assert_true(F.col("_ok"), "judge and drafter must be of two known families").isNull()).drop("_ok")


def normalised(raw: DataFrame, tokens: int = 24) -> DataFrame:
    """(key, text, error, finish, logprobs, prompt_tokens, completion_tokens) of raw responses
    (key, choices array of (text, finish, logprobs array), usage (prompt_tokens, completion_tokens), error).

    No choices are an error; only the first `tokens` log probabilities are kept; missing usage is 0.
    """
    c = F.try_element_at("choices", F.lit(1))
    none = (F.coalesce(F.size("choices"), F.lit(0)) <= 0) & (F.coalesce(F.col("error"), F.lit("")) == "")
    return raw.select("key", F.coalesce(c["text"], F.lit("")).alias("text"), F.when(none, "no choices").otherwise(F.coalesce("error", F.lit(""))).alias("error"), c["finish"].alias("finish"), F.slice(F.coalesce(c["logprobs"], F.array().cast("array<double>")), 1, tokens).alias("logprobs"), *(F.coalesce(F.col(f"usage.{k}"), F.lit(0)).alias(k) for k in ("prompt_tokens", "completion_tokens")))


def letter_choice(text: Column, logprobs: Column, letters: str, least_mass: float = 0.5) -> Column:
    """(letter, confidence, posterior) of an answer by letter, from the log probabilities of the first token.

    logprobs maps tokens to log probabilities. Where the options hold at least `least_mass`, their
    probabilities are renormalised and the likeliest, the first on ties, is taken. Otherwise a bare
    letter counts with confidence 1; anything else has no letter and confidence 0.
    """
    options = F.array(*(F.lit(x) for x in letters))
    p = F.transform(options, lambda x: F.coalesce(F.exp(F.try_element_at(logprobs, x)), F.lit(0.0)))
    mass = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    post = F.transform(p, lambda x: x / mass)
    sure = F.coalesce(mass >= least_mass, F.lit(False))
    bare = bare_letter(text, letters[-1])
    letter = F.when(sure, F.element_at(options, F.array_position(post, F.array_max(post)).cast("int"))).otherwise(bare)
    return F.struct(letter.alias("letter"), F.when(sure, F.array_max(post)).when(bare.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.when(sure, post).alias("posterior"))

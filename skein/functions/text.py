"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes that decide results, in the order they apply.
SIGNATURE = r"(?:\s*[\^*/~\-–]\s?[A-Z]{1,3}\d?)+(?:\s*\d{1,2}\s*/\s*\d{1,2})?\s*$"
ENTITY_SHAPES = (
    (r"https?://\S+|\bwww\.\S+", "url"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "email"),
    (r"@\w{1,15}", "user"),
    (r"\b[A-Z]{2}\s?\d{2,4}\b", "flight"),
    (r"\b(?=[A-Z0-9-]*\d)(?=[A-Z0-9-]*[A-Z])[A-Z0-9][A-Z0-9-]{5,}\b", "ref"),
    (r"\+\d[\d\s().-]{7,}\d|\b\d{3}[\s().-]\d{3}[\s.-]\d{4}\b", "phone"),
    (r"\b\d{3,}\b", "num"),
)
MASKS = "<(?:user|url|email|flight|ref|phone|num)>"
PRIVATE_CHANNEL = r"(?i)\b(?:d\.?m\.?s?|direct messages?|private messages?|pm us|inbox us)\b"
CORE_ESCAPES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_signature(text: Column) -> Column:
    """Without a trailing agent signature and part marker; applying it again changes nothing."""
    return F.regexp_replace(F.regexp_replace(text, SIGNATURE, ""), r"\s+$", "")


def mask_entities(text: Column, unicode_classes: bool = True) -> Column:
    """Links, mails, handles, flights, references, phones and numbers become <tokens>."""
    flag = "(?U)" if unicode_classes else ""
    for shape, token in ENTITY_SHAPES:
        text = F.regexp_replace(text, flag + shape, f" <{token}> ")
    return F.trim(F.regexp_replace(text, flag + r"\s+", " "))


def clean(text: Column) -> Column:
    return mask_entities(strip_signature(text))


def has_placeholder(text: Column) -> Column:
    """Whether a mask stands anywhere but in the leading <user>s."""
    return F.regexp_replace(text, r"^\s*(?:<user>\s*)+", "").rlike(MASKS)


def private_channel(text: Column) -> Column:
    return F.coalesce(text.rlike(PRIVATE_CHANNEL), F.lit(False))


def tokens(text: Column, unicode_classes: bool = True) -> Column:
    """Lower-case alphanumeric tokens; an empty array for a text without any, null for null."""
    kind = r"(?U)[^\p{Alnum}]+" if unicode_classes else "[^a-z0-9]+"
    return F.filter(F.split(F.lower(text), kind), lambda t: t != "")


def unescape(text: Column) -> Column:
    """The five core HTML entities; the ampersand comes last so that nothing is unescaped twice."""
    for a, b in CORE_ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cut(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


# How a reply begins that is the model thinking aloud.
REASONING = r"(?i)^\s*(?:okay|ok|alright|let me|let's|first,|the user|we need to|i need to|i should|hmm|so,? the)\b"


def looks_like_reasoning(text: Column) -> Column:
    """Whether a completion is thinking aloud, or holds the end of a thinking block; false for null."""
    return F.coalesce(text.rlike(REASONING) | text.contains("</think>"), F.lit(False))


def old_private_channel(text: Column) -> Column:
    """The narrower predicate of old index builds: it misses the plural, and is kept for comparison."""
    return F.coalesce(text.rlike(r"(?i)\b(?:dm|direct message|private message)\b"), F.lit(False))


def bare_letter(text: Column, last: str = "J") -> Column:
    """The option letter that is all of an answer but punctuation, or null."""
    return F.nullif(F.regexp_extract(text, rf"^\W*([A-{last}])\W*$", 1), F.lit(""))


def one_line(text: Column) -> Column:
    """Text for a cell of a Markdown table: white space in single blanks, bars escaped."""
    return F.trim(F.replace(F.regexp_replace(text, r"\s+", " "), F.lit("|"), F.lit("\\|")))


def as_reason(rule: Column, value: Column, trigger: Column) -> Column:
    """`rule 0.12: "trigger"`, without what is null."""
    return F.concat(rule, F.coalesce(F.concat(F.lit(" "), F.format_string("%.2f", value)), F.lit("")), F.coalesce(F.concat(F.lit(': "'), trigger, F.lit('"')), F.lit("")))


def few_shot(examples: Column) -> Column:
    """Lines `text -> label` of an array of (text, label, score), the most similar last."""
    return F.array_join(F.transform(F.array_sort(F.transform(examples, lambda e: F.struct(e["score"].alias("score"), e["text"].alias("text"), e["label"].alias("label")))), lambda e: F.concat(e["text"], F.lit(" -> "), e["label"])), "\n")

"""Who speaks, and whether a message says anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, invisible joiners included.
BLANKS = r"[\s\x0B\x1C-\x1F\u0085\u00A0\u1680\u180E\u2000-\u200D\u2028\u2029\u202F\u205F\u2060\u3000\uFEFF]+"
LINK = r"(?i)\b(?:https?://|www\.)\S+"
HANDLE = r"@\w+"


def has_content(text: Column) -> Column:
    """Whether anything is left after links, handles and white space are taken away; false for null."""
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LINK, ""), HANDLE, ""), BLANKS, "")
    return F.coalesce(F.length(left) > 0, F.lit(False))


def is_customer(author: Column) -> Column:
    """Customers have all-digit author ids; a null author is not a customer."""
    return F.coalesce(author.rlike(r"^[0-9]+$"), F.lit(False))

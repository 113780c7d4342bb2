"""Reading the several notations of a message's instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """Seconds since 1970 (UTC) of a created_at text, or null where no notation fits.

    Known notations: "Fri Apr 01 00:06:50 +0000 2022" (the weekday is not read, offsets are), and
    ISO 8601 with "T" or a blank, with "Z" or an offset. Anything else is null, as is null.
    """
    t = F.trim(text)
    dump = F.try_to_timestamp(F.substring(t, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy"))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(t))
    return F.when(t.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} \d\d "), F.unix_timestamp(dump)).otherwise(F.unix_timestamp(iso))

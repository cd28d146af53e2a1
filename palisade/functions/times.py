"""Times kept as text: lenient parsing and the form in which they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order, after T, Z and an offset have been dropped.
FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def lenient(text: Column, as_of: Column) -> Column:
    """A time of day without zone; ``as_of`` where the text is none."""
    plain = F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    fraction = F.rpad(F.regexp_extract(plain, r"\.(\d{1,6})\d*$", 1), 6, "0")
    full = F.when(F.instr(plain, ".") > 0, F.concat(F.substring_index(plain, ".", 1), F.lit("."), fraction)).otherwise(plain)
    return F.coalesce(*[F.try_to_timestamp(full, F.lit(f)) for f in FORMATS], as_of)


def shown(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS")


def with_trace(uri: Column, trace: Column) -> Column:
    return F.concat(uri, F.when(uri.contains("?"), "&").otherwise("?"), F.lit("trace="), trace)


def rule_name(text: Column) -> Column:
    """A name that a firewall takes."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.:-]", "_")

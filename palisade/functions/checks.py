"""Whether what a user gives is allowed: names, and the settings of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings that are whole numbers, with their least and greatest value.
RANGES = {"capture_batch_size": (1, 128), "auto_refresh_seconds": (1, 3600), "alert_threshold_high": (1, 100000)}


def is_username(name: Column) -> Column:
    """3 to 32 letters, digits and underscores."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_]{3,32}\z"), F.lit(False))


def whole_number(text: Column) -> Column:
    """A whole number as text may write it: with a sign, and with underscores between digits."""
    return F.when(text.rlike(r"\A\s*[+-]?\d+(_\d+)*\s*\z"), F.regexp_replace(text, r"[\s_+]", "").try_cast("long"))


def ports(text: Column) -> Column:
    """Ports between blanks and commas, each once, in order of appearance, joined by commas; null where one is none or there is none."""
    parts = F.filter(F.split(text, r"[\s,]+"), lambda p: p != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"\A\d+\z") & F.coalesce(p.try_cast("long").between(1, 65535), F.lit(False)))
    return F.when(good, F.array_join(F.array_distinct(F.transform(parts, lambda p: p.try_cast("long").cast("string"))), ","))


def setting(key: Column, value: Column) -> Column:
    """name, value and error of a setting: the value in its plain form, or what is wrong; null where there is no name."""
    key, value = F.trim(key), F.trim(F.coalesce(value, F.lit("None")))
    plain = F.when(key == "monitor_ports", ports(value)).when(key == "sound_alert_enabled", F.when(value.isin("0", "1"), value))
    for name, (low, high) in RANGES.items():
        number = whole_number(value)
        plain = plain.when(key == name, F.when(number.between(low, high), number.cast("string")))
    plain = plain.otherwise(value)
    return F.when(F.length(key) > 0, F.struct(key.alias("name"), plain.alias("value"), F.when(plain.isNull(), F.concat(F.lit("invalid_"), key)).alias("error")))

"""Payloads of captured messages: hexadecimal digits, percent signs, written-out line ends."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Encodings in the order in which a payload's bytes are tried.
ENCODINGS = ("utf-8", "gb18030", "latin1")
# Lines of a dissected body that hold a value.
VALUE_MARKS = ("String value:", "Number value:", "False value", "True value", "Null value")
# What a text has in it, or all consists of, that is taken for a payload in plain text.
TEXT_PATTERNS = (
    r'(?:\{|\}|\[|\]|=|&|:|"|<|>|/|\\n)',
    r"(?i)\b(select|union|drop|insert|update|delete|or\s+1=1|username|password|token)\b",
    r"\A[A-Za-z0-9._~=&%+\-/:;,@\s]{6,}\z",
)
PAYLOAD_LINES = ("REQUEST_BODY=", "RESPONSE_EXCERPT=")
BODY = "\nBody:\n"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def hex_digits(raw: Column) -> Column:
    """The digits of a payload in hexadecimal, four bytes at least, written without separators, or with colons or blanks; null where it is none."""
    colons = raw.rlike(r"\A(?:[0-9A-Fa-f]{2}:)++[0-9A-Fa-f]{2}\z")
    blanks = raw.rlike(r"\A(?:[0-9A-Fa-f]{2}\s++)++[0-9A-Fa-f]{2}\z")
    compact = F.when(colons, F.replace(raw, F.lit(":"), F.lit(""))).when(blanks, F.regexp_replace(raw, r"\s+", "")).otherwise(raw)
    return once(compact, lambda c: F.when(c.rlike(r"\A[0-9A-Fa-f]{8,}\z") & (F.length(c) % 2 == 0), c))


def readable(text: Column) -> Column:
    """Whether at most a tenth of a text are control characters; not so for an empty one."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.coalesce((F.length(text) > 0) & ((F.length(text) - F.length(plain)) * 10 <= F.length(text)), F.lit(False))


@F.pandas_udf(StringType())
def _other_encodings(data: pd.Series) -> pd.Series:
    """Bytes by the first encoding behind UTF-8 that gives a readable text; GB18030 is none that the JVM's decode offers."""

    def one(x: bytes | None) -> str | None:
        for name in ENCODINGS[1:] if x is not None else ():
            try:
                text = x.decode(name)
            except UnicodeDecodeError:
                continue
            if _readable(text):
                return text
        return None

    return data.map(one)


def unhexed(payload: Column) -> Column:
    """A payload in hexadecimal digits as text by the first encoding that gives a readable one; any other payload as it is, trimmed.

    UTF-8 stays in the JVM; only what is none goes to Python.
    """
    data = lambda raw: once(raw, lambda r: F.struct(r.alias("raw"), F.unhex(hex_digits(r)).alias("data")))
    text = lambda d: once(F.try_validate_utf8(d["data"].cast("string")), lambda t: F.when(readable(t), t))
    read = once(data(stripped(payload)), lambda d: F.struct(d["raw"].alias("raw"), d["data"].alias("data"), text(d).alias("text")))
    rest = once(read, lambda x: F.when(x["text"].isNull(), x["data"]))
    return once(F.struct(read.alias("x"), _other_encodings(rest).alias("other")), lambda y: F.coalesce(y["x"]["text"], y["other"], y["x"]["raw"]))


def is_text(text: Column) -> Column:
    return once(stripped(text), lambda s: readable(s) & (s.rlike(TEXT_PATTERNS[0]) | s.rlike(TEXT_PATTERNS[1]) | s.rlike(TEXT_PATTERNS[2])))


def unquoted(text: Column) -> Column:
    """A text without percent escapes and plus signs, if a plain text comes out; a percent sign that begins no escape stays."""
    plain = lambda s: F.when(s.contains("%") | s.contains("+"), F.try_url_decode(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")))
    return once(stripped(text), lambda s: F.coalesce(once(plain(s), lambda p: F.when(is_text(p), p)), s))


def captured(payload: Column) -> Column:
    """A captured body: hexadecimal digits as plain text, escapes undone; where none comes out, the digits."""
    read = once(stripped(payload), lambda r: F.struct(r.alias("raw"), F.unhex(hex_digits(r)).alias("data")))
    text = lambda t: once(unquoted(t), lambda u: F.when(is_text(u), u))
    return once(read, lambda x: F.coalesce(text(F.try_validate_utf8(x["data"].cast("string"))), text(F.decode(x["data"], "ISO-8859-1")), x["raw"]))


def decoded_block(block: Column) -> Column:
    """A message block whose part after the body's mark is decoded."""
    at = F.instr(block, BODY)
    head, tail = F.substring(block, F.lit(1), at + len(BODY) - 1), F.substring(block, at + len(BODY), F.length(block))
    return F.when(at > 0, F.concat(head, unhexed(tail))).otherwise(block)


def _readable(text: str) -> bool:
    bad = sum(ord(c) < 32 and c not in "\t\n\r" or ord(c) == 127 for c in text)
    return bool(text) and bad * 10 <= len(text)


def plain_unhexed(payload: str) -> str:
    """``unhexed`` for one text, for lines inside a text."""
    raw = payload.strip()
    digits = raw
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2}:)+[0-9A-Fa-f]{2}", raw):
        digits = raw.replace(":", "")
    elif re.fullmatch(r"(?:[0-9A-Fa-f]{2}\s+)+[0-9A-Fa-f]{2}", raw):
        digits = "".join(raw.split())
    if not re.fullmatch(r"(?:[0-9A-Fa-f]{2}){4,}", digits):
        return raw
    for name in ENCODINGS:
        try:
            text = bytes.fromhex(digits).decode(name)
        except UnicodeDecodeError:
            continue
        if _readable(text):
            return text
    return raw


@F.pandas_udf(StringType())
def _decoded_lines(texts: pd.Series) -> pd.Series:
    def line(x: str) -> str:
        key = next((k for k in PAYLOAD_LINES if x.startswith(k)), None)
        return key + plain_unhexed(x[len(key) :]) if key else x

    return texts.map(lambda t: None if t is None else "\n".join(map(line, t.split("\n"))))


def unescaped(text: Column) -> Column:
    """Line ends written as one or two backslashes and an n."""
    return F.replace(F.replace(text, F.lit("\\\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))


def normalised_text(text: Column) -> Column:
    """A stored request or response text: line ends undone, backslashes at the ends of lines dropped, payload lines decoded.

    Only texts with a payload in hexadecimal digits go to Python.
    """
    lines = F.regexp_replace(unescaped(text), r"(?m)\\+$", "")
    packed = lines.rlike(rf"(?m)^(?:{'|'.join(PAYLOAD_LINES)})[\s0-9A-Fa-f:]{{8,}}$")
    trimmed = F.regexp_replace(lines, rf"(?m)^({'|'.join(PAYLOAD_LINES)})[ \t]*(.*?)[ \t]*$", "$1$2")
    return F.when(packed, _decoded_lines(F.when(packed, lines))).otherwise(trimmed)


def payload_line(text: Column, key: str) -> Column:
    """What follows ``key`` on the first line that begins with it; null where none does."""
    return F.when(text.rlike(rf"(?m)^{key}"), F.regexp_extract(text, rf"(?m)^{key}([^\n]*)", 1))


def value_lines(block: Column, most: int = 20) -> Column:
    """The first lines of a dissected body that hold values, in one line."""
    found = F.filter(F.split(block, r"\r\n|\r|\n"), lambda x: F.greatest(*[F.instr(x, m) for m in VALUE_MARKS]) > 0)
    return F.array_join(F.transform(F.slice(found, 1, most), stripped), " | ")

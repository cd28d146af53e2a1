"""Full-text retrieval: phrases, BM25 over several columns, and a fallback.

Text is folded (case, and accents by a table of letters that consist of another
one and marks) and split at what is neither letter nor digit. A term of a query is
a phrase of such tokens; its frequency in a document is counted over the indexed
columns. Here one pass over the documents computes lengths and frequencies, which
are written as a few numbers a document; from these one aggregate gives the corpus
statistics, joined as a single row; then scores are a projection and the top k a
TakeOrderedAndProject. ``palisade.plans.fulltext`` has the same searches over an
index, which read the terms' buckets only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.sources.staging import staged

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _marked_letters() -> dict[str, str]:
    """Letters that decompose into another one and combining marks, with that other one."""
    found = {}
    for code in (*range(0xC0, 0xD800), *range(0xF900, 0x10000)):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all("\u0300" <= m <= "\u036f" for m in marks) and not unicodedata.combining(first):
            found[chr(code)] = first
    return found


MARKED = _marked_letters()


def unaccented(text: Column) -> Column:
    """Text without the accents of its letters, whether they are written as one character or as marks; ASCII stays as it is."""
    plain = F.regexp_replace(F.translate(text, "".join(MARKED), "".join(MARKED.values())), "[\u0300-\u036f]", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), plain).otherwise(text)


def folded(text: Column) -> Column:
    """Tokens joined by two spaces, with one at each end, so that neighbours share no space."""
    plain = F.regexp_replace(unaccented(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", "  ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def phrase_tokens(term: str) -> list[str]:
    """The tokens of a query's term."""
    plain = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not "\u0300" <= c <= "\u036f")
    return "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", plain)).split()


def _phrase(term: str) -> str:
    tokens = phrase_tokens(term)
    return f" {'  '.join(tokens)} " if tokens else ""


def query_terms(text: str) -> list[str]:
    """The first 14 different terms of a question."""
    return list(dict.fromkeys(re.findall(r"[a-zA-Z0-9_./:-]{2,}", text.lower())))[:14]


def bm25(docs: DataFrame, terms: list[str], columns: list[str], k: int = 3, id_column: str = "doc_id") -> DataFrame:
    """id, score: the k best documents with one of the terms at least; lower is better, ties by id."""
    phrases = [p for p in dict.fromkeys(map(_phrase, terms)) if p]
    texts = [folded(F.col(c)) for c in columns]
    length = reduce(lambda a, b: a + b, [F.when(F.length(t) > 2, (F.length(t) - F.length(F.replace(t, F.lit("  "), F.lit(" ")))) + 1).otherwise(0) for t in texts])
    hits = [reduce(lambda a, b: a + b, [(F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p) for t in texts]) for p in phrases]
    counted = docs.select(F.col(id_column), length.cast("double").alias("size"), *[h.cast("double").alias(f"f{i}") for i, h in enumerate(hits)])
    counted = staged(counted, "bm25")  # a few numbers a document, so texts are read and folded once, in one projection
    corpus = counted.agg(F.count("*").cast("double").alias("docs"), F.avg("size").alias("mean"), *holding(len(phrases)))
    return ranked(counted, corpus, len(phrases), k, id_column)


def holding(n: int) -> list[Column]:
    """For each of ``n`` terms the number of documents with it."""
    return [F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in range(n)]


def ranked(counted: DataFrame, corpus: DataFrame, n: int, k: int, id_column: str = "doc_id") -> DataFrame:
    """id, score: the k best of ``counted`` (id, size, frequencies f0.. of ``n`` terms); ``corpus`` is one row of docs, mean and n0.."""
    total = F.lit(0.0)
    for i in range(n):
        f, held = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.log((F.col("docs") - held + 0.5) / (held + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        total = total - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    found = reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(n)], F.lit(False))
    return counted.where(found).crossJoin(corpus).select(id_column, total.alias("score")).orderBy("score", id_column).limit(max(1, k))


def with_fallback(docs: DataFrame, terms: list[str], columns: list[str], k: int = 3, id_column: str = "doc_id", ranked: DataFrame | None = None) -> DataFrame:
    """BM25, or where it finds nothing documents that hold the first term as text, with score 0.

    ``ranked``: what an index has found, instead of a scan; documents are then read only if it has found nothing.
    """
    first = (terms or ["login"])[0].lower()
    like = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(first) for c in columns])
    plain = docs.where(like).select(id_column, F.lit(0.0).alias("score")).orderBy(id_column).limit(max(1, k))
    if ranked is not None:
        return plain if ranked.isEmpty() else ranked
    if not any(map(_phrase, terms)):
        return plain
    ranked = bm25(docs, terms, columns, k, id_column)
    some = ranked.agg(F.count("*").alias("found"))
    return ranked.unionByName(plain.crossJoin(some).where("found = 0").drop("found"))


def search(docs: DataFrame, text: str, attack: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the documents that ``found`` gives, newest id first."""
    return found(docs, text, attack).orderBy(F.desc("doc_id")).offset((page - 1) * size).limit(size)


def found(docs: DataFrame, text: str, attack: str | None = None, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Documents with one of the first 14 terms of ``text`` as a phrase in one of the columns, or, without terms, with the text itself; all of them without a text."""
    phrases = [p for p in map(_phrase, query_terms(text)) if p]
    out = docs
    if phrases:
        texts = [folded(F.col(c)) for c in columns]
        out = out.where(reduce(lambda a, b: a | b, [t.contains(p) for t in texts for p in phrases]))
    elif text.strip():
        out = out.where(reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(text.strip().lower()) for c in columns]))
    return out.where(F.col("source") == attack) if attack else out


def total(docs: DataFrame, text: str, attack: str | None = None) -> DataFrame:
    return found(docs, text, attack).agg(F.count("*").alias("total"))


def context(ranked: DataFrame, docs: DataFrame, most: int = 3200, id_column: str = "doc_id", fields: tuple[str, ...] = ("title", "attack_type", "severity", "evidence", "mitigation")) -> DataFrame:
    """One line for each hit with its fields, best first, cut to ``most`` characters in all; hits are the few of a top k."""
    rows = ranked.join(docs, id_column)
    hit = F.struct("score", F.col(id_column), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields]).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(hit)), lambda h, i: F.concat(F.lit("[RAG#"), (i + 1).cast("string"), F.lit("] "), h["line"]))
    return rows.agg(F.substring(F.array_join(lines, "\n"), 1, most).alias("context"))

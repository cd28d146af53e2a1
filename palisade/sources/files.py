"""Readers and writers of the engine's files; all schemas are given, none is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from palisade.sources.canonical import PACKET

ENCODINGS = ("utf-8-sig", "gbk", "latin-1")


def by_first_encoding(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file_id and value of whole text files, decoded by the first encoding that fits."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("file_id"), "content"))


def decoded(raw: DataFrame) -> DataFrame:
    """file_id and value of rows with file_id and content, bytes in one of ``ENCODINGS``; the first that fits counts.

    UTF-8 stays in the JVM; only other contents go to Python.
    """
    utf8 = raw.withColumn("value", F.try_validate_utf8(F.col("content").cast("string")))

    @F.pandas_udf("string")
    def others(content: pd.Series) -> pd.Series:
        return content.map(by_first_encoding)

    known = utf8.where("value IS NOT NULL").select("file_id", F.regexp_replace("value", "^﻿", "").alias("value"))
    return known.unionByName(utf8.where("value IS NULL").select("file_id", others("content").alias("value")))


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; a bad line stops the job, or is dropped if ``tolerant``."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """CSV with a header; with ``lines`` cells may hold line ends, and a file is read by one task."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", lines).csv(path)


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet lines: tab-separated strings; short lines are filled with nulls, long ones cut. A quote left open ends with its line.

    A line whose quotes do not pair up is split at its tabs alone.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    schema = ", ".join(f"{c} string" for c in PACKET)
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    paired = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 0
    split, row = F.split("value", "\t"), F.from_csv("value", F.lit(schema), options)
    cell = lambda i, c: F.nullif(F.when(paired, row[c]).otherwise(F.try_element_at(split, F.lit(i + 1))), F.lit("")).alias(c)
    return lines.select(*[cell(i, c) for i, c in enumerate(PACKET)])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each case counts."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    row = F.from_json("value", "case_id string, file_id string, seq_id int, raw_score double, status string")
    return lines.select(row.alias("r"), "line").where("r.case_id IS NOT NULL").groupBy("r.case_id").agg(F.max_by("r", "line").alias("r")).select("r.*")


def knowledge(spark: SparkSession, path: str, prefix: str = "DOC", forgiving: bool = False) -> DataFrame:
    """Knowledge documents of a JSON array, with defaults for what they lack; ids that are missing begin with ``prefix``.

    A file that is no JSON stops the job, or has no documents if ``forgiving``.
    """
    text = ("title", "tags", "attack_type", "content", "evidence", "mitigation")
    schema = "doc_id string, severity string, source string, " + ", ".join(f"{c} string" for c in text)
    if forgiving:
        read = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
        rows = read.where("_bad IS NULL").drop("_bad")
    else:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a seed file has a few hundred documents
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), other)
    return rows.select(
        blank("doc_id", F.format_string(f"{prefix}-%04d", order)).alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        blank("severity", F.lit("medium")).alias("severity"), blank("source", F.lit("local_seed")).alias("source"),
    )


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """case_id, number and text of case documents in folders b.<n> below ``path``, also as the values of a partition column; other names come last."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    name = F.regexp_extract("path", r"/(?:[^/=]+=)?(b\.[^/]+)/[^/]+$", 1)
    number = F.coalesce(F.regexp_extract("path", r"/(?:[^/=]+=)?b\.(\d+)/[^/]+$", 1).try_cast("long"), F.lit(10**9))
    return rows.select(name.alias("case_id"), number.alias("number"), "value").where("case_id <> ''")


def in_order(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """Files by the number that ends their names, those without one last, then by name."""
    number = F.coalesce(F.regexp_extract("file_id", r"(\d+)$", 1).try_cast("long"), F.lit(10**9))
    return rows.orderBy(number.desc() if newest_first else number, F.col("file_id").desc() if newest_first else F.col("file_id"))


MARK = "\ufeff"  # byte-order mark, by which spreadsheets know UTF-8


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, null fields too, characters as they are."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, sort_columns: bool = False, marked: bool = False, quote_all: bool = True) -> None:
    """CSV with a header: the given columns, all in their order, or all sorted by name.

    ``marked`` puts a byte-order mark before each file's header, and then only quotes cells that need it. An empty table sorted by name has one column ``empty``.
    """
    out = df.select(*columns) if columns else df.select(*sorted(df.columns)) if sort_columns else df
    if sort_columns and df.isEmpty():
        out = df.sparkSession.createDataFrame([], "empty string")
    if marked:
        out = out.withColumnRenamed(out.columns[0], MARK + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("quoteAll", quote_all and not marked).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows, one a day, as one CSV file in order of its days."""
    write_csv(report.orderBy("day").coalesce(1), path, quote_all=False)


def write_cases(cases: DataFrame, manifest: DataFrame, path: str) -> None:
    """Cases as documents, by file, with their request and response texts, and the manifest beside them."""
    document = F.to_json(F.struct(*[c for c in cases.columns if c not in ("raw_request_block", "raw_response_block")]), {"ignoreNullFields": "false"})
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    cases.select("case_id", "file_id", document.alias("case"), blank("raw_request_block"), blank("raw_response_block")).write.mode("overwrite").partitionBy("file_id").parquet(f"{path}/cases")
    write_json_lines(manifest, f"{path}/manifest")


def counted(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """A stage's table and the count of its rows, taken while the table is used."""
    seen = Observation(stage)
    return df.observe(seen, F.count("*").alias("rows")), seen


def enriched(cases: DataFrame, ask, schema: str = "case_id string, analysis string") -> DataFrame:
    """Answers of ``ask(case_id, text)`` for each case, in batches; ``ask`` may call a remote model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"case_id": f["case_id"], "analysis": [ask(i, t) for i, t in zip(f["case_id"], f["text"], strict=True)]})

    return cases.select("case_id", "text").mapInPandas(run, schema)

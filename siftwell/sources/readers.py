"""Sources: tables, foreign databases, JSON in its forms, text files, sheets."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readers by name; each takes (spark, path, **options).
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[name] = function
        return function

    return register


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A source by the name of its kind."""
    if kind not in READERS:
        raise ValueError(f"unknown source {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, path, **options)


@reader("parquet")
def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("jdbc")
def jdbc(spark: SparkSession, path: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query pushed to a database; ``partition`` is (column, low, high, parts) for a parallel read."""
    own = spark.read.format("jdbc").options(url=path, **options)
    if partition is None:
        return own.option("query", query).load()
    column, low, high, parts = partition
    return own.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


@reader("sqlite")
def sqlite(spark: SparkSession, path: str, table: str, parts: int = 4) -> DataFrame:
    """A table of an SQLite file that all executors can open, read-only, in ranges of rows."""
    from siftwell.sources.sqlite import SqliteSource

    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").options(path=path, table=table, parts=str(parts)).load()


@reader("jsonl")
def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Declared columns, and ``_corrupt_record`` for lines that aren't such objects."""
    return parse_lines(spark.read.text(path), "value", schema)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """line_state (ok, blank, malformed) and the declared columns of JSON text, without a second read."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    parsed = F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = lines.withColumn("_j", parsed)
    state = F.when(F.trim(column) == "", "blank").when(F.col("_j").isNull() | F.col("_j._corrupt_record").isNotNull(), "malformed").otherwise("ok")
    return out.select(*lines.columns, state.alias("line_state"), "_j.*").drop("_corrupt_record")


@reader("json")
def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files that are one JSON value each."""
    own = spark.read.option("multiLine", True)
    return (own.schema(schema) if schema else own).json(path)


@reader("text_files")
def text_files(spark: SparkSession, path: str, suffixes: Sequence[str] = (".txt", ".md")) -> DataFrame:
    """path and content of the files with one of the suffixes."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("path", F.input_file_name())
    keep = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(F.lower("path"), s))
    return files.where(keep).select("path", F.col("value").alias("content"))


@reader("manifest")
def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


@reader("yaml")
def yaml_catalog(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A small list kept in one YAML file. It is a driver-side configuration, so it is read there."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("the yaml source needs PyYAML") from missing
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    return spark.createDataFrame(pd.DataFrame(yaml.safe_load(text)[key]), schema)


def lenient(columns: Mapping[str, str]) -> list[Column]:
    """Casts that give null instead of an error."""
    return [F.col(name).try_cast(kind).alias(name) for name, kind in columns.items()]


def quarantine(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Lenient columns, and which of them held a value that could not be cast."""
    bad = F.array_compact(F.array(*(F.when(F.col(n).isNotNull() & F.col(n).try_cast(k).isNull(), F.lit(n)) for n, k in columns.items())))
    return rows.select(*lenient(columns), bad.alias("rejected"))


def joined_fields(names: Sequence[str]) -> Column:
    """Chosen text fields that are there, one to a line."""
    return F.concat_ws("\n", *(F.nullif(F.trim(n), F.lit("")) for n in names))


def redact_keys(column: Column, sensitive: Sequence[str]) -> Column:
    """A map whose values under sensitive keys are replaced."""
    return F.transform_values(column, lambda k, v: F.when(F.lower(k).isin(*sensitive), "[REDACTED]").otherwise(v))


def path_get(column: str, path: str) -> Column:
    """A dotted path into JSON text; numbers are positions."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(column, f"${steps}")


@F.pandas_udf(T.StringType())
def unpack_sheet(payloads: pd.Series) -> pd.Series:
    """Base64 of zlib of UTF-8; null where it is neither."""

    def one(text: str) -> str | None:
        try:
            return zlib.decompress(base64.b64decode(text, validate=True)).decode()
        except (ValueError, zlib.error):
            return None

    return payloads.map(one, na_action="ignore")


def unwrap_callback(column: Column | str) -> Column:
    """The argument of a JSONP call."""
    return F.regexp_extract(column, r"(?s)^\s*[\w.$]+\((.*)\)\s*;?\s*$", 1)


def sheet_rows(payloads: DataFrame, column: str, options: Mapping[str, str]) -> DataFrame:
    """Rows of packed sheets: names in lower case with the labels of their options, merged by name."""
    rows = payloads.select(F.explode(F.from_json(unpack_sheet(column), "array<struct<name:string,options:array<string>>>")).alias("r"))
    labels = F.create_map(*(F.lit(x) for pair in options.items() for x in pair))
    named = rows.select(F.lower("r.name").alias("name"), F.explode_outer("r.options").alias("o"))
    return named.groupBy("name").agg(F.array_sort(F.collect_set(F.coalesce(F.try_element_at(labels, "o"), F.col("o")))).alias("labels"))


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def capture_resume(pages: DataFrame, source: str, page: str, total: str) -> DataFrame:
    """For each source the page before the first one whose stated total changed (null if none did), and its last page so far."""
    own = pages.withColumn("_before", F.lag(total).over(Window.partitionBy(source).orderBy(page)))
    changed = F.min(F.when(F.col(total) != F.col("_before"), F.col(page)))
    return own.groupBy(source).agg((changed - 1).alias("reread_from"), F.max(page).alias("next_page"))


def after_cursor(rows: DataFrame, cursors: DataFrame, box: str, validity: str, uid: str) -> DataFrame:
    """Rows beyond the cursor of their box (box, validity, last_uid). Another validity, or no cursor, means from the beginning."""
    known = cursors.select(box, F.col(validity).alias("_v"), F.col("last_uid").alias("_last"))
    start = F.when(F.col("_v") == F.col(validity), F.col("_last")).otherwise(0)
    return rows.join(known, box, "left").where(F.col(uid) > start).select(*rows.columns)


def read_traces(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Trace rows of several recorders together, with the file each came from; broken lines are kept in _corrupt_record."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(list(paths)).withColumn("trace_file", F.input_file_name())

"""Sinks: snapshots that appear whole or not at all, traces, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """A version of a table in a folder of its own; Spark's commit marks it complete. Writing it again replaces it."""
    path = f"{folder}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The highest complete version; one that was interrupted has no mark and isn't seen."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS"))
    versions = sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done)
    if not versions:
        raise FileNotFoundError(f"no complete version in {folder}")
    return spark.read.parquet(f"{folder}/version={versions[-1]}")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, replaced as a whole: written beside the path first; then the old ones are renamed aside, the new ones in, and the old ones go.

    A reader sees the old lines, or for a moment none, or the new ones, never half of them. A run that fails leaves the old ones, also where
    the second rename does; after a crash between the renames they are in ``<path>.<hex>.old``, whole, from where ``restore_lines`` brings them back.
    """
    mark = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(f"{mark}.tmp")
    jvm = df.sparkSession.sparkContext._jvm
    new, old, own = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{mark}.tmp", f"{mark}.old", path))
    fs = own.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(own)
    if there and not fs.rename(own, old):
        raise OSError(f"{path} could not be renamed aside")
    if not fs.rename(new, own):
        if there:
            fs.rename(old, own)
        raise OSError(f"{mark}.tmp could not be renamed to {path}")
    if there:
        fs.delete(old, True)


def restore_lines(spark: SparkSession, path: str) -> bool:
    """Bring back what a crash between two renames left aside; whether there was anything. Lines that are in their place stay."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(own):
        return False
    aside = sorted(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.*.old")), key=lambda s: s.getModificationTime())
    return bool(aside) and bool(fs.rename(aside[-1].getPath(), own))


def append_trace(df: DataFrame, path: str, secret: Sequence[str] = ()) -> None:
    """Trace rows as JSON lines; secret columns are redacted before they leave."""
    df.withColumns({c: F.lit("[REDACTED]") for c in secret if c in df.columns}).write.mode("append").json(path)


def report_json(df: DataFrame, limit: int = 10_000) -> str:
    """A small report as JSON with sorted keys and rows; more than ``limit`` rows are an error, not a cut."""
    rows = df.limit(limit + 1).toPandas().to_dict("records")
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    return json.dumps(sorted(rows, key=lambda r: json.dumps(r, default=str, sort_keys=True)), default=str, ensure_ascii=False, sort_keys=True, indent=2)


def report_markdown(df: DataFrame, title: str, limit: int = 10_000) -> str:
    """A small report as a Markdown table, in the order of its first column."""
    rows = df.orderBy(*df.columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"

"""Operator 12: lines that many documents share, by levelled sorted runs of line hashes. Built-in functions only.

A line's key is the MD5 of the line without ASCII white space at its ends and with A-Z lower-cased; keys of shorter lines aren't
kept. A *run* is a Parquet table of key, n (documents that hold it) and top (the document that keeps it), bucketed by key and
sorted within the buckets, so that two runs meet bucket by bucket in a merge join, without an exchange.

``LineRuns`` holds the runs of a folder in levels. Each new batch of documents is reduced to its distinct keys, which
merge-anti-join the runs: a key without a partner is the batch's own and gets the batch's largest document as ``top``; of a
known one only the count is news. The result is added as a run of level 0. Two runs of one level are compacted to one of the next
level by a full merge join, so a batch meets about log2(batches) runs. Batches come in the order of their precedence.

A run is complete when Spark's commit has marked it. Its name holds the numbers of its batches: a batch that is added again after
a failure is known by its number, and of a compaction that stopped half-way either the old runs or the new one count.

``drop_shared_lines`` adds a table's batches from the largest ids down, keeps the keys with enough documents and takes the lines
away from all but the largest document. Frequent keys are broadcast up to ``BROADCAST`` of them, beyond it they meet the lines in a
merge join, whose hot keys Spark's skew handling splits (the keys' side has each key once).

Defined results: null or empty text is one empty line. Rows that share an id are one document; each is cut by itself. A row with
null id neither counts nor changes. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import cut_lineage, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
BROADCAST = 200_000
RUN = re.compile(r"run-(\d+)-(\d+)-(\d+)-(\d+)")


def stripped(line: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.trim(line, F.lit(BLANK))


def folded(line: Column) -> Column:
    """A-Z lower-cased; where all is ASCII the faster ``lower`` does the same."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(docs: DataFrame, id_col: str, text_col: str, least: int, *more: Column) -> DataFrame:
    """id, pos and key of the lines of at least ``least`` code points of documents with an id."""
    own = docs.where(F.col(id_col).isNotNull() & (F.char_length(text_col) >= least))
    own = own.select(F.col(id_col).cast("long").alias("id"), *more, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    own = own.withColumn("line", stripped(F.col("line"))).where(F.char_length("line") >= least)
    return own.withColumn("key", F.unhex(F.md5(folded(F.col("line"))))).drop("line")


class LineRuns:
    """The levelled runs of a folder that all executors share. ``open`` finds those that are there."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, int, int, str]] = []  # level, first and last batch, table
        self.mark = uuid.uuid4().hex

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int | None = None) -> LineRuns:
        self = cls(spark, folder, buckets)
        found = []
        for name in self._complete():
            level, first, last, n = map(int, RUN.fullmatch(name).groups())
            found.append((level, first, last, n))
        for level, first, last, n in sorted(found):
            if any(a <= first and last <= b and (a, b) != (first, last) for _, a, b, _ in found):
                continue  # has been compacted
            self.buckets = n
            table = self._table(level, first, last)
            self.spark.sql(
                f"CREATE TABLE {table} (key BINARY, n BIGINT, top BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{self._path(level, first, last)}'"
            )
            self.runs.append((level, first, last, table))
        self.runs.sort(key=lambda r: r[1])
        return self

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, top, top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> list[str]:
        jvm, _, fs = self._fs()
        marks = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run-*/_SUCCESS")) or []
        return [n for m in marks if RUN.fullmatch(n := m.getPath().getParent().getName())]

    def _path(self, level: int, first: int, last: int) -> str:
        return f"{self.folder}/run-{level}-{first}-{last}-{self.buckets}"

    def _table(self, level: int, first: int, last: int) -> str:
        return f"line_run_{self.mark}_{level}_{first}_{last}"

    def _drop(self, run: tuple[int, int, int, str]) -> None:
        jvm, _, fs = self._fs()
        self.spark.sql(f"DROP TABLE IF EXISTS {run[3]}")
        fs.delete(jvm.org.apache.hadoop.fs.Path(self._path(*run[:3])), True)

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> None:
        table = self._table(level, first, last)
        rows.select("key", "n", "top").write.format("parquet").mode("overwrite").bucketBy(self.buckets, "key").sortBy("key").option(
            "path", self._path(level, first, last)
        ).saveAsTable(table)
        self.runs.append((level, first, last, table))

    def add(self, docs: DataFrame, number: int, id_col: str = "doc_id", text_col: str = "text", least: int = 40) -> None:
        """One more batch. Its number must be higher than those before; one that is there already is left alone."""
        if any(first <= number <= last for _, first, last, _ in self.runs):
            return
        if any(last > number for _, _, last, _ in self.runs):
            raise ValueError("batches are added in the order of their numbers")
        # a document counts once for a key; both aggregates combine before their exchange, so a frequent line sends a row a task
        own = lines_of(docs, id_col, text_col, least).select("id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
        known = F.lit(False)
        for at, (_, _, _, table) in enumerate(self.runs):
            run = self.spark.table(table).select("key", F.lit(True).alias(f"in_{at}"))
            own = own.join(run.hint("merge"), "key", "left")
            known = known | F.coalesce(F.col(f"in_{at}"), F.lit(False))
        self._write(own.withColumn("top", F.when(~known, F.col("top"))), 0, number, number)
        self._compact()

    def _compact(self) -> None:
        """Two neighbours of one level become one of the next, as long as there are two."""
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            old, new = self.runs[-2], self.runs[-1]
            a, b = (self.spark.table(r[3]).select("key", F.col("n").alias(f"n{i}"), F.col("top").alias(f"top{i}")) for i, r in enumerate((old, new)))
            both = a.join(b.hint("merge"), "key", "full")
            merged = both.select("key", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"), F.coalesce("top0", "top1").alias("top"))
            self.runs = self.runs[:-2]
            self._write(merged, old[0] + 1, old[1], new[2])
            for run in (old, new):
                self._drop(run)

    def totals(self) -> DataFrame:
        """key, n and top over all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n long, top long")
        if len(self.runs) == 1:
            return self.spark.table(self.runs[0][3])
        rows = None
        for _, _, _, table in self.runs:
            rows = self.spark.table(table) if rows is None else rows.unionAll(self.spark.table(table))
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))  # one run alone has the key's top

    def remove(self) -> None:
        """The whole index, tables and files."""
        for run in self.runs:
            self._drop(run)
        _, top, fs = self._fs()
        fs.delete(top, True)
        self.runs = []


def batches_by_id(docs: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """Ranges of ids of about equal counts, the largest ids first."""
    shares = [i / batches for i in range(1, batches)]
    at = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares).alias("at")).first().at or []
    edges = sorted(set(at), reverse=True)
    key = F.col(id_col)
    if not edges:
        return [docs]
    out = [docs.where(key > edges[0])]
    out += [docs.where((key <= high) & (key > low)) for high, low in zip(edges[:-1], edges[1:], strict=True)]
    return [*out, docs.where(key <= edges[-1])]


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5, batches: int = 4, broadcast: int = BROADCAST
) -> DataFrame:
    """id, n_lines, n_dropped, kept (lines that stay, joined by a line feed) of every row.

    Lines whose key has at least ``least`` code points and stands in at least ``documents`` documents stay in the largest of these only.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = LineRuns(own.sparkSession, f"{shared_folder(own.sparkSession)}/lines-{uuid.uuid4().hex}")
    try:
        for number, batch in enumerate(batches_by_id(own, "id", batches)):
            index.add(batch, number, "id", "text", least)
        frequent = cut_lineage(index.totals().where(F.col("n") >= documents).select("key", "top"))
    finally:
        index.remove()
    if frequent.count() <= broadcast:
        frequent = F.broadcast(frequent)
    found = lines_of(own, "id", "text", least, F.md5("text").alias("mark")).join(frequent, "key").where("id <> top")
    gone = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # the stretches between dropped lines, each from its first line to before its last one
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    stay = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice("lines", r["a"] + 1, r["b"] - r["a"])))
    out = own.withColumn("mark", F.md5("text")).join(gone, ["id", "mark"], "left").withColumn("lines", lines)
    return out.select(
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept"),
    )


ORACLE = """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
    l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    g AS (SELECT k.*, coalesce(doc_id <> top, false) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
    FROM g GROUP BY r, doc_id"""

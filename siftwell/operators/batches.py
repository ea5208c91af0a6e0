"""Greedy batches in order: a batch closes before the row that would exceed its rows or its size; a row over the size stands alone.

Where a batch ends depends on where it began, so the plain rule is one loop. Here each row points to the row that would begin the next batch
(binary search in the running sums), and pointer jumping in blocks of rows follows the pointers: a block's pointers lead at most ``most`` rows
into the next one, so a block is summed up by what each of its first ``most`` rows as a beginning leads to: which row of the next block,
after how many batches. Only these short tables are gone through in order, one step a block. A long group is many blocks on many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import cut_lineage

BLOCK = 8192


def positions(rows: DataFrame, group: str, order: Sequence[str], size: str) -> DataFrame:
    """Adds ``_at``, a row's number in its group from 0, and ``_before``, the sizes ahead of it. Long groups are cut by ranges of the order."""
    part = F.spark_partition_id()
    cut = cut_lineage(rows.repartitionByRange(F.col(group).asc(), *map(F.asc, order)).withColumn("_part", part))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    ahead = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    base = totals.select(group, "_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_n", "_s")))
    inner = cut.withColumn("_row", F.row_number().over(own) - 1).withColumn("_sum", F.sum(size).over(own) - F.col(size))
    out = inner.join(base.withColumnRenamed(group, "_g").withColumnRenamed("_part", "_p"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.select(*rows.columns, (F.col("_row") + F.col("_n")).cast("long").alias("_at"), (F.col("_sum") + F.col("_s")).cast("long").alias("_before"))


def successors(before: np.ndarray, sizes: np.ndarray, most: int, limit: int) -> np.ndarray:
    """For each row the one that begins the next batch if it begins one (the number of rows: none of these)."""
    n = len(before)
    after = before + sizes
    by_size = np.searchsorted(after, before + limit, side="right")
    return np.maximum(np.arange(n) + 1, np.minimum(by_size, np.minimum(np.arange(n) + most, n)))


def jumps(follow: np.ndarray, end: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first rows as beginnings: the first beginning at or behind ``end``, and how many there are before it."""
    n = len(follow)
    to = np.append(np.where(np.arange(n) < end, follow, np.arange(n)), n)
    count = np.append((np.arange(n) < end).astype(np.int64), 0)
    while (to[:end] < end).any():
        count, to = count + count[to], to[to]
    return to[:entries], count[:entries]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one (group, block) each, from rows sorted by these and by at."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        marks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        edges = [i for i in range(len(marks)) if marks[i] != (marks[i - 1] if i else key)]
        for a, b in zip([0, *edges], [*edges, len(marks)], strict=True):
            if a in edges and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        key = marks[-1] if marks else key
    if held:
        yield pa.Table.from_batches(held)


def _read(rows: pa.Table, block: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    at, before, sizes = (rows[c].to_numpy() for c in ("at", "before", "size"))
    number = rows["block"][0].as_py()
    return number, before, sizes, int(np.searchsorted(at, (number + 1) * block))


def _summed(block: int, most: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            number, before, sizes, end = _read(rows, block)
            to, count = jumps(successors(before, sizes, most, limit), end, min(most, end))
            columns = [rows["grp"].slice(0, 1).combine_chunks(), pa.array([number]), pa.array([(to - end).tolist()], pa.list_(pa.int64())), pa.array([count.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "block", "to", "count"])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each block's first beginning is and how many batches began before it; blocks come in order, one short step each."""
    entry = base = 0
    for batch in batches:
        entries, bases = [], []
        for number, to, count in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if number == 0:
                entry = base = 0
            entries.append(entry)
            bases.append(base)
            if entry < len(to):
                entry, base = to[entry].as_py(), base + count[entry].as_py()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64()), pa.array(bases, pa.int64())], names=["grp", "block", "entry", "base"])


def _marked(block: int, most: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            _, before, sizes, end = _read(rows, block)
            follow = successors(before, sizes, most, limit).tolist()
            begins = np.zeros(end, np.int64)
            i = rows["entry"][0].as_py()
            while i < end:
                begins[i] = 1
                i = follow[i]
            own = rows.slice(0, end).combine_chunks()
            batch = rows["base"][0].as_py() - 1 + np.cumsum(begins)
            yield from pa.table([own["grp"], own["at"], pa.array(batch)], names=["grp", "at", "batch"]).combine_chunks().to_batches()

    return run


def greedy_batches(rows: DataFrame, group: str, order: Sequence[str], size: str | Column, most: int, limit: int, block: int = BLOCK) -> DataFrame:
    """The rows with ``batch``, its number in the group from 0. ``order`` is unique within a group; a null size counts as 0.

    Sizes are whole numbers from 0 on; ``most`` is the largest number of rows in a batch, ``limit`` its largest size.
    """
    if not 0 < most <= block or limit < 0:
        raise ValueError("limits must be positive, and most at most the block")
    columns = rows.columns
    sized = rows.withColumn("_size", F.coalesce((F.col(size) if isinstance(size, str) else size).cast("long"), F.lit(0)))
    placed = cut_lineage(positions(sized, group, list(order), "_size"))
    names = (F.col("_at").alias("at"), F.col("_before").alias("before"), F.col("_size").alias("size"))
    narrow = placed.select(F.col(group).alias("grp"), F.floor(F.col("_at") / block).cast("long").alias("block"), *names)
    halo = narrow.where((F.col("block") > 0) & (F.col("at") % block < most)).withColumn("block", F.col("block") - 1)
    both = narrow.unionAll(halo)
    kind = narrow.schema["grp"].dataType.simpleString()
    by_block = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")
    sums = by_block.mapInArrow(_summed(block, most, limit), f"grp {kind}, block long, to array<long>, count array<long>")
    begun = cut_lineage(sums.repartition("grp").sortWithinPartitions("grp", "block").mapInArrow(_chained, f"grp {kind}, block long, entry long, base long"))
    told = both.join(begun.withColumnRenamed("grp", "_g").withColumnRenamed("block", "_b"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    marked = told.repartition("grp", "block").sortWithinPartitions("grp", "block", "at").mapInArrow(_marked(block, most, limit), f"grp {kind}, at long, batch long")
    marked = marked.select(F.col("grp").alias("_g"), F.col("at").alias("_a"), F.col("batch").alias("_b"))
    met = placed.join(marked, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_a")))
    return met.select(*(c for c in columns if c != "batch"), F.col("_b").alias("batch"))

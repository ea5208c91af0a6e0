"""Event logs that accept each event once, in rising sequence and along allowed transitions; as a stream and over a stored log.

An event has an operation, an event id, a sequence (null: the next one), a status, and content that an event id stands for. In the order of arrival
an operation's event is

* ``repeated`` if its id was accepted with the same sequence (or none given), status and content, ``conflict`` if with another;
* ``stale`` if its sequence isn't higher than that of the last accepted event;
* ``illegal`` if its status can't follow the operation's present one;
* else ``accepted``, and its status and sequence are the operation's from then on. What isn't accepted leaves no trace.

Event ids are unique within an operation. ``decide`` is the rule itself, a small loop in arrival order over one operation's rows; the state
that it carries is two scalars and the accepted ids that may come again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a log's columns must be called; content is any digest of what an event says.
COLUMNS = ("operation", "event_id", "arrival", "sequence", "status", "content")
OUT = "operation long, event_id string, arrival long, sequence long, outcome string"
#: Groups that a stream's operations share; a stream keeps it for as long as its checkpoint lives.
SHARDS = 4096
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide(rows: Iterator[tuple], state: tuple[str | None, int], known, remember, allowed: Mapping[str | None, frozenset[str]]):
    """Outcome and sequence for each (event id, sequence, status, content), and at last the new state.

    ``state``: present status (None at the beginning) and last sequence. ``known(id)`` gives the (sequence, status, content) that an id was
    accepted with, or None; ``remember(id, them)`` keeps it.
    """
    status, last = state
    out = []
    for event, sequence, new, content in rows:
        before = known(event)
        if before is not None:
            same = before[1:] == (new, content) and sequence in (None, before[0])
            out.append(("repeated" if same else "conflict", before[0] if same else sequence))
            continue
        at = last + 1 if sequence is None else sequence
        if at <= last:
            out.append(("stale", sequence))
        elif new not in allowed.get(status, frozenset()):
            out.append(("illegal", sequence))
        else:
            status, last = new, at
            remember(event, (at, new, content))
            out.append(("accepted", at))
    return out, (status, last)


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    sequences = [None if pd.isna(s) else int(s) for s in frame["sequence"]]
    return zip(frame["event_id"].tolist(), sequences, frame["status"].tolist(), frame["content"].tolist(), strict=True)


class Blocks:
    """An operation's accepted ids in the state, many to an entry.

    Generation g has ``SPREAD`` ** g blocks and takes ``BLOCK`` ids for each of them; when it is full the next begins, so no block is ever split.
    An id's block in a generation is its crc32. An id is looked up in each generation that has begun, about the logarithm of their number.
    ``n``: accepted ids; blocks that were read or changed are held until ``write``, which comes after ``HELD`` of them at the latest.
    """

    BLOCK, SPREAD, HELD = 64, 8, 512

    def __init__(self, state, operation: int, n: int):
        self.state, self.operation, self.n, self.written = state, operation, n, n
        self.held: dict[tuple[int, int], dict] = {}
        self.changed: set[tuple[int, int]] = set()

    def block(self, generation: int, start: int, event: str) -> tuple[tuple[int, int], dict]:
        at = (generation, zlib.crc32(event.encode()) % self.SPREAD**generation)
        if at not in self.held:
            if len(self.held) >= self.HELD:
                self.write()
            key = (self.operation, *at)
            self.held[at] = json.loads(self.state.getValue(key)[0]) if start < self.written and self.state.containsKey(key) else {}
        return at, self.held[at]

    def starts(self, upto: int) -> Iterator[tuple[int, int]]:
        """Generations that hold some of the first ``upto`` ids, and the number of ids before each."""
        generation = start = 0
        while start < upto:
            yield generation, start
            start += self.BLOCK * self.SPREAD**generation
            generation += 1

    def known(self, event: str) -> tuple | None:
        for generation, start in self.starts(self.n):
            own = self.block(generation, start, event)[1]
            if event in own:
                return tuple(own[event])
        return None

    def remember(self, event: str, accepted: tuple) -> None:
        *_, (generation, start) = self.starts(self.n + 1)
        at, own = self.block(generation, start, event)
        own[event] = accepted
        self.changed.add(at)
        self.n += 1

    def write(self) -> None:
        for at in self.changed:
            self.state.updateValue((self.operation, *at), (json.dumps(self.held[at]),))
        self.held, self.changed, self.written = {}, set(), self.n


class Expiring:
    """An operation's accepted ids in the state, an entry each, as each expires for itself."""

    def __init__(self, state, operation: int, n: int):
        self.state, self.operation, self.n, self.fresh = state, operation, n, {}

    def known(self, event: str) -> tuple | None:
        if event in self.fresh or not self.n:
            return self.fresh.get(event)
        return tuple(self.state.getValue((self.operation, event))) if self.state.containsKey((self.operation, event)) else None

    def remember(self, event: str, accepted: tuple) -> None:
        self.fresh[event] = accepted

    def write(self) -> None:
        for event, accepted in self.fresh.items():
            self.state.updateValue((self.operation, event), accepted)
        self.n += len(self.fresh)


class EventLog(StatefulProcessor):
    """State of a shard of operations: status, last sequence and number of accepted ids of each; the ids, each forgotten ``keep_ms`` after it came."""

    def __init__(self, allowed: Mapping[str | None, frozenset[str]], keep_ms: int | None):
        self.allowed, self.keep_ms = dict(allowed), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getMapState("heads", "operation long", "status string, last long, n long")
        if self.keep_ms:
            self.ids = handle.getMapState("ids", "operation long, event_id string", "sequence long, status string, content string", self.keep_ms)
        else:
            self.ids = handle.getMapState("ids", "operation long, generation int, block int", "ids string")

    def append(self, operation: int, rows: Iterator[tuple]) -> list[tuple]:
        """Outcomes of one operation's rows of a micro-batch."""
        status, last, n = self.heads.getValue((operation,)) if self.heads.containsKey((operation,)) else (None, 0, 0)
        ids = (Expiring if self.keep_ms else Blocks)(self.ids, operation, n)
        out, state = decide(rows, (status, last), ids.known, ids.remember, self.allowed)
        ids.write()
        if ids.n > n:
            self.heads.updateValue((operation,), (*state, ids.n))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["operation", "arrival"], kind="stable")  # one micro-batch of one shard
        out = []
        for operation, own in groupby(zip(frame["operation"].tolist(), _rows(frame), strict=True), key=lambda r: r[0]):
            out += self.append(operation, (r for _, r in own))
        names = ["operation", "event_id", "arrival"]
        yield frame[names].reset_index(drop=True).assign(sequence=pd.array([s for _, s in out], "Int64"), outcome=[o for o, _ in out])

    def close(self) -> None:
        pass


def append_stream(events: DataFrame, allowed: Mapping[str | None, frozenset[str]], keep_ms: int | None = None) -> DataFrame:
    """Outcomes of a stream of events. Its session needs the state store that ``PROVIDER`` names.

    The state lives in the stream's checkpoint, so a stop between micro-batches changes nothing. ``keep_ms`` lets ids expire. Operations share
    ``SHARDS`` groups by a hash, as a call and its frames cost some milliseconds each; a shard's rows of a micro-batch are held at once. Rows
    without an operation are left out.
    """
    mode = "ProcessingTime" if keep_ms else "None"
    shard = F.pmod(F.xxhash64("operation"), F.lit(SHARDS)).alias("shard")
    own = events.where("operation is not null").select(shard, *COLUMNS)
    return own.groupBy("shard").transformWithStateInPandas(EventLog(allowed, keep_ms), OUT, "Append", mode)


def _folded(allowed: Mapping[str | None, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ids = None, (None, 0), {}
        for batch in batches:
            frame = batch.to_pandas()
            outcomes = []
            for operation, own in frame.groupby("operation", sort=False, dropna=False):
                if operation != key:
                    key, state, ids = operation, (None, 0), {}
                again = set(own.loc[own["again"], "event_id"])
                keep = lambda e, v, again=again: ids.__setitem__(e, v) if e in again else None
                out, state = decide(_rows(own), state, ids.get, keep, allowed)
                outcomes += out
            names = ("operation", "event_id", "arrival")
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array([s for _, s in outcomes], pa.int64()), pa.array([o for o, _ in outcomes], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence", "outcome"])

    return run


def append_log(events: DataFrame, allowed: Mapping[str | None, frozenset[str]]) -> DataFrame:
    """Outcomes of a stored log, the same as the stream's without expiry.

    Rows are partitioned by operation and sorted by arrival; a task goes through them in Arrow batches and holds nothing of an operation but its
    state and the accepted ids that its log holds more than once, which are marked beforehand. Rows without an operation are left out.
    """
    own = events.where("operation is not null").select(*COLUMNS)
    ids = own.groupBy("operation", "event_id").agg(F.count("*").alias("n")).where("n > 1").select("operation", "event_id", F.lit(True).alias("again"))
    marked = own.join(ids, ["operation", "event_id"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    ordered = marked.repartition("operation").sortWithinPartitions("operation", "arrival")
    return ordered.mapInArrow(_folded(allowed), OUT)


def heads(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """operation, sequence and status of the last accepted event, one row an operation."""
    last = outcomes.where("outcome = 'accepted'").withColumn("_n", F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("sequence")))).where("_n = 1")
    return last.select("operation", "arrival", "sequence").join(events.select("operation", "arrival", "status"), ["operation", "arrival"]).drop("arrival")

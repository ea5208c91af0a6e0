"""Leases as the state of a stream: claims that end by themselves when their owner says nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream's columns must be called; kind is claim, renew, done or failed.
COLUMNS = ("item", "owner", "kind")
OUT = "item string, owner string, outcome string, attempts int"


class Leases(StatefulProcessor):
    """Of an item: who holds it (or None), until when, how often it was claimed, whether it is done; and a timer at the end of the lease."""

    def __init__(self, lease_ms: int, most: int):
        self.lease_ms, self.most = lease_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "owner string, until long, attempts int, done boolean")

    def _hold(self, owner: str, now: int, attempts: int) -> None:
        self.lease.update((owner, now + self.lease_ms, attempts, False))
        self.handle.registerTimer(now + self.lease_ms)

    def _decide(self, owner: str, kind: str, now: int) -> tuple[str, int]:
        holder, until, attempts, done = self.lease.get() if self.lease.exists() else (None, 0, 0, False)
        held = holder is not None
        if kind == "claim":
            if done:
                return "finished", attempts
            if held:
                return ("held" if holder == owner else "busy"), attempts
            if attempts >= self.most:
                return "exhausted", attempts
            self._hold(owner, now, attempts + 1)
            return "claimed", attempts + 1
        if not held or holder != owner:
            return "lost", attempts
        self.handle.deleteTimer(until)
        if kind == "renew":
            self._hold(owner, now, attempts)
            return "renewed", attempts
        self.lease.update((None, 0, attempts, kind == "done"))
        return kind, attempts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            out = [row for o, k in zip(frame["owner"], frame["kind"], strict=True) for row in (*self._over(now), (o, *self._decide(o, k, now)))]
            yield self._frame(key, out)

    def _over(self, now: int) -> list[tuple]:
        """The row of a lease that ran out, once: whichever comes first, its timer or another request."""
        holder, until, attempts, done = self.lease.get() if self.lease.exists() else (None, 0, 0, False)
        if holder is None or now < until:
            return []
        self.handle.deleteTimer(until)
        self.lease.update((None, 0, attempts, done))
        return [(holder, "expired", attempts)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._over(timerValues.getCurrentProcessingTimeInMs())
        if out:
            yield self._frame(key, out)

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["owner", "outcome", "attempts"]).astype({"attempts": "int32"})
        out.insert(0, "item", key[0])
        return out

    def close(self) -> None:
        pass


def lease_stream(requests: DataFrame, lease_ms: int = 180_000, most: int = 5) -> DataFrame:
    """What becomes of each request, and a row ``expired`` for each lease that ran out, which needs no further event.

    A claim is ``claimed`` where nobody holds the item, ``held`` by its owner already, ``busy`` with another, ``exhausted`` after ``most`` attempts or
    ``finished`` once it is done. Renewals and ends are taken from the holder within its lease only, else they are ``lost``: an owner that comes back
    too late can't end another's work. Times are those of processing, one for each micro-batch; requests of one item within a batch count in the
    order of delivery. State is in the stream's checkpoint; the session needs the state store that ``eventlog.PROVIDER`` names.
    """
    own = requests.select(*COLUMNS).where("item is not null")
    return own.groupBy("item").transformWithStateInPandas(Leases(lease_ms, most), OUT, "Append", "ProcessingTime")

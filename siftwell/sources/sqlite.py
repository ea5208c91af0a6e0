"""A read-only SQLite source: columns are discovered, rows are read in ranges of rowid."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary", "BOOL": "boolean"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return [(r[1], next((kind for part, kind in _KINDS.items() if part in r[2].upper()), "string")) for r in found]

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("parts", "4")), [n for n, _ in self._columns()])


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, columns: list[str]):
        self.path, self.table, self.parts, self.columns = path, table, max(1, parts), columns

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        con = _open(self.path)
        try:
            yield from con.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        finally:
            con.close()

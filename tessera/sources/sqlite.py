"""A read-only Spark data source for tables of SQLite files, split by row id.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("table", name).load()

The file must be on storage that every executor mounts. Views and tables without row ids are read as one
partition. With the option ``pushdown`` comparisons with numbers reach SQLite; Spark asks that
``spark.sql.python.filterPushdown.enabled`` be set for it.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.execute("PRAGMA query_only = ON")
    return con


def _kind(declared: str) -> DataType:
    """SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(k in d for k in ("REAL", "FLOA", "DOUB")) else StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], splits: int):
        self.path, self.table, self.names, self.splits = path, table, names, splits
        self.tests: list[tuple[str, int | float]] = []

    def partitions(self) -> list[InputPartition]:
        con = _open(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            split = low is not None
        except sqlite3.OperationalError:  # a table without row ids
            split = False
        if not split:  # so has a view, whose row ids are null, as an empty table's are
            some = con.execute(f"SELECT EXISTS (SELECT 1 FROM {_quoted(self.table)})").fetchone()[0]
        con.close()
        if not split:
            return [Range(None, None)] if some else []
        step = max(1, -(-(high - low + 1) // self.splits))
        return [Range(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands out where a table is empty
            return
        low, high = partition.value
        tests = self.tests + ([] if low is None else [("rowid >= ?", low), ("rowid < ?", high)])
        where = " WHERE " + " AND ".join(t for t, _ in tests) if tests else ""
        con = _open(self.path)
        columns = ", ".join(map(_quoted, self.names))
        yield from con.execute(f"SELECT {columns} FROM {_quoted(self.table)}{where}", [v for _, v in tests])
        con.close()


class FilteringReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a number column with a number go into SQLite's WHERE; Spark checks them again, as columns may hold other kinds."""
        for f in filters:
            sign = _SIGNS.get(type(f))
            if sign and len(f.attribute) == 1 and type(f.value) in (int, float):
                self.tests.append((f"({_quoted(f.attribute[0])} {sign} ? OR typeof({_quoted(f.attribute[0])}) NOT IN ('integer', 'real'))", f.value))
            yield f


class SqliteSource(DataSource):
    """Options: path, table, splits (8), pushdown (false)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        con = _open(self.options["path"])
        found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        con.close()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(name, _kind(kind)) for _, name, kind, *_ in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else SqliteReader
        return kind(self.options["path"], self.options["table"], schema.names, int(self.options.get("splits", "8")))


def first_with_rows(candidates: list) -> object:
    """The first readable table that has rows; else the first readable one; else an error.

    Candidates are functions that return a DataFrame, or raise ValueError where their table is missing.
    """
    readable = []
    for read in candidates:
        try:
            rows = read()
        except ValueError:
            continue
        if not rows.isEmpty():
            return rows
        readable.append(rows)
    if not readable:
        raise ValueError("none of the tables is there")
    return readable[0]

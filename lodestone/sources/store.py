"""Tables on a file system, with a catalogue of keys, and changes to them by copy on write.

A table is a folder of parts (folders of files) and of versions, each a list of parts; the highest version is the table.
Inserts write a part and a version that has it besides the old ones, so their cost is that of the new rows; deletes and
updates write one part that replaces all. A version appears whole, by a rename, and parts go only when none of the last
KEEP versions has them: a failed job leaves the table as it was, and a reader keeps what it began with.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import assert_unique, clustered

#: Versions whose parts stay for readers that began with them.
KEEP = 4

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def register(spark: SparkSession, folder: str, tables: Sequence[str] = TABLES) -> None:
    """Views over a folder of tables, under the tables' names."""
    for t in tables:
        read(spark, folder, t).createOrReplaceTempView(t)


def register_with_statistics(spark: SparkSession, folder: str, database: str, tables: Sequence[str] = TABLES) -> None:
    """External tables with column statistics, for cost-based join order (views have none)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for t in tables:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{t} USING parquet LOCATION '{folder}/{t}.parquet'")
        spark.sql(f"ANALYZE TABLE {database}.{t} COMPUTE STATISTICS FOR ALL COLUMNS")


@dataclass
class Entry:
    """What the catalogue knows about a table: its schema and which columns are unique or declared as an index."""

    schema: str
    unique: list[str] = field(default_factory=list)
    indexes: dict[str, str] = field(default_factory=dict)  # index name -> column


class Store:
    """A folder of tables with a catalogue; names are case-insensitive."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- catalogue ------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def entry(self, table: str) -> Entry:
        fs, path = self._path(table.lower(), "table.json")
        if not fs.exists(path):
            raise KeyError(f"no table {table}")
        return Entry(**json.loads(self._text(table.lower(), "table.json")))

    def _write_entry(self, table: str, entry: Entry) -> None:
        fs, path = self._path(table.lower(), "table.json")
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(json.dumps(asdict(entry)).encode()))
        finally:
            stream.close()

    def tables(self) -> list[str]:
        fs, path = self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def create(self, table: str, schema: StructType, unique: Sequence[str] = ()) -> None:
        fs, path = self._path(table.lower())
        if fs.exists(path):
            raise ValueError(f"table {table} exists")
        self._write_entry(table, Entry(schema.json(), list(unique)))
        self._replace(table, self.spark.createDataFrame([], schema))

    def drop(self, table: str) -> None:
        fs, path = self._path(table.lower())
        fs.delete(path, True)

    def create_index(self, table: str, name: str, column: str, unique: bool = False) -> None:
        """Declares an access path: the table is laid out by the column; a unique one is checked now and on inserts."""
        entry, rows = self.entry(table), self.table(table)
        if column not in rows.columns:
            raise KeyError(f"no column {column} in {table}")
        if unique:
            assert_unique(rows, column)
            entry.unique = sorted({*entry.unique, column})
        entry.indexes[name] = column
        self._write_entry(table, entry)
        self._replace(table, clustered(rows, column))

    # -- versions ---------------------------------------------------------------------------------------------------

    def _versions(self, table: str) -> list[int]:
        fs, path = self._path(table.lower())
        if not fs.exists(path):
            raise KeyError(f"no table {table}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def _parts(self, table: str, version: int) -> list[str]:
        return json.loads(self._text(table.lower(), f"v{version}.json"))

    def _text(self, *where: str) -> str:
        fs, path = self._path(*where)
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, table: str, rows: DataFrame, keep: bool) -> None:
        """The next version: a new part with the rows, beside the parts so far or in their place."""
        old = self._versions(table)
        parts = self._parts(table, old[-1]) if old and keep else []
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{table.lower()}/{part}")
        fs, draft = self._path(table.lower(), f"{part}.json")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps([*parts, part]).encode()))
        finally:
            stream.close()
        if not fs.rename(draft, self._path(table.lower(), f"v{(old[-1] if old else 0) + 1}.json")[1]):
            raise RuntimeError(f"{table} was changed by another writer")
        self._forget(table)

    def _forget(self, table: str) -> None:
        versions = self._versions(table)
        held = {p for v in versions[-KEEP:] for p in self._parts(table, v)}
        gone = {p for v in versions[:-KEEP] for p in self._parts(table, v)} - held
        for name in [*sorted(gone), *[f"v{v}.json" for v in versions[:-KEEP]]]:
            fs, path = self._path(table.lower(), name)
            fs.delete(path, True)

    def _replace(self, table: str, rows: DataFrame) -> None:
        self._commit(table, rows, False)

    def _schema(self, table: str) -> StructType:
        return StructType.fromJson(json.loads(self.entry(table).schema))

    def table(self, table: str) -> DataFrame:
        schema, versions = self._schema(table), self._versions(table)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{table.lower()}/{p}" for p in self._parts(table, versions[-1])])

    # -- changes ------------------------------------------------------------------------------------------------------

    def insert(self, table: str, rows: DataFrame) -> None:
        """Appends rows (by position), after a check of unique columns among themselves and of the new keys against the table."""
        schema, entry = self._schema(table), self.entry(table)
        if len(rows.columns) != len(schema):
            raise ValueError(f"{table} has {len(schema)} columns, the rows have {len(rows.columns)}")
        typed = rows.select([F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, schema)])
        for column in entry.unique:
            assert_unique(typed, column)
            known = self.table(table).select(column).join(typed.select(column), column, "left_semi").limit(1).collect()
            if known:
                raise ValueError(f"duplicate key in unique column {column}: {known[0][0]}")
        self._commit(table, typed, True)

    def insert_values(self, table: str, values: Sequence[Sequence]) -> None:
        schema = self._schema(table)
        if any(len(v) != len(schema) for v in values):
            raise ValueError(f"{table} has {len(schema)} columns")
        self.insert(table, self.spark.createDataFrame([tuple(v) for v in values], schema))

    def delete(self, table: str, predicate: Column | None = None) -> None:
        """Deletes rows for which the predicate is true; rows for which it is null stay."""
        rows = self.table(table)
        self._replace(table, deleted(rows, predicate))

    def update(self, table: str, values: dict[str, Column | Callable[[DataFrame], Column]], predicate: Column | None = None) -> None:
        """Sets columns, all from the row's old values, in rows for which the predicate is true."""
        schema = self._schema(table)
        rows = updated(self.table(table), values, predicate)
        for column in {*values} & {*self.entry(table).unique}:
            assert_unique(rows, column)
        self._replace(table, rows.select([F.col(f.name).cast(f.dataType) for f in schema]))

    def truncate(self, table: str) -> None:
        self._replace(table, self.spark.createDataFrame([], self._schema(table)))


def deleted(rows: DataFrame, predicate: Column | None) -> DataFrame:
    """What a delete leaves."""
    return rows.filter(F.lit(False)) if predicate is None else rows.filter(~F.coalesce(predicate, F.lit(False)))


def updated(rows: DataFrame, values: dict, predicate: Column | None) -> DataFrame:
    """What an update makes of rows."""
    holds = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    return rows.select([F.when(holds, v(rows) if callable(v := values[c]) and not isinstance(v, Column) else v).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])

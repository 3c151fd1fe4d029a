"""Table-to-table operators: a tree over named tables whose results are named tables again.

Nothing is materialised between operators unless asked for: a result is a lazily evaluated view of the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import relational


@dataclass
class Bulk:
    """A node of a bulk plan. run() gives the name of the result's view."""

    inputs: Sequence[Bulk] = ()
    name: str = field(default_factory=lambda: f"result_{uuid.uuid4().hex[:12]}")

    def frame(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def run(self, spark: SparkSession) -> str:
        self.frame(spark).createOrReplaceTempView(self.name)
        return self.name

    def save(self, spark: SparkSession, table: str, mode: str = "append") -> None:
        """Writes the result to a table of the catalogue."""
        self.frame(spark).write.mode(mode).saveAsTable(table)


class TableInput(Bulk):
    """A leaf: an existing table or view."""

    def __init__(self, table: str):
        super().__init__((), table)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def run(self, spark: SparkSession) -> str:
        return self.name


def tagged(spark: SparkSession, *tables: str) -> DataFrame:
    """The rows of several tables as (source, row); row is null-padded to all their columns."""
    parts = [spark.table(t).withColumn("_source", F.lit(t)) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(F.col("_source").alias("source"), F.struct(*[c for c in out.columns if c != "_source"]).alias("row"))


class Identity(Bulk):
    def frame(self, spark: SparkSession) -> DataFrame:
        return self.inputs[0].frame(spark)


class ForwardLeft(Bulk):
    """Of two inputs the rows of the left one. Its rows are known by their source, so the right one is never read."""

    def frame(self, spark: SparkSession) -> DataFrame:
        left, right = (i.frame(spark) for i in self.inputs)
        both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
        return both.filter("_left").select(*left.columns)


class CountTuples(Bulk):
    """The number of rows as an INT named count; partial counts are added up."""

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.inputs[0].frame(spark).agg(F.count(F.lit(1)).cast("int").alias("count"))


class Job(Bulk):
    """A job of the user over the rows of its inputs.

    `map` gives (key, value) pairs of a row (a dict; of several inputs it has `_source`, the input's name), `combine`
    makes one value of a key's values, and `reduce` gives the output rows of a key and its combined value. combine must
    not depend on order or grouping: it runs in the mapping tasks first, over at most `held` keys at a time, and again
    where the parts of a key meet, so a frequent key comes as one value of each task. Null keys are a key.
    """

    def __init__(self, inputs: Sequence[Bulk], map: Callable, combine: Callable, reduce: Callable, key: str, value: str, output: str, held: int = 100_000):  # noqa: A002
        super().__init__(tuple(inputs))
        self.map, self.combine, self.reduce, self.held = map, combine, reduce, held
        self.pair, self.output = f"key {key}, value {value}", output

    def frame(self, spark: SparkSession) -> DataFrame:
        map_, combine, reduce_, held = self.map, self.combine, self.reduce, self.held
        pair, output = (to_arrow_schema(_parse_datatype_string(s)) for s in (self.pair, self.output))

        def rows(found, schema):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in found], schema=schema)

        def mapped(source):
            def run(batches):
                parts = {}
                for b in batches:
                    for row in b.to_pylist():
                        for k, v in map_({**row, "_source": source}):
                            parts[k] = combine([parts[k], v]) if k in parts else combine([v])
                        if len(parts) > held:
                            yield rows(parts.items(), pair)
                            parts = {}
                if parts:
                    yield rows(parts.items(), pair)

            return run

        def merged(table):
            values = table.column("value").to_pylist()
            key = table.column("key")[0].as_py()
            return pa.Table.from_batches([rows(reduce_(key, combine(values)), output)], schema=output)

        pairs = [i.frame(spark).mapInArrow(mapped(i.name), self.pair) for i in self.inputs]
        both = pairs[0]
        for p in pairs[1:]:
            both = both.unionByName(p)
        return both.groupBy("key").applyInArrow(merged, self.output)


class Scan(Bulk):
    def __init__(self, child: Bulk, predicate):
        super().__init__((child,))
        self.predicate = predicate

    def frame(self, spark: SparkSession) -> DataFrame:
        return relational.filter_rows(self.inputs[0].frame(spark), self.predicate)


class GroupBy(Bulk):
    def __init__(self, child: Bulk, groups: Sequence[int | str], aggregates: Sequence[tuple[str, int | str, str]]):
        super().__init__((child,))
        self.groups, self.aggregates = groups, aggregates

    def frame(self, spark: SparkSession) -> DataFrame:
        return relational.group_by(self.inputs[0].frame(spark), self.groups, self.aggregates)

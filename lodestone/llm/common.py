"""Shared plumbing of the training-data operators: table access, staged tables, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_base: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over as many partitions as there are cores, where a small input has fewer; others stay as they are."""
    width = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def work_base(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and "cluster" not in master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = tempfile.mkdtemp(prefix="lodestone-")
    return _own_base[app]


class Stage:
    """Tables written to the shared folder in order to cut lineage and to be read more than once."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{work_base(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def deal(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """The same as save, in buckets of the column: joins on it then move only their other side.

        The catalogue knows the table until the session ends; its files are where save's are.
        """
        known, width = f"lodestone_{uuid.uuid4().hex}", shuffle_width(self.spark)
        df.repartition(width, column).write.bucketBy(width, column).option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(known)
        return self.spark.table(known)

    def drop(self, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about limit bytes of the string column; one row may be larger."""
    for batch in batches:
        text = batch.column(column)
        if batch.num_rows < 2 or text.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        at, held = 0, 0
        for i, n in enumerate(pc.binary_length(text).to_pylist()):
            n = n or 0
            if held and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def give_back() -> None:
    """Returns free memory to the system at the end of a task: workers live on, and their next task is another one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most about SLICE_BYTES on their way to Python, unless the session has its own bound: 10,000 long rows are too many at once."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, f"{SLICE_BYTES}b")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str | StructType) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns."""
    kinds = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    assert isinstance(kinds, StructType)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for cols in fn(batches):
                yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    bounded(df.sparkSession)
    return df.mapInArrow(run, kinds)


def rest(df: DataFrame, flag: Column) -> tuple[Column, str]:
    """The columns of df besides doc_id and text in a struct `row`, beside a flag under the name given back, which none of them has."""
    others = [c for c in df.columns if c.lower() not in ("doc_id", "text")]
    name = "_flag"
    while name in {c.lower() for c in others}:
        name = "_" + name
    return F.struct(flag.alias(name), *[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in others]).alias("row"), name


def with_row(schema: str, row: StructField) -> StructType:
    """A schema and the struct of rest."""
    kinds = _parse_datatype_string(schema)
    assert isinstance(kinds, StructType)
    return kinds.add(row)


def unpacked(df: DataFrame, schema: StructType, **own: Column) -> DataFrame:
    """The columns of schema in order and in their types: own ones as given, the others out of `row`."""
    return df.select(*[(own[f.name.lower()] if f.name.lower() in own else F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with null texts as they are; other columns only where named."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

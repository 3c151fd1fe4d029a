"""What becomes of a plan's rows outside the engine: sinks that take them in order, and a printer."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import Protocol, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Sink(Protocol):
    """Takes a result: open once, add for each row, then close, or fail with what went wrong."""

    def open(self, schema: T.StructType) -> None: ...

    def add(self, row: Sequence) -> None: ...

    def close(self) -> None: ...

    def fail(self, error: Exception) -> None: ...


def deliver(df: DataFrame, sink: Sink, prefetch: bool = True) -> None:
    """Hands the rows to the sink in their order, a partition at a time: the driver never holds the whole result.

    Errors of the plan go to the sink, which decides whether they are raised.
    """
    try:
        sink.open(df.schema)
        for row in df.toLocalIterator(prefetchPartitions=prefetch):
            sink.add(tuple(row))
    except Exception as error:  # whatever the plan or the sink raised is the sink's to tell
        sink.fail(error)
    else:
        sink.close()


_WIDTHS = {T.ShortType: 6, T.IntegerType: 11, T.LongType: 20, T.FloatType: 14, T.DoubleType: 23, T.DateType: 10, T.TimestampNTZType: 23, T.TimestampType: 23, T.BooleanType: 5}


class Printer:
    """Columns of a width by type, numbers to the right; then how many rows there were. Text wider than its column is cut."""

    def __init__(self, out: TextIO | None = None, text_width: int = 25):
        self.out, self.text_width, self.rows = out or sys.stdout, text_width, 0

    def open(self, schema: T.StructType) -> None:
        self.right = [isinstance(f.dataType, T.NumericType) for f in schema]
        self.widths = [max(_WIDTHS.get(type(f.dataType), self.text_width), len(f.name)) for f in schema]
        self._line([f.name for f in schema])
        print("-+-".join("-" * w for w in self.widths), file=self.out)

    def _line(self, said: Sequence[str]) -> None:
        print(" | ".join(x[:w].rjust(w) if r else x[:w].ljust(w) for x, w, r in zip(said, self.widths, self.right)).rstrip(), file=self.out)

    def add(self, row: Sequence) -> None:
        self.rows += 1
        self._line(["NULL" if v is None else str(v) for v in row])

    def close(self) -> None:
        print(f"{self.rows} rows returned.", file=self.out)

    def fail(self, error: Exception) -> None:
        print(f"failed after {self.rows} rows: {error}", file=self.out)
        raise error


def show(df: DataFrame, out: TextIO | None = None, rows: int | None = None) -> None:
    """Prints a result, or its first rows, which is all that is computed then."""
    deliver(df if rows is None else df.limit(rows), Printer(out))

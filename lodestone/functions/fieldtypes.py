"""The engine's ten scalar types: their Spark types, and how they are read from and written as text.

The text null (any case) is a null in every type. Not-a-number is no value either, so it becomes null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 1024
#: Milliseconds of the largest UTC offset either way.
MOST_OFFSET = 12 * 3_600_000

#: A time of day with its offset from UTC; times order by the instant, which is ms - off.
TIME = T.StructType([T.StructField("ms", T.IntegerType()), T.StructField("off", T.IntegerType())])

_PLAIN = {"SMALL_INT": T.ShortType(), "INT": T.IntegerType(), "BIG_INT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "TIME": TIME, "TIMESTAMP": T.TimestampNTZType()}
ARITHMETIC = ("SMALL_INT", "INT", "BIG_INT", "FLOAT", "DOUBLE")


@dataclass(frozen=True)
class FieldType:
    """A type by name; CHAR and VAR_CHAR have a length."""

    name: str
    length: int | None = None

    def __post_init__(self) -> None:
        if (self.length is not None) != (self.name in ("CHAR", "VAR_CHAR")) or self.name not in (*_PLAIN, "CHAR", "VAR_CHAR"):
            raise ValueError(f"no type {self.name}({self.length})")
        if self.length is not None and not 1 <= self.length <= MOST_CHARS:
            raise ValueError(f"a length is from 1 to {MOST_CHARS}")

    @classmethod
    def of(cls, text: str) -> FieldType:
        m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*\))?\s*", text)
        if not m:
            raise ValueError(f"no type {text}")
        return cls(m[1].upper().replace("VARCHAR", "VAR_CHAR"), int(m[2]) if m[2] else None)

    @property
    def spark(self) -> T.DataType:
        return _PLAIN.get(self.name, T.StringType())

    @property
    def arithmetic(self) -> bool:
        return self.name in ARITHMETIC

    @property
    def indexable(self) -> bool:
        """Only types of fixed width can be keys of an index."""
        return self.name != "VAR_CHAR"

    def parse(self, text: Column) -> Column:
        """The value of a text column; texts that are no value of the type raise an error when the plan runs."""
        given = F.when(F.lower(F.trim(text)) != "null", text)
        if self.name in ("SMALL_INT", "INT", "BIG_INT"):
            return F.trim(given).cast(self.spark)
        if self.name in ("FLOAT", "DOUBLE"):
            return ingest(F.trim(given).cast(self.spark), self)
        if self.name in ("CHAR", "VAR_CHAR"):
            said = F.trim(given) if self.name == "VAR_CHAR" else given
            fits = F.when(F.length(said) <= self.length, said).when(said.isNotNull(), F.raise_error(F.concat(F.lit(f"longer than {self.length}: "), said)).cast("string"))
            return F.rpad(fits, self.length, " ") if self.name == "CHAR" else fits
        if self.name == "DATE":
            return F.to_date(F.trim(given), "yyyy-M-d")
        if self.name == "TIMESTAMP":
            return F.to_timestamp_ntz(F.trim(given), F.lit("yyyy-M-d H:mm:ss.SSS"))
        return _time(F.trim(given))

    def text(self, value: Column) -> Column:
        """The text of a value; null is written NULL."""
        if self.name == "DATE":
            said = F.date_format(value, "yyyy-MM-dd")
        elif self.name == "TIMESTAMP":
            said = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS")
        elif self.name == "TIME":
            ms, off = value["ms"], value["off"]
            clock = F.concat_ws(":", F.floor(ms / 3_600_000).cast("string"), F.lpad(F.floor(ms / 60_000 % 60).cast("string"), 2, "0"), F.lpad(F.floor(ms / 1000 % 60).cast("string"), 2, "0"))
            far = F.abs(off)
            zone = F.concat(F.lit(" (UTC "), F.when(off < 0, "-").otherwise("+"), F.concat_ws(":", F.floor(far / 3_600_000).cast("string"), F.lpad(F.floor(far / 60_000 % 60).cast("string"), 2, "0"), F.lpad(F.floor(far / 1000 % 60).cast("string"), 2, "0")), F.lit(")"))
            said = F.when(value.isNotNull(), F.concat(clock, F.when(off == 0, "").otherwise(zone)))
        else:
            said = value.cast("string")
        return F.coalesce(said, F.lit("NULL"))

    def parts(self, value: Column) -> dict[str, Column]:
        """What a date or timestamp consists of, by name; months count from 0."""
        if self.name not in ("DATE", "TIMESTAMP"):
            raise ValueError(f"{self.name} has no year, month and day")
        return {"year": F.year(value), "month": F.month(value) - 1, "day": F.dayofmonth(value)}

    def key(self, value: Column) -> Column:
        """What values are compared and sorted by: the instant for times, no trailing blanks for CHAR."""
        if self.name == "TIME":
            return value["ms"] - value["off"]
        return F.rtrim(value) if self.name == "CHAR" else value


_TIME = r"^(\d{1,2}):(\d{2}):(\d{2})(?:\s*\(UTC\s*([+-])(\d{1,2})(?::(\d{2}))?(?::(\d{2}))?\))?$"


def _time(text: Column) -> Column:
    """A text without an offset has offset 0."""
    part = lambda i: F.coalesce(F.when((p := F.regexp_extract(text, _TIME, i)) != "", p).cast("int"), F.lit(0))
    clock = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000
    far = (part(5) * 3600 + part(6) * 60 + part(7)) * 1000
    off = F.when(F.regexp_extract(text, _TIME, 4) == "-", -far).otherwise(far)
    fine = text.rlike(_TIME) & (part(1) < 24) & (part(2) < 60) & (part(3) < 60) & (far <= MOST_OFFSET)
    made = F.struct(clock.cast("int").alias("ms"), off.cast("int").alias("off"))
    return F.when(text.isNull(), F.lit(None).cast(TIME)).when(fine, made).otherwise(F.raise_error(F.concat(F.lit("no time: "), text)).cast(TIME))


def ingest(value: Column, kind: FieldType) -> Column:
    """A value read from elsewhere: not-a-number is null, variable text has no blanks at its ends, fixed text is padded."""
    if kind.name in ("FLOAT", "DOUBLE"):
        return F.when(~F.isnan(value), value)
    if kind.name == "VAR_CHAR":
        return F.trim(value)
    return F.rpad(value, kind.length, " ") if kind.name == "CHAR" else value


def divide(a: Column, b: Column, kind: FieldType) -> Column:
    """Integers divide to an integer, cut off towards zero."""
    return F.call_function("div", a, b).cast(kind.spark) if kind.name.endswith("INT") else a / b

"""Relational operators over DataFrames. Each one declares a plan; Catalyst and adaptive execution choose how it runs.

Operators that work by position take indexes of their input's columns; -1 in an output map means "not from this side".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import And, Between, JoinAnd, JoinAtom

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def _numbered(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def _unique(names: Sequence[str]) -> list[str]:
    """Repeated names get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


# -- scans ---------------------------------------------------------------------------------------------------------


def table_scan(table: DataFrame, columns: Sequence[int | str] | None = None, predicates: Sequence = ()) -> DataFrame:
    """Rows for which all predicates hold, projected to columns in any order, repeats included.

    Predicates are over the table's own columns, projected or not.
    """
    rows = filter_rows(table, And(*predicates)) if predicates else table
    if columns is None:
        return rows
    names = [table.columns[c] if isinstance(c, int) else c for c in columns]
    return rows.select([F.col(n).alias(u) for n, u in zip(names, _unique(names))])


def scan_with_rid(table: DataFrame) -> DataFrame:
    """A file table's rows with their row id: the file and the row's place in it."""
    return table.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("rid"))


# -- index-style access: a declared order of a column; row-group statistics of the sorted files do the lookup --------


def index_scan(table: DataFrame, key: str, span: Between | None = None) -> DataFrame:
    """Keys only, one for each row in the range, ascending. Nulls are in no range."""
    span = span or Between(key)
    return table.filter(span.compile()).select(key).orderBy(key)


def index_lookup(table: DataFrame, key: str, value=None, span: Between | None = None) -> DataFrame:
    """Row ids of the rows whose key equals the value or lies in the range."""
    rows = scan_with_rid(table)
    return rows.filter(span.compile() if span is not None else F.col(key) == F.lit(value)).select("rid")


def index_fetch(table: DataFrame, key: str, value=None, span: Between | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A lookup and the fetch of its rows in one: a single scan, whose filter and columns reach the files."""
    rows = table.filter(span.compile() if span is not None else F.col(key) == F.lit(value))
    names = list(columns or table.columns)
    return rows.select([F.col(n).alias(u) for n, u in zip(names, _unique(names))])


def index_join(outer: DataFrame, table: DataFrame, outer_key: str, key: str, residual: Column | None = None) -> DataFrame:
    """For each outer row the table's rows with its key: what an index probe for each row would give, as one equi join."""
    joined = outer.join(table, outer[outer_key] == table[key])
    return joined if residual is None else joined.filter(residual)


def fetch(rids: DataFrame, table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of row ids, as often as an id is given."""
    names = list(columns or table.columns)
    rows = scan_with_rid(table)
    return rids.select("rid").join(rows, "rid").select([F.col(n).alias(u) for n, u in zip(names, _unique(names))])


def assert_unique(table: DataFrame, key: str) -> None:
    """Raises if a key that isn't null occurs twice. One row comes back, whatever the size of the table."""
    twice = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key in unique column {key}: {twice[0][0]}")


def clustered(table: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The layout an index stands for: ranges of the key in each partition, sorted inside, so scans skip row groups."""
    dealt = table.repartitionByRange(partitions, key) if partitions else table.repartitionByRange(key)
    return dealt.sortWithinPartitions(key)


# -- filters ---------------------------------------------------------------------------------------------------------


def filter_rows(child: DataFrame, predicate) -> DataFrame:
    if predicate.truth is False:
        return child.filter(F.lit(False))
    return child.filter(predicate.compile(lambda c: child[child.columns[c]] if isinstance(c, int) else F.col(c)))


def correlated_filter(child: DataFrame, outer: DataFrame, predicate: JoinAtom | JoinAnd) -> DataFrame:
    """For each outer row the child's rows that go with it: child columns, then outer columns."""
    width = len(child.columns)
    return nested_loop_join(child, outer, predicate, [*range(width), *[-1] * len(outer.columns)], [*[-1] * width, *range(len(outer.columns))])


# -- joins ---------------------------------------------------------------------------------------------------------


def _mapped(left: DataFrame, right: DataFrame, left_map: Sequence[int], right_map: Sequence[int]) -> list[Column]:
    if len(left_map) != len(right_map):
        raise ValueError("both output maps must be as long as the output")
    picked, names = [], []
    for a, b in zip(left_map, right_map):
        if (a < 0) == (b < 0):
            raise ValueError("each output column must come from one side")
        picked.append(f"l{a}" if b < 0 else f"r{b}")
        names.append(left.columns[a] if b < 0 else right.columns[b])
    return [F.col(p).alias(n) for p, n in zip(picked, _unique(names))]


def nested_loop_join(outer: DataFrame, inner: DataFrame, predicate, outer_map: Sequence[int], inner_map: Sequence[int]) -> DataFrame:
    """Inner join by any predicate; without one the product. Equalities among its parts make it a hash or merge join."""
    left, right = _numbered(outer, "l"), _numbered(inner, "r")
    if predicate is None:
        joined = left.crossJoin(right)
    else:
        place = lambda df, prefix: lambda c: F.col(f"{prefix}{c if isinstance(c, int) else df.columns.index(c)}")
        joined = left.join(right, predicate.compile(place(outer, "l"), place(inner, "r")))
    return joined.select(_mapped(outer, inner, outer_map, inner_map))


def merge_join(left: DataFrame, right: DataFrame, left_columns: Sequence[int], right_columns: Sequence[int], left_map: Sequence[int], right_map: Sequence[int]) -> DataFrame:
    """Inner equality join on one or more columns by sorted merging; equal keys give all their pairs."""
    if not left_columns or len(left_columns) != len(right_columns):
        raise ValueError("a merge join needs as many join columns on the left as on the right, and one at least")
    a, b = _numbered(left, "l"), _numbered(right, "r").hint("merge")
    on = JoinAnd(*[JoinAtom(f"l{x}", "=", f"r{y}") for x, y in zip(left_columns, right_columns)])
    return a.join(b, on.compile(F.col, F.col)).select(_mapped(left, right, left_map, right_map))


# -- grouping and order ----------------------------------------------------------------------------------------------


def group_by(child: DataFrame, groups: Sequence[int | str], aggregates: Sequence[tuple[str, int | str, str]], types: Sequence[str | None] = ()) -> DataFrame:
    """Group columns, then (function, column, name) aggregates, several of which may read the same column.

    Without groups there is one row, also for an empty input: counts are 0, the others null. Nulls are not counted and
    form one group. types casts a result to a declared type; sums and averages are wide otherwise.
    """
    name = lambda c: child.columns[c] if isinstance(c, int) else c
    made = []
    for k, (fn, column, alias) in enumerate(aggregates):
        c = AGGREGATES[fn.upper()](F.col(name(column)))
        kind = types[k] if k < len(types) else None
        made.append((c.cast(kind) if kind else c).alias(alias))
    keys = [name(g) for g in groups]
    if not made:
        return child.select(*keys).distinct()
    return child.groupBy(*keys).agg(*made) if keys else child.agg(*made)


def having(grouped: DataFrame, predicate) -> DataFrame:
    """A predicate on output names after grouping."""
    return filter_rows(grouped, predicate)


def sort(child: DataFrame, columns: Sequence[int | str], ascending: Sequence[bool] | None = None) -> DataFrame:
    """By several columns; null is the lowest value: first ascending, last descending."""
    names = [child.columns[c] if isinstance(c, int) else c for c in columns]
    up = list(ascending or [True] * len(names))
    return child.orderBy(*[F.col(n).asc_nulls_first() if a else F.col(n).desc_nulls_last() for n, a in zip(names, up)])

"""All relational queries of the engine by name, each with the SQL that must give the same rows.

Orders are part of the rows where a query is about order: row numbers are projected. Sums of doubles are rounded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.fieldtypes import FieldType, divide
from .operators import bulk
from .operators import relational as R
from .operators.predicates import And, Atom, Between, JoinAnd, JoinAtom, JoinOr, Or
from .plans import dialect
from .sources.store import Store, deleted, read, updated

FLAGSHIP = "agg_all_by_nation"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def keep(fn):
        _QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def queries() -> dict:
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _dialect(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return dialect.sql(spark, text, lambda name: read(spark, sf_dir, name.lower()))


# -- scans and projections ------------------------------------------------------------------------------------------


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_full(spark, d):
    return R.table_scan(read(spark, d, "nation"))


@_query("SELECT l_suppkey, l_orderkey, l_suppkey AS l_suppkey_2 FROM lineitem")
def scan_project_reorder_repeat(spark, d):
    return R.table_scan(read(spark, d, "lineitem"), [2, 0, 2])


@_query("SELECT l_partkey, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'A' AND l_suppkey <> 3 AND l_shipdate >= TIMESTAMP '1996-01-01'")
def scan_conjunction_unprojected(spark, d):
    preds = [Atom("l_quantity", "<", 10.0), Atom("l_returnflag", "=", "A"), Atom("l_suppkey", "<>", 3), Atom("l_shipdate", ">=", "1996-01-01")]
    return R.table_scan(read(spark, d, "lineitem"), ["l_partkey", "l_quantity"], preds)


@_query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_rids, CAST(count(*) AS BIGINT) AS n_back FROM lineitem")
def rid_scan_count(spark, d):
    """Row ids are distinct, and each leads back to the row that it came with."""
    t = read(spark, d, "lineitem")
    rows = R.scan_with_rid(t).select("rid", F.xxhash64(*t.columns).alias("said"))
    back = R.scan_with_rid(t).select("rid", F.xxhash64(*t.columns).alias("found"))
    told = rows.agg(F.count("rid").alias("n"), F.countDistinct("rid").alias("n_rids"))
    return told.join(rows.join(back, "rid").filter("said = found").agg(F.count(F.lit(1)).alias("n_back")))


@_query("SELECT o_orderkey, o_orderkey AS o_orderkey_2, o_totalprice FROM orders WHERE o_custkey BETWEEN 100 AND 110")
def fetch_by_rid(spark, d):
    t = read(spark, d, "orders")
    return R.fetch(R.index_lookup(t, "o_custkey", span=Between("o_custkey", 100, 110)), t, ["o_orderkey", "o_orderkey", "o_totalprice"])


# -- predicates ------------------------------------------------------------------------------------------------------


@_query("SELECT p_partkey, p_size FROM part WHERE p_size = 15")
def filter_eq_int(spark, d):
    return R.filter_rows(read(spark, d, "part"), Atom("p_size", "=", 15)).select("p_partkey", "p_size")


@_query("SELECT p_partkey, p_brand FROM part WHERE p_brand <> 'Brand#3'")
def filter_ne_str(spark, d):
    return R.filter_rows(read(spark, d, "part"), Atom("p_brand", "<>", "Brand#3")).select("p_partkey", "p_brand")


@_query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice < 5000")
def filter_lt_double(spark, d):
    return R.filter_rows(read(spark, d, "lineitem"), Atom("l_extendedprice", "<", 5000.0)).select("l_orderkey", "l_extendedprice")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def filter_le_ts(spark, d):
    return R.filter_rows(read(spark, d, "orders"), Atom("o_orderdate", "<=", "1996-06-30")).select("o_orderkey", "o_orderdate")


@_query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '3-MEDIUM'")
def filter_gt_str(spark, d):
    return R.filter_rows(read(spark, d, "orders"), Atom("o_orderpriority", ">", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@_query("SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
def filter_ge_int(spark, d):
    return R.filter_rows(read(spark, d, "part"), Atom("p_size", ">=", 40)).select("p_partkey", "p_size")


@_query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 400000 AND o_orderpriority = '1-URGENT'")
def filter_conjunction(spark, d):
    return R.filter_rows(read(spark, d, "orders"), And(Atom("o_totalprice", ">=", 400000.0), Atom("o_orderpriority", "=", "1-URGENT"))).select("o_orderkey", "o_totalprice", "o_orderpriority")


@_query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 490000 OR (o_orderpriority = '1-URGENT' AND o_totalprice < 20000)")
def filter_disjunction(spark, d):
    either = Or(Atom("o_totalprice", ">=", 490000.0), And(Atom("o_orderpriority", "=", "1-URGENT"), Atom("o_totalprice", "<", 20000.0)))
    return R.filter_rows(read(spark, d, "orders"), either).select("o_orderkey", "o_totalprice", "o_orderpriority")


@_query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE nullif(p_size, 10) <> 5")
def filter_null_rejects(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return R.filter_rows(rows, Atom("size", "<>", 5))


@_query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 10")
def filter_contradiction(spark, d):
    return R.filter_rows(read(spark, d, "part"), Between("p_size", 10, 10, False, False)).select("p_partkey")


# -- index-style access ----------------------------------------------------------------------------------------------


def _range(name: str, condition: str, span: Between) -> None:
    def run(spark, d):
        t = read(spark, d, "lineitem")
        return R.index_fetch(t, "l_suppkey", span=span, columns=["l_orderkey", "l_suppkey", "l_quantity"])

    run.__name__ = name
    _query(f"SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE {condition}")(run)


_range("range_both_incl", "l_suppkey >= 23 AND l_suppkey <= 43", Between("l_suppkey", 23, 43))
_range("range_lo_incl", "l_suppkey >= 23 AND l_suppkey < 43", Between("l_suppkey", 23, 43, True, False))
_range("range_hi_incl", "l_suppkey > 23 AND l_suppkey <= 43", Between("l_suppkey", 23, 43, False, True))
_range("range_excl", "l_suppkey > 23 AND l_suppkey < 43", Between("l_suppkey", 23, 43, False, False))
_range("range_open_low", "l_suppkey < 12", Between("l_suppkey", None, 12, True, False))
_range("range_open_high", "l_suppkey >= 90", Between("l_suppkey", 90, None))
_range("range_point", "l_suppkey = 7", Between("l_suppkey", 7, 7))


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 127")
def index_eq_lookup(spark, d):
    t = read(spark, d, "orders")
    return R.index_fetch(t, "o_custkey", 127, columns=["o_orderkey", "o_custkey", "o_totalprice"])


@_query("SELECT l_suppkey, CAST(row_number() OVER (ORDER BY l_suppkey) AS BIGINT) AS place FROM lineitem WHERE l_suppkey BETWEEN 10 AND 20")
def index_key_scan_dups(spark, d):
    return _placed(R.index_scan(read(spark, d, "lineitem"), "l_suppkey", Between("l_suppkey", 10, 20)))


@_query("SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey >= 23 AND l_suppkey < 43")
def index_declared_lookup(spark, d):
    """A lookup over a table that a declared index has laid out in sorted ranges."""
    store = Store(spark, _scratch(spark, "store"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    store.create("lineitem", rows.schema)
    store.insert("lineitem", rows)
    store.create_index("lineitem", "lineitem_fk_supplier", "l_suppkey")
    return R.index_fetch(store.table("lineitem"), "l_suppkey", span=Between("l_suppkey", 23, 43, True, False))


@_query("SELECT CAST(count(l_suppkey) AS BIGINT) AS n FROM lineitem")
def index_key_scan_all(spark, d):
    return R.index_scan(read(spark, d, "lineitem"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
def index_corr_lookup(spark, d):
    outer = R.filter_rows(read(spark, d, "customer"), Atom("c_nationkey", "=", 7))
    return R.index_join(outer, read(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@_query("SELECT o_totalprice, o_orderkey, o_totalprice AS o_totalprice_2 FROM orders WHERE o_custkey BETWEEN 100 AND 110")
def fetch_projection(spark, d):
    t = read(spark, d, "orders")
    return R.index_fetch(t, "o_custkey", span=Between("o_custkey", 100, 110), columns=["o_totalprice", "o_orderkey", "o_totalprice"])


# -- joins -------------------------------------------------------------------------------------------------------------


@_query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
def nlj_equi(spark, d):
    return R.nested_loop_join(read(spark, d, "region"), read(spark, d, "nation"), JoinAtom(0, "=", 2), [1, -1], [-1, 1])


@_query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey < n_regionkey")
def nlj_theta_lt(spark, d):
    return R.nested_loop_join(read(spark, d, "region"), read(spark, d, "nation"), JoinAtom(0, "<", 2), [0, -1], [-1, 0])


@_query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey <> n_regionkey")
def nlj_ne(spark, d):
    return R.nested_loop_join(read(spark, d, "region"), read(spark, d, "nation"), JoinAtom(0, "<>", 2), [0, -1], [-1, 0])


@_query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark, d):
    return R.nested_loop_join(read(spark, d, "region"), read(spark, d, "nation"), None, [1, -1], [-1, 1])


@_query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE r_regionkey = n_regionkey OR r_regionkey = n_nationkey")
def join_or_condition(spark, d):
    return R.nested_loop_join(read(spark, d, "region"), read(spark, d, "nation"), JoinOr(JoinAtom(0, "=", 2), JoinAtom(0, "=", 0)), [0, -1], [-1, 0])


@_query("SELECT n_nationkey, n_name, r_name FROM region, nation WHERE n_regionkey = r_regionkey AND n_nationkey > r_regionkey")
def correlated_filter(spark, d):
    both = R.correlated_filter(read(spark, d, "nation"), read(spark, d, "region"), JoinAnd(JoinAtom("n_regionkey", "=", "r_regionkey"), JoinAtom("n_nationkey", ">", "r_regionkey")))
    return both.select("n_nationkey", "n_name", "r_name")


@_query("SELECT c_name, o_orderkey, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey AND c_nationkey = 7")
def index_nlj(spark, d):
    outer = R.table_scan(read(spark, d, "customer"), ["c_custkey", "c_name"], [Atom("c_nationkey", "=", 7)])
    return R.index_join(outer, read(spark, d, "orders"), "c_custkey", "o_custkey").select("c_name", "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, l_partkey, l_quantity FROM orders, lineitem WHERE o_orderkey = l_orderkey AND o_totalprice >= 400000 AND o_orderpriority = '1-URGENT' AND l_returnflag = 'A'")
def index_nlj_filter(spark, d):
    outer = R.table_scan(read(spark, d, "orders"), ["o_orderkey"], [Atom("o_totalprice", ">=", 400000.0), Atom("o_orderpriority", "=", "1-URGENT")])
    return R.index_join(outer, read(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag") == "A").select("o_orderkey", "l_partkey", "l_quantity")


@_query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders, lineitem WHERE o_orderkey = l_orderkey")
def merge_join_single(spark, d):
    return R.merge_join(read(spark, d, "orders"), read(spark, d, "lineitem"), [0], [0], [0, -1, -1], [-1, 3, 4])


@_query("SELECT a.l_partkey, a.l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem a, (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY 1, 2")
def merge_join_multikey(spark, d):
    t = read(spark, d, "lineitem")
    pairs = t.filter("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    return R.group_by(R.merge_join(t, pairs, [1, 2], [0, 1], [1, 2], [-1, -1]), [0, 1], [("COUNT", 0, "n")])


@_query("SELECT n_name, round(sum(o_totalprice), 2) AS total FROM nation, customer, orders WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY n_name")
def merge_join_group(spark, d):
    customers = R.merge_join(read(spark, d, "nation"), read(spark, d, "customer"), [0], [2], [1, -1], [-1, 0])
    joined = R.merge_join(customers, read(spark, d, "orders"), [1], [1], [0, -1], [-1, 3])
    return R.group_by(joined, ["n_name"], [("SUM", "o_totalprice", "total")]).withColumn("total", F.round("total", 2))


@_query("SELECT DISTINCT p_name, p_brand FROM region, nation, supplier, lineitem, part WHERE r_name = 'AFRICA' AND r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = l_suppkey AND l_partkey = p_partkey AND p_brand = 'Brand#3'")
def join_5way_africa(spark, d):
    return _dialect(spark, d, '''SELECT p_name AS p_name, p_brand AS p_brand FROM region, nation, supplier, lineitem, part
        WHERE r_name = "AFRICA" AND r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = l_suppkey
        AND l_partkey = p_partkey AND p_brand = "Brand#3" GROUP BY p_name, p_brand''')


@_query("""SELECT r_name, p_brand, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM region, nation, customer, orders, lineitem, part, supplier
    WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_acctbal > 0 AND p_size < 20 GROUP BY r_name, p_brand""")
def join_7way(spark, d):
    return _dialect(spark, d, """SELECT r_name AS r_name, p_brand AS p_brand, COUNT(l_orderkey) AS n, SUM(l_extendedprice) AS total
        FROM region, nation, customer, orders, lineitem, part, supplier
        WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_acctbal > 0 AND p_size < 20 GROUP BY r_name, p_brand""").withColumn("total", F.round("total", 2))


@_query("SELECT p_partkey, p_brand, p_retailprice FROM part, (SELECT p_brand AS brand, min(p_retailprice) AS least FROM part GROUP BY p_brand) m WHERE p_brand = m.brand AND p_retailprice = m.least")
def derived_table_min(spark, d):
    return _dialect(spark, d, """SELECT p.p_partkey AS p_partkey, p.p_brand AS p_brand, p.p_retailprice AS p_retailprice
        FROM part p, (SELECT p_brand AS brand, MIN(p_retailprice) AS least FROM part GROUP BY p_brand) m
        WHERE p.p_brand = m.brand AND p.p_retailprice = m.least""")


# -- grouping ----------------------------------------------------------------------------------------------------------


@_query("SELECT c_mktsegment, CAST(count(c_custkey) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")
def agg_count(spark, d):
    return R.group_by(read(spark, d, "customer"), ["c_mktsegment"], [("COUNT", "c_custkey", "n")])


@_query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, d):
    return R.group_by(read(spark, d, "lineitem"), ["l_returnflag"], [("SUM", "l_extendedprice", "total"), ("SUM", "l_linenumber", "lines")]).withColumn("total", F.round("total", 2))


@_query("SELECT p_brand, round(avg(p_size), 4) AS size, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand")
def agg_avg(spark, d):
    return R.group_by(read(spark, d, "part"), ["p_brand"], [("AVG", "p_size", "size"), ("AVG", "p_retailprice", "price")]).withColumns({c: F.round(c, 4) for c in ("size", "price")})


@_query("SELECT s_nationkey, min(s_acctbal) AS least, max(s_acctbal) AS most FROM supplier GROUP BY s_nationkey")
def agg_min_max(spark, d):
    return R.group_by(read(spark, d, "supplier"), ["s_nationkey"], [("MIN", "s_acctbal", "least"), ("MAX", "s_acctbal", "most")])


@_query("SELECT n_name, CAST(count(c_acctbal) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")
def agg_all_by_nation(spark, d):
    rows = _dialect(spark, d, """SELECT n_name AS n_name, COUNT(c_acctbal) AS n, SUM(c_acctbal) AS total, AVG(c_acctbal) AS mean,
        MIN(c_acctbal) AS least, MAX(c_acctbal) AS most FROM customer, nation WHERE c_nationkey = n_nationkey
        GROUP BY n_name ORDER BY n_name ASCENDING""")
    return rows.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@_query("SELECT CAST(count(c_acctbal) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
def agg_global(spark, d):
    return _five(read(spark, d, "customer"), [])


@_query("SELECT c_nationkey, CAST(count(c_acctbal) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer WHERE c_custkey < 0 GROUP BY c_nationkey")
def agg_empty_group(spark, d):
    return _five(R.filter_rows(read(spark, d, "customer"), Atom("c_custkey", "<", 0)), ["c_nationkey"])


@_query("SELECT CAST(count(c_acctbal) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer WHERE c_custkey < 0")
def agg_empty_global(spark, d):
    return _five(R.filter_rows(read(spark, d, "customer"), Atom("c_custkey", "<", 0)), [])


def _five(rows: DataFrame, groups: list) -> DataFrame:
    fns = [("COUNT", "n"), ("SUM", "total"), ("AVG", "mean"), ("MIN", "least"), ("MAX", "most")]
    return R.group_by(rows, groups, [(f, "c_acctbal", a) for f, a in fns]).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@_query("SELECT nullif(p_size, 10) AS size, CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(p_brand, 'Brand#1')) AS BIGINT) AS brands FROM part GROUP BY nullif(p_size, 10)")
def agg_null_group(spark, d):
    rows = read(spark, d, "part").select(F.nullif(F.col("p_size"), F.lit(10)).alias("size"), "p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("brand"))
    return R.group_by(rows, [0], [("COUNT", 1, "n"), ("COUNT", 2, "brands")])


@_query("SELECT o_orderstatus, min(o_orderpriority) AS first_priority, max(o_orderpriority) AS last_priority, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY o_orderstatus")
def agg_minmax_string_ts(spark, d):
    return R.group_by(read(spark, d, "orders"), ["o_orderstatus"], [("MIN", "o_orderpriority", "first_priority"), ("MAX", "o_orderpriority", "last_priority"), ("MIN", "o_orderdate", "first_date"), ("MAX", "o_orderdate", "last_date")])


@_query("SELECT c_nationkey, CAST(count(c_custkey) AS BIGINT) AS n FROM customer GROUP BY c_nationkey HAVING count(c_custkey) > 60")
def having_alias(spark, d):
    return _dialect(spark, d, "SELECT c_nationkey AS c_nationkey, COUNT(c_custkey) AS n FROM customer GROUP BY c_nationkey HAVING n > 60")


# -- order -------------------------------------------------------------------------------------------------------------


def _placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place, counted as they stand in the sort's partitions: no task holds all rows."""
    marked = rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    marked = marked.withColumn("_within", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    stage = _scratch(rows.sparkSession, "placed")
    marked.drop("_id").write.parquet(stage)
    marked = rows.sparkSession.read.parquet(stage)
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return marked.join(before, "_part").withColumn("place", (F.col("_before") + F.col("_within")).cast("bigint")).drop("_part", "_n", "_before", "_within")


def _scratch(spark: SparkSession, tag: str) -> str:
    """A new folder within the shared one of spark.checkpoint.dir, gone when the session ends.

    A temporary folder serves only where none is set and all runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    folder = f"{base.rstrip('/')}/lodestone-{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


@_query("SELECT c_custkey, c_nationkey, c_acctbal, CAST(row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey ASC) AS BIGINT) AS place FROM customer")
def order_multi_mixed(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return _placed(R.sort(rows, ["c_nationkey", "c_acctbal", "c_custkey"], [False, True, True]))


@_query("SELECT p_partkey, nullif(p_size, 10) AS size, CAST(row_number() OVER (ORDER BY nullif(p_size, 10) ASC NULLS FIRST, p_partkey ASC) AS BIGINT) AS place FROM part")
def order_nulls_first(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return _placed(R.sort(rows, ["size", "p_partkey"]))


@_query("SELECT p_partkey, nullif(p_size, 10) AS size, CAST(row_number() OVER (ORDER BY nullif(p_size, 10) DESC NULLS LAST, p_partkey DESC) AS BIGINT) AS place FROM part")
def order_nulls_last_desc(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return _placed(R.sort(rows, ["size", "p_partkey"], [False, False]))


@_query("SELECT s_suppkey, s_name, s_nationkey, CAST(row_number() OVER (ORDER BY s_nationkey DESC, s_name ASC, s_suppkey ASC) AS BIGINT) AS place FROM supplier")
def sort_supplier(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return _placed(R.sort(rows, ["s_nationkey", "s_name", "s_suppkey"], [False, True, True]))


@_query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_partkey, l_quantity, l_orderkey")
def sort_lineitem_3key(spark, d):
    return R.sort(read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), [1, 3, 0])


# -- expressions -------------------------------------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CAST(l_linenumber * 2 - 1 AS BIGINT) AS odd FROM lineitem")
def expr_arith(spark, d):
    rows = _dialect(spark, d, "SELECT l_orderkey AS l_orderkey, l_linenumber AS l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_linenumber * 2 - 1 AS odd FROM lineitem")
    return rows.withColumns({"charge": F.round("charge", 6), "odd": F.col("odd").cast("bigint")})


@_query("SELECT n_nationkey, CAST(n_nationkey + 3 AS BIGINT) AS moved, CAST(10 AS BIGINT) AS ten FROM nation WHERE n_nationkey < 14")
def expr_const_fold(spark, d):
    rows = _dialect(spark, d, "SELECT n_nationkey AS n_nationkey, n_nationkey + 7 / 2 AS moved, 2 * (3 + 2) AS ten FROM nation WHERE n_nationkey < 28 / 2")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("moved", "ten")})


@_query("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS weeks, p_retailprice / 7 AS part FROM part")
def expr_int_div(spark, d):
    rows = _dialect(spark, d, "SELECT p_partkey AS p_partkey, p_size / 7 AS weeks, p_retailprice / 7 AS part FROM part")
    return rows.withColumn("weeks", F.col("weeks").cast("bigint"))


@_query("SELECT s_suppkey, CAST(trunc((s_suppkey - 50) / 7.0) AS BIGINT) AS cut FROM supplier")
def expr_div_towards_zero(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", divide(F.col("s_suppkey") - 50, F.lit(7), FieldType("BIG_INT")).alias("cut"))


@_query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) - 1 AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2, 3")
def expr_date_parts(spark, d):
    day = FieldType("DATE")
    parts = day.parts(F.col("o_orderdate").cast("date"))
    return read(spark, d, "orders").groupBy(*[parts[k].cast("bigint").alias(a) for k, a in (("year", "y"), ("month", "m"), ("day", "dd"))]).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS VARCHAR) AS said FROM orders")
def type_text_round_trip(spark, d):
    day, key = FieldType("DATE"), FieldType("BIG_INT")
    text = read(spark, d, "orders").select(key.text(F.col("o_orderkey")).alias("k"), day.text(F.col("o_orderdate").cast("date")).alias("t"))
    return text.select(key.parse(F.col("k")).alias("o_orderkey"), day.parse(F.col("t")).alias("day"), F.col("k").alias("said"))


# -- bulk operators ------------------------------------------------------------------------------------------------------


def _view(spark, d: str, table: str) -> bulk.TableInput:
    name = f"bulk_{table}_{uuid.uuid4().hex[:8]}"
    read(spark, d, table).createOrReplaceTempView(name)
    return bulk.TableInput(name)


@_query("SELECT * FROM supplier")
def bulk_identity(spark, d):
    return spark.table(bulk.Identity([_view(spark, d, "supplier")]).run(spark))


@_query("SELECT * FROM nation")
def bulk_forward_left(spark, d):
    return spark.table(bulk.ForwardLeft([_view(spark, d, "nation"), _view(spark, d, "customer")]).run(spark))


@_query("SELECT CAST(count(*) AS INTEGER) AS count FROM lineitem")
def bulk_count(spark, d):
    return spark.table(bulk.CountTuples([_view(spark, d, "lineitem")]).run(spark))


@_query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def bulk_scan_filter(spark, d):
    scan = bulk.Scan(_view(spark, d, "lineitem"), And(Atom("l_quantity", ">=", 45.0), Atom("l_returnflag", "=", "R")))
    return spark.table(scan.run(spark)).select("l_orderkey", "l_quantity")


@_query("SELECT l_returnflag, l_linestatus, CAST(count(l_orderkey) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def bulk_group_by(spark, d):
    grouped = bulk.GroupBy(_view(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [("COUNT", "l_orderkey", "n"), ("SUM", "l_quantity", "quantity")])
    return spark.table(grouped.run(spark)).withColumn("quantity", F.round("quantity", 2))


@_query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'nation' AS source FROM nation UNION ALL SELECT 'region' FROM region) GROUP BY source")
def bulk_tagged_input(spark, d):
    names = {t: _view(spark, d, t).name for t in ("nation", "region")}
    rows = bulk.tagged(spark, *names.values())
    said = F.when(rows.source == names["nation"], "nation").otherwise("region")
    return rows.groupBy(said.alias("source")).agg(F.count(F.lit(1)).alias("n"))


# -- changes -------------------------------------------------------------------------------------------------------------


def _store(spark, d: str, table: str) -> Store:
    store = Store(spark, _scratch(spark, "store"))
    rows = read(spark, d, table)
    store.create(table, rows.schema)
    store.insert(table, rows)
    return store


@_query("SELECT * FROM region UNION ALL SELECT 7, 'ATLANTIS' UNION ALL SELECT 8, NULL")
def dml_insert_values(spark, d):
    store = _store(spark, d, "region")
    dialect.execute(store, 'INSERT INTO region VALUES (7, "ATLANTIS"), (8, NULL)')
    return store.table("region")


@_query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def dml_insert_select(spark, d):
    store = _store(spark, d, "nation")
    dialect.execute(store, "INSERT INTO nation SELECT n_nationkey + 100 AS n_nationkey, n_name AS n_name, n_regionkey AS n_regionkey FROM nation WHERE n_regionkey = 1")
    return store.table("nation")


@_query("SELECT * FROM supplier WHERE NOT (s_acctbal < 0 AND s_nationkey > 5)")
def dml_delete(spark, d):
    store = _store(spark, d, "supplier")
    dialect.execute(store, "DELETE FROM supplier WHERE s_acctbal < 0 AND s_nationkey > 5")
    return store.table("supplier")


@_query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN 4 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, d):
    store = _store(spark, d, "supplier")
    dialect.execute(store, "UPDATE supplier SET s_nationkey = 4, s_acctbal = s_acctbal + 10 WHERE s_nationkey = 3")
    return store.table("supplier")


@_query("SELECT p_partkey, nullif(p_size, 10) AS size FROM part WHERE coalesce(nullif(p_size, 10) <= 25, FALSE) = FALSE")
def dml_delete_null_stays(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return deleted(rows, F.col("size") <= 25)


@_query("SELECT p_partkey, CASE WHEN nullif(p_size, 10) > 25 THEN 0 ELSE nullif(p_size, 10) END AS size FROM part")
def dml_update_null_stays(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(10)).alias("size"))
    return updated(rows, {"size": F.lit(0)}, F.col("size") > 25)


@_query("SELECT CAST(0 AS BIGINT) AS n")
def dml_truncate(spark, d):
    store = _store(spark, d, "nation")
    store.truncate("nation")
    return store.table("nation").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, CAST(max(l_suppkey) AS BIGINT) AS last FROM lineitem WHERE l_quantity < 20 GROUP BY l_returnflag")
def bulk_user_job(spark, d):
    """A map, combine and reduce job of the user."""
    view = f"lineitem_{uuid.uuid4().hex[:8]}"
    read(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_suppkey").createOrReplaceTempView(view)
    job = bulk.Job(
        [bulk.TableInput(view)],
        lambda row: [(row["l_returnflag"], {"n": 1, "last": row["l_suppkey"]})] if row["l_quantity"] < 20 else [],
        lambda values: {"n": sum(v["n"] for v in values), "last": max(v["last"] for v in values)},
        lambda key, value: [(key, value["n"], value["last"])],
        key="string",
        value="struct<n: bigint, last: bigint>",
        output="flag string, n bigint, last bigint",
    )
    return job.frame(spark)

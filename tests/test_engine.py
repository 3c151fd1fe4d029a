import io
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.fieldtypes import FieldType, divide, ingest
from lodestone.operators import bulk, results
from lodestone.operators import relational as R
from lodestone.operators.predicates import OPERATORS, And, Atom, Between, JoinAnd, JoinAtom, JoinOr, Or, invert, switch_sides
from lodestone.plans import dialect, explain
from lodestone.plans.explain import operators
from lodestone.sources.store import Store, read

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- scans and predicates against a plain model ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_random_scans(spark, seed):
    rnd = random.Random(seed)
    makers = {"int": lambda: rnd.randint(-5, 5), "double": lambda: rnd.random(), "string": lambda: "".join(rnd.choices("aBé", k=rnd.randint(0, 3)))}
    kinds = [rnd.choice(list(makers)) for _ in range(rnd.randint(2, 6))]
    data = [tuple(None if rnd.random() < 0.05 else makers[k]() for k in kinds) for _ in range(300)]
    df = spark.createDataFrame(data, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    for _ in range(4):
        preds = [Atom(f"c{c}", rnd.choice(list(OPERATORS)), makers[kinds[c]]()) for c in rnd.choices(range(len(kinds)), k=2)]
        columns = rnd.choices(range(len(kinds)), k=3)
        want = [tuple(r[c] for c in columns) for r in data if all(r[int(p.column[1:])] is not None and OPERATORS[p.op][0](r[int(p.column[1:])], p.value) for p in preds)]
        assert values(R.table_scan(df, columns, preds)) == sorted(want, key=repr)


@pytest.mark.parametrize("low,high", [(True, True), (True, False), (False, True), (False, False)])
def test_ranges(spark, low, high):
    df = spark.createDataFrame([(x,) for x in [None, *range(10), 4, 4]], "k int")
    want = [x for x in [*range(10), 4, 4] if (x > 3 or low and x == 3) and (x < 7 or high and x == 7)]
    assert [r.k for r in R.index_scan(df, "k", Between("k", 3, 7, low, high)).collect()] == sorted(want)


def test_predicate_algebra():
    assert invert("<") == ">=" and switch_sides("<=") == ">=" and invert("=") == "<>"
    assert And(Atom("a", "=", 1), Atom("b", "=", 2)) == And(Atom("b", "=", 2), Atom("a", "=", 1))
    assert Between("a", 5, 4).truth is False and Between("a", 4, 4).truth is None and Between("a", 4, 4, False).truth is False
    assert And(Atom("a", "=", 1), Atom("b", "=", None)).truth is False and Or(Atom("a", "=", 1), Atom("b", "=", None)).truth is None
    assert JoinAnd(JoinAtom("a", "=", "b")).equi and not JoinOr(JoinAtom("a", "=", "b")).equi and not JoinAtom("a", "<", "b").equi
    assert JoinAtom("a", "<", "b").switched() == JoinAtom("b", ">", "a")


# -- joins, groups, order ------------------------------------------------------------------------------------------------


def test_joins_with_duplicates_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, 5), (1, 6), (3, 7), (None, 8)], "k int, b int")
    want = [("x", 5), ("x", 6), ("y", 5), ("y", 6)]
    assert values(R.merge_join(a, b, [0], [0], [1, -1], [-1, 1])) == want
    assert values(R.nested_loop_join(a, b, JoinAtom(0, "=", 0), [1, -1], [-1, 1])) == want
    assert len(values(R.nested_loop_join(a, b, None, [1, -1], [-1, 1]))) == 16
    assert values(R.nested_loop_join(a, b, JoinAtom("k", ">", "k"), [0, -1], [-1, 0])) == [(2, 1), (2, 1)]
    assert R.nested_loop_join(a, b, None, [0, -1], [-1, 0]).columns == ["k", "k_2"]
    with pytest.raises(ValueError):
        R.merge_join(a, b, [0], [], [0], [-1])


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "g int, v int")
    fns = [("COUNT", "v", "n"), ("SUM", "v", "s"), ("AVG", "v", "a"), ("MIN", "v", "l"), ("MAX", "v", "m")]
    assert values(R.group_by(none, [], fns)) == [(0, None, None, None, None)]
    assert values(R.group_by(none, ["g"], fns)) == []
    some = spark.createDataFrame([(None, 1), (None, None), (1, 4)], "g int, v int")
    assert values(R.group_by(some, [0], [("COUNT", 1, "n"), ("AVG", 1, "a")], [None, "float"])) == sorted([(None, 1, 1.0), (1, 1, 4.0)], key=repr)


def test_null_is_lowest(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "v int")
    assert [r.v for r in R.sort(df, ["v"]).collect()] == [None, 1, 3]
    assert [r.v for r in R.sort(df, [0], [False]).collect()] == [3, 1, None]


# -- plans -----------------------------------------------------------------------------------------------------------------


def test_scan_is_pruned_and_pushed_down(spark):
    plan = R.table_scan(read(spark, SF, "lineitem"), ["l_partkey"], [Atom("l_quantity", "<", 10.0)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_join_strategies(spark):
    orders, lines = read(spark, SF, "orders"), read(spark, SF, "lineitem")
    assert "SortMergeJoin" in operators(R.merge_join(orders, lines, [0], [0], [0, -1], [-1, 3]))
    assert "CartesianProduct" not in operators(dialect.sql(spark, "SELECT n_name AS n FROM nation, region WHERE n_regionkey = r_regionkey", lambda t: read(spark, SF, t)))


def test_counts_are_partial_first(spark):
    assert operators(read(spark, SF, "lineitem").agg(F.count(F.lit(1)))).count("HashAggregate") == 2


# -- types -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("SMALL_INT", " 12 ", 12), ("INT", "NULL", None), ("BIG_INT", "-9000000000", -9000000000), ("DOUBLE", "NaN", None), ("FLOAT", "1.5", 1.5),
        ("CHAR(4)", "ab", "ab  "), ("VARCHAR(4)", "  ab ", "ab"), ("VAR_CHAR(4)", "null", None), ("DATE", "2004-3-9", "2004-03-09"),
        ("TIMESTAMP", "2004-3-9 7:05:06.070", "2004-03-09 07:05:06.070"), ("TIME", "7:05:06", "7:05:06"), ("TIME", "7:05:06 (UTC +2:30)", "7:05:06 (UTC +2:30:00)"), ("TIME", "0:00:01 (UTC -1)", "0:00:01 (UTC -1:00:00)"),
    ],
)
def test_text_of_types(spark, kind, text, want):
    t = FieldType.of(kind)
    df = spark.createDataFrame([(text,)], "t string").select(t.parse(F.col("t")).alias("v"))
    row = df.select("v", t.text(F.col("v")).alias("s")).first()
    assert df.schema["v"].dataType == t.spark
    assert row.s == ("NULL" if want is None else str(want)) and (want is not None or row.v is None)


def test_bad_texts_raise(spark):
    for kind, text in (("VARCHAR(2)", "abc"), ("CHAR(2)", "abc"), ("TIME", "25:00:00"), ("TIME", "1:00:00 (UTC +13)"), ("INT", "x")):
        with pytest.raises(Exception):
            spark.createDataFrame([(text,)], "t string").select(FieldType.of(kind).parse(F.col("t"))).collect()
    for kind in ("CHAR", "INT(3)", "VARCHAR(2000)", "BLOB"):
        with pytest.raises(ValueError):
            FieldType.of(kind)


def test_times_order_by_instant(spark):
    t = FieldType("TIME")
    df = spark.createDataFrame([("12:00:00 (UTC +2)",), ("11:00:00",), ("9:59:59",)], "t string")
    assert [r.t for r in df.orderBy(t.key(t.parse(F.col("t")))).collect()] == ["9:59:59", "12:00:00 (UTC +2)", "11:00:00"]


def test_ingest_and_division(spark):
    df = spark.createDataFrame([(float("nan"), " a ", -7)], "d double, s string, i int")
    row = df.select(ingest(F.col("d"), FieldType("DOUBLE")).alias("d"), ingest(F.col("s"), FieldType("VAR_CHAR", 5)).alias("s"), divide(F.col("i"), F.lit(2), FieldType("INT")).alias("i")).first()
    assert tuple(row) == (None, "a", -3)


# -- dialect ---------------------------------------------------------------------------------------------------------------


def test_tree_of_a_select():
    q = dialect.parse('select a.x + 2 * -3 as y, count(b) as n from t a, (select z as z from u) v where a.x <> "q\\"r" and n >= 1.5 group by a.x, b order by y descending, n')
    assert q.outputs[0].expr == dialect.Binary("+", dialect.Name("x", "a"), dialect.Binary("*", dialect.Literal(2), dialect.Literal(-3)))
    assert q.where[0].right == dialect.Literal('q"r') and q.sources[1].query.outputs[0].name == "z"
    assert [o.ascending for o in q.order] == [False, True]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT a FROM t", "SELECT a AS b FROM", "SELECT a AS b FROM t WHERE a != 3", "SELECT a AS b FROM t HAVING b > 1", "SELECT a AS b FROM t x y", "SELECT a AS count FROM t", "DELETE t", "INSERT INTO t VALUES (a)", 'SELECT "x AS b FROM t', "SELECT a - - b AS c FROM t"])
def test_errors_have_a_place(text):
    with pytest.raises(dialect.DialectError) as e:
        dialect.parse(text)
    assert 0 <= e.value.position <= len(text)


def test_identical_trees():
    p = dialect.parse
    assert dialect.identical(p("SELECT a + b AS c FROM t, u WHERE a = 1 AND b = 2"), p("select B + a as C from u, t where b = 2 and a = 1"))
    assert not dialect.identical(p("SELECT a - b AS c FROM t"), p("SELECT b - a AS c FROM t"))
    assert not dialect.identical(p("SELECT a AS a, b AS b FROM t"), p("SELECT b AS b, a AS a FROM t"))


def test_constants_fold():
    e = lambda s: dialect.fold(dialect.parse(f"SELECT {s} AS x FROM t").outputs[0].expr)
    assert e("7 / 2") == dialect.Literal(3) and e("-7 / 2") == dialect.Literal(-3) and e("7 / 2.0") == dialect.Literal(3.5)
    assert e("2 * 3 + a") == dialect.Binary("+", dialect.Literal(6), dialect.Name("a"))
    assert e("1 / 0") == dialect.Binary("/", dialect.Literal(1), dialect.Literal(0))
    tree = dialect.parse("SELECT a + b AS x FROM t").outputs[0].expr
    assert dialect.replace(tree, dialect.Name("b"), dialect.Literal(1)) == dialect.Binary("+", dialect.Name("a"), dialect.Literal(1))


def test_select_refuses_loose_columns(spark):
    with pytest.raises(ValueError):
        dialect.sql(spark, "SELECT n_name AS n, COUNT(n_regionkey) AS c FROM nation GROUP BY n_regionkey", lambda t: read(spark, SF, t))


# -- store -----------------------------------------------------------------------------------------------------------------


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    schema = spark.createDataFrame([], "id int, name string, v double").schema
    store.create("T", schema, unique=["id"])
    run = lambda s: dialect.execute(store, s)
    run('INSERT INTO t VALUES (1, "a", 1.5), (2, NULL, 2.5), (3, "c", NULL)')
    with pytest.raises(ValueError):
        run('INSERT INTO t VALUES (3, "again", 0.0)')
    with pytest.raises(ValueError):
        store.insert_values("t", [(1, "short")])
    run('UPDATE t SET v = v + 1, name = "z" WHERE v > 2')
    assert values(store.table("t")) == [(1, "a", 1.5), (2, "z", 3.5), (3, "c", None)]
    run("DELETE FROM t WHERE v < 2")
    run("INSERT INTO t SELECT id + 10 AS id, name AS name, v AS v FROM t")
    assert values(store.table("T").select("id")) == [(12,), (13,), (2,), (3,)]
    with pytest.raises(ValueError):
        run("UPDATE t SET id = 5")
    store.create_index("t", "t_pk", "id", unique=True)
    assert store.entry("t").indexes == {"t_pk": "id"} and len(values(store.table("t"))) == 4
    run("DELETE FROM t")
    assert values(run("SELECT COUNT(id) AS n FROM t")) == [(0,)] and store.tables() == ["t"]
    with pytest.raises(ValueError):
        store.create("t", schema)
    store.drop("t")
    with pytest.raises(KeyError):
        store.table("t")


def test_row_ids_and_fetch(spark):
    t = read(spark, SF, "orders")
    rids = R.index_lookup(t, "o_custkey", span=Between("o_custkey", 5, 9))
    assert values(R.fetch(rids, t, ["o_orderkey", "o_orderkey"])) == values(t.filter("o_custkey between 5 and 9").selectExpr("o_orderkey", "o_orderkey AS b"))
    assert len(values(R.fetch(rids.unionAll(rids), t, ["o_orderkey"]))) == 2 * rids.count()
    with pytest.raises(ValueError):
        R.assert_unique(t, "o_custkey")
    R.assert_unique(t, "o_orderkey")


def test_large_sort_is_ordered(spark):
    rows = [(r.l_partkey, r.l_quantity) for r in R.sort(read(spark, SF, "lineitem"), ["l_partkey", "l_quantity"]).collect()]
    assert rows == sorted(rows)


def test_layout_of_an_index(spark):
    parts = R.clustered(read(spark, SF, "lineitem").select("l_partkey"), "l_partkey", 4).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).orderBy("p").collect()
    assert all(x.b < y.a for x, y in zip(parts, parts[1:]))


def test_conjunctions_are_multisets():
    a, b = Atom("x", "=", 1), Atom("y", "<", 2)
    assert And(a, a) != And(a, b) and And(a, b, a) == And(a, a, b) and hash(And(a, b)) == hash(And(b, a))
    assert Or(a, b) == Or(b, a) and Or(a, b) != And(a, b)


def test_a_lookup_is_one_pruned_scan(spark):
    found = R.index_fetch(read(spark, SF, "lineitem"), "l_suppkey", span=Between("l_suppkey", 3, 5), columns=["l_orderkey"])
    said = explain.text(found)
    assert said.count("Scan parquet") == 2 and "GreaterThanOrEqual(l_suppkey,3)" in said and "l_quantity" not in said  # in the tree and below it


def test_readers_keep_the_version_they_began_with(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    store.create("t", spark.createDataFrame([], "id int").schema, unique=["id"])
    store.insert_values("t", [(1,), (2,)])
    before = store.table("t")
    store.insert_values("t", [(3,)])
    store.delete("t", F.col("id") < 3)
    assert values(before) == [(1,), (2,)] and values(store.table("t")) == [(3,)]
    with pytest.raises(ValueError, match="duplicate key in unique column id: 3"):
        store.insert_values("t", [(4,), (3,)])
    for i in range(10, 20):
        store.insert_values("t", [(i,)])
    store.truncate("t")
    for i in range(5):
        store.insert_values("t", [(i,)])
    assert values(store.table("t")) == [(i,) for i in range(5)]
    assert len(list((tmp_path / "db" / "t").glob("part-*"))) <= 6


def test_results_are_printed_and_errors_handed_over(spark):
    out = io.StringIO()
    results.show(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").orderBy("id"), out)
    lines = out.getvalue().splitlines()
    assert lines[0].split() == ["id", "|", "name"] and lines[2].endswith("1 | a") and lines[3].endswith("2 | NULL") and lines[-1] == "2 rows returned."
    seen = []

    class Sink:
        def open(self, schema):
            seen.append(schema.names)

        def add(self, row):
            seen.append(row)

        def close(self):
            seen.append("closed")

        def fail(self, error):
            seen.append("failed")

    results.deliver(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), Sink())
    assert seen == [["x"], "failed"]


def test_a_job_over_several_inputs(spark):
    spark.createDataFrame([("a", 1), ("b", 2), (None, 5)], "k string, v int").createOrReplaceTempView("job_left")
    spark.createDataFrame([("a", 10), (None, 7)], "k string, v int").createOrReplaceTempView("job_right")
    job = bulk.Job([bulk.TableInput("job_left"), bulk.TableInput("job_right")], lambda r: [(r["k"], r["v"] if r["_source"] == "job_left" else -r["v"])], sum, lambda k, v: [(k, v)], "string", "bigint", "k string, v bigint", held=1)
    assert values(job.frame(spark)) == values(spark.createDataFrame([("a", -9), ("b", 2), (None, -2)], "k string, v bigint"))


def test_errors_have_a_code_and_what_was_expected():
    for text, code in (("SELECT a AS a FRO t", "TOKEN"), ("SELECT a AS a FROM t ; x", "END"), ("SELECT # FROM t", "CHARACTER"), ("SELECT COUNT(a) AS n FROM t HAVING n > 1", "GROUPING")):
        with pytest.raises(dialect.DialectError) as e:
            dialect.parse(text)
        assert e.value.code == code and e.value.position > 0, text


def test_date_parts_count_months_from_0(spark):
    parts = FieldType("DATE").parts(F.to_date(F.lit("2020-03-09")))
    assert tuple(spark.range(1).select(*parts.values()).first()) == (2020, 2, 9)
    with pytest.raises(ValueError):
        FieldType("TIME").parts(F.lit(1))


def test_having_is_a_filter_after_grouping(spark):
    grouped = R.group_by(read(spark, SF, "nation"), ["n_regionkey"], [("COUNT", "n_nationkey", "n")])
    assert values(R.having(grouped, Atom("n", ">", 4)).select("n")) == [(5,)] * 5

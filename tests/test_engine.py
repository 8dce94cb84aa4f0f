"""Units of the plan API: semantics that the query catalogue does not pin down."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import queries as q
from basalt.catalog import Catalog
from basalt.config import parse, spark_settings, with_config
from basalt.operators.sort import sort, top
from basalt.plans import Builder, assign, column, constant, function, lower
from basalt.plans.nodes import scanned_tables
from basalt.plans.tune import order_filters
from basalt.result import discard, profile, progress, rendered, run
from basalt.sources import append_rows, load_delimited, load_star_schema
from basalt.streaming import run_on_batches
from basalt.types import SqlType, narrowest_bits

B, SF = Builder(), "/root/testdata/sf0.001"


@pytest.fixture
def catalog(spark):
    c = Catalog(spark)
    c.add_rows("T", [(i, i % 4) for i in range(16)], {"a": "bigint", "b": "bigint"})
    c.add_rows("none", [], {"a": "bigint", "b": "bigint"})
    return c


def rows(x):
    return sorted(tuple(r) for r in x.df.collect())


def test_sql_types():
    assert SqlType.parse("Decimal(15, 2)").literal("1.00") == 100
    assert SqlType.parse("decimal(4,2)").literal("-1.5") == -150
    assert SqlType.parse("char(1)").kind == "char1" and SqlType.parse("char(2)").kind == "text"
    assert [narrowest_bits(*d) for d in ((0, 56), (-128, 127), (-32768, 32767), (0, 2**31), (0, 2**63))] == [8, 8, 16, 64, 128]
    for bad in ("float", "decimal(2,3)", ""):
        with pytest.raises(ValueError):
            SqlType.parse(bad)


def test_catalog_names(catalog):
    assert catalog.table("t").rows == 16 and catalog.names() == ["none", "t"]
    with pytest.raises(ValueError):
        catalog.add("t", catalog.table("T").df, {"a": "bigint"})
    with pytest.raises(KeyError):
        catalog.table("missing")


def test_builder_rejects():
    scan = B.scan("t", ["a"])
    with pytest.raises(ValueError):
        B.project(scan, [function("+", "a", 1)])
    with pytest.raises(ValueError):
        B.hash_group_by(scan, ["a"], [], [assign("s", function("sum", function("+", "a", 1)))])
    with pytest.raises(ValueError):
        B.hash_join(scan, ["a"], [], scan, [])
    assert constant("82").value == 82 and constant("1-URGENT").value == "1-URGENT"


def test_unknown_names(catalog):
    for plan in (B.scan("t", ["z"]), B.select(B.scan("t", ["a"]), function("=", "z", 1)), B.select(B.scan("t", ["a"]), function("nope", "a", 1))):
        with pytest.raises(KeyError):
            lower(plan, catalog)


def test_lateral_alias_input_wins(catalog):
    items = [assign("a", function("+", "a", 1)), assign("c", function("+", "a", 0)), assign("d", function("*", "c", 10))]
    x = lower(B.project(B.scan("t", ["a"]), items), catalog)
    assert rows(x)[0] == (1, 0, 0) and rows(x)[-1] == (16, 15, 150)


def test_global_aggregate_of_nothing(catalog):
    agg = [assign("s", function("sum", "a")), assign("n", function("count", "a"))]
    assert rows(lower(B.hash_group_by(B.scan("none", ["a"]), [], [], agg), catalog)) == []
    assert rows(lower(B.hash_group_by(B.scan("t", ["a"]), [], [], agg), catalog)) == [(120, 16)]


@pytest.mark.parametrize("groups", [1, 4])
def test_many_to_many(spark, groups):
    c = Catalog(spark)
    c.add_rows("x", [(i % groups,) for i in range(16)], {"a": "bigint"})
    s = B.scan("x", ["a"])
    assert lower(B.hash_join(s, ["a"], [], s, ["a"]), c).df.count() == 16 * 16 // groups
    assert lower(B.hash_join(s, ["a"], [], s, ["a"], fk1=True), c).df.count() == 16


def test_at_most_one_payload_is_least(catalog):
    s = B.project(B.scan("t", ["a", "b"]), [assign("k", column("b")), assign("v", column("a"))])
    x = lower(B.hash_join(s, ["k"], ["v"], B.scan("t", ["b"]), ["b"], fk1=True), catalog)
    assert rows(x) == sorted((b, b, b) for b in range(4) for _ in range(4))


def test_wide_sums(spark):
    c = Catalog(spark)
    c.add_rows("x", [(2**62,), (2**62,), (2**62,)], {"a": "bigint"})
    x = lower(B.hash_group_by(B.scan("x", ["a"]), [], [], [assign("s", function("sum", "a"))]), c)
    assert int(x.df.first()[0]) == 3 * 2**62 and isinstance(x.df.schema["s"].dataType, T.DecimalType)


def test_bool_is_int_when_projected(catalog):
    x = lower(B.project(B.scan("t", ["a"]), [assign("f", function("<", "a", 3)), assign("g", function("+", function("<", "a", 3), 1))]), catalog)
    assert sorted(rows(x))[-1] == (1, 2) and x.df.schema["f"].dataType == T.IntegerType()


def test_filter_order_is_neutral(spark):
    cat, plan = load_star_schema(spark, SF), q.tpch_q6()
    assert rows(lower(plan, cat)) == rows(lower(plan, cat, reorder_filters=True))
    x = B.scan("lineitem", ["l_linenumber", "l_quantity"])
    wide, narrow = function(">=", "l_linenumber", 0), function("<", "l_quantity", 200)
    assert order_filters(B.select(B.select(x, wide), narrow), cat).predicate == wide
    assert scanned_tables(plan) == {"lineitem"}


def test_pushdown_and_pruning(spark):
    plan = q.run("tpch_q6", spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for c in ("l_shipdate", "l_quantity", "l_discount"):
        assert f"OrEqual({c}" in pushed or f"LessThan({c}" in pushed
    assert "l_orderkey" not in pushed.split("ReadSchema")[1]


def test_config(spark):
    assert parse("a=1; b = 2;") == {"a": "1", "b": "2"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with with_config(spark, "parallelism=3;vector_size=512;paranoid_mode=true"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(KeyError):
        spark_settings({"unheard_of": "1"})


@pytest.mark.parametrize("settings", ["vector_size=256", "compilation_strategy=none", "compilation_strategy=adaptive", "enable_reoptimize=false"])
def test_config_is_result_neutral(spark, settings):
    expected = rows(lower(q.tpch_q1(), load_star_schema(spark, SF, ["lineitem"])))
    with with_config(spark, settings):
        assert rows(lower(q.tpch_q1(), load_star_schema(spark, SF, ["lineitem"]))) == expected


def test_rendered(spark):
    df = spark.createDataFrame([(dt.date(1998, 9, 2), "N", 5, True)], "d date, f string, n int, b boolean")
    assert rendered(df, {"f": True}).first()[0] == "2451059|78|5|1"
    assert json.loads(profile(df))["columns"] == ["d", "f", "n", "b"]


def test_output_knows_the_plan(spark):
    x = lower(B.scan("lineitem", ["l_orderkey", "l_returnflag", "l_shipdate"]), load_star_schema(spark, SF))
    assert x.char1 == {"l_returnflag"}
    row = x.df.first()
    days = (row.l_shipdate - dt.date(1970, 1, 1)).days + 2440588
    assert rendered(x).first()[0] == f"{row.l_orderkey}|{ord(row.l_returnflag)}|{days}"
    renamed = B.hash_group_by(B.project(B.scan("lineitem", ["l_returnflag", "l_tax"]), [assign("f", column("l_returnflag")), column("l_tax")]), ["f"], [], [assign("m", function("max", "l_tax"))])
    assert lower(renamed, load_star_schema(spark, SF)).char1 == {"f"}


def test_run_and_profile(spark):
    x = lower(q.tpch_q1(), load_star_schema(spark, SF, ["lineitem"]))
    out, told = run(x)
    told = json.loads(told)
    assert out.count() == told["rows"] == 6
    scan = next(o for o in told["operators"] if o["operator"].startswith("Scan"))
    assert scan["metrics"]["numOutputRows"] > 5000 and sum("HashAggregate" in o["operator"] for o in told["operators"]) == 2
    with with_config(spark, "enable_output=0;enable_profiling=0"):
        assert run(x) == (None, None)


def test_progress(spark):
    spark.sparkContext.setJobGroup("watched", "a scan")
    assert progress(spark, "watched") == 0
    discard(lower(B.scan("lineitem", ["l_orderkey"]), load_star_schema(spark, SF)).df)
    assert progress(spark, "watched") == 1
    spark.sparkContext.setJobGroup("", "")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tpch_q3", "tpch_q9", "tpch_q10", "tpch_q18", "join_group", "join_then_sum", "join_fk1_unique", "join_fk1_payload", "join_nm", "join_multikey", "group_payload"])
def test_plans_hash(spark, name):
    assert "SortAggregate" not in _plan(q.run(name, spark, "/root/testdata/sf0.01"))


def _pairs(spark, left, right):
    c = Catalog(spark)
    for name, df in (("p", left), ("b", right)):
        c.add(name, df, dict(df.dtypes))
    return lower(B.hash_join(B.scan("b", ["k", "y"]), ["k"], ["y"], B.scan("p", ["j", "x"]), ["j"]), c).df


def test_many_matches_are_dealt_to_tasks(spark):
    """One key of 10,000 rows a side: no task makes most of the 100 million pairs."""
    p, b = (spark.range(0, 10_000, 1, 1).selectExpr(f"7L AS {k}", f"id AS {v}") for k, v in ("jx", "ky"))
    made = [r.n for r in _pairs(spark, p, b).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == 10**8 and max(made) < 7 * 10**7


@pytest.mark.parametrize("limits", [{}, {"SIDE": 4, "TASK_MATCHES": 64}, {"SIDE": 4, "TASK_MATCHES": 64, "TASK_ROWS": 16, "BROADCAST_KEYS": 0}, {"SIDE": 1000, "TASK_MATCHES": 64, "LINEAR": 1}])
def test_many_to_many_rows(spark, monkeypatch, limits):
    """Hot keys of one side or both, copies, missing keys and keys of one side only; bigint and int keys."""
    from basalt.operators import join

    for k, v in limits.items():
        monkeypatch.setattr(join, k, v)
    p = [(1, i) for i in range(50)] + [(1, 5)] * 30 + [(2, i) for i in range(90)] + [(3, 0), (None, 1), (None, 2), (4, 1)] + [(6, 6)] * 3
    b = [(1, i) for i in range(60)] + [(2, 7)] + [(3, i) for i in range(70)] + [(None, 1), (5, 1)] + [(6, 0)] * 2 + [(1, 9)] * 20
    out = _pairs(spark, spark.createDataFrame(p, "j long, x long"), spark.createDataFrame(b, "k int, y long"))
    assert out.dtypes == [("j", "bigint"), ("x", "bigint"), ("k", "int"), ("y", "bigint")]
    assert sorted(map(tuple, out.collect())) == sorted((j, x, k, y) for j, x in p for k, y in b if j is not None and j == k)


def test_many_to_many_with_itself(spark, monkeypatch):
    from basalt.operators import join

    monkeypatch.setattr(join, "SIDE", 4)
    monkeypatch.setattr(join, "TASK_MATCHES", 64)
    c = Catalog(spark)
    c.add_rows("t", [(i % 3, i % 2, i) for i in range(60)], {"a": "bigint", "b": "bigint", "v": "bigint"})
    s = B.scan("t", ["a", "b", "v"])
    x = lower(B.hash_join(s, ["a", "b"], ["v"], s, ["a", "b"]), c)
    assert x.columns == ["a__probe", "b__probe", "v__probe", "a", "b", "v"]
    assert rows(x) == sorted((i % 3, i % 2, i, j % 3, j % 2, j) for i in range(60) for j in range(60) if i % 6 == j % 6)


def test_unique_builds_are_not_reduced(spark):
    for name, aggregates in (("join_group", 2), ("tpch_q9", 2), ("tpch_q10", 2)):
        assert _plan(q.run(name, spark, "/root/testdata/sf0.01")).count("HashAggregate(") == aggregates


def test_schema_does_not_depend_on_rows(spark):
    kinds = set()
    for rows_ in (10, 10**7, 10**11):
        c = load_star_schema(spark, SF, ["lineitem"])
        c.table("lineitem")._rows = rows_
        kinds.add(lower(q.tpch_q1(), c).df.schema.simpleString())
    assert len(kinds) == 1
    with with_config(spark, "max_tuples=1000"):
        assert "sum_charge:bigint" in lower(q.tpch_q1(), load_star_schema(spark, SF, ["lineitem"])).df.schema.simpleString()


def test_sums_beyond_64_bits(spark):
    c = Catalog(spark)
    c.add_rows("x", [(v,) for v in (2**63 - 1, 2**63 - 1, -(2**63), -1, -5, 2**40, 0)], {"a": "bigint"})
    x = lower(B.hash_group_by(B.scan("x", ["a"]), [], [], [assign("s", function("sum", "a"))]), c)
    assert int(x.df.first()[0]) == 2 * (2**63 - 1) - 2**63 - 6 + 2**40


def test_runtime_bloom_filter(spark):
    """A selective build side filters the probe before its exchange."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        o = B.select(B.scan("orders", ["o_orderkey", "o_orderpriority"]), function("=", "o_orderpriority", constant("1-URGENT")))
        x = B.hash_join(o, ["o_orderkey"], ["o_orderpriority"], B.scan("lineitem", ["l_orderkey", "l_quantity"]), ["l_orderkey"], fk1=True)
        assert "might_contain" in _plan(lower(x, load_star_schema(spark, "/root/testdata/sf0.01")).df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["", "|"])
def test_delimited(spark, tmp_path, end):
    path, cache = tmp_path / "x.tbl", tmp_path / "cache"
    path.write_text("".join(f"{i}|{i}|-{i}.5|{i}.3{end}\n" for i in range(13)))
    declared = {"c0": "bigint", "c1": "decimal(2,0)", "c2": "decimal(4,1)", "c3": "decimal(8,4)"}
    c = Catalog(spark)
    load_delimited(c, "x", str(path), declared, cache=str(cache))
    expected = [(i, i, -10 * i - 5, 10000 * i + 3000) for i in range(13)]
    assert rows(lower(B.scan("x", list(declared)), c)) == sorted(expected)
    path.unlink()  # from here on the copy is read
    load_delimited(c, "y", str(path), declared, cache=str(cache))
    assert rows(lower(B.scan("y", list(declared)), c)) == sorted(expected)
    append_rows(c.table("y"), ["13|13|1.5|2.25"])
    append_rows(c.table("y"), ["14|14|1.5|2.25|"])
    assert rows(lower(B.scan("y", list(declared)), c))[-2:] == [(13, 13, 15, 22500), (14, 14, 15, 22500)]
    for bad in ("1|1|1.5|2|3", "1|1|1.5"):
        with pytest.raises(ValueError):
            append_rows(c.table("y"), [bad])
    path.write_text(f"7|7|1.0|1.0{end}\n")  # a changed file is read anew
    load_delimited(c, "z", str(path), declared, cache=str(cache))
    assert rows(lower(B.scan("z", list(declared)), c)) == [(7, 7, 10, 10000)]


def test_delimited_limit_and_failure(spark, tmp_path):
    path = tmp_path / "x.tbl"
    path.write_text("1|a\nnope|b\n")
    c = Catalog(spark)
    load_delimited(c, "x", str(path), {"a": "bigint", "b": "text"})
    with pytest.raises(Exception):
        c.table("x").df.collect()
    path.write_text("1|a\n2|b\n3|c\n")
    load_delimited(c, "z", str(path), {"a": "bigint", "b": "text"}, num_lines=2)
    assert c.table("z").rows == 2


def test_sort_and_top(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (1, "a")], "i int, s string")
    assert [tuple(r) for r in sort(df, [("i", False), ("s", True)]).collect()] == [(2, "a"), (1, "a"), (1, "b")]
    assert [tuple(r) for r in top(df, [("s", True), ("i", True)], 1).collect()] == [(1, "a")]


def test_plan_over_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    plan = B.hash_group_by(B.scan("e", ["user_id"]), ["user_id"], [], [assign("n", function("count", "user_id"))])
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run_on_batches(stream, "e", {"event_id": "bigint", "user_id": "bigint"}, plan, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r[0]: r[1] for r in spark.read.parquet(out).groupBy("user_id").agg(F.sum("n")).collect()}
    assert got == {r[0]: r[1] for r in events.groupBy("user_id").count().collect()}


def test_scaling_rounds_ties_away(spark):
    values = [0.07, 0.125, 0.135, -0.125, 2.675, 1e6, -0.07, 0.0]
    c = Catalog(spark)
    c.add("x", spark.createDataFrame([(v,) for v in values], "a double"), {"a": "decimal(12,2)"})
    assert [r[0] for r in c.table("x").scan(["a"]).collect()] == [r[0] for r in c.table("x").df.select(F.round(F.col("a") * 100).cast("long")).collect()]

"""The query catalogue: each plan with the SQL that must give the same rows.

Constants follow the local tables (dates of 1996-1998, no ``partsupp``).
Money is in cents in both forms, so no sum depends on the order of addition.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .config import with_config
from .operators.sort import sort
from .plans import Builder, assign, column, constant, function, lower
from .plans.nodes import RelOp, scanned_tables
from .result import rendered
from .result import run as run_query
from .sources import append_rows, load_delimited, load_star_schema, write_delimited
from .sources.folders import new_folder
from .types import SqlType

B = Builder()
F = function
D = lambda text: constant(dt.date.fromisoformat(text))
K = constant
PLANS: dict[str, tuple[Callable[[], RelOp], str]] = {}


def cents(c: str) -> str:
    return f"CAST(ROUND({c}*100) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def exact(x: str) -> str:
    """Of a sum that may leave 64 bits within the row bound."""
    return f"CAST({x} AS DECIMAL(38,0))"


def query(name: str, sql: str):
    def keep(plan: Callable[[], RelOp]):
        PLANS[name] = (plan, sql)
        return plan

    return keep


def _sum(name: str, col: str):
    return assign(name, F("sum", col))


def _count(name: str, col: str):
    return assign(name, F("count", col))


def lineitem(*cols: str) -> RelOp:
    return B.scan("lineitem", cols)


def revenue(name: str = "revenue") -> tuple:
    return assign(name, F("*", "l_extendedprice", F("-", K(100), column("l_discount"))))


SQL_REVENUE = f"{cents('l_extendedprice')} * (100 - {cents('l_discount')})"

# scans, filters, projections -------------------------------------------------


@query("scan_pruned", "SELECT n_nationkey, n_name FROM nation")
def _():
    return B.scan("nation", ["n_nationkey", "n_name"])


@query("scan_duplicate_cols", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _():
    return B.scan("lineitem", ["l_orderkey", "l_linenumber", "l_orderkey"])


def _filtered(name: str, sql: str, *predicates):
    @query(name, f"SELECT l_orderkey, l_linenumber, {cents('l_quantity')} AS l_quantity FROM lineitem WHERE {sql}")
    def _():
        plan = lineitem("l_orderkey", "l_linenumber", "l_quantity")
        for p in predicates:
            plan = B.select(plan, p)
        return plan


_filtered("filter_ge", "l_quantity >= 25", F(">=", "l_quantity", K(2500)))
_filtered("filter_gt", "l_quantity > 25", F(">", "l_quantity", K(2500)))
_filtered("filter_le", "l_quantity <= 25", F("<=", "l_quantity", K(2500)))
_filtered("filter_lt", "l_quantity < 25", F("<", "l_quantity", K(2500)))
_filtered("filter_eq", "l_quantity = 25", F("=", "l_quantity", K(2500)))
_filtered("filter_ne", "l_quantity <> 25", F("!=", "l_quantity", K(2500)))
_filtered("filter_range", "l_quantity >= 10 AND l_quantity < 20", F(">=", "l_quantity", K(1000)), F("<", "l_quantity", K(2000)))
_filtered("filter_empty", "l_quantity < 0", F("<", "l_quantity", K(0)))
_filtered("filter_and", "l_quantity >= 10 AND l_linenumber <> 3", F("&&", F(">=", "l_quantity", K(1000)), F("!=", "l_linenumber", K(3))))
_filtered("logic_or", "l_quantity < 5 OR l_linenumber = 3", F("||", F("<", "l_quantity", K(500)), F("=", "l_linenumber", K(3))))
_filtered("logic_or_single", "l_quantity < 5 OR l_linenumber = 3", F("|", F("<", "l_quantity", K(500)), F("=", "l_linenumber", K(3))))
_filtered("logic_and_single", "l_quantity < 5 AND l_linenumber = 3", F("&", F("<", "l_quantity", K(500)), F("=", "l_linenumber", K(3))))
_filtered("logic_not", "NOT (l_quantity < 5)", F("!", F("<", "l_quantity", K(500))))
for _name, _fn, _lo, _hi in (("between_incl", "between", ">=", "<="), ("between_upper_excl", "between<", ">=", "<"), ("between_lower_excl", "between>", ">", "<="), ("between_both_excl", "between<>", ">", "<")):
    _filtered(_name, f"l_quantity {_lo} 10 AND l_quantity {_hi} 20", F(_fn, "l_quantity", K(1000), K(2000)))


@query("project_arith", f"SELECT l_orderkey, l_linenumber, {SQL_REVENUE} AS revenue, {cents('l_tax')} + {cents('l_discount')} AS plus, {cents('l_tax')} - {cents('l_discount')} AS minus FROM lineitem")
def _():
    return B.project(
        lineitem("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"),
        [column("l_orderkey"), column("l_linenumber"), revenue(), assign("plus", F("+", "l_tax", "l_discount")), assign("minus", F("-", "l_tax", "l_discount"))],
    )


@query("project_lateral_alias", f"SELECT l_orderkey, l_linenumber, {SQL_REVENUE} AS revenue, {SQL_REVENUE} * (100 + {cents('l_tax')}) AS charge FROM lineitem")
def _():
    return B.project(
        lineitem("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"),
        [column("l_orderkey"), column("l_linenumber"), revenue(), assign("charge", F("*", "revenue", F("+", K(100), column("l_tax"))))],
    )


@query("project_rename", "SELECT n_nationkey AS a, n_name AS b FROM nation")
def _():
    return B.project(B.scan("nation", ["n_nationkey", "n_name"]), [assign("a", column("n_nationkey")), assign("b", column("n_name"))])


@query("project_bool", f"SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS is_large FROM lineitem")
def _():
    return B.project(lineitem("l_orderkey", "l_linenumber", "l_quantity"), [column("l_orderkey"), column("l_linenumber"), assign("is_large", F(">", "l_quantity", K(2500)))])


@query("string_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _():
    return B.project(B.select(B.scan("customer", ["c_custkey", "c_mktsegment"]), F("=", "c_mktsegment", K("BUILDING"))), [column("c_custkey")])


@query("string_ne", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _():
    return B.project(B.select(B.scan("customer", ["c_custkey", "c_mktsegment"]), F("!=", "c_mktsegment", K("BUILDING"))), [column("c_custkey")])


@query("string_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'blue')")
def _():
    return B.select(B.scan("part", ["p_partkey", "p_name"]), F("contains", "p_name", K("blue")))


@query("string_not_contains", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'blue')")
def _():
    return B.select(B.scan("part", ["p_partkey", "p_name"]), F("!", F("contains", "p_name", K("blue"))))


@query("ifthenelse_int", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS high FROM orders")
def _():
    urgent = F("|", F("=", "o_orderpriority", K("1-URGENT")), F("=", "o_orderpriority", K("2-HIGH")))
    return B.project(B.scan("orders", ["o_orderkey", "o_orderpriority"]), [column("o_orderkey"), assign("high", F("ifthenelse", urgent, K(1), K(0)))])


@query("ifthenelse_str", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def _():
    return B.project(B.scan("orders", ["o_orderkey", "o_orderstatus"]), [column("o_orderkey"), assign("state", F("ifthenelse", F("=", "o_orderstatus", K("O")), K("open"), K("other")))])


@query("extract_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def _():
    return B.project(B.scan("orders", ["o_orderkey", "o_orderdate"]), [column("o_orderkey"), assign("y", F("extract_year", "o_orderdate"))])


# aggregation -----------------------------------------------------------------


@query("distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _():
    return B.hash_group_by(lineitem("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])


@query("group_sum", f"SELECT l_suppkey, {big('SUM(' + cents('l_quantity') + ')')} AS qty FROM lineitem GROUP BY l_suppkey")
def _():
    return B.hash_group_by(lineitem("l_suppkey", "l_quantity"), ["l_suppkey"], [], [_sum("qty", "l_quantity")])


@query("group_sum_count", f"SELECT l_partkey, {big('SUM(' + cents('l_quantity') + ')')} AS qty, COUNT(*) AS n FROM lineitem GROUP BY l_partkey")
def _():
    return B.hash_group_by(lineitem("l_partkey", "l_quantity"), ["l_partkey"], [], [_sum("qty", "l_quantity"), _count("n", "l_quantity")])


@query("group_payload", "SELECT o_custkey, c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name")
def _():
    j = B.hash_join(B.scan("customer", ["c_custkey", "c_name"]), ["c_custkey"], ["c_name"], B.scan("orders", ["o_custkey"]), ["o_custkey"], fk1=True)
    return B.hash_group_by(j, ["o_custkey"], ["c_name"], [_count("n", "o_custkey")])


@query("agg_min_max", f"SELECT l_returnflag, MIN({cents('l_quantity')}) AS lo, MAX({cents('l_extendedprice')}) AS hi FROM lineitem GROUP BY l_returnflag")
def _():
    return B.hash_group_by(lineitem("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], [], [assign("lo", F("min", "l_quantity")), assign("hi", F("max", "l_extendedprice"))])


@query("global_agg", f"SELECT {big('SUM(' + cents('l_quantity') + ')')} AS qty, COUNT(*) AS n FROM lineitem HAVING COUNT(*) > 0")
def _():
    return B.hash_group_by(lineitem("l_quantity"), [], [], [_sum("qty", "l_quantity"), _count("n", "l_quantity")])


@query("global_agg_empty", f"SELECT {big('SUM(' + cents('l_quantity') + ')')} AS qty, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING COUNT(*) > 0")
def _():
    return B.hash_group_by(B.select(lineitem("l_quantity"), F("<", "l_quantity", K(0))), [], [], [_sum("qty", "l_quantity"), _count("n", "l_quantity")])


@query("group_having", f"SELECT l_orderkey, {big('SUM(' + cents('l_quantity') + ')')} AS qty FROM lineitem GROUP BY l_orderkey HAVING SUM({cents('l_quantity')}) > 30000")
def _():
    return _large_orders()


def _large_orders() -> RelOp:
    g = B.hash_group_by(lineitem("l_orderkey", "l_quantity"), ["l_orderkey"], [], [_sum("qty", "l_quantity")])
    return B.select(g, F(">", "qty", K(30000)))


# joins -----------------------------------------------------------------------


@query("join_fk1_unique", "SELECT l_orderkey, l_linenumber, o_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _():
    return B.hash_join(B.scan("orders", ["o_orderkey", "o_custkey"]), ["o_orderkey"], ["o_custkey"], lineitem("l_orderkey", "l_linenumber"), ["l_orderkey"], fk1=True)


@query("join_fk1_semi", "SELECT o_orderkey, o_custkey, o_orderkey AS l_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def _():
    b = B.select(lineitem("l_orderkey", "l_quantity"), F(">", "l_quantity", K(2500)))
    return B.hash_join(b, ["l_orderkey"], [], B.scan("orders", ["o_orderkey", "o_custkey"]), ["o_orderkey"], fk1=True)


@query("join_fk1_payload", "SELECT o_orderkey, l_orderkey, p AS l_partkey FROM orders JOIN (SELECT l_orderkey, MIN(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def _():
    return B.hash_join(lineitem("l_orderkey", "l_partkey"), ["l_orderkey"], ["l_partkey"], B.scan("orders", ["o_orderkey"]), ["o_orderkey"], fk1=True)


@query("join_nm", "SELECT c_custkey, c_nationkey, s_nationkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _():
    return B.hash_join(B.scan("supplier", ["s_nationkey", "s_suppkey"]), ["s_nationkey"], ["s_suppkey"], B.scan("customer", ["c_custkey", "c_nationkey"]), ["c_nationkey"])


@query("join_self", "SELECT a.n_nationkey AS n_nationkey__probe, b.n_nationkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey")
def _():
    n = B.scan("nation", ["n_nationkey"])
    return B.hash_join(n, ["n_nationkey"], [], n, ["n_nationkey"])


@query("join_multikey", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pk, sk FROM lineitem JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_quantity > 40) ON l_partkey = pk AND l_suppkey = sk")
def _():
    pairs = B.project(B.select(lineitem("l_partkey", "l_suppkey", "l_quantity"), F(">", "l_quantity", K(4000))), [assign("pk", column("l_partkey")), assign("sk", column("l_suppkey"))])
    return B.hash_join(B.hash_group_by(pairs, ["pk", "sk"]), ["pk", "sk"], [], lineitem("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("join_then_sum", f"SELECT {exact('SUM(' + cents('o_totalprice') + ')')} AS total, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey HAVING COUNT(*) > 0")
def _():
    j = B.hash_join(B.scan("orders", ["o_orderkey", "o_totalprice"]), ["o_orderkey"], ["o_totalprice"], lineitem("l_orderkey"), ["l_orderkey"], fk1=True)
    narrow = B.project(j, [assign("price", column("o_totalprice"))])
    return B.hash_group_by(narrow, [], [], [_sum("total", "price"), _count("n", "price")])


@query("join_group", f"SELECT o_custkey, {big('SUM(' + cents('l_quantity') + ')')} AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def _():
    j = B.hash_join(B.scan("orders", ["o_orderkey", "o_custkey"]), ["o_orderkey"], ["o_custkey"], lineitem("l_orderkey", "l_quantity"), ["l_orderkey"], fk1=True)
    return B.hash_group_by(j, ["o_custkey"], [], [_sum("qty", "l_quantity")])


# TPC-H shapes ----------------------------------------------------------------


@query(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, {big(f"SUM({cents('l_quantity')})")} AS sum_qty, {exact(f"SUM({cents('l_extendedprice')})")} AS sum_base_price,
    {exact(f"SUM({SQL_REVENUE})")} AS sum_disc_price, {exact(f"SUM({SQL_REVENUE} * (100 + {cents('l_tax')}))")} AS sum_charge,
    {big(f"SUM({cents('l_discount')})")} AS sum_disc, COUNT(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""",
)
def tpch_q1():
    x = B.select(lineitem("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"), F("<=", "l_shipdate", D("1998-09-02")))
    x = B.project(x, [*map(column, ("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")), revenue("disc_price"), assign("charge", F("*", "disc_price", F("+", K(100), column("l_tax"))))])
    return B.hash_group_by(x, ["l_returnflag", "l_linestatus"], [], [_sum("sum_qty", "l_quantity"), _sum("sum_base_price", "l_extendedprice"), _sum("sum_disc_price", "disc_price"), _sum("sum_charge", "charge"), _sum("sum_disc", "l_discount"), _count("count_order", "l_quantity")])


@query(
    "tpch_q3",
    f"""SELECT l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, {exact(f"SUM({SQL_REVENUE})")} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 2""",
)
def _():
    c = B.select(B.scan("customer", ["c_custkey", "c_mktsegment"]), F("=", "c_mktsegment", K("BUILDING")))
    o = B.select(B.scan("orders", ["o_orderkey", "o_custkey", "o_orderdate"]), F("<", "o_orderdate", D("1998-03-15")))
    o = B.hash_join(c, ["c_custkey"], [], o, ["o_custkey"], fk1=True)
    x = B.select(lineitem("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"), F(">", "l_shipdate", D("1998-03-15")))
    x = B.hash_join(o, ["o_orderkey"], ["o_orderdate"], x, ["l_orderkey"], fk1=True)
    x = B.project(x, [column("l_orderkey"), column("o_orderdate"), revenue("v")])
    return B.hash_group_by(x, ["l_orderkey"], ["o_orderdate"], [_sum("revenue", "v")])


@query(
    "tpch_q4",
    """SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) GROUP BY 1""",
)
def _():
    o = B.select(B.scan("orders", ["o_orderkey", "o_orderdate", "o_orderpriority"]), F("between<", "o_orderdate", D("1996-07-01"), D("1996-10-01")))
    x = B.select(lineitem("l_orderkey", "l_quantity"), F(">", "l_quantity", K(2500)))
    x = B.hash_join(x, ["l_orderkey"], [], o, ["o_orderkey"], fk1=True)
    return B.hash_group_by(x, ["o_orderpriority"], [], [_count("order_count", "o_orderpriority")])


_SQL_Q6 = f"""SELECT {exact(f"SUM({cents('l_extendedprice')} * {cents('l_discount')})")} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
    AND {cents('l_discount')} BETWEEN 5 AND 7 AND l_quantity < 24 HAVING COUNT(*) > 0"""
_Q6_DATE = F("between<", "l_shipdate", D("1996-01-01"), D("1997-01-01"))
_Q6_DISC = F("between", "l_discount", K(5), K(7))
_Q6_QTY = F("<", "l_quantity", K(2400))
_Q6_ORDERS = [(_Q6_DATE, _Q6_DISC, _Q6_QTY), (_Q6_QTY, _Q6_DISC, _Q6_DATE), (_Q6_DISC, _Q6_QTY, _Q6_DATE), (_Q6_DATE, _Q6_QTY, _Q6_DISC), (F("&&", F("&&", _Q6_DATE, _Q6_DISC), _Q6_QTY),)]


def tpch_q6(variant: int = 0) -> RelOp:
    x = lineitem("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    for p in _Q6_ORDERS[variant]:
        x = B.select(x, p)
    x = B.project(x, [assign("v", F("*", "l_extendedprice", "l_discount"))])
    return B.hash_group_by(x, [], [], [_sum("revenue", "v")])


for _i in range(5):
    query("tpch_q6" if not _i else f"tpch_q6_v{_i}", _SQL_Q6)(lambda i=_i: tpch_q6(i))


@query(
    "tpch_q9",
    f"""SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, {exact(f"SUM({SQL_REVENUE} - {cents('p_retailprice')} * {cents('l_quantity')})")} AS sum_profit
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey
    WHERE contains(p_name, 'blue') GROUP BY 1, 2""",
)
def _():
    p = B.select(B.scan("part", ["p_partkey", "p_name", "p_retailprice"]), F("contains", "p_name", K("blue")))
    s = B.hash_join(B.scan("nation", ["n_nationkey", "n_name"]), ["n_nationkey"], ["n_name"], B.scan("supplier", ["s_suppkey", "s_nationkey"]), ["s_nationkey"], fk1=True)
    x = lineitem("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    x = B.hash_join(p, ["p_partkey"], ["p_retailprice"], x, ["l_partkey"], fk1=True)
    x = B.hash_join(s, ["s_suppkey"], ["n_name"], x, ["l_suppkey"], fk1=True)
    x = B.hash_join(B.scan("orders", ["o_orderkey", "o_orderdate"]), ["o_orderkey"], ["o_orderdate"], x, ["l_orderkey"], fk1=True)
    x = B.project(x, [column("n_name"), assign("o_year", F("extract_year", "o_orderdate")), revenue("gain"), assign("cost", F("*", "p_retailprice", "l_quantity")), assign("profit", F("-", "gain", "cost"))])
    return B.hash_group_by(x, ["n_name", "o_year"], [], [_sum("sum_profit", "profit")])


@query(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {cents('c_acctbal')} AS c_acctbal, n_name, {exact(f"SUM({SQL_REVENUE})")} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 3, 4""",
)
def _():
    o = B.select(B.scan("orders", ["o_orderkey", "o_custkey", "o_orderdate"]), F("between<", "o_orderdate", D("1996-10-01"), D("1997-01-01")))
    x = B.select(lineitem("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"), F("=", "l_returnflag", K("R")))
    x = B.hash_join(o, ["o_orderkey"], ["o_custkey"], x, ["l_orderkey"], fk1=True)
    c = B.hash_join(B.scan("nation", ["n_nationkey", "n_name"]), ["n_nationkey"], ["n_name"], B.scan("customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"]), ["c_nationkey"], fk1=True)
    x = B.hash_join(c, ["c_custkey"], ["c_name", "c_acctbal", "n_name"], x, ["o_custkey"], fk1=True)
    x = B.project(x, [*map(column, ("c_custkey", "c_name", "c_acctbal", "n_name")), revenue("v")])
    return B.hash_group_by(x, ["c_custkey"], ["c_name", "c_acctbal", "n_name"], [_sum("revenue", "v")])


@query(
    "tpch_q12",
    """SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
    CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('R','A') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""",
)
def _():
    x = B.select(lineitem("l_orderkey", "l_linestatus", "l_returnflag", "l_shipdate"), F("|", F("=", "l_returnflag", K("R")), F("=", "l_returnflag", K("A"))))
    x = B.select(x, F("between<", "l_shipdate", D("1996-01-01"), D("1997-01-01")))
    x = B.hash_join(B.scan("orders", ["o_orderkey", "o_orderpriority"]), ["o_orderkey"], ["o_orderpriority"], x, ["l_orderkey"], fk1=True)
    urgent = F("|", F("=", "o_orderpriority", K("1-URGENT")), F("=", "o_orderpriority", K("2-HIGH")))
    x = B.project(x, [column("l_linestatus"), assign("high", F("ifthenelse", urgent, K(1), K(0))), assign("low", F("ifthenelse", urgent, K(0), K(1)))])
    return B.hash_group_by(x, ["l_linestatus"], [], [_sum("high_line_count", "high"), _sum("low_line_count", "low")])


@query(
    "tpch_q18",
    f"""SELECT c_custkey, c_name, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, {cents('o_totalprice')} AS o_totalprice, {big(f"SUM({cents('l_quantity')})")} AS sum_qty
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM({cents('l_quantity')}) > 30000) GROUP BY 1, 2, 3, 4, 5""",
)
def _():
    o = B.hash_join(B.project(_large_orders(), [assign("k", column("l_orderkey"))]), ["k"], [], B.scan("orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]), ["o_orderkey"], fk1=True)
    o = B.hash_join(B.scan("customer", ["c_custkey", "c_name"]), ["c_custkey"], ["c_name"], o, ["o_custkey"], fk1=True)
    x = B.hash_join(o, ["o_orderkey"], ["c_custkey", "c_name", "o_orderdate", "o_totalprice"], lineitem("l_orderkey", "l_quantity"), ["l_orderkey"], fk1=True)
    return B.hash_group_by(x, ["o_orderkey"], ["c_custkey", "c_name", "o_orderdate", "o_totalprice"], [_sum("sum_qty", "l_quantity")])


# building blocks ---------------------------------------------------------------


@query("q1_sums", f"SELECT {exact('SUM(' + cents('l_extendedprice') + ')')} AS price, {big('SUM(' + cents('l_discount') + ')')} AS discount FROM lineitem HAVING COUNT(*) > 0")
def _():
    return B.hash_group_by(lineitem("l_extendedprice", "l_discount"), [], [], [_sum("price", "l_extendedprice"), _sum("discount", "l_discount")])


@query("q3_revenue", f"SELECT {exact(f'SUM({SQL_REVENUE})')} AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate > DATE '1998-03-15' HAVING COUNT(*) > 0")
def _():
    x = B.select(lineitem("l_extendedprice", "l_discount", "l_shipdate"), F(">", "l_shipdate", D("1998-03-15")))
    return B.hash_group_by(B.project(x, [revenue("v")]), [], [], [_sum("revenue", "v"), _count("n", "v")])


@query("q4_orders_in_range", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' HAVING COUNT(*) > 0")
def _():
    return B.hash_group_by(B.select(B.scan("orders", ["o_orderkey", "o_orderdate"]), F("between<", "o_orderdate", D("1996-07-01"), D("1996-10-01"))), [], [], [_count("n", "o_orderkey")])


for _name, _preds, _where in (
    ("q6_unfiltered", (), "TRUE"),
    ("q6_only_date", (_Q6_DATE,), "l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'"),
    ("q6_only_discount", (_Q6_DISC,), f"{cents('l_discount')} BETWEEN 5 AND 7"),
    ("q6_only_quantity", (_Q6_QTY,), "l_quantity < 24"),
    ("q6_date_discount", (_Q6_DATE, _Q6_DISC), f"l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND {cents('l_discount')} BETWEEN 5 AND 7"),
):

    @query(_name, f"SELECT {exact('SUM(' + cents('l_extendedprice') + ' * ' + cents('l_discount') + ')')} AS revenue FROM lineitem WHERE {_where} HAVING COUNT(*) > 0")
    def _(preds=_preds):
        x = lineitem("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
        for p in preds:
            x = B.select(x, p)
        return B.hash_group_by(B.project(x, [assign("v", F("*", "l_extendedprice", "l_discount"))]), [], [], [_sum("revenue", "v")])


@query("q9_nation_count", "SELECT n_name, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _():
    j = B.hash_join(B.scan("nation", ["n_nationkey", "n_name"]), ["n_nationkey"], ["n_name"], B.scan("supplier", ["s_nationkey"]), ["s_nationkey"], fk1=True)
    return B.hash_group_by(j, ["n_name"], [], [_count("n", "n_name")])


@query("q9_named_parts", "SELECT CAST(SUM(p_partkey) AS DECIMAL(38,0)) AS s, COUNT(*) AS n FROM part WHERE contains(p_name, 'blue') HAVING COUNT(*) > 0")
def _():
    x = B.select(B.scan("part", ["p_partkey", "p_name"]), F("contains", "p_name", K("blue")))
    return B.hash_group_by(x, [], [], [_sum("s", "p_partkey"), _count("n", "p_partkey")])


@query("q10_prerevenue", f"SELECT {exact(f'SUM({SQL_REVENUE})')} AS revenue, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' HAVING COUNT(*) > 0")
def _():
    o = B.select(B.scan("orders", ["o_orderkey", "o_orderdate"]), F("between<", "o_orderdate", D("1996-10-01"), D("1997-01-01")))
    x = B.select(lineitem("l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"), F("=", "l_returnflag", K("R")))
    x = B.hash_join(o, ["o_orderkey"], [], x, ["l_orderkey"], fk1=True)
    return B.hash_group_by(B.project(x, [revenue("v")]), [], [], [_sum("revenue", "v"), _count("n", "v")])


@query("q12_project", "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') HAVING COUNT(*) > 0")
def _():
    x = B.select(lineitem("l_returnflag"), F("|", F("=", "l_returnflag", K("R")), F("=", "l_returnflag", K("A"))))
    x = B.project(x, [assign("is_r", F("ifthenelse", F("=", "l_returnflag", K("R")), K(1), K(0)))])
    return B.hash_group_by(x, [], [], [_count("n", "is_r"), _sum("r", "is_r")])


@query("q18_group_select", "SELECT COUNT(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300) HAVING COUNT(*) > 0")
def _():
    return B.hash_group_by(_large_orders(), [], [], [_count("n", "l_orderkey")])


def run(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    plan = PLANS[name][0]()
    return lower(plan, load_star_schema(spark, sf_dir, sorted(scanned_tables(plan))), **options).df


def sorted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-key ordering: balance descending, then key ascending."""
    plan = B.scan("customer", ["c_custkey", "c_acctbal"])
    return sort(lower(plan, load_star_schema(spark, sf_dir, ["customer"])).df, [("c_acctbal", False), ("c_custkey", True)])


def _orders_file(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, str]]:
    """Orders as delimited files in the shared folder, and their declared types."""
    kinds = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "char(1)", "o_totalprice": "decimal(10,2)", "o_orderdate": "date"}
    stored = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = new_folder(spark, "orders")
    write_delimited(stored.select("o_orderkey", "o_custkey", "o_orderstatus", stored.o_totalprice.cast("decimal(10,2)"), stored.o_orderdate.cast("date")), path)
    return path, kinds


_FILE_PLAN = B.hash_group_by(B.scan("o", ["o_custkey", "o_totalprice", "o_orderdate"]), ["o_custkey"], [], [_sum("total", "o_totalprice"), assign("last", F("max", "o_orderdate")), _count("n", "o_custkey")])
_FILE_SQL = f"SELECT o_custkey, {exact('SUM(' + cents('o_totalprice') + ')')} AS total, CAST(MAX(o_orderdate) AS DATE) AS last, COUNT(*) AS n FROM orders GROUP BY 1"


def file_scan(spark: SparkSession, sf_dir: str, cached: bool = False) -> DataFrame:
    """A plan over delimited files, or over their columnar copy."""
    path, kinds = _orders_file(spark, sf_dir)
    catalog = Catalog(spark)
    load_delimited(catalog, "o", path, kinds, cache=f"{path}-copy" if cached else None)
    return lower(_FILE_PLAN, catalog).df


def file_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a row-limited load has."""
    path, kinds = _orders_file(spark, sf_dir)
    catalog = Catalog(spark)
    load_delimited(catalog, "o", path, kinds, num_lines=100)
    return lower(B.hash_group_by(B.scan("o", ["o_orderkey"]), [], [], [_count("n", "o_orderkey")]), catalog).df


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with rows appended one by one, as lines and as values."""
    catalog = load_star_schema(spark, sf_dir, ["region"])
    width = len(catalog.table("region").df.columns)
    catalog.table("region").append([(100, "MOON", *[None] * (width - 2))])
    catalog.add_rows("more", [], {"r_regionkey": "integer", "r_name": "char(25)"})
    append_rows(catalog.table("more"), ["100|MOON|", "200|MARS"])
    j = B.hash_join(B.scan("region", ["r_regionkey", "r_name"]), ["r_regionkey"], ["r_name"], B.project(B.scan("more", ["r_regionkey"]), [assign("k", column("r_regionkey"))]), ["k"])
    return lower(B.project(j, [column("k"), column("r_regionkey"), column("r_name")]), catalog).df


def sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered output: values joined, dates as day numbers, char(1) as codes."""
    plan = B.scan("orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    return rendered(lower(plan, load_star_schema(spark, sf_dir, ["orders"])))


def sink_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without output: no rows come back, its profile has the row count."""
    with with_config(spark, "enable_output=false;enable_profiling=true"):
        out, told = run_query(lower(B.scan("orders", ["o_orderkey"]), load_star_schema(spark, sf_dir, ["orders"])))
    return spark.createDataFrame([(out is None, json.loads(told)["rows"])], "discarded boolean, n long")


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6's shape under other settings: the rows stay the same. The rows are few
    and the plan is run inside the settings."""
    with with_config(spark, "vector_size=256;parallelism=3;enable_reoptimize=false;dynamic_minmax=false"):
        rows = [tuple(r) for r in run("tpch_q6", spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "revenue decimal(38,0)")


_ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_delimited": (file_scan, _FILE_SQL),
    "source_columnar_copy": (lambda spark, sf_dir: file_scan(spark, sf_dir, cached=True), _FILE_SQL),
    "source_row_limit": (file_limited, "SELECT LEAST(COUNT(*), 100) AS n FROM orders"),
    "source_append": (appended, "SELECT 100 AS k, 100 AS r_regionkey, 'MOON' AS r_name"),
    "sink_rendered": (sink_rows, f"SELECT concat_ws('|', o_orderkey, ascii(o_orderstatus), {cents('o_totalprice')}, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588) AS row FROM orders"),
    "sink_discarded": (sink_discarded, "SELECT TRUE AS discarded, COUNT(*) AS n FROM orders"),
    "config_neutral": (configured, _SQL_Q6),
}


@query("typed_literals", f"SELECT o_orderkey FROM orders WHERE {cents('o_totalprice')} >= 10000050 AND o_orderdate < DATE '1997-06-01'")
def _():
    price, day = SqlType.parse("decimal(10,2)"), SqlType.parse("date")
    x = B.select(B.scan("orders", ["o_orderkey", "o_totalprice", "o_orderdate"]), F(">=", "o_totalprice", K(price.literal("100000.50"))))
    return B.project(B.select(x, F("<", "o_orderdate", K(day.literal("1997-06-01")))), [column("o_orderkey")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, sf_dir, n=name: run(n, spark, sf_dir)) for name in PLANS}
    out["tpch_q6_reordered"] = lambda spark, sf_dir: run("tpch_q6", spark, sf_dir, reorder_filters=True)
    out["sort_multikey"] = sorted_customers
    return out | {name: entry for name, (entry, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql) in PLANS.items()}
    out["tpch_q6_reordered"] = _SQL_Q6
    out["sort_multikey"] = f"SELECT c_custkey, {cents('c_acctbal')} AS c_acctbal FROM customer ORDER BY 2 DESC, 1"
    return out | {name: sql for name, (_, sql) in _ENTRIES.items()}

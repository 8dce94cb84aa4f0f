"""The star schema's Parquet tables with their declared types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..catalog import Catalog

#: Declared types. Money is held in cents.
STAR_SCHEMA: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "integer", "r_name": "char(25)"},
    "nation": {"n_nationkey": "integer", "n_name": "char(25)", "n_regionkey": "integer"},
    "supplier": {"s_suppkey": "bigint", "s_name": "char(25)", "s_nationkey": "integer", "s_acctbal": "decimal(15,2)"},
    "customer": {"c_custkey": "bigint", "c_name": "varchar(25)", "c_nationkey": "integer", "c_acctbal": "decimal(15,2)", "c_mktsegment": "char(10)"},
    "part": {"p_partkey": "bigint", "p_name": "varchar(55)", "p_brand": "char(10)", "p_type": "varchar(25)", "p_size": "integer", "p_retailprice": "decimal(8,2)"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "char(1)", "o_totalprice": "decimal(10,2)", "o_orderdate": "date", "o_orderpriority": "char(15)"},
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer",
        "l_quantity": "decimal(4,2)", "l_extendedprice": "decimal(8,2)", "l_discount": "decimal(2,2)", "l_tax": "decimal(2,2)",
        "l_returnflag": "char(1)", "l_linestatus": "char(1)", "l_shipdate": "date",
    },
}

#: The column that no two rows of a table share.
UNIQUE = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}


def load_star_schema(spark: SparkSession, sf_dir: str, tables: Iterable[str] = STAR_SCHEMA) -> Catalog:
    """A catalog of these tables; only they are opened."""
    catalog = Catalog(spark)
    for name in tables:
        catalog.add(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), STAR_SCHEMA[name], unique=[[UNIQUE[name]]] if name in UNIQUE else ())
    return catalog

"""Test mappings: the driver's tables seen as long (entity, code, date) tables.

The method's real inputs (health records) are not public; these mappings turn
public benchmark tables into inputs with the same shape. Each returns the
columns of :class:`~tierwise.plans.spec.ColumnSpec` (default names) plus a row
key where the table has one.

* ``m1_orders``    - orders: entity = customer, about 10 records each, years as dates
* ``m2_lineitem``  - lineitem: entity = order, about 4 records each, an unrecognised source
* ``m3_events``    - events: entity = user, about 67 records each, real dates
* ``m4_all_codes`` - lineitem: every code that a preset names, ``J`` and ``U``, a real code
  ``historic``, NULL codes, NULL entities, NULL dates, unrecognised and NULL sources
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _case(col: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    expr = None
    for when, then in pairs:
        expr = F.when(col == when, F.lit(then)) if expr is None else expr.when(col == when, F.lit(then))
    return expr.otherwise(F.lit(default))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Fixed values for the mappings (same as the oracle SQL in __spark_entry__).
M1_CODES = [("1-URGENT", "A"), ("2-HIGH", "G"), ("3-MEDIUM", "S"), ("4-NOT SPECIFIED", "Z")]
M1_SOURCES = [("F", "apc"), ("O", "ae")]
M2_CODES = [("AF", "A"), ("AO", "G"), ("NF", "S"), ("NO", "Z"), ("RF", "99")]
M2_SOURCES = [(0, "apc"), (1, "ae"), (2, "op")]
M3_CODES = [("click", "A"), ("error", "99"), ("purchase", "G"), ("signup", "S")]
M3_SOURCES = [(0, "apc"), (1, "ae")]
M4_CODES = ["99", "X", "-1", "-3", "Z", "S", "G", "L", "P", "C", "J", "U", "A", "B", "historic"]
M4_SOURCES = [(0, "apc"), (1, "ae"), (2, "op"), (3, "oth")]


def m1_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.col("o_custkey").alias("entity"),
        _case(F.col("o_orderpriority"), M1_CODES, "99").alias("category"),
        F.year("o_orderdate").cast("int").alias("observed_at"),
        _case(F.col("o_orderstatus"), M1_SOURCES, "op").alias("source"),
        (F.col("o_totalprice") > 250000).cast("int").alias("flag"),
    )


def m2_lineitem(spark: SparkSession, sf_dir: str, *, null_flags: bool = False) -> DataFrame:
    """M2; with ``null_flags`` the flag is NULL wherever ``l_quantity < 10``."""
    li = _read(spark, sf_dir, "lineitem")
    flag = (F.col("l_discount") > 0.05).cast("int")
    if null_flags:
        flag = F.when(F.col("l_quantity") < 10, F.lit(None)).otherwise(flag)
    return li.select(
        F.col("l_orderkey").alias("entity"),
        _case(F.concat("l_returnflag", "l_linestatus"), M2_CODES, "B").alias("category"),
        F.year("l_shipdate").cast("int").alias("observed_at"),
        _case(F.col("l_linenumber") % 4, M2_SOURCES, "oth").alias("source"),
        flag.alias("flag"),
    )


def m3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("entity"),
        _case(F.col("event_type"), M3_CODES, "Z").alias("category"),
        F.to_date("ts").alias("observed_at"),
        _case(F.col("event_id") % 3, M3_SOURCES, "op").alias("source"),
        (F.col("value") > 10).cast("int").alias("flag"),
    )


def m4_all_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part 0 to 16 modulo 17 choose the code: the listed ones, NULL, then A again."""
    li = _read(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") % 17
    category = _case(part, list(enumerate(M4_CODES)), "A")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_orderkey") % 40 != 0, F.col("l_orderkey")).alias("entity"),
        F.when(part != len(M4_CODES), category).alias("category"),
        F.when(F.col("l_linenumber") != 3, F.year("l_shipdate").cast("int")).alias("observed_at"),
        F.when(F.col("l_suppkey") % 5 != 4, _case(F.col("l_suppkey") % 5, M4_SOURCES, "")).alias("source"),
        F.when(F.col("l_quantity") >= 10, (F.col("l_discount") > 0.05).cast("int")).alias("flag"),
    )

"""Readers, and views of star-schema tables as the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_SQL = """
select r_regionkey*8+0 as node_id, 'Region' as label, r_name as name, cast(null as string) as grp from region
union all select n_nationkey*8+1, 'Nation', n_name, cast(null as string) from nation
union all select c_custkey*8+2, 'Customer', c_name, c_mktsegment from customer
union all select s_suppkey*8+3, 'Supplier', s_name, cast(null as string) from supplier
union all select p_partkey*8+4, 'Part', p_name, p_brand from part
union all select o_orderkey*8+5, 'Purchase', cast(o_orderkey as string), o_orderpriority from orders"""
EDGES_SQL = """
select n_nationkey*8+1 as from_node, n_regionkey*8+0 as to_node, 'IN_REGION' as relation, cast(1.0 as double) as weight from nation
union all select c_custkey*8+2, c_nationkey*8+1, 'IN_NATION', c_acctbal from customer
union all select s_suppkey*8+3, s_nationkey*8+1, 'BASED_IN', s_acctbal from supplier
union all select o_custkey*8+2, o_orderkey*8+5, 'PLACED', o_totalprice from orders
union all select l_orderkey*8+5, l_partkey*8+4, 'CONTAINS', l_quantity from lineitem
union all select l_suppkey*8+3, l_partkey*8+4, 'SUPPLIES', l_extendedprice from lineitem"""
KV_SQL = """
select event_id as seq, ts, concat('u', cast(user_id as string), ':', event_type) as k, props as v,
 case user_id % 3 when 0 then 0 when 1 then 86400 else 604800 end as ttl,
 case when event_id % 7 = 0 then 'delete' else 'set' end as op from events"""
ACCESS_SQL = "select (user_id*7+event_id) % 500 as vec_id, ts from events"
WAL_SQL = """
select event_id+1 as lsn, case when event_type in ('view','click') then 'kv' when event_type='purchase' then 'graph' else 'vector' end as layer,
 cast(user_id as string) as entity_key, case event_id % 5 when 0 then 'delete' when 1 then 'update' else 'insert' end as op, props as payload from events"""


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sql(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """SQL over tables of a folder, without leaving views behind."""
    return spark.sql(_placeholders(sql, names), **{n: read(spark, folder, n) for n in names})


def _placeholders(sql: str, names) -> str:
    import re

    return re.sub(r"\bfrom (\w+)", lambda m: f"from {{{m[1]}}}" if m[1] in names else m[0], sql)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    d = _sql(spark, folder, NODES_SQL, "region", "nation", "customer", "supplier", "part", "orders")
    return d.select("node_id", "label", F.create_map(F.lit("name"), "name", F.lit("grp"), "grp").alias("properties"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, EDGES_SQL, "nation", "customer", "supplier", "orders", "lineitem")


def kv_log(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, KV_SQL, "events")


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, ACCESS_SQL, "events")


def wal(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, WAL_SQL, "events")

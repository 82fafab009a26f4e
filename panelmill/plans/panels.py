"""Panels built from the tables, as DataFrames and as SQL.

Each panel is `(unique_id, ds, y)` with one row per observed step. Sums are
rounded to the two decimals of their inputs so that equal values stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _aggregate(df: DataFrame, uid: Column, ds: Column, value: str) -> DataFrame:
    return df.groupBy(uid.alias("unique_id"), ds.alias("ds")).agg(F.round(F.sum(value), 2).alias("y"))


def _bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts).cast("timestamp"))


def panel(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name == "events_hourly":
        return _aggregate(read(spark, sf, "events"), F.col("event_type"), _bucket("ts", "hour"), "value")
    if name == "events_6h":
        day = _bucket("ts", "day")
        quarter = F.timestamp_seconds(F.unix_seconds(day) + F.floor(F.hour("ts") / 6) * 21600)
        return _aggregate(read(spark, sf, "events"), F.col("event_type"), quarter, "value")
    if name == "events_user_type":
        uid = F.concat_ws("_", F.col("user_id").cast("string"), "event_type")
        return _aggregate(read(spark, sf, "events"), uid, _bucket("ts", "hour"), "value")
    if name == "orders_daily":
        return _aggregate(read(spark, sf, "orders"), F.col("o_orderpriority"), _bucket("o_orderdate", "day"),
                          "o_totalprice")
    if name == "lineitem_daily":
        return _aggregate(read(spark, sf, "lineitem"), F.concat("l_returnflag", "l_linestatus"),
                          _bucket("l_shipdate", "day"), "l_quantity")
    if name == "supplier_weekly":
        return _aggregate(read(spark, sf, "lineitem"), F.col("l_suppkey").cast("string"),
                          _bucket("l_shipdate", "week"), "l_quantity")
    if name == "nation_monthly":
        orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
        customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return _aggregate(orders.join(customers, "o_custkey"), F.col("c_nationkey").cast("string"),
                          _bucket("o_orderdate", "month"), "o_totalprice")
    raise ValueError(f"unknown panel {name}")


FREQ = {
    "events_hourly": "H", "events_6h": "6H", "events_user_type": "H", "orders_daily": "D",
    "lineitem_daily": "D", "supplier_weekly": "W-MON", "nation_monthly": "MS",
}
STEP = {"H": "1 HOUR", "6H": "6 HOUR", "D": "1 DAY", "W-MON": "7 DAY", "MS": "1 MONTH"}


def _sql(uid: str, ds: str, value: str, source: str) -> str:
    return (f"SELECT {uid} AS unique_id, CAST({ds} AS TIMESTAMP) AS ds, round(sum({value}), 2) AS y "
            f"FROM {source} GROUP BY 1, 2")


SQL = {
    "events_hourly": _sql("event_type", "date_trunc('hour', ts)", "value", "events"),
    "events_6h": _sql("event_type", "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01')", "value", "events"),
    "events_user_type": _sql("CAST(user_id AS VARCHAR) || '_' || event_type", "date_trunc('hour', ts)", "value",
                             "events"),
    "orders_daily": _sql("o_orderpriority", "date_trunc('day', o_orderdate)", "o_totalprice", "orders"),
    "lineitem_daily": _sql("l_returnflag || l_linestatus", "date_trunc('day', l_shipdate)", "l_quantity", "lineitem"),
    "supplier_weekly": _sql("CAST(l_suppkey AS VARCHAR)", "date_trunc('week', l_shipdate)", "l_quantity", "lineitem"),
    "nation_monthly": _sql("CAST(c_nationkey AS VARCHAR)", "date_trunc('month', o_orderdate)", "o_totalprice",
                           "orders JOIN customer ON o_custkey = c_custkey"),
}


def dense_sql(name: str) -> str:
    """CTEs `p` (panel), `g` (grid) and `f` (gap-filled, with pos and n)."""
    step = STEP[FREQ[name]]
    return f"""
p AS ({SQL[name]}),
g AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL {step})) AS ds FROM p GROUP BY 1),
f AS (SELECT unique_id, ds, p.y,
             row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS pos,
             count(*) OVER (PARTITION BY unique_id) AS n
      FROM g LEFT JOIN p USING (unique_id, ds))"""


def filled_sql(name: str) -> str:
    """`dense_sql` plus `h`: the history filled forward, backward, with 0."""
    return dense_sql(name) + """,
h AS (SELECT *, coalesce(
        last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS yf
      FROM f)"""

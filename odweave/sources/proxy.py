"""Flows, reports and weather read off tables of orders, for use where the real inputs are not at hand.

Nations are cells, an order line is a movement from the customer's to the supplier's
nation, its quantity the flow. All views are narrow scans with the date filter at the
source; the joins on keys are left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROXY, PROXY_STATIONS, Settings
from . import tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nationkey, cell, y, x, area, lat, lon; nation 0 is the outside sentinel."""
    k = F.col("n_nationkey")
    y, x = (F.lit(33) + F.floor(k / 5)).cast("int"), (F.lit(30) + k % 5).cast("int")
    return _table(spark, sf_dir, "nation").select(
        k.alias("nationkey"), F.when(k == 0, "-1_-1").otherwise(F.concat_ws("_", y, x)).alias("cell"), y.alias("y"), x.alias("x"), F.col("n_regionkey").alias("area"),
        (37.0 + (y - 35) * 0.018).alias("lat"), (136.7 + (x - 30) * 0.0225).alias("lon"),
    )


def _orders(spark: SparkSession, sf_dir: str, s: Settings, *columns: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    # The bound on the raw column reaches the scan.
    inside = (F.col("o_orderdate") >= F.lit(s.start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.date_add(F.lit(s.end), 1).cast("timestamp_ntz"))
    return _table(spark, sf_dir, "orders").where(inside).select(day.alias("day"), *columns)


def flows(spark: SparkSession, sf_dir: str, s: Settings = PROXY) -> DataFrame:
    """day, origin, dest, value of the whole calendar."""
    cells = nation_cells(spark, sf_dir).select("nationkey", "cell")
    orders = _orders(spark, sf_dir, s, "o_orderkey", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ok"))
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dk"))
    moved = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    # Summed by nation keys first, named after: the strings meet 625 pairs a day at most.
    by_key = moved.groupBy("day", "ok", "dk").agg(F.sum("l_quantity").alias("value"))
    o, d = cells.toDF("ok", "origin"), cells.toDF("dk", "dest")
    return by_key.join(o, "ok").join(d, "dk").select("day", "origin", "dest", "value")


def reports(spark: SparkSession, sf_dir: str, s: Settings = PROXY) -> DataFrame:
    """area, day, evac, water: shares of order states on report days after the break; area 4 never reports, area 2 reports nothing once."""
    region = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("area")), "c_nationkey").select("c_custkey", "area")
    orders = _orders(spark, sf_dir, s, "o_custkey", "o_orderstatus").where(F.dayofmonth("day").isin(3, 10, 20) & (F.col("day") >= F.date_add(F.lit(s.break_day), 2)))
    share = lambda x: F.count_if(F.col("o_orderstatus") == x).cast("double") / F.count("*").cast("double")
    got = orders.join(region, F.col("o_custkey") == F.col("c_custkey")).where("area <> 4").groupBy("area", "day").agg(share("F").alias("evac"), share("O").alias("water"))
    silent = (F.col("area") == 2) & (F.col("day") == F.date_add(F.lit(s.break_day), 19))
    return got.select("area", "day", *[F.when(~silent, F.col(c)).alias(c) for c in ("evac", "water")])


def weather(spark: SparkSession, sf_dir: str, s: Settings = PROXY) -> DataFrame:
    """day, station, rain, snow of days with lines; some rain is missing."""
    inside = (F.col("l_shipdate") >= F.lit(s.start).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.date_add(F.lit(s.end), 1).cast("timestamp_ntz"))
    lines = _table(spark, sf_dir, "lineitem").where(inside).select(F.to_date("l_shipdate").alias("day"), "l_suppkey", "l_discount")
    got = lines.groupBy("day", F.concat(F.lit("st"), F.col("l_suppkey") % 6).alias("station")).agg(
        F.sum(F.floor(F.col("l_discount") * 100 + 0.5).cast("int")).alias("r"), F.count("*").cast("double").alias("snow")
    )
    return got.select("day", "station", F.when(F.col("r") % 7 != 0, F.col("r").cast("double")).alias("rain"), "snow")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, facility_count (0 where there is none)."""
    n = _table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").cast("double").alias("n"))
    return nation_cells(spark, sf_dir).join(n, "nationkey", "left").select("cell", F.coalesce("n", F.lit(0.0)).alias("facility_count"))


def stations(spark: SparkSession) -> DataFrame:
    return tables.stations(spark, PROXY_STATIONS)

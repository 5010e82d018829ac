"""Readers of the side tables, with fixed schemas, and the dimensions that come from settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Box, Settings
from ..functions.columns import day_int, is_year_end


def read_rates(spark: SparkSession, path: str, column: str) -> DataFrame:
    """area, day, rate from a CSV of reports; text that is no number is a missing rate. (area, day) has to be unique."""
    raw = spark.read.csv(path, header=True)  # all strings: numbers are cast here, so bad ones become null
    return raw.select(F.col("市町名").alias("area"), F.to_date("日付").alias("day"), F.col(column).try_cast("double").alias("rate"))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """day, station, rain, snow."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.to_date("date").alias("day"), "station", F.col("precipitation_total_mm").try_cast("double").alias("rain"), F.col("snow_depth_max_cm").try_cast("double").alias("snow"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """cell, area, lat, lon."""
    raw = spark.read.csv(path, header=True).select("grid_id", "area", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    return raw.withColumnRenamed("grid_id", "cell")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """cell, facility_count."""
    return spark.read.csv(path, header=True).select(F.col("grid_id").alias("cell"), F.col("facility_count").cast("double").alias("facility_count"))


def stations(spark: SparkSession, places: dict[str, tuple[float, float]]) -> DataFrame:
    """station, ord, lat, lon; a fixed handful of rows."""
    return spark.createDataFrame([(n, i, *p) for i, (n, p) in enumerate(places.items())], "station string, ord int, lat double, lon double")


def calendar(spark: SparkSession, s: Settings) -> DataFrame:
    """One row a day of the span: t, day_int, weekday (Monday 0), year_end, regime, cv_window, is_test, in_span."""
    day = F.col("day")
    window = F.coalesce(*[F.when(day.between(F.lit(a), F.lit(b)), F.lit(n)) for n, a, b in s.windows])
    in_span = day.between(*map(F.lit, s.test_span))
    days = spark.range(1).select(F.explode(F.sequence(F.lit(s.start), F.lit(s.end))).alias("day"))
    return days.select(
        "day", F.datediff(day, F.lit(s.start)).alias("t"), day_int(day).alias("day_int"), F.weekday(day).alias("weekday"), is_year_end(day).alias("year_end"),
        (day >= F.lit(s.break_day)).cast("int").alias("regime"), window.alias("cv_window"), (in_span & ~day.isin(list(s.test_excluded))).alias("is_test"), in_span.alias("in_span"),
    )


def box_cells(spark: SparkSession, box: Box) -> DataFrame:
    """cell, y, x, cell_ord of the box, by y, then x."""
    ys = spark.range(1).select(F.explode(F.sequence(F.lit(box.y_min), F.lit(box.y_max))).alias("y"))
    cells = ys.select("y", F.explode(F.sequence(F.lit(box.x_min), F.lit(box.x_max))).alias("x"))
    order = (F.col("y") - box.y_min) * (box.x_max - box.x_min + 1) + F.col("x") - box.x_min
    return cells.select(F.concat_ws("_", "y", "x").alias("cell"), "y", "x", order.cast("int").alias("cell_ord"))


def aligned(cells: DataFrame, attributes: DataFrame, *needed: str) -> DataFrame:
    """Every cell with its attributes; a cell that has none is an error."""
    j = cells.join(attributes.withColumn("_there", F.lit(True)), "cell", "left")
    guard = F.when(F.col("_there"), F.col("cell")).otherwise(F.raise_error(F.concat(F.lit("cell without attributes: "), "cell")).cast("string"))
    return j.withColumn("cell", guard).drop("_there").select(*cells.columns, *needed)

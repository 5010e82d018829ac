"""Flows as text: one line a day, ``YYYYMMDD<tab>{origin: {destination: value}}`` or ``NA``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import day_int

MAP = "map<string,map<string,double>>"


def read_od_days(spark: SparkSession, path: str) -> DataFrame:
    """day, od (nested map): days with NA are left out, an empty map is an observed day, anything else unreadable is an error."""
    part = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(part[0].alias("d"), F.get(part, F.lit(1)).alias("p"), "value")
    day, od = F.try_to_timestamp("d", F.lit("yyyyMMdd")).cast("date"), F.from_json("p", MAP)
    # One expression decides, so that no filter can be moved around the error.
    error = F.raise_error(F.concat(F.lit("malformed flow line: "), F.substring("value", 1, 80))).cast(MAP)
    read = F.when(F.trim("p") == "NA", F.lit(None).cast(MAP)).when(od.isNull() | day.isNull(), error).otherwise(od)
    return rows.select(day.alias("day"), read.alias("od")).where("od is not null")


def explode_od(days: DataFrame) -> DataFrame:
    """day, origin, dest, value: one row a recorded pair."""
    return days.select("day", F.explode("od").alias("origin", "m")).select("day", "origin", F.explode("m").alias("dest", "value"))


def read_od(spark: SparkSession, path: str) -> DataFrame:
    return explode_od(read_od_days(spark, path))


def od_lines(flows: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """day, value: one line a day, for the days (day) that are named or else for those that have a row; a day without a row is an empty map."""
    by_origin = flows.groupBy("day", "origin").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dest", "value")))).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("origin", "m")), lambda x, y: F.when(x["origin"] < y["origin"], -1).when(x["origin"] > y["origin"], 1).otherwise(0))
    by_day = by_origin.groupBy("day").agg(F.to_json(F.map_from_entries(ordered)).alias("body"))
    if days is not None:
        by_day = days.select("day").distinct().join(by_day, "day", "left")
    return by_day.select("day", F.concat(day_int(F.col("day")).cast("string"), F.lit("\t"), F.coalesce("body", F.lit("{}"))).alias("value"))


def write_od(flows: DataFrame, path: str, days: DataFrame | None = None) -> None:
    """A single text file, days ascending; a day's line is one row, so what one task writes is as many rows as there are days."""
    spark = flows.sparkSession
    parts = f"{path}.parts"
    od_lines(flows, days).repartition(1).sortWithinPartitions("day").select("value").write.mode("overwrite").text(parts)
    # The one part takes the file's name, in whatever store the path lies.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    part = next(str(f.getPath()) for f in fs.listStatus(hadoop(parts)) if f.getPath().getName().startswith("part-"))
    if not fs.rename(hadoop(part), hadoop(path)):
        raise OSError(f"{path} was not written")
    fs.delete(hadoop(parts), True)

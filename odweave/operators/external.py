"""External features: as-of reports, nearest usable station, cell and pair features, standardising."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, haversine_km


def as_of(reports: DataFrame, cal: DataFrame, areas: DataFrame, values: list[str]) -> DataFrame:
    """area, day, t and values: the latest report on or before each day, missing values included as they are.

    Before the first report a value is missing; before the break it is 0; an area
    without any report is missing throughout. Each report is spread over the days it
    holds for, so the join is one of equal keys, with no range condition. Two reports of
    an area on one day are an error.
    """
    last = cal.agg(F.max("day").alias("last"))
    by_area = Window.partitionBy("area").orderBy("day")
    held = reports.withColumn("_next", F.lead("day").over(by_area)).join(last, F.lit(True))
    until = F.coalesce(F.date_sub("_next", 1), "last")
    tied = F.when(F.col("_next") == F.col("day"), F.raise_error(F.concat(F.lit("two reports of one day: "), F.col("day").cast("string"))).cast("date")).otherwise(until)
    spread = held.withColumn("_until", tied).where("_until >= day").select("area", F.explode(F.sequence("day", "_until")).alias("day"), *values)
    known = reports.select("area").distinct().withColumn("_reports", F.lit(True))
    grid = areas.select("area").distinct().join(known, "area", "left").join(cal.select("day", "t", "regime"), F.lit(True))
    j = grid.join(spread, ["area", "day"], "left")
    before = F.col("_reports") & (F.col("regime") == 0)
    return j.select("area", "day", "t", *[F.when(before, F.lit(0.0)).otherwise(F.col(v)).alias(v) for v in values])


def weather_complete(weather: DataFrame, cal: DataFrame, stations: DataFrame) -> DataFrame:
    """Every station on every day; a second row of a station and day is an error."""
    one = weather.groupBy("day", "station").agg(F.count("*").alias("_n"), F.first("rain").alias("rain"), F.first("snow").alias("snow"))
    guard = lambda c: F.when(F.col("_n") > 1, F.raise_error(F.lit("two weather rows of one station and day")).cast("double")).otherwise(F.col(c)).alias(c)
    return cal.select("day", "t").join(stations.select("station"), F.lit(True)).join(one, ["day", "station"], "left").select("day", "t", "station", guard("rain"), guard("snow"))


def station_distances(cells: DataFrame, stations: DataFrame) -> DataFrame:
    """cell, station, ord, km; stations are a fixed handful."""
    st = stations.select("station", "ord", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return cells.join(st, F.lit(True)).select("cell", "station", "ord", haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")).alias("km"))


def nearest_weather(complete: DataFrame, distances: DataFrame, value: str) -> DataFrame:
    """day, t, cell and log1p of the value at the nearest station with a finite, non-negative one; ties to the first station; else missing.

    A cell has its stations in order of distance and a day a map of usable values, so a cell's value is the
    first that the map has; stations by cells by days are never rows.
    """
    usable = complete.where(finite(F.col(value)) & (F.col(value) >= 0)).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("station", value))).alias("_values"))
    ranked = distances.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("km", "ord", "station")))["station"].alias("_stations"))
    grid = complete.select("day", "t").distinct().join(usable, "day", "left").join(ranked, F.lit(True))
    found = F.filter(F.transform("_stations", lambda x: F.try_element_at("_values", x)), lambda x: x.isNotNull())
    return grid.select("day", "t", "cell", F.log1p(F.get(found, F.lit(0))).alias(value))


def daily_features(cells: DataFrame, rates: DataFrame, rain: DataFrame, snow: DataFrame) -> DataFrame:
    """day, t, cell, evac, water, rain, snow; ``cells`` has cell and area."""
    by_cell = cells.select("cell", "area").join(rates, "area").drop("area")
    return by_cell.join(rain.select("day", "cell", "rain"), ["day", "cell"]).join(snow.select("day", "cell", "snow"), ["day", "cell"])


def cell_features(daily: DataFrame, facility: DataFrame) -> DataFrame:
    """Adds shelter: evac times log1p of the cell's facilities."""
    return daily.join(facility, "cell").withColumn("shelter", F.col("evac") * F.log1p("facility_count")).drop("facility_count")


PAIR_COLUMNS = ("evac_anchor", "evac_partner", "water_anchor", "water_partner", "rain_anchor", "rain_partner", "snow_anchor", "snow_partner", "log_facility", "has_facility", "evac_facility")


def pair_features(pairs: DataFrame, daily: DataFrame, facility: DataFrame, view: str) -> DataFrame:
    """day, t, pair_id and PAIR_COLUMNS: what holds at the anchor and at the partner, and the partner's facilities."""
    from .matrix import ANCHOR

    anchor, partner = ANCHOR[view]
    base = pairs.select("pair_id", F.col(anchor).alias("anchor"), F.col(partner).alias("partner"))
    groups = ("evac", "water", "rain", "snow")
    a = daily.select("day", "t", F.col("cell").alias("anchor"), *[F.col(g).alias(f"{g}_anchor") for g in groups])
    b = daily.select("day", F.col("cell").alias("partner"), *[F.col(g).alias(f"{g}_partner") for g in groups])
    f = facility.select(F.col("cell").alias("partner"), "facility_count")
    j = base.join(a, "anchor").join(b, ["day", "partner"]).join(f, "partner")
    j = j.withColumn("log_facility", F.log1p("facility_count")).withColumn("has_facility", (F.col("facility_count") > 0).cast("double")).withColumn("evac_facility", F.col("evac_partner") * F.col("log_facility"))
    return j.select("day", "t", "pair_id", *PAIR_COLUMNS)


@dataclass(frozen=True)
class Scale:
    """How one standardised feature is made: of a column's value, or of whether it is missing."""

    name: str
    missing: bool
    mean: float
    sd: float

    def of(self, value: Column) -> Column:
        x = (~finite(value)).cast("double") if self.missing else F.when(finite(value), value).otherwise(F.lit(self.mean))
        return (x - self.mean) / self.sd


def moments(value: Column) -> list[Column]:
    """n, n_ok, mean, sd: what ``scales`` has to know of a column on the training rows."""
    x = F.when(finite(value), value)
    return [F.count("*").alias("n"), F.count(x).alias("n_ok"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd")]


def scales(column: str, n: int, n_ok: int, mean: float | None, sd: float | None, constant_sd: float) -> list[Scale]:
    """A column's value and its flag, as far as they vary on the training rows.

    Missing values take the mean of the others, which leaves it and shrinks the deviation.
    """
    if not n_ok:
        return []
    gone = (n - n_ok) / n
    both = (Scale(column, False, mean, sd * math.sqrt(n_ok / n)), Scale(f"{column}_missing", True, gone, math.sqrt(gone * (1 - gone))))
    return [x for x in both if x.sd >= constant_sd]


def standardize(raw: DataFrame, columns: list[str], mask: str, constant_sd: float = 1e-10) -> tuple[DataFrame, list[str]]:
    """Features by their mean and deviation over the rows where ``mask`` holds; (frame, surviving columns).

    Missing values take the training mean and set a flag; a column without any
    training value, and a value or flag that does not vary on the mask, is dropped.
    One aggregation of a few numbers decides which; the frame stays lazy.
    """
    one = raw.where(F.col(mask)).agg(*[F.struct(*moments(F.col(c))).alias(c) for c in columns]).first()
    made = [(c, x) for c in columns for x in scales(c, *one[c], constant_sd)]
    if not made:
        raise ValueError("no feature has a value that varies on the training rows")
    keep = [c for c in raw.columns if c not in columns]
    return raw.select(*keep, *[x.of(F.col(c)).alias(x.name) for c, x in made]), [x.name for _, x in made]

"""Flow matrices in long form: splits, candidate pairs, totals, shares, templates.

Flows are rows (day, origin, dest, value). Cells are parsed once; what is dense in a
matrix program stays sparse here and is filled up by ``dense`` only where a model
needs every day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Box, Settings
from ..functions.columns import in_box, safe_divide

ANCHOR = {"outgoing": ("origin", "dest"), "incoming": ("dest", "origin")}


def located(flows: DataFrame, box: Box) -> DataFrame:
    """Adds o_in and d_in."""
    return flows.withColumn("o_in", in_box(F.col("origin"), box)).withColumn("d_in", in_box(F.col("dest"), box))


def in_box_flows(flows: DataFrame, box: Box) -> DataFrame:
    return located(flows, box).where("o_in and d_in").drop("o_in", "d_in")


def outside_flows(flows: DataFrame, box: Box) -> DataFrame:
    return located(flows, box).where("not (o_in and d_in)").drop("o_in", "d_in")


def held_out_days(cal: DataFrame) -> DataFrame:
    return cal.where("cv_window is not null").select("day", "cv_window")


def split(flows: DataFrame, cal: DataFrame, s: Settings, holdout: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, truth): held-out days only count as in-box truth; days in the test span are in neither; a day outside the calendar is an error."""
    days = cal.select("day", "cv_window", "in_span", F.lit(True).alias("_known"))
    j = flows.join(days, "day", "left")
    # One expression tells the error, so no filter can be moved before it.
    strict = F.when(F.col("_known"), F.col("in_span")).otherwise(F.raise_error(F.concat(F.lit("a day outside the calendar: "), F.col("day").cast("string"))).cast("boolean"))
    known = j.withColumn("in_span", strict)
    train = known.where("not in_span and cv_window is null") if holdout else known.where("not in_span")
    truth = in_box_flows(known.where("cv_window is not null"), s.box) if holdout else in_box_flows(known.limit(0), s.box)
    return train.select(*flows.columns), truth.select(*flows.columns)


def train_days(train: DataFrame, cal: DataFrame) -> DataFrame:
    """Observed training days with their calendar fields."""
    return cal.join(train.select("day").distinct(), "day", "left_semi")


def recorded_days(days: DataFrame, cal: DataFrame, holdout: bool = True) -> DataFrame:
    """Training days among ``days`` (day) on which something was recorded, be it that nobody moved."""
    open_ = cal.where("not in_span and cv_window is null") if holdout else cal.where("not in_span")
    return open_.join(days.select("day").distinct(), "day", "left_semi")


def leak_guard(target: DataFrame, observed: DataFrame) -> DataFrame:
    """Target days that are also observed; has to be empty."""
    return target.select("day").join(observed.select("day"), "day", "left_semi")


def candidate_pairs(train: DataFrame, box: Box) -> DataFrame:
    """pair_id, origin, dest: in-box pairs of different cells with a positive flow on any training day, numbered in order."""
    pairs = in_box_flows(train, box).where("origin <> dest and value > 0").select("origin", "dest").distinct()
    # Numbered within an origin, after all pairs of the origins before; only one row an origin of the box is summed in a single task.
    before = F.sum("n").over(Window.orderBy("origin").rowsBetween(Window.unboundedPreceding, -1))
    first = pairs.groupBy("origin").agg(F.count("*").alias("n")).select("origin", F.coalesce(before, F.lit(0)).alias("first"))
    own = pairs.withColumn("own", F.row_number().over(Window.partitionBy("origin").orderBy("dest")) - 1)
    return own.join(first, "origin").select((F.col("first") + F.col("own")).cast("int").alias("pair_id"), "origin", "dest")


def candidate_flows(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """day, pair_id, origin, dest, value of candidate pairs; other pairs are left out."""
    return train.join(pairs, ["origin", "dest"]).select("day", "pair_id", "origin", "dest", "value")


def view_totals(flows: DataFrame, view: str) -> DataFrame:
    """day, anchor, total: candidate flow by anchor cell; the anchor is the origin of outgoing, the destination of incoming."""
    anchor, _ = ANCHOR[view]
    return flows.groupBy("day", F.col(anchor).alias("anchor")).agg(F.sum("value").alias("total"))


def view_shares(flows: DataFrame, view: str) -> DataFrame:
    """day, anchor, partner, value, total, share: one shuffle on (day, anchor)."""
    anchor, partner = ANCHOR[view]
    total = F.sum("value").over(Window.partitionBy("day", anchor))
    return flows.select("day", F.col(anchor).alias("anchor"), F.col(partner).alias("partner"), "value", total.alias("total"), safe_divide(F.col("value"), total).alias("share"))


def dense(series: DataFrame, keys: list[str], days: DataFrame, ids: DataFrame, value: str = "value") -> DataFrame:
    """Every day of ``days`` for every row of ``ids``, 0 where ``series`` has none. A product by definition: days are a few hundred."""
    grid = ids.select(*keys, F.lit(1).alias("_one")).join(days.select("day", "t", F.lit(1).alias("_one")), "_one").drop("_one")
    return grid.join(series.select("day", *keys, value), ["day", *keys], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def outside_weekday_mean(train: DataFrame, cal: DataFrame, box: Box, observed: DataFrame | None = None) -> DataFrame:
    """weekday, origin, dest, mean over all observed days of that weekday since the break, whether the pair was seen or not."""
    late = train.join(cal.where("regime = 1").select("day", "weekday"), "day")
    days = late.select("weekday", "day").distinct() if observed is None else observed.where("regime = 1").select("weekday", "day")
    days = days.groupBy("weekday").agg(F.count("*").alias("n_days"))
    sums = outside_flows(late, box).groupBy("weekday", "origin", "dest").agg(F.sum("value").alias("total"))
    return sums.join(days, "weekday").select("weekday", "origin", "dest", (F.col("total") / F.col("n_days")).alias("mean"))


def active(flows: DataFrame, key: str) -> DataFrame:
    """Series with a positive value on any day."""
    return flows.groupBy(key).agg(F.max((F.col("value") > 0).cast("int")).alias("active")).where("active = 1").select(key)


def regime_level(dense_series: DataFrame, key: str, cal: DataFrame, observed: DataFrame) -> DataFrame:
    """key, regime, level: mean over observed days of each regime, 0 without any."""
    seen = cal.select("day", "regime").join(observed.select("day", F.lit(True).alias("_seen")), "day", "left")
    level = F.coalesce(F.avg(F.when(F.col("_seen"), F.col("value"))), F.lit(0.0))
    return dense_series.join(seen, "day").groupBy(key, "regime").agg(level.alias("level"))


def share_fallback(flows: DataFrame, pairs: DataFrame, view: str) -> DataFrame:
    """pair_id, ratio: a pair's training flow over its anchor's."""
    anchor, _ = ANCHOR[view]
    per = flows.groupBy("pair_id").agg(F.sum("value").alias("flow"))
    all_ = flows.groupBy(F.col(anchor).alias("_a")).agg(F.sum("value").alias("total"))
    j = pairs.join(per, "pair_id", "left").join(all_, F.col(anchor) == F.col("_a"), "left")
    return j.select("pair_id", "origin", "dest", safe_divide(F.coalesce("flow", F.lit(0.0)), F.coalesce("total", F.lit(0.0))).alias("ratio"))


def share_renormalized(shares: DataFrame, fallback: DataFrame) -> DataFrame:
    """day, anchor, pair_id, share: negatives to 0, then to a sum of 1 by day and anchor; where nothing is left, the fallback ratio.

    ``shares`` has day, anchor, pair_id, share.
    """
    up = F.greatest(F.col("share"), F.lit(0.0))
    total = F.sum(up).over(Window.partitionBy("day", "anchor"))
    return shares.join(fallback.select("pair_id", "ratio"), "pair_id").select("day", "anchor", "pair_id", F.when(total > 0, up / total).otherwise(F.col("ratio")).alias("share"))

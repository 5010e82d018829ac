"""Scores of predicted flows: daily RMSE over fixed denominators, normalised period means, error breakdowns, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from .matrix import in_box_flows


def matched(pred: DataFrame, truth: DataFrame, s: Settings) -> DataFrame:
    """day, origin, dest, pred, actual of in-box pairs on either side; a missing side counts 0."""
    p = in_box_flows(pred, s.box).select("day", "origin", "dest", F.coalesce("value", F.lit(0.0)).alias("pred"))
    a = in_box_flows(truth, s.box).select("day", "origin", "dest", F.col("value").alias("actual"))
    return p.join(a, ["day", "origin", "dest"], "full_outer").select("day", "origin", "dest", F.coalesce("pred", F.lit(0.0)).alias("pred"), F.coalesce("actual", F.lit(0.0)).alias("actual"))


def daily_rmse(both: DataFrame, days: DataFrame, s: Settings, predicted: DataFrame | None = None) -> DataFrame:
    """day, cv_window, rmse_diag, rmse_off of every held-out day, also of those without any row.

    ``predicted`` names the days for which there is a prediction, be it an empty one; another day to score is an error.
    """
    sq = F.pow(F.col("pred") - F.col("actual"), 2)
    diag = F.col("origin") == F.col("dest")
    per = both.groupBy("day").agg(F.sum(F.when(diag, sq)).alias("d"), F.sum(F.when(~diag, sq)).alias("o"))
    root = lambda c, n: F.sqrt(F.coalesce(c, F.lit(0.0)) / float(n))
    days = days.select("day", "cv_window")
    if predicted is not None:
        there = days.join(predicted.select("day", F.lit(True).alias("_there")).distinct(), "day", "left")
        missing = F.raise_error(F.concat(F.lit("no prediction of "), F.col("day").cast("string"))).cast("string")
        days = there.select("day", F.when(F.col("_there"), F.col("cv_window")).otherwise(missing).alias("cv_window"))
    return days.join(per, "day", "left").select("day", "cv_window", root("d", s.n_diag).alias("rmse_diag"), root("o", s.n_off).alias("rmse_off"))


def period_scores(daily: DataFrame, s: Settings) -> DataFrame:
    """period (overall and each window), n_days, nrmse_diag, nrmse_offdiag, combined_nrmse. No day at all is an error."""
    sums = [F.count("*").alias("n_days"), F.avg("rmse_diag").alias("d"), F.avg("rmse_off").alias("o")]
    # A total of its own, since it has a row (and so its error) for an empty input too.
    by = daily.agg(*sums).select(F.lit(None).cast("string").alias("cv_window"), "*").unionByName(daily.groupBy("cv_window").agg(*sums))
    n = F.when(F.col("n_days") > 0, F.col("n_days")).otherwise(F.raise_error(F.lit("no day to score")).cast("long"))
    d, o = F.col("d") / s.norm_diag, F.col("o") / s.norm_off
    return by.select(F.coalesce("cv_window", F.lit("overall")).alias("period"), n.alias("n_days"), d.alias("nrmse_diag"), o.alias("nrmse_offdiag"), ((d + o) / 2).alias("combined_nrmse"))


def hit_extra_miss(both: DataFrame) -> DataFrame:
    """kind, n, sq_error, share of the off-diagonal squared error: recorded and predicted, predicted only, recorded only."""
    off = both.where("origin <> dest and (pred > 0 or actual > 0)").withColumn("e", F.pow(F.col("pred") - F.col("actual"), 2))
    kind = F.when((F.col("pred") > 0) & (F.col("actual") > 0), "hit").when(F.col("pred") > 0, "extra").otherwise("miss")
    per = off.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("e").alias("sq_error"))
    return per.withColumn("share", F.col("sq_error") / F.sum("sq_error").over(Window.partitionBy()))


def concentration(both: DataFrame, tops: tuple[int, ...] = (10, 50)) -> DataFrame:
    """top, share: part of the off-diagonal squared error in the worst pairs."""
    per = both.where("origin <> dest").groupBy("origin", "dest").agg(F.sum(F.pow(F.col("pred") - F.col("actual"), 2)).alias("e"))
    total = per.agg(F.sum("e").alias("all"))
    worst = per.orderBy(F.desc("e"), "origin", "dest").limit(max(tops)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("e"), "origin", "dest")))
    sums = [F.sum(F.when(F.col("place") <= n, F.col("e"))).alias(f"t{n}") for n in tops]
    pairs = F.array(*[F.struct(F.lit(n).alias("top"), (F.col(f"t{n}") / F.col("all")).alias("share")) for n in tops])
    return worst.agg(*sums).join(total, F.lit(True)).select(F.explode(pairs).alias("x")).select("x.top", "x.share")


def cell_concentration(both: DataFrame, top: int = 100) -> DataFrame:
    """top, share: part of the diagonal squared error in the worst cells."""
    per = both.where("origin = dest").groupBy("origin").agg(F.sum(F.pow(F.col("pred") - F.col("actual"), 2)).alias("e"))
    worst = per.orderBy(F.desc("e"), "origin").limit(top).agg(F.sum("e").alias("worst"))
    return worst.join(per.agg(F.sum("e").alias("all")), F.lit(True)).select(F.lit(top).alias("top"), (F.col("worst") / F.col("all")).alias("share"))


def error_by_area(both: DataFrame, areas: DataFrame) -> DataFrame:
    """area of the origin, part (diagonal or off-diagonal): squared error over that of predicting nothing, predicted and actual totals."""
    j = both.join(areas.select(F.col("cell").alias("origin"), "area"), "origin")
    part = F.when(F.col("origin") == F.col("dest"), "diagonal").otherwise("off-diagonal")
    e, z = F.sum(F.pow(F.col("pred") - F.col("actual"), 2)), F.sum(F.pow("actual", F.lit(2)))
    return j.groupBy("area", part.alias("part")).agg(F.when(z > 0, e / z).alias("relative_error"), F.sum("pred").alias("pred_total"), F.sum("actual").alias("actual_total"))


def daily_pairs(both: DataFrame, days: DataFrame) -> DataFrame:
    """day, n_predicted, n_recorded, n_both: off-diagonal pairs with a positive value."""
    off = F.col("origin") != F.col("dest")
    said, there = off & (F.col("pred") > 0), off & (F.col("actual") > 0)
    per = both.groupBy("day").agg(F.count_if(said).alias("n_predicted"), F.count_if(there).alias("n_recorded"), F.count_if(said & there).alias("n_both"))
    return days.select("day").join(per, "day", "left").na.fill(0)


def daily_bias(both: DataFrame, days: DataFrame) -> DataFrame:
    """day, bias_diag, bias_off: (predicted - actual) / actual, null where nothing is recorded."""
    diag = F.col("origin") == F.col("dest")
    sums = [F.sum(F.when(c, F.col(v))).alias(n) for c, v, n in ((diag, "pred", "pd"), (diag, "actual", "ad"), (~diag, "pred", "po"), (~diag, "actual", "ao"))]
    per = both.groupBy("day").agg(*sums)
    bias = lambda p, a: F.when(F.col(a) > 0, (F.coalesce(p, F.lit(0.0)) - F.col(a)) / F.col(a))
    return days.select("day").join(per, "day", "left").select("day", bias("pd", "ad").alias("bias_diag"), bias("po", "ao").alias("bias_off"))


def candidate_coverage(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of held-out off-diagonal pairs, and of their flow, that candidate pairs cover."""
    off = truth.where("origin <> dest and value > 0").join(pairs.select("origin", "dest", F.lit(1).alias("c")), ["origin", "dest"], "left")
    return off.agg(F.count("*").alias("n"), F.count("c").alias("n_covered"), F.sum("value").alias("amount"), F.sum(F.when(F.col("c") == 1, F.col("value")).otherwise(0.0)).alias("amount_covered"))


def neighbours(target: DataFrame, observed: DataFrame, same_weekday: bool) -> DataFrame:
    """day, prev, next: nearest observed days around each target day, over one ordered pass of both day lists."""
    keys = ["weekday"] if same_weekday else []
    both = target.select("day", "weekday", F.lit(None).cast("date").alias("o")).unionByName(observed.select("day", "weekday", F.col("day").alias("o")))
    w = Window.partitionBy(*keys).orderBy("day")
    near = both.select("day", "o", F.last("o", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.first("o", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    return near.where("o is null").select("day", "prev", "next")


def interpolated(flows: DataFrame, around: DataFrame) -> DataFrame:
    """day, origin, dest, value: linear between the days around, or the one that there is; unrecorded is 0."""
    span = F.datediff("next", "prev")
    wp = F.when(F.col("next").isNull(), 1.0).otherwise(F.when(F.col("prev").isNull(), 0.0).otherwise(F.datediff("next", "day") / span))
    sides = around.select("day", F.explode(F.array(F.struct(F.col("prev").alias("at"), wp.alias("w")), F.struct(F.col("next").alias("at"), (1.0 - wp).alias("w")))).alias("x")).select(F.col("day").alias("target"), "x.at", "x.w").where("at is not null")
    j = sides.join(flows, sides["at"] == flows["day"])
    return j.groupBy(F.col("target").alias("day"), "origin", "dest").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def appearance_times_mean(flows: DataFrame, observed: DataFrame, target: DataFrame) -> DataFrame:
    """day, origin, dest, value: how often a pair appears on the weekday's observed days times its mean when it does."""
    days = observed.groupBy("weekday").agg(F.count("*").alias("n_days"))
    per = flows.where("value > 0").join(observed.select("day", "weekday"), "day").groupBy("weekday", "origin", "dest").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    typical = per.join(days, "weekday").select("weekday", "origin", "dest", (F.col("n") / F.col("n_days") * F.col("mean")).alias("value"))
    return target.select("day", "weekday").join(typical, "weekday").select("day", "origin", "dest", "value")

"""Analyses of recorded flows and of predictions that are documented beside the model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quantized
from ..operators import matrix, scoring


def presence_daily(v, s) -> DataFrame:
    """day, cell, presence: flow by origin, own cell included."""
    return matrix.in_box_flows(v.od, s.box).groupBy("day", F.col("origin").alias("cell")).agg(F.sum("value").alias("presence"))


def presence_monthly(v, s) -> DataFrame:
    """month, cell, mean presence over the month's observed days, and its log1p."""
    days = v.od.select("day").distinct().groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    per = presence_daily(v, s).groupBy(F.date_format("day", "yyyy-MM").alias("month"), "cell").agg(F.sum("presence").alias("p"))
    mean = F.col("p") / F.col("n")
    return per.join(days, "month").select("month", "cell", quantized(mean).alias("mean"), quantized(F.log1p(mean)).alias("log_mean"))


def presence_weekly(v, s) -> DataFrame:
    """week (from the break, negative before), cell, mean presence over the week's observed days."""
    week = F.floor(F.datediff("day", F.lit(s.break_day)) / 7).cast("int")
    days = v.od.select("day").distinct().groupBy(week.alias("week")).agg(F.count("*").alias("n"))
    per = presence_daily(v, s).groupBy(week.alias("week"), "cell").agg(F.sum("presence").alias("p"))
    return per.join(days, "week").select("week", "cell", quantized(F.col("p") / F.col("n")).alias("mean"))


def classed(cells: DataFrame, land: DataFrame, shore: int = 2) -> DataFrame:
    """Adds kind to ``cells`` (cell, y, x, active): land, sea, or noise for activity at sea ``shore`` cells or more from all land.

    ``land`` has y and x of the land mask. The mask is grown cell by cell instead of measuring distances: each land cell is
    spread over the square around it, so the join is one of equal keys.
    """
    steps = F.sequence(F.lit(1 - shore), F.lit(shore - 1))
    near = land.select("y", "x", F.explode(steps).alias("dy")).select((F.col("y") + F.col("dy")).alias("y"), F.col("x"), F.explode(steps).alias("dx")).select("y", (F.col("x") + F.col("dx")).alias("x"))
    known = land.select("y", "x", F.lit(True).alias("_land")).distinct()
    j = cells.join(known, ["y", "x"], "left").join(near.distinct().withColumn("_near", F.lit(True)), ["y", "x"], "left")
    kind = F.when(F.col("_land"), "land").when(F.col("active") & F.col("_near").isNull(), "noise").otherwise("sea")
    return j.select(*cells.columns, kind.alias("kind"))


def cell_class(v, s, shore: int = 2) -> DataFrame:
    """cell, kind and presence of all cells; five nations in a corner of the grid stand for the land."""
    all_ = v.od.groupBy(F.col("origin").alias("cell")).agg(F.sum("value").alias("presence"))
    cells = v.nations.where("cell <> '-1_-1'").select("cell", "y", "x", "nationkey").join(all_, "cell", "left").withColumn("active", F.coalesce(F.col("presence") > 0, F.lit(False)))
    land = cells.where("nationkey in (1, 2, 6, 7, 11)").select("y", "x")
    return classed(cells, land, shore).select("cell", "kind", F.coalesce("presence", F.lit(0.0)).alias("presence"))


def damage_ratio(v, s, least: float = 1.0, cap: float = 3.0) -> DataFrame:
    """cell, before, after, ratio: log2 of January's daily mean over that of the two months before, for cells with enough before, capped."""
    before = F.col("day") < F.lit(s.break_day)
    after = (F.col("day") >= F.lit(s.break_day)) & (F.col("day") < F.add_months(F.lit(s.break_day), 1))
    days = v.od.select("day").distinct().agg(F.count_if(before).alias("nb"), F.count_if(after).alias("na"))
    per = presence_daily(v, s).groupBy("cell").agg(F.coalesce(F.sum(F.when(before, F.col("presence"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(after, F.col("presence"))), F.lit(0.0)).alias("a"))
    j = per.join(days, F.lit(True)).select("cell", (F.col("b") / F.col("nb")).alias("before"), (F.col("a") / F.col("na")).alias("after")).where(F.col("before") >= least)
    ratio = F.when(F.col("after") > 0, F.greatest(F.lit(-cap), F.least(F.lit(cap), F.log2(F.col("after") / F.col("before"))))).otherwise(F.lit(-cap))
    return j.select("cell", quantized(F.col("before")).alias("before"), quantized(F.col("after")).alias("after"), quantized(ratio).alias("ratio"))


def damage_topk(v, s, k: int = 5) -> DataFrame:
    """The cells that lost most; ties by name."""
    return damage_ratio(v, s).orderBy("ratio", "cell").limit(k)


def weekly_recovery(v, s) -> DataFrame:
    """week (from the break, negative before), part (north or south half), activity in percent of the mean week of the eight before the break."""
    rows = (s.box.y_min + s.box.y_max) / 2
    week = F.floor(F.datediff("day", F.lit(s.break_day)) / 7).cast("int")
    cells = v.cells.select(F.col("cell"), F.when(F.col("y") > rows, "north").otherwise("south").alias("part"))
    per = presence_daily(v, s).join(cells, "cell").groupBy(week.alias("week"), "part").agg(F.sum("presence").alias("p"))
    base = per.where("week between -8 and -1").groupBy("part").agg((F.sum("p") / 8).alias("base"))
    return per.join(base, "part").where("base > 0").select("week", "part", quantized(100 * F.col("p") / F.col("base")).alias("percent"))


def cell_geo(v, s) -> DataFrame:
    """cell with its longitude and latitude, a linear function of its place."""
    return v.nations.where("cell <> '-1_-1'").select("cell", quantized(F.col("lat")).alias("lat"), quantized(F.col("lon")).alias("lon"))


def daily_total(v, s) -> DataFrame:
    return v.od.groupBy("day").agg(F.sum("value").alias("total"), F.count("*").alias("n_pairs"))


def directional_baseline(flows: DataFrame, pairs: DataFrame, observed: DataFrame, target: DataFrame, view: str) -> DataFrame:
    """day, origin, dest, value: weekday mean of the anchor's total times the training ratio of the pair."""
    anchor, _ = matrix.ANCHOR[view]
    days = observed.groupBy("weekday").agg(F.count("*").alias("n_days"))
    total = matrix.view_totals(flows, view).join(observed.select("day", "weekday"), "day").groupBy("weekday", "anchor").agg(F.sum("total").alias("all"))
    mean = total.join(days, "weekday").select("weekday", "anchor", (F.col("all") / F.col("n_days")).alias("mean"))
    ratio = matrix.share_fallback(flows, pairs, view).select("origin", "dest", "ratio", F.col(anchor).alias("anchor"))
    return target.select("day", "weekday").join(mean, "weekday").join(ratio, "anchor").select("day", "origin", "dest", (F.col("mean") * F.col("ratio")).alias("value"))


def blend_compare(v, s) -> DataFrame:
    """variant, rmse_off over all held-out days, and the correlation of the two views' errors."""
    from .forecast import blend

    o, i = (directional_baseline(v.flows, v.pairs, v.observed, v.target, x) for x in ("outgoing", "incoming"))
    truth = v.truth.where("origin <> dest")
    a, b = (scoring.matched(x, truth, s).select("day", "origin", "dest", (F.col("pred") - F.col("actual")).alias(n)) for x, n in ((o, "eo"), (i, "ei")))
    c = scoring.matched(blend(o, i, s.incoming_weight), truth, s).select("day", "origin", "dest", (F.col("pred") - F.col("actual")).alias("eb"))
    j = a.join(b, ["day", "origin", "dest"], "full_outer").join(c, ["day", "origin", "dest"], "full_outer").na.fill(0.0, ["eo", "ei", "eb"])
    root = lambda x: F.sqrt(F.avg(F.pow(x, F.lit(2))))
    one = j.agg(root(F.col("eo")).alias("o"), root(F.col("ei")).alias("i"), root(F.col("eb")).alias("b"), F.corr("eo", "ei").alias("c"))
    row = lambda n, x: F.struct(F.lit(n).alias("variant"), quantized(F.col(x)).alias("value"))
    return one.select(F.explode(F.array(row("outgoing", "o"), row("incoming", "i"), row("blend", "b"), row("error_correlation", "c"))).alias("x")).select("x.variant", "x.value")


def submission_shape(pred: DataFrame) -> DataFrame:
    """day, n_rows, n_bad (null, not finite or negative) and n_twice (pairs given again)."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.abs("value") == float("inf"))
    return pred.groupBy("day").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"), (F.count("*") - F.countDistinct("origin", "dest")).alias("n_twice"))

"""Queries over the tables of orders, one for each operator, each with SQL of another engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROXY, Settings
from ..functions.columns import in_box, parse_cell, quantized
from ..operators import external, matrix, ridge, scoring, smoothing
from ..sources import proxy, tables
from ..sources.storage import scratch, store
from . import analytics, forecast
from .oracle import SQL

S: Settings = PROXY
Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


class Views:
    """The frames that queries start from, built lazily and once a call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.cal = tables.calendar(spark, S)
        self.nations = proxy.nation_cells(spark, sf_dir)
        self.cells = self.nations.where(in_box(F.col("cell"), S.box))
        self.od = proxy.flows(spark, sf_dir, S)
        self.train, self.truth = matrix.split(self.od, self.cal, S)

    @property
    def observed(self) -> DataFrame:
        return matrix.train_days(self.train, self.cal)

    @property
    def target(self) -> DataFrame:
        return self.cal.where("cv_window is not null")

    @property
    def pairs(self) -> DataFrame:
        return matrix.candidate_pairs(self.train, S.box)

    @property
    def flows(self) -> DataFrame:
        return matrix.candidate_flows(self.train, self.pairs)

    @property
    def diag(self) -> DataFrame:
        return matrix.in_box_flows(self.train, S.box).where("origin = dest").select("day", F.col("origin").alias("cell"), "value")

    @property
    def diag_dense(self) -> DataFrame:
        return matrix.dense(self.diag, ["cell"], self.cal, self.cells)

    @property
    def facility(self) -> DataFrame:
        return proxy.facilities(self.spark, self.dir)

    @property
    def inputs(self) -> forecast.Inputs:
        return forecast.proxy_inputs(self.spark, self.dir, S)

    @property
    def daily(self) -> DataFrame:
        """Stored: several sides of one plan look at it."""
        return store(forecast.daily_external(self.inputs))

    @property
    def baseline(self) -> DataFrame:
        """Same-weekday interpolation inside the box, the prediction that SQL can make too."""
        return scoring.interpolated(matrix.in_box_flows(self.train, S.box), scoring.neighbours(self.target, self.observed, True))

    @property
    def matched(self) -> DataFrame:
        return scoring.matched(self.baseline, self.truth, S)


# --- sources and calendar ----------------------------------------------------


@query
def calendar_dim(spark, sf_dir):
    """The calendar, with the number of recorded pairs a day."""
    v = Views(spark, sf_dir)
    recorded = v.od.groupBy("day").agg(F.count("*").alias("n_pairs"))
    days = v.cal.join(recorded, "day", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return days.select("day", "t", "day_int", "weekday", "year_end", "regime", "cv_window", "is_test", "in_span", "n_pairs")


def regressors(cal: DataFrame) -> DataFrame:
    """t and the calendar's columns of the design."""
    return cal.select("t", *[(F.col("weekday") == k).cast("int").alias(f"weekday_{k}") for k in range(1, 7)], F.col("year_end").cast("int").alias("turn"))


@query
def calendar_regressors(spark, sf_dir):
    """The regressors of the days that are learned from, with what the diagonal sums to on each."""
    v = Views(spark, sf_dir)
    return regressors(v.observed).join(v.diag_dense.groupBy("t").agg(F.sum("value").alias("diagonal")), "t")


@query
def eval_cells(spark, sf_dir):
    """Every cell of the box in order, with its facilities and the flow that starts in it."""
    v = Views(spark, sf_dir)
    flow = matrix.in_box_flows(v.od, S.box).groupBy(F.col("origin").alias("cell")).agg(F.sum("value").alias("flow"))
    return tables.box_cells(spark, S.box).join(v.facility, "cell", "left").join(flow, "cell", "left").select(
        "cell", "y", "x", "cell_ord", F.coalesce("facility_count", F.lit(0.0)).alias("facility_count"), F.coalesce("flow", F.lit(0.0)).alias("flow"))


@query
def cell_parse(spark, sf_dir):
    """Every pair of numbers that keys of suppliers and of nations make, well-formed or not."""
    v = Views(spark, sf_dir)
    ids = v.nations.select("cell").union(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat_ws("_", (F.col("s_suppkey") % 120).cast("string"), F.when(F.col("s_suppkey") % 7 == 0, "x").otherwise((F.col("s_suppkey") % 90).cast("string")))).alias("cell"))
    c = parse_cell(F.col("cell"))
    return ids.distinct().select("cell", c["y"].alias("y"), c["x"].alias("x"), in_box(F.col("cell")).alias("in_box"))


def _csv(frame: DataFrame, **names: str) -> str:
    """The frame as a folder of CSV files with these column names; nulls as a dash, which is no number. Its path."""
    path = scratch(frame.sparkSession, "csv")
    frame.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(n) for c, n in names.items()]).write.csv(path, header=True)
    return path


@query
def rate_reports(spark, sf_dir):
    """Reports of both kinds as the CSV readers read them."""
    given = proxy.reports(spark, sf_dir)
    evac, water = (tables.read_rates(spark, _csv(given, day="日付", area="市町名", **{c: n}), n).withColumnRenamed("rate", c) for c, n in (("evac", "避難者率"), ("water", "断水世帯率")))
    return evac.join(water, ["area", "day"], "full_outer").select(F.col("area").cast("int").alias("area"), "day", "evac", "water")


@query
def station_daily(spark, sf_dir):
    """Weather as the CSV reader reads it."""
    return tables.read_weather(spark, _csv(proxy.weather(spark, sf_dir), day="date", station="station", rain="precipitation_total_mm", snow="snow_depth_max_cm"))


@query
def cell_dim_aligned(spark, sf_dir):
    v = Views(spark, sf_dir)
    read = tables.read_cells(spark, _csv(v.nations, cell="grid_id", area="area", lat="latitude", lon="longitude"))
    return tables.aligned(v.cells.select("cell"), read, "area", "lat", "lon").select("cell", F.coalesce(F.col("area").cast("string"), F.lit("out-of-scope")).alias("area"), quantized(F.col("lat")).alias("lat"), quantized(F.col("lon")).alias("lon"))


@query
def facility_aligned(spark, sf_dir):
    v = Views(spark, sf_dir)
    return tables.aligned(v.cells.select("cell"), tables.read_facilities(spark, _csv(v.facility, cell="grid_id", facility_count="facility_count")), "facility_count")


@query
def od_scan_roundtrip(spark, sf_dir):
    """Flows written as text and read again."""
    from ..sources import od_text
    from ..sources.storage import scratch

    path = scratch(spark, "od")
    od_text.write_od(Views(spark, sf_dir).od, path)
    return od_text.read_od(spark, path)


# --- flow matrix -------------------------------------------------------------


@query
def in_box_flows(spark, sf_dir):
    return matrix.in_box_flows(Views(spark, sf_dir).od, S.box)


@query
def outside_flows(spark, sf_dir):
    return matrix.outside_flows(Views(spark, sf_dir).od, S.box)


@query
def diag_offdiag_daily(spark, sf_dir):
    f = matrix.in_box_flows(Views(spark, sf_dir).od, S.box)
    same = F.col("origin") == F.col("dest")
    return f.groupBy("day").agg(F.sum(F.when(same, F.col("value")).otherwise(0.0)).alias("diag"), F.sum(F.when(~same, F.col("value")).otherwise(0.0)).alias("offdiag"))


@query
def holdout_truth(spark, sf_dir):
    return Views(spark, sf_dir).truth


@query
def train_days(spark, sf_dir):
    return Views(spark, sf_dir).observed.select("day", "t", "weekday")


@query
def leak_guard(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matrix.leak_guard(v.target, v.observed)


@query
def candidate_pairs(spark, sf_dir):
    return Views(spark, sf_dir).pairs


@query
def flow_matrix_long(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matrix.dense(v.flows, ["pair_id"], v.cal, v.pairs).select("t", "pair_id", "value")


@query
def dense_diag(spark, sf_dir):
    return Views(spark, sf_dir).diag_dense.select("t", "cell", "value")


def _totals(view: str):
    def f(spark, sf_dir):
        return matrix.view_totals(Views(spark, sf_dir).flows, view)

    f.__name__ = f"total_{view}"
    return query(f)


def _shares(view: str):
    def f(spark, sf_dir):
        return matrix.view_shares(Views(spark, sf_dir).flows, view)

    f.__name__ = f"share_{view}"
    return query(f)


for _v in ("outgoing", "incoming"):
    _totals(_v)
    _shares(_v)


@query
def active_series(spark, sf_dir):
    v = Views(spark, sf_dir)
    one = lambda df, key, kind: matrix.active(df, key).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("series"))
    anchors = matrix.view_totals(v.flows, "outgoing").withColumnRenamed("total", "value")
    return one(v.diag, "cell", "diag").union(one(anchors, "anchor", "outgoing")).union(one(v.flows, "pair_id", "pair"))


@query
def outside_weekday_mean(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matrix.outside_weekday_mean(v.train, v.cal, S.box).select("weekday", "origin", "dest", quantized(F.col("mean")).alias("mean"))


@query
def log_diag(spark, sf_dir):
    return Views(spark, sf_dir).diag.select("day", "cell", quantized(F.log1p("value")).alias("log_value"))


@query
def regime_level(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matrix.regime_level(v.diag_dense, "cell", v.cal, v.observed).select("cell", "regime", quantized(F.col("level")).alias("level"))


@query
def share_fallback(spark, sf_dir):
    v = Views(spark, sf_dir)
    return matrix.share_fallback(v.flows, v.pairs, "outgoing").select("pair_id", quantized(F.col("ratio")).alias("ratio"))


@query
def share_renormalized(spark, sf_dir):
    """Shares less 0.05 (so that some are negative and some anchors empty), renormalised."""
    v = Views(spark, sf_dir)
    s = matrix.view_shares(v.flows, "outgoing").select("day", F.col("anchor").alias("origin"), F.col("partner").alias("dest"), (F.col("share") - 0.05).alias("share")).join(v.pairs, ["origin", "dest"])
    out = matrix.share_renormalized(s.select("day", F.col("origin").alias("anchor"), "pair_id", "share"), matrix.share_fallback(v.flows, v.pairs, "outgoing"))
    return out.select("day", "pair_id", quantized(F.col("share")).alias("share"))


@query
def inspect_summary(spark, sf_dir):
    v = Views(spark, sf_dir)
    n = v.observed.agg(F.count("*").cast("long").alias("n")).select(F.lit("observed_days").alias("item"), "n")
    p = v.pairs.agg(F.count("*").cast("long").alias("n")).select(F.lit("candidate_pairs").alias("item"), "n")
    o = matrix.outside_weekday_mean(v.train, v.cal, S.box).groupBy("weekday").agg(F.count("*").cast("long").alias("n")).select(F.concat(F.lit("outside_pairs_"), "weekday").alias("item"), "n")
    return n.union(p).union(o)


# --- external features -------------------------------------------------------


@query
def rate_asof(spark, sf_dir):
    v = Views(spark, sf_dir)
    return external.as_of(proxy.reports(spark, sf_dir), v.cal, v.cells, ["evac", "water"]).select("area", "t", "evac", "water")


@query
def rate_by_cell(spark, sf_dir):
    v = Views(spark, sf_dir)
    r = external.as_of(proxy.reports(spark, sf_dir), v.cal, v.cells, ["evac"])
    return v.cells.select("cell", "area").join(r, "area").select("cell", "t", "evac")


@query
def weather_complete(spark, sf_dir):
    return external.weather_complete(proxy.weather(spark, sf_dir), tables.calendar(spark, S), proxy.stations(spark)).select("t", "station", "rain", "snow")


@query
def cell_station_distance(spark, sf_dir):
    v = Views(spark, sf_dir)
    return external.station_distances(v.cells, proxy.stations(spark)).select("cell", "station", quantized(F.col("km")).alias("km"))


@query
def weather_nearest(spark, sf_dir):
    v = Views(spark, sf_dir)
    whole = external.weather_complete(proxy.weather(spark, sf_dir), v.cal, proxy.stations(spark))
    km = external.station_distances(v.cells, proxy.stations(spark))
    rain, snow = (external.nearest_weather(whole, km, c) for c in ("rain", "snow"))
    return rain.join(snow.select("t", "cell", "snow"), ["t", "cell"]).select("t", "cell", quantized(F.col("rain")).alias("rain"), quantized(F.col("snow")).alias("snow"))


@query
def cell_features(spark, sf_dir):
    v = Views(spark, sf_dir)
    f = external.cell_features(v.daily, v.facility)
    return f.select("t", "cell", *[quantized(F.col(c)).alias(c) for c in ("evac", "water", "rain", "snow", "shelter")])


@query
def pair_features(spark, sf_dir):
    v = Views(spark, sf_dir)
    f = external.pair_features(v.pairs, v.daily, v.facility, "outgoing")
    return f.select("t", "pair_id", *[quantized(F.col(c)).alias(c) for c in external.PAIR_COLUMNS])


@query
def standardize_features(spark, sf_dir):
    v = Views(spark, sf_dir)
    groups = ["evac", "water", "rain", "snow", "shelter"]
    seen = v.observed.select("day", F.lit(True).alias("seen"))
    raw = external.cell_features(v.daily, v.facility).join(seen, "day", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    z, names = external.standardize(store(raw.select("t", "cell", "seen", *groups)), groups, "seen", S.constant_sd)
    long = z.select("t", "cell", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("z")) for n in names])).alias("x"))
    return long.select("t", "cell", "x.feature", quantized(F.col("x.z")).alias("z"))


# --- smoothing and fits ------------------------------------------------------


def _filtered(spark, sf_dir, q: float = 0.05, r: float = 2.0) -> DataFrame:
    """The filter over the diagonal under fixed q and r."""
    v = Views(spark, sf_dir)
    seen = v.observed.select("day", F.lit(True).alias("seen"))
    rows = v.diag_dense.join(seen, "day", "left").select("cell", "t", F.col("value").alias("y"), F.coalesce("seen", F.lit(False)).alias("seen"), F.lit(q).alias("q"), F.lit(r).alias("r"))
    return smoothing.filtered(rows, ["cell"], S)


@query
def kalman_filter_fixed(spark, sf_dir):
    days = _filtered(spark, sf_dir).select("cell", F.explode("f").alias("d"))
    return days.select("cell", "d.t", quantized(F.col("d.m")).alias("mean"), quantized(F.col("d.p")).alias("var"))


@query
def rts_smoother_fixed(spark, sf_dir):
    days = smoothing.smoothed(_filtered(spark, sf_dir), ["cell"], S).select("cell", F.explode("s").alias("d"))
    return days.select("cell", "d.t", quantized(F.col("d.mean")).alias("mean"), quantized(F.col("d.var")).alias("var"), quantized(F.col("d.lag")).alias("lag_cov"))


#: Known variances (q, r) of components on their scales, for forecasts that SQL can make too.
VARIANCES = {"D5": (0.004, 2.0), "F-total": (0.004, 2.0), "R-total": (0.001, 0.5), "F-share": (0.00004, 0.02), "R-share": (0.00004, 0.02)}


def _fixed(spark, sf_dir) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(means, diagnostics, forecast) of the components without regressors under known variances."""
    i = forecast.proxy_inputs(spark, sf_dir, S)
    train, truth, observed, pairs = forecast.training(i, S)
    rows, _ = forecast.components(i, train, pairs, observed, S, {n: (n, []) for n in forecast.COMPONENTS})
    means, told = smoothing.fixed_fit(rows, VARIANCES, S)
    means = store(means)
    return means, told, forecast.from_fit(i, S, means, train, truth, observed, pairs, i.calendar.where("cv_window is not null"))


@query
def fixed_fit_means(spark, sf_dir):
    return _fixed(spark, sf_dir)[0].select("component", "sid", "t", quantized(F.col("mean")).alias("mean"))


@query
def fixed_fit_diagnostics(spark, sf_dir):
    told = _fixed(spark, sf_dir)[1]
    return told.select("model", "active", "observations", quantized(F.col("objective"), 4).alias("objective"), quantized(F.col("negative_fraction")).alias("negative_fraction"), quantized(F.col("max_state_variance")).alias("max_state_variance"))


@query
def fixed_directional_flow(spark, sf_dir):
    r = _fixed(spark, sf_dir)[2]
    both = r["outgoing"].withColumn("view", F.lit("outgoing")).unionByName(r["incoming"].withColumn("view", F.lit("incoming")))
    return both.select("view", "day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def fixed_forecast_full(spark, sf_dir):
    return _fixed(spark, sf_dir)[2]["full"].select("day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def fixed_forecast_scores(spark, sf_dir):
    p = forecast.scores(_fixed(spark, sf_dir)[2], tables.calendar(spark, S), S)
    return p.select("period", "n_days", *[quantized(F.col(c)).alias(c) for c in ("nrmse_diag", "nrmse_offdiag", "combined_nrmse")])


def fitted(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = forecast.COMPONENTS) -> DataFrame:
    return forecast.fitted(forecast.proxy_inputs(spark, sf_dir, S), S, only)


def forecasted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    i = forecast.proxy_inputs(spark, sf_dir, S)
    return forecast.forecast(i, S, i.calendar.where("cv_window is not null"))


def _em(key: str, names: tuple[str, ...]):
    def f(spark, sf_dir):
        return fitted(spark, sf_dir, names).select("component", "sid", "t", "mean")

    f.__name__ = key
    return query(f)


_em("em_fit_diag", ("D5",))
_em("em_fit_total", ("F-total", "R-total"))
_em("em_fit_share", ("F-share", "R-share"))

INFO = "model string, active long, observations long, q double, r double, iterations long, converged boolean, objective double, negative_fraction double, max_state_variance double, beta array<double>, local_mean array<double>"


@query
def fit_diagnostics(spark, sf_dir):
    info = F.from_json("info", INFO)
    return fitted(spark, sf_dir).where("info is not null").select(info.alias("x")).select("x.*").drop("beta", "local_mean")


@query
def coef_summary(spark, sf_dir):
    """Mean local coefficient of each regressor, the global ones, and their sum, by component and name; effects on the log scale in percent too."""
    i = forecast.proxy_inputs(spark, sf_dir, S)
    train, _, observed, pairs = forecast.training(i, S)
    rows, fits = forecast.components(i, train, pairs, observed, S, forecast.plain_variants(S))
    return forecast.named_coefficients(forecast.fit_components(rows, fits, i.calendar, S).where("info is not null").select(F.from_json("info", INFO).alias("x")), fits)


@query
def ridge_fit(spark, sf_dir):
    """Coefficients of the two levels of the diagonal fit: local ones of every active series, and the global ones (sid null)."""
    fit = fitted(spark, sf_dir, ("D5",))
    local = fit.where("local is not null").select("sid", F.posexplode("local").alias("place", "coefficient"))
    shared = fit.where("info is not null").select(F.lit(None).cast("int").alias("sid"), F.posexplode(F.from_json("info", INFO)["beta"]).alias("place", "coefficient"))
    return local.unionByName(shared)


@query
def ridge_fixed_levels(spark, sf_dir):
    """Both levels of the diagonal's coefficients around the mean of each regime: local ones by cell, global ones without a cell."""
    i = forecast.proxy_inputs(spark, sf_dir, S)
    train, _, observed, pairs = forecast.training(i, S)
    rows, fits = forecast.components(i, train, pairs, observed, S, forecast.plain_variants(S, ("D5",)))
    names = [*(f"weekday_{k}" for k in range(1, 7)), "turn", *fits["D5"].names]
    seen = rows.where("seen").join(i.calendar.select("t", "regime"), "t").join(regressors(i.calendar), "t").join(forecast.numbered_cells(i.cells).select("cell", "sid"), "sid")
    y = F.log1p("target")
    around = seen.select("cell", F.concat(F.array(*[F.col(n).cast("double") for n in names[:7]]), "x").alias("b"), (y - F.avg(y).over(Window.partitionBy("cell", "regime"))).alias("y"))
    local, beta = ridge.two_level(store(around), "cell", 7, len(names), S)
    named = F.array(*map(F.lit, names))
    own = local.select("cell", F.posexplode("local").alias("place", "v")).select("cell", F.get(named, F.col("place")).alias("name"), quantized(F.col("v")).alias("coefficient"))
    shared = spark.range(1).select(F.lit(None).cast("string").alias("cell"), F.explode(F.arrays_zip(F.array(*map(F.lit, names[7:])).alias("n"), F.array(*map(F.lit, beta)).alias("v"))).alias("z"))
    return own.unionByName(shared.select("cell", F.col("z.n").alias("name"), quantized(F.col("z.v")).alias("coefficient")))


@query
def gram_stats(spark, sf_dir):
    """Masked sums of products over the seen days of active diagonal series: zz and zx by cell, xx over all; z is the calendar and x, x the features."""
    v = Views(spark, sf_dir)
    seen = v.observed.select("day", F.lit(True).alias("obs"))
    raw = external.cell_features(v.daily, v.facility).join(matrix.active(v.diag, "cell"), "cell").join(seen, "day")
    z, names = external.standardize(store(raw.select("t", "cell", "obs", *S.diagonal_groups)), list(S.diagonal_groups), "obs", S.constant_sd)
    j = z.join(regressors(v.cal), "t")
    left = [*[f"weekday_{k}" for k in range(1, 7)], "turn", *names]
    sums = j.groupBy("cell").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a in left for b in left])
    cells = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"{a}__{b}").cast("double").alias("v")) for a in left for b in left])
    long = store(sums.select("cell", F.explode(cells).alias("x")).select("cell", "x.i", "x.j", "x.v"))
    is_x = F.col("j").isin(names)
    per = long.select(F.lit("zz").alias("kind"), "cell", "i", "j", "v").unionByName(long.where(is_x).select(F.lit("zx").alias("kind"), "cell", "i", "j", "v"))
    all_ = long.where(is_x & F.col("i").isin(names)).groupBy("i", "j").agg(F.sum("v").alias("v")).select(F.lit("xx").alias("kind"), F.lit(None).cast("string").alias("cell"), "i", "j", "v")
    return per.unionByName(all_).select("kind", "cell", "i", "j", quantized(F.col("v"), 4).alias("v"))


@query
def directional_flow(spark, sf_dir):
    r = forecasted(spark, sf_dir)
    return r["outgoing"].withColumn("view", F.lit("outgoing")).unionByName(r["incoming"].withColumn("view", F.lit("incoming")))


@query
def forecast_full(spark, sf_dir):
    return forecasted(spark, sf_dir)["full"]


@query
def forecast_scores(spark, sf_dir):
    return forecast.scores(forecasted(spark, sf_dir), tables.calendar(spark, S), S)


# --- scores and documented analyses ------------------------------------------


@query
def blend_flow(spark, sf_dir):
    v = Views(spark, sf_dir)
    o, i = (analytics.directional_baseline(v.flows, v.pairs, v.observed, v.target, x) for x in ("outgoing", "incoming"))
    return forecast.blend(o, i, S.incoming_weight).select("day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def blend_compare(spark, sf_dir):
    v = Views(spark, sf_dir)
    return analytics.blend_compare(v, S)


@query
def daily_rmse(spark, sf_dir):
    v = Views(spark, sf_dir)
    return scoring.daily_rmse(v.matched, v.target, S).select("day", "cv_window", quantized(F.col("rmse_diag")).alias("rmse_diag"), quantized(F.col("rmse_off")).alias("rmse_off"))


def _scored(both: DataFrame, target: DataFrame) -> DataFrame:
    p = scoring.period_scores(scoring.daily_rmse(both, target, S), S)
    return p.select("period", "n_days", *[quantized(F.col(c)).alias(c) for c in ("nrmse_diag", "nrmse_offdiag", "combined_nrmse")])


@query
def score_periods(spark, sf_dir):
    v = Views(spark, sf_dir)
    return _scored(v.matched, v.target)


@query
def combined_nrmse(spark, sf_dir):
    return score_periods(spark, sf_dir).where("period = 'overall'").select("n_days", "combined_nrmse")


@query
def zero_baseline(spark, sf_dir):
    v = Views(spark, sf_dir)
    return _scored(scoring.matched(v.truth.limit(0), v.truth, S), v.target)


@query
def weekday_interp(spark, sf_dir):
    return Views(spark, sf_dir).baseline.select("day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def linear_interp(spark, sf_dir):
    v = Views(spark, sf_dir)
    p = scoring.interpolated(matrix.in_box_flows(v.train, S.box), scoring.neighbours(v.target, v.observed, False))
    return p.select("day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def appearance_times_mean(spark, sf_dir):
    v = Views(spark, sf_dir)
    p = scoring.appearance_times_mean(matrix.in_box_flows(v.train, S.box), v.observed, v.target)
    return p.select("day", "origin", "dest", quantized(F.col("value")).alias("value"))


@query
def error_hit_extra_miss(spark, sf_dir):
    return scoring.hit_extra_miss(Views(spark, sf_dir).matched).select("kind", "n", quantized(F.col("sq_error"), 3).alias("sq_error"), quantized(F.col("share")).alias("share"))


@query
def error_concentration(spark, sf_dir):
    return scoring.concentration(Views(spark, sf_dir).matched).select("top", quantized(F.col("share")).alias("share"))


@query
def ablation(spark, sf_dir):
    """Errors of the held-out days, cells and pairs, without features, with one source, with the chosen ones, beside levels that stay fixed by regime; errors as of ``score_periods``."""
    i = forecast.proxy_inputs(spark, sf_dir, S)
    return forecast.ablation(i, S, i.calendar.where("cv_window is not null"))


@query
def cell_error_concentration(spark, sf_dir):
    return scoring.cell_concentration(Views(spark, sf_dir).matched, 5).select("top", quantized(F.col("share")).alias("share"))


@query
def error_by_area(spark, sf_dir):
    v = Views(spark, sf_dir)
    e = scoring.error_by_area(v.matched, v.cells)
    return e.select("area", "part", *[quantized(F.col(c), 4).alias(c) for c in ("relative_error", "pred_total", "actual_total")])


@query
def daily_bias(spark, sf_dir):
    v = Views(spark, sf_dir)
    return scoring.daily_bias(v.matched, v.target).select("day", quantized(F.col("bias_diag")).alias("bias_diag"), quantized(F.col("bias_off")).alias("bias_off"))


@query
def candidate_coverage(spark, sf_dir):
    v = Views(spark, sf_dir)
    return scoring.candidate_coverage(v.truth, v.pairs)


@query
def daily_pairs(spark, sf_dir):
    v = Views(spark, sf_dir)
    return scoring.daily_pairs(v.matched, v.target)


@query
def submission_shape(spark, sf_dir):
    """Rows, bad values and days of a prediction, as a validator counts them."""
    v = Views(spark, sf_dir)
    return analytics.submission_shape(v.baseline)


def _analysis(f):
    def g(spark, sf_dir):
        return f(Views(spark, sf_dir), S)

    g.__name__ = f.__name__
    return query(g)


for _f in (analytics.presence_monthly, analytics.presence_weekly, analytics.cell_class, analytics.damage_ratio, analytics.damage_topk, analytics.weekly_recovery, analytics.cell_geo, analytics.daily_total):
    _analysis(_f)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in FOUND}

"""The forecasting plan: five components fitted side by side, directional flows, blend, full forecast, scores."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import finite
from ..operators import estimation, external, matrix, scoring
from ..session import slots
from ..sources.storage import store as stored

COMPONENTS = ("D5", "F-total", "F-share", "R-total", "R-share")
#: Series of a block; blocks are what tasks are dealt.
BLOCK_SERIES = 64
#: Of the columns of pairs, those that a source of features brings.
PAIR_GROUPS = {g: (f"{g}_anchor", f"{g}_partner") for g in ("evac", "water", "rain", "snow")} | {"shelter": ("log_facility", "has_facility", "evac_facility")}


@dataclass
class Inputs:
    """Frames that a forecast is made from."""

    flows: DataFrame  # day, origin, dest, value
    cells: DataFrame  # cell, area, lat, lon of the box
    reports: list[tuple[DataFrame, list[str]]]  # (area, day, rates) and the rates' names, one for each source of reports
    weather: DataFrame  # day, station, rain, snow
    stations: DataFrame
    facility: DataFrame  # cell, facility_count
    calendar: DataFrame
    recorded: DataFrame | None = None  # day, where days without any flow count as observed too


def daily_external(i: Inputs) -> DataFrame:
    # Each source's reports come on days of their own and hold until the next of the same source.
    held = [external.as_of(frame, i.calendar, i.cells, names) for frame, names in i.reports]
    rates = reduce(lambda x, y: x.join(y.drop("t"), ["area", "day"]), held)
    whole = external.weather_complete(i.weather, i.calendar, i.stations)
    km = external.station_distances(i.cells, i.stations)
    return external.daily_features(i.cells, rates, external.nearest_weather(whole, km, "rain"), external.nearest_weather(whole, km, "snow"))


def numbered_cells(cells: DataFrame) -> DataFrame:
    """Adds sid, the place by y, then x; the cells are those of the box, one row each."""
    return cells.withColumn("sid", (F.row_number().over(Window.orderBy("y", "x")) - 1).cast("int"))


def component_frame(name: str, series: DataFrame, features: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """component, sid, t, target, seen, active, raw: one row a day and series, features not standardised yet.

    ``series`` has the keys, day, t, sid, target, seen, active.
    """
    j = series.join(features.select(*keys, "day", *columns), [*keys, "day"]) if columns else series
    raw = F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")
    return j.select(F.lit(name).alias("component"), "sid", "t", "target", "seen", "active", raw.alias("raw"))


def plain_variants(s: Settings, only: tuple[str, ...] = COMPONENTS) -> dict[str, tuple[str, list[str]]]:
    """The fits of the plan: each component with its features, under its own name."""
    return {n: (n, list(external.PAIR_COLUMNS if n.endswith("share") else s.diagonal_groups if n == "D5" else s.offdiagonal_groups)) for n in only}


def components(i: Inputs, train: DataFrame, pairs: DataFrame, observed: DataFrame, s: Settings, variants: dict[str, tuple[str, list[str]]], store=stored) -> tuple[DataFrame, dict[str, estimation.Fit]]:
    """(rows of the fits: component, sid, t, target, seen, active, x; what each fit's series share).

    ``variants`` names fits: a component and the features that it is given, possibly none. The rows of a component
    are stored once with the raw features of all its fits; one aggregation over them tells
    how each feature is standardised over the seen rows of active series, and each fit takes its own.
    """
    columns = {n: list(dict.fromkeys(c for m, own in variants.values() if m == n for c in own)) for n in COMPONENTS if any(m == n for m, _ in variants.values())}
    only = tuple(columns)
    days = i.calendar.select("day", "t", "weekday", "year_end")
    observed = observed.select("day", F.lit(True).alias("obs"))
    daily = store(daily_external(i)) if any(columns.values()) else None
    cellwise = external.cell_features(daily, i.facility) if daily is not None else None
    cells = numbered_cells(i.cells)
    flows = matrix.candidate_flows(train, pairs)

    def ready(dense_: DataFrame, act: DataFrame, key: str, extra: Column | None = None) -> DataFrame:
        d = dense_.join(observed, "day", "left").join(act.select(key, F.lit(True).alias("active")), key, "left")
        active = F.coalesce("active", F.lit(False))
        seen = F.coalesce("obs", F.lit(False)) & active
        return d.select("day", "t", key, "sid", F.col("value").alias("target"), (seen & extra if extra is not None else seen).alias("seen"), active.alias("active"))

    parts = []
    if "D5" in only:
        diag = matrix.in_box_flows(train, s.box).where("origin = dest").select("day", F.col("origin").alias("cell"), "value")
        grid = matrix.dense(diag, ["cell"], days, cells).join(cells.select("cell", "sid"), "cell")
        parts.append(component_frame("D5", ready(grid, matrix.active(diag, "cell"), "cell"), cellwise, columns["D5"], ["cell"]))
    for view, label in (("outgoing", "F"), ("incoming", "R")):
        anchor, _ = matrix.ANCHOR[view]
        total = matrix.view_totals(flows, view).select("day", F.col("anchor").alias("cell"), F.col("total").alias("value"))
        if f"{label}-total" in only:
            grid = matrix.dense(total, ["cell"], days, cells).join(cells.select("cell", "sid"), "cell")
            parts.append(component_frame(f"{label}-total", ready(grid, matrix.active(total, "cell"), "cell"), cellwise, columns[f"{label}-total"], ["cell"]))
        if f"{label}-share" in only:
            shares = matrix.view_shares(flows, view).select("day", F.col("anchor" if view == "outgoing" else "partner").alias("origin"), F.col("partner" if view == "outgoing" else "anchor").alias("dest"), F.col("share").alias("value")).join(pairs, ["origin", "dest"])
            grid = matrix.dense(shares, ["pair_id"], days, pairs).join(pairs.select("pair_id", F.col("pair_id").alias("sid"), F.col(anchor).alias("cell")), "pair_id")
            grid = grid.join(total.select("day", "cell", F.col("value").alias("_total")), ["day", "cell"], "left")
            d = ready(grid.withColumn("_pos", F.coalesce(F.col("_total") > 0, F.lit(False))), matrix.active(flows, "pair_id"), "pair_id", F.col("_pos"))
            parts.append(component_frame(f"{label}-share", d, external.pair_features(pairs, daily, i.facility, view) if columns[f"{label}-share"] else None, columns[f"{label}-share"], ["pair_id"]))
    raw = store(reduce(DataFrame.unionByName, parts))
    known = {}
    if any(columns.values()):
        # Element by element, so no row is taken apart: one row a component with a struct a place.
        most = max(map(len, columns.values()))
        place = lambda k: F.struct(*external.moments(F.when(F.size("raw") > k, F.get("raw", F.lit(k)))))
        for r in raw.where("seen").groupBy("component").agg(*[place(k).alias(f"f{k}") for k in range(most)]).collect():  # a row a component
            known |= {(r["component"], c): r[f"f{k}"] for k, c in enumerate(columns[r["component"]])}
    of, fits = {n: [] for n in only}, {}
    for fit, (name, own) in variants.items():
        made = [(columns[name].index(c), f) for c in own if (name, c) in known for f in external.scales(c, *known[name, c], s.constant_sd)]
        if own and not made:
            raise ValueError(f"{fit}: no feature has a value that varies on the training rows")
        fits[fit] = estimation.Fit(not name.endswith("share"), name == "D5", len(made), tuple(f.name for _, f in made))
        of[name].append(F.struct(F.lit(fit).alias("fit"), F.array(*[f.of(F.col("raw")[k]) for k, f in made]).cast("array<double>").alias("x")))
    if all(len(v) == 1 for v in of.values()):
        each = F.lit(None)
        for name, v in of.items():
            each = F.when(F.col("component") == name, v[0]).otherwise(each)
        out = raw.withColumn("each", each)
    else:
        every = F.lit(None)
        for name, v in of.items():
            every = F.when(F.col("component") == name, F.array(*v)).otherwise(every)
        out = raw.withColumn("each", F.explode(every))
    return out.select(F.col("each.fit").alias("component"), "sid", "t", "target", "seen", "active", F.col("each.x").alias("x")), fits


def fit_components(rows: DataFrame, fits: dict[str, estimation.Fit], cal: DataFrame, s: Settings) -> DataFrame:
    """component, sid, t, mean; on one row a fit its diagnostics as JSON, on the first day of each active series its local coefficients.

    Series are numbered from 0 in each component. Blocks of them are dealt in turn over as many tasks as run at a time; all
    fits go through their passes together in one barrier stage.
    """
    days = cal.select("t", "weekday", "year_end").orderBy("t").collect()  # the calendar: a few hundred rows
    design = estimation.calendar_design(np.array([d["weekday"] for d in days]), np.array([d["year_end"] for d in days]))
    sizes = {r["component"]: r["n"] for r in rows.where("t = 0").groupBy("component").agg(F.count("*").alias("n")).collect()}  # a row a fit
    first, before = {}, 0
    for name in fits:
        first[name], before = before, before - (-sizes.get(name, 0) // BLOCK_SERIES)
    if not before:
        return rows.sparkSession.createDataFrame([], "component string, sid int, t int, mean double, info string, local array<double>")
    tasks = min(slots(rows.sparkSession), before)
    number = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("component")] + F.floor(F.col("sid") / BLOCK_SERIES).cast("int")
    dealt = rows.withColumn("block", number).withColumn("task", (F.col("block") % tasks).cast("int")).repartitionById(tasks, "task").drop("task")
    fitted_ = dealt.sortWithinPartitions("component", "block", "sid", "t").mapInArrow(
        partial(estimation.fit_tasks, fits={n: f for n, f in fits.items() if sizes.get(n)}, calendar=design, s=s), "component string, sid int, mean array<double>, info string, local array<double>", barrier=True)
    first_day = lambda c: F.when(F.col("t") == 0, F.col(c)).alias(c)
    return fitted_.select("component", "sid", F.posexplode("mean").alias("t", "mean"), "info", "local").select("component", "sid", "t", "mean", first_day("info"), first_day("local"))


CALENDAR_NAMES = ("tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "turn of the year")


def named_coefficients(info: DataFrame, fits: dict[str, estimation.Fit]) -> DataFrame:
    """model, name, local (mean over series), shared, total, percent (of the flow, where the scale is logarithmic); ``info`` has a struct x a fit."""
    names = F.lit(None)
    for fit, f in fits.items():
        entries = [F.struct(F.lit(n).alias("name"), F.lit(k).alias("l"), F.lit(None).cast("int").alias("g")) for k, n in enumerate(CALENDAR_NAMES)]
        entries += [F.struct(F.lit(n).alias("name"), F.lit(len(CALENDAR_NAMES) + k if f.local else None).cast("int").alias("l"), F.lit(k).alias("g")) for k, n in enumerate(f.names)]
        names = F.when(F.col("x.model") == fit, F.array(*entries)).otherwise(names)
    rows = info.select("x", F.explode(names).alias("n")).select(
        F.col("x.model").alias("model"), "n.name", F.get("x.local_mean", F.col("n.l")).alias("local"), F.get("x.beta", F.col("n.g")).alias("shared"))
    total = F.coalesce("local", F.lit(0.0)) + F.coalesce("shared", F.lit(0.0))
    return rows.select("*", total.alias("total"), F.when(~F.col("model").endswith("share"), 100 * F.expm1(total)).alias("percent"))


def directional_flow(fit: DataFrame, pairs: DataFrame, flows: DataFrame, cells: DataFrame, target: DataFrame, view: str) -> DataFrame:
    """day, origin, dest, value: the anchor's total times the renormalised share, on the target days."""
    label, anchor = ("F" if view == "outgoing" else "R"), matrix.ANCHOR[view][0]
    share = fit.where(F.col("component") == f"{label}-share").join(target, "t").join(pairs, F.col("sid") == F.col("pair_id")).select("day", F.col(anchor).alias("anchor"), "pair_id", F.col("mean").alias("share"))
    share = matrix.share_renormalized(share, matrix.share_fallback(flows, pairs, view))
    total = fit.where(F.col("component") == f"{label}-total").join(target, "t").join(cells, "sid").select("day", F.col("cell").alias("anchor"), F.col("mean").alias("total"))
    return share.join(total, ["day", "anchor"]).join(pairs, "pair_id").select("day", "origin", "dest", (F.col("total") * F.col("share")).alias("value"))


def blend(outgoing: DataFrame, incoming: DataFrame, weight: float) -> DataFrame:
    """day, origin, dest, value: (1 - weight) of outgoing and weight of incoming; a value that is not finite is an error."""
    o, i = outgoing.withColumnRenamed("value", "_o"), incoming.withColumnRenamed("value", "_i")
    both = o.join(i, ["day", "origin", "dest"], "full_outer")
    v = (1 - weight) * F.coalesce("_o", F.lit(0.0)) + weight * F.coalesce("_i", F.lit(0.0))
    return both.select("day", "origin", "dest", F.when(finite(v), v).otherwise(F.raise_error(F.lit("a predicted flow is not finite")).cast("double")).alias("value"))


def full_forecast(diagonal: DataFrame, off: DataFrame, outside: DataFrame, target: DataFrame) -> DataFrame:
    """day, origin, dest, value: positive predictions in the box, weekday means outside; a target weekday without means is an error."""
    has = outside.select("weekday").distinct().withColumn("_has", F.lit(True))
    days = target.join(has, "weekday", "left")
    days = days.withColumn("day", F.when(F.col("_has"), F.col("day")).otherwise(F.raise_error(F.lit("no weekday mean of flows outside the box")).cast("date")))
    out = days.select("day", "weekday").join(outside, "weekday").select("day", "origin", "dest", F.col("mean").alias("value"))
    return out.unionByName(diagonal.where("value > 0")).unionByName(off.where("value > 0"))


def training(i: Inputs, s: Settings, holdout: bool = True, store=stored) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(train, truth, observed days with their calendar fields, candidate pairs)."""
    train, truth = matrix.split(i.flows, i.calendar, s, holdout)
    train = store(train)
    observed = matrix.train_days(train, i.calendar) if i.recorded is None else matrix.recorded_days(i.recorded, i.calendar, holdout)
    return train, truth, observed, store(matrix.candidate_pairs(train, s.box))


def fitted(i: Inputs, s: Settings, only: tuple[str, ...] = COMPONENTS, holdout: bool = True, store=stored) -> DataFrame:
    """The fit of some components alone, as of ``fit_components``."""
    train, _, observed, pairs = training(i, s, holdout, store)
    rows, fits = components(i, train, pairs, observed, s, plain_variants(s, only), store)
    return store(fit_components(rows, fits, i.calendar, s))


def forecast(i: Inputs, s: Settings, target: DataFrame, holdout: bool = True, store=stored) -> dict[str, DataFrame]:
    """fit, pairs, outgoing, incoming, diagonal, off, full, predicted. ``target`` has day, t, weekday; a target day that is observed is an error."""
    train, truth, observed, pairs = training(i, s, holdout, store)
    if not matrix.leak_guard(target, observed).isEmpty():
        raise ValueError("days to predict are among the training days")
    rows, fits = components(i, train, pairs, observed, s, plain_variants(s), store)
    return from_fit(i, s, store(fit_components(rows, fits, i.calendar, s)), train, truth, observed, pairs, target)


def from_fit(i: Inputs, s: Settings, fit: DataFrame, train: DataFrame, truth: DataFrame, observed: DataFrame, pairs: DataFrame, target: DataFrame) -> dict[str, DataFrame]:
    """What ``forecast`` gives, of a fit of the five components."""
    flows = matrix.candidate_flows(train, pairs)
    cells = numbered_cells(i.cells).select("cell", "sid")
    days = target.select("day", "t")
    both = [directional_flow(fit, pairs, flows, cells, days, v) for v in ("outgoing", "incoming")]
    diagonal = fit.where("component = 'D5'").join(days, "t").join(cells, "sid").select("day", F.col("cell").alias("origin"), F.col("cell").alias("dest"), F.col("mean").alias("value"))
    off = blend(*both, s.incoming_weight)
    full = full_forecast(diagonal, off, matrix.outside_weekday_mean(train, i.calendar, s.box, observed), target)
    return {"train": train, "truth": truth, "pairs": pairs, "fit": fit, "outgoing": both[0], "incoming": both[1], "diagonal": diagonal, "off": off, "full": full, "predicted": days}


def proxy_inputs(spark: SparkSession, sf_dir: str, s: Settings) -> Inputs:
    from ..functions.columns import in_box
    from ..sources import proxy, tables

    cells = proxy.nation_cells(spark, sf_dir).where(in_box(F.col("cell"), s.box))
    return Inputs(proxy.flows(spark, sf_dir, s), cells, [(proxy.reports(spark, sf_dir, s), ["evac", "water"])], proxy.weather(spark, sf_dir, s), proxy.stations(spark), proxy.facilities(spark, sf_dir), tables.calendar(spark, s))


def scores(result: dict[str, DataFrame], cal: DataFrame, s: Settings) -> DataFrame:
    both = scoring.matched(result["full"], result["truth"], s)
    return scoring.period_scores(scoring.daily_rmse(both, matrix.held_out_days(cal), s, result["predicted"]), s)


def shortened(s: Settings, iterations: int) -> Settings:
    return replace(s, max_iter=iterations)


def ablation_variants(s: Settings) -> dict[str, tuple[tuple[str, ...] | None, tuple[str, ...] | None]]:
    """By name the features of the diagonal and of the flows between cells; None where a variant says nothing of one."""
    single = ("evac", "water", "rain", "snow")
    return {"no features": ((), ())} | {g: ((g,), (g,)) for g in single} | {
        " + ".join(s.diagonal_groups): (s.diagonal_groups, None), " + ".join((*s.diagonal_groups, "snow")): ((*s.diagonal_groups, "snow"), None), " + ".join(s.offdiagonal_groups): (None, s.offdiagonal_groups)}


def fixed_levels(train: DataFrame, pairs: DataFrame, observed: DataFrame, cal: DataFrame, cells: DataFrame, target: DataFrame, s: Settings) -> DataFrame:
    """day, origin, dest, value: each cell's and each pair's mean over the observed days of the target day's regime."""
    flows = matrix.in_box_flows(train, s.box)
    diag = flows.where("origin = dest").select("day", F.col("origin").alias("cell"), "value")
    own = matrix.regime_level(matrix.dense(diag, ["cell"], cal, cells), "cell", cal, observed).select("regime", F.col("cell").alias("origin"), F.col("cell").alias("dest"), "level")
    off = matrix.regime_level(matrix.dense(matrix.candidate_flows(train, pairs), ["pair_id"], cal, pairs), "pair_id", cal, observed).join(pairs, "pair_id").select("regime", "origin", "dest", "level")
    return target.select("day", "regime").join(own.unionByName(off), "regime").select("day", "origin", "dest", F.col("level").alias("value"))


def ablation(i: Inputs, s: Settings, target: DataFrame, store=stored) -> DataFrame:
    """variant, nrmse_diag, nrmse_offdiag over all held-out days: fits without features, with one source, with the chosen ones, and levels fixed by regime instead.

    Flows between cells are the outgoing ones. All fits of all variants go side by side; what a variant says nothing of is null.
    """
    train, truth, observed, pairs = training(i, s, True, store)
    cells, days = numbered_cells(i.cells).select("cell", "sid"), target.select("day", "t")
    variants = ablation_variants(s)
    asked: dict[str, tuple[str, list[str]]] = {}
    for name, (own, off) in variants.items():
        if own is not None:
            asked[f"{name}:D5"] = ("D5", list(own))
        if off is not None:
            asked[f"{name}:F-total"] = ("F-total", list(off))
            asked[f"{name}:F-share"] = ("F-share", [c for g in off for c in PAIR_GROUPS[g]])
    rows, fits = components(i, train, pairs, observed, s, asked, store)
    fit = store(fit_components(rows, fits, i.calendar, s).join(days, "t").select("component", "sid", "t", "mean"))
    flows = store(matrix.candidate_flows(train, pairs))
    truth = store(truth)

    def scored(name: str, predicted: DataFrame, diag: bool, off: bool) -> DataFrame:
        total = scoring.period_scores(scoring.daily_rmse(scoring.matched(predicted, truth, s), target, s, days), s).where("period = 'overall'")
        said = lambda on, c: (F.col(c) if on else F.lit(None).cast("double")).alias(c)
        return total.select(F.lit(name).alias("variant"), said(diag, "nrmse_diag"), said(off, "nrmse_offdiag"))

    parts = [scored("fixed levels", fixed_levels(train, pairs, observed, i.calendar, i.cells, target, s), True, True)]
    for name, (own, off) in variants.items():
        here = fit.where(F.col("component").startswith(f"{name}:")).withColumn("component", F.substring_index("component", ":", -1))
        diagonal = here.where("component = 'D5'").join(days, "t").join(cells, "sid").select("day", F.col("cell").alias("origin"), F.col("cell").alias("dest"), F.col("mean").alias("value"))
        predicted = diagonal if off is None else diagonal.unionByName(directional_flow(here, pairs, flows, cells, days, "outgoing"))
        parts.append(scored(name, predicted, own is not None, off is not None))
    return reduce(DataFrame.unionByName, parts)

"""The local-level filter and smoother with known variances, as folds over each series' days in the engine itself.

A series is one row with an array of its days (as many as the calendar has), so nothing but the grouping of
days by series is shuffled and no Python runs. Estimated variances and coefficients are the work of ``estimation``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings

_FILTERED = "array<struct<t: int, y: double, seen: boolean, before: double, ahead: double, m: double, p: double>>"
_SMOOTHED = "array<struct<t: int, mean: double, var: double, next: double>>"


def _with(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def filtered(series: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, r and f: by day t the value y, seen, the mean and variance ahead of the day and after it.

    ``series`` has the keys, t, y, seen, q and r (the same on all days of a series); both regimes start from the prior.
    """
    new = f"(d.t = 0 or d.t = {s.break_index})"
    ahead = f"named_struct('m', if({new}, 0D, a.m), 'p', if({new}, {s.initial_variance}D, a.p + q))"
    gain = "if(d.seen, s.p / (s.p + r), 0D)"
    day = "named_struct('t', d.t, 'y', d.y, 'seen', d.seen, 'before', s.m, 'ahead', s.p, 'm', s.m + k * (d.y - s.m), 'p', (1 - k) * s.p)"
    step = _with(ahead, "s", _with(gain, "k", _with(day, "o", "named_struct('out', array_append(a.out, o), 'm', o.m, 'p', o.p)")))
    fold = f"aggregate(days, named_struct('out', cast(array() as {_FILTERED}), 'm', 0D, 'p', 0D), (a, d) -> {step}, a -> a.out)"
    rows = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "y", "seen"))).alias("days"), F.first("q").alias("q"), F.first("r").alias("r"))
    return rows.select(*keys, "r", F.expr(fold).alias("f"))


def smoothed(passed: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """keys, s: by day t the smoothed mean and variance and the covariance with the day before (lag); nll, the negative log likelihood."""
    j = f"if(x.t = {s.n_days - 1} or x.t = {s.break_index - 1}, 0D, x.p / a.ahead)"
    day = "named_struct('t', x.t, 'mean', x.m + j * (a.mean - x.m), 'var', greatest(0D, x.p + j * j * (a.var - a.ahead)), 'next', j * a.var)"
    step = _with(j, "j", _with(day, "o", "named_struct('out', array_append(a.out, o), 'mean', o.mean, 'var', o.var, 'ahead', x.ahead)"))
    lagged = _with("reverse(a.out)", "v", "transform(v, (o, i) -> named_struct('t', o.t, 'mean', o.mean, 'var', o.var, 'lag', if(i = 0, 0D, get(v, i - 1).next)))")
    back = f"aggregate(reverse(f), named_struct('out', cast(array() as {_SMOOTHED}), 'mean', 0D, 'var', 0D, 'ahead', 1D), (a, x) -> {step}, a -> {lagged})"
    nll = f"aggregate(f, 0D, (a, x) -> a + if(x.seen, 0.5D * (ln({2 * math.pi!r}D * (x.ahead + r)) + (x.y - x.before) * (x.y - x.before) / (x.ahead + r)), 0D))"
    return passed.select(*keys, F.expr(back).alias("s"), F.expr(nll).alias("nll"))


def fixed_fit(rows: DataFrame, variances: dict[str, tuple[float, float]], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Means of components without regressors under known (q, r): component, sid, t, mean; and their diagnostics, one row a component.

    ``rows`` has component, sid, t, target, seen, active. Shares stay as they are, the rest is smoothed as log1p; inactive series are 0.
    """
    of = F.create_map(*[x for n, (q, r) in variances.items() for x in (F.lit(n), F.struct(F.lit(q).alias("q"), F.lit(r).alias("r")))])[F.col("component")]
    share = F.col("component").endswith("share")
    y = F.when(F.col("seen"), F.when(share, F.col("target")).otherwise(F.log1p("target"))).otherwise(0.0)
    keys = ["component", "sid", "active"]
    series = rows.select(*keys, "t", y.alias("y"), "seen", of["q"].alias("q"), of["r"].alias("r"))
    done = smoothed(filtered(series, keys, s), keys, s)
    days = done.select(*keys, "nll", F.explode("s").alias("d")).select(*keys, "nll", "d.t", "d.mean", "d.var")
    mean = F.when(F.col("active"), F.when(share, F.col("mean")).otherwise(F.expm1("mean"))).otherwise(0.0)
    days = days.withColumn("mean", mean)
    first = F.col("t") == 0
    told = days.join(rows.select("component", "sid", "t", "seen"), ["component", "sid", "t"]).groupBy(F.col("component").alias("model")).agg(
        F.count_if(first & F.col("active")).alias("active"), F.count_if("seen").alias("observations"), F.sum(F.when(first, F.col("nll")).otherwise(0.0)).alias("objective"),
        (F.count_if(F.col("mean") < 0) / F.count("*")).alias("negative_fraction"), F.max(F.when(F.col("active"), F.col("var"))).alias("max_state_variance"))
    return days.select("component", "sid", "t", F.when(share, F.col("mean")).otherwise(F.greatest(F.col("mean"), F.lit(0.0))).alias("mean")), told

"""Command line: validate, submit, inspect or check, on tables of orders (--tables) or on real inputs (--inputs)."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PROXY, STATIONS, Settings
from .operators import matrix
from .plans import forecast
from .session import get_spark
from .sources import od_text, sinks, tables


def real_inputs(spark: SparkSession, folder: str, s: Settings) -> forecast.Inputs:
    """od.tsv, cells.csv, evacuation.csv, water.csv, shelters.csv and weather.csv of a folder."""
    cells = tables.aligned(tables.box_cells(spark, s.box), tables.read_cells(spark, f"{folder}/cells.csv"), "area", "lat", "lon").withColumn("area", F.coalesce("area", F.lit("対象外")))
    evac = tables.read_rates(spark, f"{folder}/evacuation.csv", "避難者率").withColumnRenamed("rate", "evac")
    water = tables.read_rates(spark, f"{folder}/water.csv", "断水世帯率").withColumnRenamed("rate", "water")
    facility = tables.aligned(cells.select("cell"), tables.read_facilities(spark, f"{folder}/shelters.csv"), "facility_count")
    days = od_text.read_od_days(spark, f"{folder}/od.tsv")
    reports = [(evac, ["evac"]), (water, ["water"])]
    return forecast.Inputs(od_text.explode_od(days), cells, reports, tables.read_weather(spark, f"{folder}/weather.csv"), tables.stations(spark, STATIONS), facility, tables.calendar(spark, s), days.select("day"))


def inspected(i: forecast.Inputs, s: Settings) -> list[tuple[str, object]]:
    """Settings, calendar, held-out windows, days to predict, and the size of the training data of a validation."""
    span = lambda days: "{} .. {}, {} days".format(*days.agg(F.min("day"), F.max("day"), F.count("*")).first())
    train, _, observed, pairs = forecast.training(i, s)
    outside = matrix.outside_weekday_mean(train, i.calendar, s.box, observed).groupBy("weekday").count().collect()  # seven rows at most
    per = {r["weekday"]: r["count"] for r in outside}
    items: list[tuple[str, object]] = [*s.model().items(), ("calendar", span(i.calendar))]
    items += [(f"window {name}", span(i.calendar.where(F.col("cv_window") == name))) for name, *_ in s.windows]
    items += [("to predict", span(i.calendar.where("is_test"))), ("training days", observed.count()), ("candidate pairs", pairs.count())]
    return [*items, ("pairs outside by weekday", [per.get(d, 0) for d in range(7)])]


def validate(i: forecast.Inputs, s: Settings, out: Path, tell) -> None:
    days = i.calendar.where("cv_window is not null")
    tell("stage", "fit of five components without the held-out days")
    r = forecast.forecast(i, s, days)
    tell("stage", "scores and flows of the held-out days")
    scores = {x["period"]: {k: x[k] for k in ("n_days", "combined_nrmse", "nrmse_diag", "nrmse_offdiag")} for x in forecast.scores(r, i.calendar, s).collect()}
    info = [json.loads(x["info"]) for x in r["fit"].where("info is not null").select("info").collect()]
    overall = scores.pop("overall")
    file = out / "metrics.json"
    file.write_text(sinks.metrics_text({
        "experiment": "state-space", "date": dt.datetime.now().astimezone().isoformat(timespec="minutes"), "status": "scored", "compared_to": None,
        "results": {"overall": overall, "validation": scores, "fit_diagnostics": info}, "config": s.model(),
    }), encoding="utf-8")
    tell("result", f"combined_nrmse {overall['combined_nrmse']:.4f}")
    tell("file", sinks.relative(file, out))
    for window, *_ in s.windows:
        write(r["full"], days.where(F.col("cv_window") == window), out / f"validation_{window}.tsv", out, tell)


def submit(i: forecast.Inputs, s: Settings, out: Path, validator: Path, tell) -> None:
    days = i.calendar.where("is_test")
    tell("stage", "fit of five components on all observed days")
    r = forecast.forecast(i, s, days, holdout=False)
    tell("stage", "flows of the days to predict")
    write(r["full"], days, out / "submission.tsv", out, tell)
    tell("result", f"validator {sinks.outside_check(validator, out / 'submission.tsv')}")


def write(flows: DataFrame, days: DataFrame, path: Path, root: Path, tell) -> None:
    od_text.write_od(flows.join(days.select("day"), "day", "left_semi"), str(path), days)
    tell("file", sinks.relative(path, root))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    for name in ("validate", "submit", "inspect"):
        mode.add_argument(f"--{name}", action="store_true")
    mode.add_argument("--check", metavar="PATH", type=Path, nargs="?", const=Path("odweave-out/submission.tsv"))
    p.add_argument("--tables", default="/root/testdata/sf0.01")
    p.add_argument("--inputs")
    p.add_argument("--out", type=Path, default=Path("odweave-out"))
    p.add_argument("--validator", type=Path, default=Path("validator.py"))
    p.add_argument("--iterations", type=int)
    a = p.parse_args(argv)
    if a.check:
        print(sinks.outside_check(a.validator, a.check))
        return 0
    spark = get_spark()
    s = Settings() if a.inputs else PROXY
    s = forecast.shortened(s, a.iterations) if a.iterations else s
    i = real_inputs(spark, a.inputs, s) if a.inputs else forecast.proxy_inputs(spark, a.tables, s)
    if a.inspect:
        for k, v in inspected(i, s):
            print(k, v, sep="\t")
        return 0
    a.out.mkdir(parents=True, exist_ok=True)
    with sinks.run_log(a.out / "runs.log", sinks.command_line("--validate" if a.validate else "--submit")) as tell:
        if a.validate:
            validate(i, s, a.out, tell)
        else:
            submit(i, s, a.out, a.validator, tell)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

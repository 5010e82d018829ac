"""Readers of CSV files and the modes of the command line, on a small set of files."""

from __future__ import annotations

import datetime as dt
import json
import random
from functools import partial

import pytest

from odweave import cli
from odweave.config import Box, Settings
from odweave.plans import forecast
from odweave.sources import tables

START = dt.date(2023, 11, 1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rnd = tmp_path_factory.mktemp("inputs"), random.Random(3)
    ids = [f"{y}_{x}" for y in range(35, 71) for x in range(30, 71)]
    put = lambda name, rows: (at / name).write_text("\n".join(",".join(map(str, r)) for r in rows) + "\n", encoding="utf-8")
    put("cells.csv", [("grid_id", "area", "latitude", "longitude", "more"), *[(c, "七尾" if i % 3 else "", 37 + i / 5000, 136.7, "x") for i, c in enumerate(ids)]])
    put("shelters.csv", [("grid_id", "facility_count"), *[(c, i % 4) for i, c in enumerate(ids)]])
    put("evacuation.csv", [("日付", "市町名", "避難者率"), ("2024-01-03", "七尾", 0.5), ("2024-01-05", "七尾", "-"), ("2024-01-08", "七尾", 0.25)])
    put("water.csv", [("日付", "市町名", "断水世帯率"), ("2024-01-04", "七尾", 0.9)])
    weather = [(START + dt.timedelta(t), s, (t * 7 + k) % 11, "" if (t + k) % 9 == 0 else t % 5) for t in range(366) for k, s in enumerate(("珠洲", "七尾"))]
    put("weather.csv", [("date", "station", "precipitation_total_mm", "snow_depth_max_cm"), *weather])
    near = ids[:6]
    lines = []
    for t in range(366):
        day = START + dt.timedelta(t)
        od = {a: {b: rnd.randint(1, 9) for b in near if a == b or rnd.random() < 0.5} for a in near} | {"10_10": {near[0]: 2.0}}
        body = "NA" if dt.date(2024, 2, 1) <= day <= dt.date(2024, 3, 31) or t % 17 == 3 else "{}" if t % 23 == 5 else repr(od)
        lines.append(f"{day:%Y%m%d}\t{body}")
    (at / "od.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return at


def test_readers(spark, folder):
    evac = {r["day"].day: r["rate"] for r in tables.read_rates(spark, f"{folder}/evacuation.csv", "避難者率").collect()}
    assert evac == {3: 0.5, 5: None, 8: 0.25}
    weather = tables.read_weather(spark, f"{folder}/weather.csv")
    assert weather.count() == 732 and weather.where("snow is null").count() > 50 and weather.where("rain is null").count() == 0
    cells = tables.read_cells(spark, f"{folder}/cells.csv")
    assert cells.columns == ["cell", "area", "lat", "lon"] and cells.where("area is null").count() == 492
    assert tables.read_facilities(spark, f"{folder}/shelters.csv").where("facility_count = 3").count() == 369


def test_rates_hold_source_by_source(spark, folder):
    i = cli.real_inputs(spark, str(folder), Settings())
    rows = forecast.daily_external(i).where("cell = '35_31' and day between date'2024-01-01' and date'2024-01-09'").orderBy("day").collect()
    assert [r["evac"] for r in rows] == [None, None, 0.5, 0.5, None, None, None, 0.25, 0.25]
    assert [r["water"] for r in rows] == [None, None, None, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9]
    silent = forecast.daily_external(i).where("cell = '35_30' and (evac is not null or water is not null)")
    assert silent.count() == 0  # a cell outside all areas has no reports
    assert i.cells.where("area = '対象外'").count() == 492


def test_modes(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "Settings", partial(Settings, box=Box(35, 37, 30, 36)))  # the same plan on fewer cells
    common = ["--inputs", str(folder), "--out", str(tmp_path), "--iterations", "2"]
    assert cli.main(["--inspect", *common]) == 0
    told = dict(x.split("\t", 1) for x in capsys.readouterr().out.splitlines())
    assert told["calendar"] == "2023-11-01 .. 2024-10-31, 366 days" and told["window jan"].endswith("7 days") and told["to predict"].endswith("58 days")
    read = [x.split("\t") for x in (folder / "od.tsv").read_text().splitlines()]
    held = [f"202401{d}" for d in range(25, 32)] + [f"202404{d:02}" for d in range(1, 8)]
    assert told["training days"] == str(sum(b != "NA" and d not in held for d, b in read)) and int(told["candidate pairs"]) == 30
    assert cli.main(["--validate", *common]) == 0
    metrics = json.loads((tmp_path / "metrics.json").read_text())
    assert list(metrics) == ["experiment", "date", "status", "compared_to", "results", "config"] and metrics["results"]["overall"]["n_days"] == 14
    assert {d["model"] for d in metrics["results"]["fit_diagnostics"]} == set(forecast.COMPONENTS)
    assert len((tmp_path / "validation_jan.tsv").read_text().splitlines()) == 7
    (tmp_path / "v.py").write_text("import sys; sys.exit(0 if len(open(sys.argv[1]).read().splitlines()) == 58 else 1)")
    assert cli.main(["--submit", *common, "--validator", str(tmp_path / "v.py")]) == 0
    assert "validator passed" in (tmp_path / "runs.log").read_text()
    assert cli.main(["--check", str(tmp_path / "submission.tsv"), "--validator", str(tmp_path / "v.py")]) == 0
    with pytest.raises(ValueError):
        cli.main(["--check", str(tmp_path / "validation_jan.tsv"), "--validator", str(tmp_path / "v.py")])

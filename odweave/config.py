"""Settings of the flow model: calendar, grid, holdout windows, estimation."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

D = dt.date


@dataclass(frozen=True)
class Box:
    """Cells whose flows are estimated and scored, both ends included."""

    y_min: int = 35
    y_max: int = 70
    x_min: int = 30
    x_max: int = 70
    grid_y: int = 100
    grid_x: int = 70

    @property
    def n_cells(self) -> int:
        return (self.y_max - self.y_min + 1) * (self.x_max - self.x_min + 1)


@dataclass(frozen=True)
class Settings:
    start: dt.date = D(2023, 11, 1)
    end: dt.date = D(2024, 10, 31)
    break_day: dt.date = D(2024, 1, 1)  # first day of the second regime
    windows: tuple[tuple[str, dt.date, dt.date], ...] = (("jan", D(2024, 1, 25), D(2024, 1, 31)), ("apr", D(2024, 4, 1), D(2024, 4, 7)))
    test_span: tuple[dt.date, dt.date] = (D(2024, 2, 1), D(2024, 3, 31))
    test_excluded: tuple[dt.date, ...] = (D(2024, 2, 2), D(2024, 3, 5))
    box: Box = field(default_factory=Box)
    # From here on, sizes and norms of the score, then the model's numbers.
    n_diag: int = 1476
    n_off: int = 1476 * 1476 - 1476
    norm_diag: float = 26.57
    norm_off: float = 0.0176
    diagonal_groups: tuple[str, ...] = ("evac", "water", "rain")
    offdiagonal_groups: tuple[str, ...] = ("evac", "water", "rain", "snow", "shelter")
    incoming_weight: float = 0.5
    max_iter: int = 200
    tol: float = 1e-5
    variance_floor: float = 1e-8
    initial_variance: float = 1e4
    initial_q_ratio: float = 0.03
    max_log_mean: float = 50.0
    calendar_ridge: float = 1.0
    deviation_ridge: float = 20.0
    global_ridge: float = 1.0
    constant_sd: float = 1e-10

    @property
    def n_days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def break_index(self) -> int:
        return (self.break_day - self.start).days

    def model(self) -> dict[str, object]:
        """What a metrics file says about the model. The names of the keys."""
        a = asdict(self)
        return {
            "diagonal_groups": list(self.diagonal_groups), "offdiagonal_groups": list(self.offdiagonal_groups), "incoming_weight": self.incoming_weight,
            "em": {k: a[k] for k in ("max_iter", "tol", "variance_floor", "initial_variance", "initial_q_ratio")},
            "ridge": {"weekday": self.calendar_ridge, "deviation": self.deviation_ridge, "global": self.global_ridge},
        }


#: Stations, latitude and longitude in degrees; their order breaks ties.
STATIONS = {
    "珠洲": (37 + 26.8 / 60, 137 + 17.2 / 60),
    "輪島": (37 + 23.4 / 60, 136 + 53.7 / 60),
    "門前": (37 + 15.7 / 60, 136 + 43.7 / 60),
    "三井": (37 + 17.6 / 60, 136 + 57.7 / 60),
    "志賀": (37 + 8.6 / 60, 136 + 43.5 / 60),
    "七尾": (37 + 1.8 / 60, 136 + 59.5 / 60),
}

#: The same calendar 28 years earlier (366 days, the break on a Monday), for tables of orders; 15 cells.
PROXY = Settings(
    start=D(1995, 11, 1), end=D(1996, 10, 31), break_day=D(1996, 1, 1),
    windows=(("jan", D(1996, 1, 25), D(1996, 1, 31)), ("apr", D(1996, 4, 1), D(1996, 4, 7))),
    test_span=(D(1996, 2, 1), D(1996, 3, 31)), test_excluded=(D(1996, 2, 2), D(1996, 3, 5)),
    box=Box(y_min=35, y_max=37, x_min=30, x_max=34), n_diag=15, n_off=210,
)
#: Stations of the proxy box; latitude, longitude.
PROXY_STATIONS = {"st0": (37.05, 136.70), "st1": (37.02, 136.74), "st2": (37.03, 136.78), "st3": (37.00, 136.71), "st4": (37.04, 136.73), "st5": (37.01, 136.79)}

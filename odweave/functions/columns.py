"""Column functions: cell ids, calendar fields, distances, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Box

EARTH_KM = 6371.0
OUTSIDE = "-1_-1"


def parse_cell(cell_id: Column, box: Box = Box()) -> Column:
    """STRUCT<y, x> of a cell id, null for the outside sentinel, malformed ids and places off the grid."""
    part = F.split(cell_id, "_")
    y, x = (F.get(part, F.lit(i)).try_cast("int") for i in (0, 1))
    ok = (F.size(part) == 2) & (cell_id != OUTSIDE) & y.between(1, box.grid_y) & x.between(1, box.grid_x)
    return F.when(ok, F.struct(y.alias("y"), x.alias("x")))


def in_box(cell_id: Column, box: Box = Box()) -> Column:
    """Whether a cell lies in the box; what is no cell does not."""
    c = parse_cell(cell_id, box)
    return F.coalesce(c["y"].between(box.y_min, box.y_max) & c["x"].between(box.x_min, box.x_max), F.lit(False))


def day_int(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def is_year_end(day: Column) -> Column:
    """29 December to 3 January."""
    return ((F.month(day) == 12) & (F.dayofmonth(day) >= 29)) | ((F.month(day) == 1) & (F.dayofmonth(day) <= 3))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))


def safe_divide(num: Column, den: Column) -> Column:
    """0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantized(x: Column, digits: int = 6) -> Column:
    """Halves up by floor, the same on every engine."""
    s = float(10**digits)
    return F.floor(x * s + 0.5) / s

"""Two-level ridge with the levels given: sums of products by series in the engine, small solves in batches, one Schur complement over all series.

Each series has local coefficients (calendar and deviations of the features) and all share the features' global
ones. Local ones are eliminated series by series; what that leaves of the global system is summed by Spark, so only
a matrix as wide as there are features reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.storage import store
from .estimation import kept_solve


def product_sums(rows: DataFrame, key: str, width: int) -> DataFrame:
    """key, g (the symmetric sums of products of ``b``, its upper triangle by rows) and w (of ``b`` with ``y``), in one aggregation with partial sums."""
    b = lambda i: F.col("b")[i]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    return rows.groupBy(key).agg(F.array(*[F.sum(b(i) * b(j)) for i, j in pairs]).alias("g"), F.array(*[F.sum(b(i) * F.col("y")) for i in range(width)]).alias("w"))


def _eliminate(batches: Iterator[pa.RecordBatch], key: str, calendar: int, width: int, noise: float, s: Settings) -> Iterator[pa.RecordBatch]:
    upper = np.triu_indices(width)
    penalty = noise * np.diag(np.r_[np.full(calendar, s.calendar_ridge), np.full(width - calendar, s.deviation_ridge)])
    for batch in batches:
        n = batch.num_rows
        flat = lambda c, n=n, batch=batch: batch.column(c).flatten().to_numpy().reshape(n, -1)
        gram = np.zeros((n, width, width))
        gram[:, upper[0], upper[1]] = flat("g")
        gram += np.triu(gram, 1).transpose(0, 2, 1)
        w, x = flat("w"), slice(calendar, None)
        lower = np.linalg.cholesky(gram + penalty)
        half = np.linalg.solve(lower, np.concatenate([gram[:, :, x], w[:, :, None]], 2))
        solved = np.linalg.solve(lower.transpose(0, 2, 1), half)
        taken, own = solved[:, :, :-1], solved[:, :, -1]
        schur = gram[:, x, x] - half[:, :, :-1].transpose(0, 2, 1) @ half[:, :, :-1]
        rest = w[:, x] - (half[:, :, :-1].transpose(0, 2, 1) @ half[:, :, -1:])[..., 0]
        listed = lambda a: pa.array(list(a.reshape(len(a), -1)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(key), listed(own), listed(taken), listed(np.concatenate([schur.reshape(n, -1), rest], 1))], [key, "own", "taken", "shared"])


def two_level(rows: DataFrame, key: str, calendar: int, width: int, s: Settings, noise: float = 1.0) -> tuple[DataFrame, list[float]]:
    """(key, local: coefficients of each series; the global ones). ``rows`` has the key, b (calendar columns, then features) and y, observed days only."""
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, own array<double>, taken array<double>, shared array<double>"
    k = width - calendar
    done = store(product_sums(rows, key, width).mapInArrow(partial(_eliminate, key=key, calendar=calendar, width=width, noise=noise, s=s), kind))
    one = done.agg(*[F.coalesce(F.sum(F.col("shared")[i]), F.lit(0.0)) for i in range(k * k + k)]).first() or ()
    beta = kept_solve(np.array(one[: k * k]).reshape(k, k) + noise * s.global_ridge * np.eye(k), np.array(one[k * k :], float)).tolist()
    shift = "0.0D" if not k else " + ".join(f"taken[i * {k} + {j}] * {v!r}D" for j, v in enumerate(beta))
    return done.select(key, F.expr(f"transform(own, (o, i) -> o - ({shift}))").alias("local")), beta

"""Quality classifier: random Fourier features over document statistics.

Statistics of a whole text (lengths, repetition, shares of character classes) are
squashed and standardised; cosines of random projections approximate a Gaussian
kernel over them; ridge weights come from normal equations that every partition
sums for itself and Spark adds up; isotonic regression on a part of the rows that
the ridge has not seen turns the scores into probabilities.

A rows' text is the only thing that a score is made from. Rows are learned from if
crc32(doc_id as text) mod 5 is not 0: remainder 1 calibrates, 2 to 4 fit. Labels are
joined on doc_id after the statistics, which are a few numbers a row. A doc_id with
several labels counts for each; null labels are left out. Null and empty texts are
scored as texts without words, very long ones whole, in one task each. A row without a doc_id meets no label and
counts as held out. Without labels every score is 0.5. Repeated rows get
equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import stored

U = K.U
FEATURES, WIDTH, RIDGE, SEED = 192, 3.0, 1.0, 7
#: Bins of the scores that isotonic regression pools; what reaches the driver is one row a bin.
BINS = 1000
CUT = 0.3
STATS = (
    "words", "chars_per_word", "long_words", "distinct", "distinct_pairs", "top_repeat", "lines", "repeated_lines", "upper", "digits", "symbols", "pipes",
    "ends", "commas", "other_ascii", "non_ascii", "one_char_words", "words_per_line", "neighbours_equal", "symbol_ends",
)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS a text."""
    n = len(off) - 1
    s, e, d = K.words(buf, off)
    length = (e - s).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    words = np.bincount(d, minlength=n).astype(float)
    some = np.maximum(words, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]) / size

    h = K.span(K.prefix(buf), s, e)
    pair = K.mix(h[:-1] * U(3) + h[1:]) if len(h) > 1 else np.zeros(0, U)
    same_row = d[:-1] == d[1:]
    at = np.searchsorted(d, np.arange(n + 1))
    distinct, pairs, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if at[i + 1] > at[i]:
            _, c = np.unique(h[at[i] : at[i + 1]], return_counts=True)
            distinct[i], top[i] = len(c), c.max()
            if at[i + 1] - at[i] > 1:
                pairs[i] = len(np.unique(pair[at[i] : at[i + 1] - 1]))
    is_line = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
    cut = np.concatenate([[0], np.cumsum(buf == 10)])
    if len(d) > 1:
        is_line[1:] |= cut[s[1:]] > cut[s[:-1]]
    first = np.flatnonzero(is_line)
    line_rows = d[first]
    lines = np.bincount(line_rows, minlength=n).astype(float)
    repeats = np.zeros(n)
    if len(first):
        # A line's hash is the sum of its words' hashes by place.
        lh = np.add.reduceat(K.mix(h + (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(U)), first)
        la = np.searchsorted(line_rows, np.arange(n + 1))
        for i in range(n):
            if la[i + 1] - la[i] > 1:
                repeats[i] = la[i + 1] - la[i] - len(np.unique(lh[la[i] : la[i + 1]]))
    last = buf[e - 1] if len(e) else np.zeros(0, np.uint8)
    per = lambda mask: np.bincount(d, weights=mask, minlength=n) / some
    equal = np.bincount(d[:-1], weights=(h[:-1] == h[1:]) & same_row, minlength=n) / some if len(h) > 1 else np.zeros(n)
    code = np.zeros(256, np.uint8)
    code[65:91], code[48:58] = 1, 2
    for c in b"#*$%&|<>^~@\\{}[]":
        code[c] = 3
    kind = code[buf]
    letters = np.zeros(256, bool)
    letters[97:123] = True
    plain = ~(K.IS_SPACE | letters) & (np.arange(256) < 128)
    marks = np.isin(last, np.frombuffer(b"#*$%&|<>!", np.uint8))
    return np.stack([
        np.log1p(words), np.bincount(d, weights=length, minlength=n) / some, per(length > 12), distinct / some, pairs / some, top / some,
        np.log1p(lines), repeats / np.maximum(lines, 1), np.sqrt(share(kind == 1)), np.sqrt(share(kind == 2)), np.sqrt(share(kind == 3)), np.sqrt(share(buf == 124)),
        per(np.isin(last, np.frombuffer(b".!?", np.uint8))), per(last == 44), share(plain[buf]), share(buf > 127), per(length == 1), np.log1p(words / np.maximum(lines, 1)), equal, per(marks),
    ], 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in K.chunks(batch.column("text")):
            x = statistics(buf, off).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "x"])


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random features whose inner products approximate a Gaussian kernel of WIDTH, a constant first."""
    rng = np.random.default_rng(SEED)
    w, shift = rng.normal(0, 1 / WIDTH, (len(STATS), features)), rng.uniform(0, 2 * math.pi, features)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(x), 1)), np.cos(z @ w + shift) * math.sqrt(2 / features)], 1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), float).reshape(-1, len(STATS))


def _normal(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's sums of z z' and z y: one row a matrix row."""
    a = None
    for batch in batches:
        z = fourier(_rows(batch), mean, scale)
        y = np.asarray(batch.column("quality"), float)
        part = z.T @ np.concatenate([z, y[:, None]], 1)
        a = part if a is None else a + part
    if a is not None:
        k = a.shape[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k + 1)), pa.array(np.tile(np.arange(k + 1), k)), pa.array(a.ravel())], ["i", "j", "v"])


def _score(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, knots: np.ndarray, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = fourier(_rows(batch), mean, scale) @ weights if batch.num_rows else np.zeros(0)
        p = np.interp(raw, knots, levels) if len(knots) else raw
        cols = [batch.column(c) for c in batch.schema.names if c != "x"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], [*[c for c in batch.schema.names if c != "x"], "score"])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` in weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a row of ``docs``; see the module. ``labels`` has doc_id and quality."""
    x = stored(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<float>"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0))
    learned = stored(x.withColumn("fold", fold).where("fold <> 0").join(labels.select("doc_id", "quality").where("quality in (0, 1)"), "doc_id").select("fold", "x", F.col("quality").cast("long").alias("quality")))
    fit = learned.where("fold > 1")
    k = len(STATS)
    sums = fit.agg(F.count("*"), *[f(F.col("x")[i].cast("double")) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    base = x.withColumn("held_out", fold == 0).select("doc_id", "held_out", "x")
    if not sums[0]:
        return base.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean, scale = np.array(sums[1::2], float), np.array(sums[2::2], float)
    scale[scale < 1e-6] = 1
    # The sums of the partitions are added in Spark; one (FEATURES + 1) x (FEATURES + 2) table reaches the driver.
    cells = fit.select("x", "quality").mapInArrow(partial(_normal, mean=mean, scale=scale), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    a = np.zeros((FEATURES + 1, FEATURES + 2))
    a[np.asarray(cells["i"]), np.asarray(cells["j"])] = np.asarray(cells["v"])
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[0] = 0
    weights = np.linalg.solve(a[:, :-1] + np.diag(penalty) + 1e-9 * np.eye(FEATURES + 1), a[:, -1])
    raw = learned.where("fold = 1").select("x", "quality").mapInArrow(partial(_score, mean=mean, scale=scale, weights=weights, knots=np.zeros(0), levels=np.zeros(0)), "quality long, score double")
    lo, hi = -0.5, 1.5
    bins = raw.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") - lo) / (hi - lo) * BINS))).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum("quality").alias("s")).orderBy("b").collect()
    if bins:
        n, s = (np.array([r[c] for r in bins], float) for c in "ns")
        knots = lo + (np.array([r["b"] for r in bins]) + 0.5) * (hi - lo) / BINS
        levels = isotonic((s + 0.02) / (n + 0.04), n)
    else:
        knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    out = base.mapInArrow(partial(_score, mean=mean, scale=scale, weights=weights, knots=knots, levels=levels), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))

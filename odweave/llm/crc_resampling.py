"""Importance resampling towards a target text collection, over hashed word n-grams.

One scan of a document keeps the running zlib states of the last ``n`` starts in a ring. Each word extends
every state by a blank and itself and opens a new one; a state is the checksum of the run of words
from its start, so all runs of 1 to n words come out of the ring as buckets and no run is ever put together.
A document's buckets are stored, so counting and weighing do not scan texts again; what
reaches the driver is one row a bucket.

A document's weight is the floored mean of its features' gains, a bucket's gain the scaled log ratio of its
smoothed shares in target and corpus. A Gumbel draw fixed by doc_id and seed is added, and the highest scores
among long enough documents are drawn, which samples without replacement in proportion to exp(weight / 1000).

Null and blank texts have no features and weight 0. A null doc_id counts as the empty string in the seed and comes last among ties.
Repeated rows are scored and ranked each for itself. Long texts are scanned in bounded pieces, and
only their buckets (2 bytes a feature) are held. Empty tables: no documents give no rows, without targets the corpus alone gives the gains. Other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS, RUN = 10_000, 2
#: Words a document needs to be drawn, and the share that is drawn in percent.
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
#: Bytes that are part of a word once A-Z are lower-cased: digits, a-z and all of a character beyond ASCII; others become blanks.
_IN_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = re.compile(rb"[^ ]*\Z")


def word_pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, some at a time; a piece never ends inside a word."""
    rest = b""
    for a in range(0, len(text), limit):
        part = rest + text[a : a + limit].translate(_IN_WORD)
        cut = len(part) if a + limit >= len(text) else _LAST.search(part).start()
        rest = part[cut:]
        yield part[:cut].split()


def ring_buckets(text: bytes, n: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to n of them."""
    ring: list[int] = []  # states of the last n - 1 starts, the oldest first
    count, found = 0, []
    for words in word_pieces(text):
        out: list[int] = []
        for w in words:
            spaced = b" " + w
            ring = [crc32(spaced, state) for state in ring]
            ring.append(crc32(w))
            out += ring
            if len(ring) == n:
                del ring[0]
        count += len(words)
        found.append((np.array(out, np.uint32) % np.uint32(buckets)).astype("<u2"))
    return count, np.concatenate(found) if found else np.zeros(0, "<u2")


def _scan(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = [ring_buckets(t.as_buffer().to_pybytes() if t.is_valid else b"", n, buckets) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([c for c, _ in rows], pa.int64()), pa.array([b.tobytes() for _, b in rows], pa.binary())], ["doc_id", "n_words", "buckets"])


def features(docs: DataFrame, n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the packed buckets of each row's features; ``buckets`` fit in 16 bits."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets have to fit in 16 bits")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_scan, n=n, buckets=buckets), "doc_id long, n_words long, buckets binary")


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for b in batch.column("buckets"):
            total += np.bincount(np.frombuffer(b.as_buffer(), "<u2"), minlength=size)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    rows = feats.select("buckets").mapInArrow(partial(_count, size=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(b.as_buffer(), "<u2") for b in batch.column("buckets")]
        weight = [int(gain[b].sum()) // len(b) if len(b) else 0 for b in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array([len(b) for b in found], pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise fixed by the seed and the doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... in the given order.

    Spark sorts by ranges; a row's rank is its place in its range plus the rows of the ranges before, which
    are counted from the stored result: one row a range is all that meets in one place.
    """
    s = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = s.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # one row a range of the sort
    before, table = 0, []
    for r in sizes:
        table.append((r["_part"], before))
        before += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(table, "_part long, _before long"))
    return s.withColumn("_part", part).join(offsets, "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    ``target`` has a text. Of the documents with ``min_words`` words, floor(percent / 100) are drawn.
    """
    feats = stored(features(docs, n, buckets))
    gain = gains(bucket_counts(feats, buckets), bucket_counts(features(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets), buckets))
    weighed = feats.mapInArrow(partial(_weigh, gain=gain), "doc_id long, n_words long, n_features long, weight long")
    scored = ranked(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), (F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # Documents that are long enough come first, so the drawn ones are the first ranks.
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    return scored.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))

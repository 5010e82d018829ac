"""Array kernels over the bytes of a batch of texts: words, hashes of spans, chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; the arrays of a chunk take some hundred times as much. One longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i up to n."""
    if len(_powers.get("p", ())) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, b in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each starts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with ``limit`` bytes at most, or one row."""
    buf, off = text_buffer(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def pieces(batch: pa.RecordBatch, column: pa.Array, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``limit`` bytes at most, or one row; nothing is copied."""
    off = text_buffer(column)[1]
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span`` reads the hash of any span from it."""
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[: len(buf)], out=out[1:])
    return out


def span(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    _, inv = powers(len(run))
    return mix((run[end] - run[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses rows."""
    sp = IS_SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    before = np.ones(len(buf), bool)
    before[1:] = sp[:-1]
    after = np.ones(len(buf), bool)
    after[:-1] = sp[1:]
    start = np.flatnonzero(~sp & (before | first[:-1]))
    end = np.flatnonzero(~sp & (after | first[1:])) + 1
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    return start, end, np.repeat(np.arange(len(off) - 1), counts)


def word_hashes(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z lower-cased if asked."""
    s, e, d = words(buf, off)
    return span(prefix(LOWER[buf] if lower else buf), s, e), d


def shingles(h: np.ndarray, d: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row with fewer words has one shingle, its whole sequence."""
    per = np.bincount(d, minlength=n_rows)
    mult = powers(k)[0]
    n = len(h)
    out = np.zeros(0, U)
    rows = np.zeros(0, np.int64)
    if n >= k:
        x = h[: n - k + 1] * mult[1]
        for i in range(1, k):
            x = mix(x) + h[i : n - k + 1 + i] * mult[i + 1]
        ok = d[: n - k + 1] == d[k - 1 :]
        out, rows = mix(x[ok]), d[: n - k + 1][ok]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(per)])
        extra = []
        for r in short:
            x = np.array([per[r]], U)
            for i in range(at[r], at[r + 1]):
                x = mix(x) + h[i : i + 1] * mult[1:2]
            extra.append(x[0])
        out, rows = np.concatenate([out, mix(np.array(extra, U))]), np.concatenate([rows, short])
        o = np.argsort(rows, kind="stable")
        out, rows = out[o], rows[o]
    return out, rows


def row_sets(x: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, one after the other, and where each row starts."""
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    off = np.zeros(n_rows + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), off

"""Line dedup by a segment-partition edit join.

A line is what stands between two \\n, without white space at its ends. Two lines are
linked if they are equal, or if both have at least MIN_LINE code points and their edit
distance is at most the threshold t. A line of n code points is split into t + 1
segments of even length; a line within t edits of it holds one of them unchanged,
shifted by no more than the difference in length allows. So every line goes into an
index under (length, segment, content), and looks in it for the lengths n - t to n,
at the places where the segment can still stand (multi-match-aware bounds). Keys are
hashes of content, so a candidate is verified on the texts, by a banded bit-parallel
edit distance. Equal lines are one node throughout, so a line that stands in a third
of all documents costs one row.

Keys and line hashes travel as packed arrays, one row for a bucket and batch. A key
that many lines share, so that it has more than LINE_PAIRS pairs a line, is not paired
in its bucket: what a bucket gives grows with its lines. Up to WHOLE of them meet in
one task, where what is linked already is not compared again. More are first compared
with one of them, the most central one, as long as such rounds link anything: a
family around one line costs a comparison each. What is linked need not be compared
again. Of the lines left apart those of a key whose lines differ in a short middle only meet by their
shortened middles; the others are compared with all of the key, dealt out as
blocks, each pair of blocks a task of bounded size, where a bag-of-characters bound
drops most pairs before the edit distance is run.

Components of the links are classes; the line that comes first stays, all later ones
go. The order is by doc_id (rows without one last), then by the row's key, then by line
number. Blank lines are never linked and stay. Null and empty texts have one blank
line. Equal rows keep and lose the same lines: they count as one. Rows with one doc_id
and different texts follow each other in the order of their keys. A very long text takes its
arrays' memory in one task. An empty table gives
no rows; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import noded, partitions, passing, salted_join, stored
from .graph import components

U = K.U
THRESHOLD, MIN_LINE = 2, 40
#: Pairs of one key that its bucket lists itself, in all and for each of its lines; beyond either, the key's lines meet their leaders, then in blocks of BLOCK.
BUCKET_PAIRS, LINE_PAIRS, BLOCK = 4096, 4, 512
#: Lines of a common key that are compared in one task, as many as a pair of blocks has; only keys with more take rounds of leaders.
WHOLE = 2 * BLOCK
#: Keys that are packed at once; sorted and packed they take some hundred bytes each of a worker.
PACK_KEYS = 1 << 18
#: Rounds in which lines of a common key are compared with one of them.
LEADER_ROUNDS = 3
#: Characters in which all lines of a common key may differ for it to be refined; lines of a refined key that are paired at once.
MIDDLE, FEW = 16, 32
_BLANK = " \t\n\x0b\f\r"


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edit distance if it is at most ``limit`` (31 or less), else limit + 1.

    Bit-parallel on a band: one 64-bit column of the differences between rows slides
    along the diagonal, so the cost is one step a character whatever the length.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    n = 0
    while n < len(b) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < len(b) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not b:
        return min(limit + 1, len(a))
    band = min(limit, len(a))
    full = (1 << 64) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down = (full << (63 - band)) & full, 0  # rows that are one more, one less than the row above
    score, give_up, edge = band, band + len(b) - (len(a) - band), 1 << 62
    for j, c in enumerate(b):
        at = j + band - 63
        rows = where.get(c, 0)
        eq = (rows >> at if at >= 0 else rows << -at) & full
        diag = ((((eq & up) + up) & full) ^ up) | eq | down
        right_up = (down | ~(diag | up)) & full
        right_down = diag & up
        if j < len(a) - band:
            score += not diag >> 63
        else:
            score += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        if score > give_up:
            return limit + 1
        up = (right_down | ~((diag >> 1) | right_up)) & full
        down = (diag >> 1) & right_up
    return min(score, limit + 1)


def segments(n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the t + 1 segments of lines of n code points; the longer ones stand last."""
    short, more = n // (t + 1), n % (t + 1)
    i = np.arange(t + 1)
    lengths = short[:, None] + (i[None, :] > t - more[:, None])
    starts = np.cumsum(lengths, 1) - lengths
    return starts, lengths


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without blanks at both ends) and row of every line."""
    cut = buf == 10
    rows, starts, ends = [], [], []
    nl = np.flatnonzero(cut)
    for r in range(len(off) - 1):
        a, b = off[r], off[r + 1]
        mine = nl[np.searchsorted(nl, a) : np.searchsorted(nl, b)]
        starts.append(np.concatenate([[a], mine + 1]))
        ends.append(np.concatenate([mine, [b]]))
        rows.append(np.full(len(mine) + 1, r))
    s, e, d = np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)
    sp = np.concatenate([K.IS_SPACE[buf], [False]])
    solid = np.flatnonzero(~sp[:-1])
    i, j = np.searchsorted(solid, s), np.searchsorted(solid, e) - 1
    full = j >= i
    s2, e2 = s.copy(), s.copy()
    s2[full], e2[full] = solid[i[full]], solid[j[full]] + 1
    return s2, e2, d


def _ends(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A second hash of lines, of their length and first and last bytes: two lines that share the first hash by chance differ in it."""
    x = (e - s).astype(U)
    for i in range(8):
        at = np.minimum(i, e - s - 1)
        x = K.mix(x + buf[s + at].astype(U) * U(257) + buf[e - 1 - at].astype(U))
    return (x >> U(33)).astype(np.int32)


def _hashes(run: np.ndarray, s: np.ndarray, e: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of lines, cut to ``bits`` bits."""
    return K.span(run, s, e) >> U(64 - bits)


def _line_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """doc_id, node, line, h, g: the place and hashes of every line with content."""
    for batch in batches:
        for a, b, buf, off in K.chunks(batch.column("text")):
            s, e, d = _lines(buf, off)
            first = np.searchsorted(d, np.arange(b - a))
            number = np.arange(len(d)) - first[d]
            full = e > s
            h = _hashes(K.prefix(buf), s[full], e[full], bits).view(np.int64)
            ids = [batch.column(c).slice(a, b - a).take(pa.array(d[full])) for c in ("doc_id", "node")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(number[full]), pa.array(h), pa.array(_ends(buf, s[full], e[full]))], ["doc_id", "node", "line", "h", "g"])


def _keys(batches: Iterator[pa.RecordBatch], t: int, least: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """bucket, keys, lines: index and probe keys of lines, packed, some PACK_KEYS at once and each once a piece of text; the lowest bit of a key tells a probe."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        key, h = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        where = ((key >> U(1)) % U(buckets)).astype(np.int64)
        o = np.argsort(where, kind="stable")
        where, key, h = where[o], key[o], h[o]
        cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        ends = np.append(cut[1:], len(where))
        return pa.RecordBatch.from_arrays(
            [pa.array(where[cut]), pa.array([key[x:y].tobytes() for x, y in zip(cut, ends, strict=True)]), pa.array([h[x:y].tobytes() for x, y in zip(cut, ends, strict=True)])],
            ["bucket", "keys", "lines"],
        )

    for batch in batches:
        for _, _, buf, off in K.chunks(batch.column("text")):
            s, e, _ = _lines(buf, off)
            lead = (buf & 0xC0) != 0x80  # bytes that begin a code point
            at = np.concatenate([np.flatnonzero(lead), [len(buf)]])
            cs, ce = np.searchsorted(at, s), np.searchsorted(at, e)
            ok = np.flatnonzero(ce - cs >= least)
            if not len(ok):
                continue
            run = K.prefix(buf)
            h = _hashes(run, s[ok], e[ok], bits)
            _, one = np.unique(K.mix(h + _ends(buf, s[ok], e[ok]).astype(U)), return_index=True)  # each kind of line once
            ok, h = ok[one], h[one]
            c0, n = cs[ok], ce[ok] - cs[ok]
            for back in range(t + 1):  # lengths that are looked up; 0 is also what is indexed
                m = n - back
                starts, lengths = segments(m, t)
                for i in range(t + 1):
                    low = np.maximum(starts[:, i] - i, starts[:, i] + back - (t - i))
                    high = np.minimum(starts[:, i] + i, starts[:, i] + back + (t - i))
                    for shift in range(-t, 2 * t + 1):
                        p = starts[:, i] + shift
                        go = (p >= np.maximum(low, 0)) & (p <= np.minimum(high, n - lengths[:, i])) & (m >= least)
                        if not go.any():
                            continue
                        q = c0[go] + p[go]
                        key = K.mix(K.span(run, at[q], at[q + lengths[go, i]]) + m[go].astype(U) * U(2 * t + 3) + U(i))
                        found.append((key | U(1), h[go]))
                        if back == 0 and shift == 0:
                            found.append((key & ~U(1), h[go]))
            if sum(len(x) for x, _ in found) >= PACK_KEYS:
                yield flush()
    if found:
        yield flush()


def _match(bucket: pa.Table, most: int) -> pa.Table:
    """a, b, key, n: pairs of lines that share an index key (key null), or the lines of a very common key (b null) and their number."""
    key = np.frombuffer(b"".join(x.as_py() for x in bucket.column("keys")), U)
    h = np.frombuffer(b"".join(x.as_py() for x in bucket.column("lines")), np.int64)
    o = np.lexsort((h, key))
    key, h = key[o], h[o]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
    key, h = key[new], h[new]
    group = key >> U(1)
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(cut[1:], len(group))
    probe = (key & U(1)).astype(np.int64)
    n_probe = np.add.reduceat(probe, cut) if len(cut) else np.zeros(0, np.int64)
    n_index = end - cut - n_probe
    live = np.flatnonzero((n_probe > 0) & (n_index > 0) & (end - cut > 2))
    a, b, k = [], [], []
    for g in live:
        index, looks = h[cut[g] : cut[g] + n_index[g]], h[cut[g] + n_index[g] : end[g]]
        if len(index) * len(looks) <= min(most, LINE_PAIRS * (len(index) + len(looks))):
            x, y = np.repeat(index, len(looks)), np.tile(looks, len(index))
            no = x != y
            a.append(np.minimum(x, y)[no])
            b.append(np.maximum(x, y)[no])
        else:
            k.append((int(group[g]), np.union1d(index, looks)))
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
    common = np.concatenate([m for _, m in k]) if k else np.zeros(0, np.int64)
    names = np.concatenate([np.full(len(m), g, np.int64) for g, m in k]) if k else np.zeros(0, np.int64)
    sizes = np.concatenate([np.full(len(m), len(m), np.int64) for _, m in k]) if k else np.zeros(0, np.int64)
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(common)]),
        "b": pa.concat_arrays([pa.array(pairs[:, 1]), none(len(common))]),
        "key": pa.concat_arrays([none(len(pairs)), pa.array(names)]),
        "n": pa.concat_arrays([none(len(pairs)), pa.array(sizes)]),
    })


def bag(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) & 31, minlength=32)


def _verify(batches: Iterator[pa.RecordBatch], t: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
        good = [(a, b) for a, b, x, y in rows if min(len(x), len(y)) >= least and edit_distance(x, y, t) <= t]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in good], pa.int64()) for i in (0, 1)], ["a", "b"])


def _verify_blocks(block: pa.Table, t: int) -> pa.Table:
    """Links between the lines of two blocks (side 0 and 1, or within side 0)."""
    h, side, text = (block.column(c).to_pylist() for c in ("h", "side", "text"))
    bags = np.stack([bag(x) for x in text]).astype(np.int16)
    size = np.array([len(x) for x in text])
    left = [i for i, s in enumerate(side) if s == 0]
    right = np.array([i for i, s in enumerate(side) if s == 1], int)
    out: list[tuple[int, int]] = []
    for x, i in enumerate(left):
        other = right if len(right) else np.array(left[x + 1 :], int)
        if not len(other):
            continue
        other = other[np.abs(size[other] - size[i]) <= t]
        other = other[np.abs(bags[other] - bags[i]).sum(1) <= 2 * t]
        out += [(min(h[i], h[j]), max(h[i], h[j])) for j in other if h[i] != h[j] and edit_distance(text[i], text[j], t) <= t]
    return pa.table({c: pa.array([p[i] for p in out], pa.int64()) for i, c in enumerate("ab")})


def _verify_key(block: pa.Table, t: int, least: int, check) -> pa.Table:
    """Links between the lines of one key that leave the same components as all its pairs within t edits: ``check`` (_verify) gets no lines that are in one already."""
    h, text = (block.column(c).to_pylist() for c in ("h", "text"))
    place = {x: i for i, x in enumerate(h)}
    bags, size, root = np.stack([bag(x) for x in text]).astype(np.int32), np.array([len(x) for x in text]), np.arange(len(text))
    out: list[tuple[int, int]] = []
    for i in range(len(text) - 1):
        other = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (np.abs(size[i + 1 :] - size[i]) <= t))
        other = other[np.abs(bags[other] - bags[i]).sum(1) <= 2 * t]
        if not len(other):
            continue
        rows = [[h[i]] * len(other), [h[j] for j in other], [text[i]] * len(other), [text[j] for j in other]]
        for found in check(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "ta", "tb"])]), t, least):
            for b in found.column("b").to_pylist():
                out.append((h[i], b))
                root[root == root[place[b]]] = root[i]
    return pa.table({c: pa.array([p[i] for p in out], pa.int64()) for i, c in enumerate("ab")})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, text of the lines whose number is wanted (column lines, ascending)."""
    for batch in (piece for b in batches for piece in K.pieces(b, b.column("text"))):
        hs, texts = [], []
        for text, wanted, keys in zip(*(batch.column(c).to_pylist() for c in ("text", "lines", "hs")), strict=True):
            parts = (text or "").split("\n")
            hs += keys
            texts += [parts[i].strip(_BLANK) for i in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(texts, pa.string())], ["h", "text"])


def verified(pairs: DataFrame, texts: DataFrame, t: int, least: int) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are within t edits; an ``a`` that most pairs have does not fill one task."""
    n = pairs.groupBy("a").agg(F.count("*").alias("n"))
    with_a = salted_join(pairs, n.join(texts.toDF("a", "ta"), "a"), ["a"], "b").drop("n")
    return with_a.join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(partial(_verify, t=t, least=least), "a long, b long")


def key_links(common: DataFrame, texts: DataFrame, t: int, least: int) -> DataFrame:
    """Links among the lines of each key (key, h) in one task a key; no key has more than WHOLE of them."""
    check = _verify
    return common.select("key", "h").join(texts, "h").groupBy("key").applyInArrow(lambda block: _verify_key(block, t, least, check), "a long, b long")


def common_links(common: DataFrame, texts: DataFrame, t: int, least: int, refine: bool = True) -> DataFrame:
    """Links among lines that share a key (key, h); every pair of a key within t edits ends up in one component, if not as a link."""
    links, label = None, None

    def by_component() -> DataFrame:
        if label is None:
            return common.withColumn("c", F.col("h"))
        known = label.select(F.col("node").alias("h"), "component")
        return common.join(known, "h", "left").select("key", "h", F.coalesce("component", "h").alias("c"))

    for _ in range(LEADER_ROUNDS):
        placed = by_component()
        size = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
        per = size.groupBy("key").agg(F.sum("k").alias("n"), F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("x")).where("parts > 1")
        open_ = stored(salted_join(placed, per.select("key", "n", F.when(F.col("x.k") > 1, F.col("x.c")).alias("done")), ["key"], "h"))
        if open_.isEmpty():
            return links
        # The most central line of a key is in many large keys. Later rounds take it from outside the key's largest component, which is linked already.
        weighed = open_.join(open_.groupBy("h").agg(F.sum("n").alias("w")), "h").where("done is null or c <> done")
        lead = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("h")).alias("minus"), "c")).alias("x"), F.max("n").alias("n"))
        lead = lead.select("key", "n", (-F.col("x.minus")).alias("a"), F.col("x.c").alias("lc"))
        met = salted_join(open_.select("key", "h", "c"), lead, ["key"], "h").where("c <> lc").select("a", F.col("h").alias("b")).distinct()
        more = stored(verified(stored(met), texts, t, least))
        if more.isEmpty():
            break
        links = more if links is None else stored(links.unionByName(more))
        label = components(links)
    placed = stored(by_component())
    narrow, rest = refined(placed, texts, t) if refine else (None, placed)
    found = [block_links(rest, texts, t)] + ([links] if links is not None else [])
    if narrow is not None and not narrow.isEmpty():
        size = narrow.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("c").alias("parts")).where("parts > 1")
        few = narrow.join(size.where(F.col("n") <= FEW).select("key"), "key", "left_semi")
        one, other = few.toDF("key", "a", "ca"), few.toDF("key", "b", "cb")
        pairs = stored(one.join(other, "key").where("a < b and ca <> cb").select("a", "b").distinct())
        found.append(verified(pairs, texts, t, least))
        many = stored(narrow.join(size.where(F.col("n") > FEW).select("key"), "key", "left_semi").select("key", "h"))
        if not many.isEmpty():
            more = common_links(many, texts, t, least, refine=False)
            found += [more] if more is not None else []
    return reduce(DataFrame.unionByName, found)


def _ends_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h, c, text and how many characters a line shares with ``lead`` from its start and from its end."""
    for batch in batches:
        head, tail = [], []
        for x, y in zip(batch.column("text").to_pylist(), batch.column("lead").to_pylist(), strict=True):
            head.append(len(os.path.commonprefix([x, y])))
            tail.append(len(os.path.commonprefix([x[::-1], y[::-1]])))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "h", "c", "text")], pa.array(head, pa.int32()), pa.array(tail, pa.int32())], ["key", "h", "c", "text", "head", "tail"])


def shortened(x: str, t: int) -> set[str]:
    """A string with up to t characters left out, in all ways."""
    out = last = {x}
    for _ in range(t):
        last = {y[:i] + y[i + 1 :] for y in last for i in range(len(y))}
        out = out | last
    return out


def _variants(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            rows = [(k, h, c, v) for k, h, c, x in zip(*(part.column(n).to_pylist() for n in ("key", "h", "c", "middle")), strict=True) for v in shortened(x, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["key", "h", "c", "v"])


def refined(placed: DataFrame, texts: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """(finer keys: key, h, c; what is left as it was) of lines of a common key in several components.

    Where all lines of a key start and end alike and differ in a short middle only (a sentence with a counter),
    lines within t edits have middles within t edits, and those become equal by leaving out up to t characters of each.
    So a line's new keys are its shortened middles, which few lines share.
    """
    per = placed.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("c").alias("parts"), F.min("h").alias("first")).where("parts > 1")
    lead = per.join(texts.toDF("first", "lead"), "first").select("key", "n", "lead")
    met = salted_join(placed, lead, ["key"], "h").join(texts, "h").select("key", "h", "c", "text", "lead")
    shared = stored(met.mapInArrow(_ends_shared, "key long, h long, c long, text string, head int, tail int"))
    size = F.length("text")
    key = shared.groupBy("key").agg(F.count("*").alias("n"), F.min("head").alias("p"), F.min("tail").alias("s"), F.min(size).alias("low"), F.max(size).alias("high"))
    key = stored(key.withColumn("s", F.least("s", F.col("low") - F.col("p"))).withColumn("narrow", F.col("high") - F.col("p") - F.col("s") <= MIDDLE))
    middle = F.substring("text", F.col("p") + 1, F.length("text") - F.col("p") - F.col("s"))
    short = salted_join(shared, key.where("narrow").select("key", "n", "p", "s"), ["key"], "h").select("key", "h", "c", middle.alias("middle"))
    fine = short.mapInArrow(partial(_variants, t=t), "key long, h long, c long, v string").select(F.xxhash64("key", "v").alias("key"), "h", "c").distinct()
    return stored(fine), stored(placed.join(key.where("not narrow").select("key"), "key", "left_semi"))


def block_links(placed: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """Links between lines of one key in different components (key, h, c): the key's largest component against the rest, and the rest among itself, block by block."""
    check = _verify_blocks
    size = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    per = size.groupBy("key").agg(F.max(F.struct("k", "c")).alias("x"), F.sum("k").alias("n")).where("x.k < n")
    per = per.select("key", F.col("x.c").alias("main"), "n", F.ceil((F.col("n") - F.col("x.k")) / BLOCK).cast("int").alias("nr"), F.ceil(F.col("x.k") / BLOCK).cast("int").alias("nm"))
    j = salted_join(placed, per, ["key"], "h").withColumn("rest", F.col("c") != F.col("main"))
    own = F.pmod(F.xxhash64("h"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    j = j.withColumn("own", own)
    # Blocks of the rest meet each other and those of the largest component, which do not meet one another.
    rest = j.where("rest").select("key", "h", "c", "own", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("other"))
    within = rest.select("key", "h", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    across = j.where("rest").select("key", "h", "c", F.col("own").alias("i"), F.explode(F.sequence(F.lit(-1), -F.col("nm"), F.lit(-1))).alias("j"), F.lit(0).alias("side"))
    main = j.where("not rest").select("key", "h", "c", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side"))
    return within.unionByName(across).unionByName(main).join(texts, "h").groupBy("key", "i", "j").applyInArrow(lambda block: check(block, t), "a long, b long")


def line_kinds(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds of lines: k, h, g, the first place p and the number n; those h that several kinds share, as h, k).

    A kind is told by both hashes of a line. Its key k is h, or a hash of both where different lines
    have one h, so that none takes another's place. A line in very many documents is pre-aggregated before anything meets it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "line")).alias("p")
    by_hash = stored(lines.groupBy("h").agg(first, F.count("*").alias("n"), F.min("g").alias("g"), F.max("g").alias("other")))
    single = by_hash.where("g = other").select(F.col("h").alias("k"), "h", "g", "p", "n")
    several = stored(by_hash.where("g < other").select("h"))
    if several.isEmpty():
        return single, several.select("h", F.col("h").alias("k"))
    split = lines.join(several, "h").groupBy("h", "g").agg(first, F.count("*").alias("n")).select(F.xxhash64("h", "g").alias("k"), "h", "g", "p", "n")
    kinds = stored(single.unionByName(split))
    return kinds, stored(kinds.join(several, "h", "left_semi").select("h", "k"))


def told_apart(found: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) and members of common keys (key, h, the key's number n) of ``_match`` by kinds instead of hashes; kinds of one hash are candidates of each other."""
    pairs, common = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("h"), "n")
    if not several.isEmpty():
        of = lambda c: several.toDF(f"_{c}", f"_{c}k")
        kind = lambda df, c: df.join(of(c), F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}k", c)).drop(f"_{c}", f"_{c}k")
        same = several.toDF("h", "a").join(several.toDF("h", "b"), "h").where("a < b").select("a", "b")
        pairs, common = kind(kind(pairs, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same), stored(kind(common, "h").select("key", "h"))
        common = stored(salted_join(common, common.groupBy("key").agg(F.count("*").alias("n")), ["key"], "h"))
    return stored(pairs.distinct()), common  # a key's lines come from one bucket, each once


def line_classes(src: DataFrame, t: int = THRESHOLD, least: int = MIN_LINE, most: int = BUCKET_PAIRS, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines: doc_id, node, line, h, g; kinds as of ``line_kinds``; classes: node, component over kinds) of ``src`` (node, doc_id, text)."""
    spark = src.sparkSession
    lines = stored(src.mapInArrow(partial(_line_rows, bits=bits), "doc_id long, node long, line long, h long, g int"))
    kinds, several = line_kinds(lines)
    n = partitions(spark)
    # A bucket's packed arrays are held by one task: their number follows the lines, a few MB each.
    buckets = max(4 * n, -(-lines.count() // 40_000))
    packed = src.select("text").mapInArrow(partial(_keys, t=t, least=least, buckets=buckets, bits=bits), "bucket long, keys binary, lines binary")
    found = stored(packed.groupBy("bucket").applyInArrow(lambda bucket: _match(bucket, most), "a long, b long, key long, n long"))
    pairs, common = told_apart(found, several)
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(common.select("h")).distinct()
    # One place of each wanted line, gathered by row, so a text is read once.
    place = kinds.join(wanted, "k").select("k", "p.node", "p.line")
    asked = place.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("line", "k"))).alias("x")).select("node", F.col("x.line").alias("lines"), F.col("x.k").alias("hs"))
    texts = stored(src.select("node", "text").join(asked, "node").mapInArrow(_texts, "h long, text string").groupBy("h").agg(F.min("text").alias("text")))
    links = verified(pairs, texts, t, least)
    whole, beyond = common.where(F.col("n") <= WHOLE), common.where(F.col("n") > WHOLE)
    if not whole.isEmpty():
        links = links.unionByName(key_links(whole, texts, t, least))
    if not beyond.isEmpty():
        more = common_links(beyond.select("key", "h"), texts, t, least)
        links = links if more is None else links.unionByName(more)
    return lines, kinds, components(links)


@passing
def dedup_lines(docs: DataFrame, t: int = THRESHOLD, least: int = MIN_LINE, most: int = BUCKET_PAIRS, bits: int = 64) -> DataFrame:
    """node, doc_id, n_removed, n_fuzzy and drop (ascending numbers of the lines that go), one row a (doc_id, text) with a line to drop.

    ``bits`` of the first hash of a line count; a second one tells lines apart that share it.
    ``docs`` has doc_id, text and, if ``noded`` has given it, node.
    """
    src = (docs if "node" in docs.columns else noded(docs.select("doc_id", "text"))).select("node", "doc_id", "text")
    lines, kinds, classes = line_classes(src, t, least, most, bits)
    # First per line, then per class.
    placed = stored(kinds.join(classes.toDF("k", "component"), "k", "left").select("h", "g", "p", "n", F.coalesce("component", "k").alias("component")))
    top = placed.groupBy("component").agg(F.min("p").alias("top"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    repeated = placed.join(top, "component").select("h", "g", "n", "top", (F.col("p") != F.col("top")).alias("fuzzy"))
    gone = salted_join(lines, repeated, ["h", "g"], "node").where("struct(doc_id is null, doc_id, node, line) <> top")
    return gone.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("line").alias("n_removed"), F.count_distinct(F.when(F.col("fuzzy"), F.col("line"))).alias("n_fuzzy"), F.sort_array(F.collect_set("line")).alias("drop"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for b in batches for piece in K.pieces(b, b.column("row").field("text"))):
        row, kept = batch.column("row"), []
        names = [f.name for f in row.type]
        fields = row.flatten()
        for text, drop in zip(fields[names.index("text")].to_pylist(), batch.column("drop").to_pylist(), strict=True):
            if text is not None and drop:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            kept.append(text)
        fields[names.index("text")] = pa.array(kept, pa.string())
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type)), *[batch.column(c) for c in batch.schema.names[2:]]], ["row", *batch.schema.names[2:]])


def without_lines(docs: DataFrame, t: int = THRESHOLD, least: int = MIN_LINE) -> DataFrame:
    """row (a row of ``docs`` as a struct, the repeated lines taken out of its text), n_removed, n_fuzzy: one row a row of ``docs``."""
    whole = noded(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    drop = dedup_lines(whole, t, least).select("node", "n_removed", "n_fuzzy", "drop")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    j = whole.select("node", "row").join(drop, "node", "left").select("row", "drop", none("n_removed"), none("n_fuzzy"))
    row = j.schema["row"].dataType.simpleString()
    return j.mapInArrow(_cut, f"row {row}, n_removed long, n_fuzzy long")

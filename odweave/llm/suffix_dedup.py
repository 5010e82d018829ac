"""Suffix-array dedup by prefix doubling.

Which 50-byte strings of a document start in a document with a smaller id is read
from ranks of suffixes. Positions start with the rank of their first 8 bytes; the
rank of a longer prefix is that of the pair (rank here, rank further on), so sorted
pairs at offsets 8, 16 and 18 give ranks of prefixes of 16, 32 and 50 bytes. A
position whose rank is unique is done and leaves; equal ranks at 50 bytes are equal
strings.

Spark deals out what has to be sorted together, and each deal is sorted by its task.
Every 50-byte window has an anchor, its least 24-byte string by hash, so equal windows
have equal anchors: windows are dealt to tasks by their anchor, and no suffix of the
corpus is compared with one of another deal. Anchors that stand in one document only,
most of them, are found first from their hashes alone (6 bytes and the document),
so only shared stretches are ever dealt out with their bytes. Neighbouring windows
with one anchor travel as one stretch of 50 to 76 bytes. Of equal stretches in one
group of documents only the one of the smallest document travels, all others are gone
whatever else there is; so a stretch of a third of all documents is one row a group. The
windows of an anchor that HOT documents or more have are dealt out one by one, by
their own hashes. The number of groups and deals follows the bytes of the corpus.
Documents equal to an earlier one as a whole are settled before. Hashes only bring
together: before a stretch goes, its bytes are compared.

Texts are UTF-8 bytes, null is empty; texts under 50 bytes lose nothing. Windows
never cross documents. A string that repeats within one document only is kept.
Equal rows keep or lose the same bytes. Rows that share a doc_id count as one document,
each text keeping its own spans. Rows with a null doc_id are kept whole. A very long
text is held whole by the tasks that read and cut it, some forty bytes a byte. An empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import partitions, salted_join, stored

U = K.U
LENGTH, ANCHOR = 50, 24
KEPT_BITS = U((1 << 48) - 1)
#: Bytes of text for one group of documents and one deal; documents from which on an anchor's windows are dealt out one by one.
DEAL_BYTES, HOT = 6 << 20, 1 << 14
IS_HOT = U(1 << 63)
#: Anchors that are packed at once.
PACK_ANCHORS = 2 << 20


def packed(x: np.ndarray) -> bytes:
    """The bytes of an array plane by plane: high planes that hold zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(parts, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(size, -1).T).view(kind).ravel() for p in parts if len(p)]
    return np.concatenate(out) if out else np.zeros(0, kind)


def anchors(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fp, row, first and last window start (in the row) of each run of windows with one anchor."""
    n, w = len(buf), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U), none, none, none
    run = K.prefix(buf)
    at = np.arange(n - k + 1)
    h = K.span(run, at, at + k)
    least, width = h.copy(), 1
    while width < w:  # minimum over w values, by doubling
        step = min(width, w - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)[: n - length + 1]
    start = np.arange(n - length + 1)
    inside = start + length <= off[1:][row]
    start, row, least = start[inside], row[inside], least[inside]
    if not len(start):
        return none.astype(U), none, none, none
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (np.diff(start) != 1)])
    # A run of one minimum that is longer than a window can share it only by a repeat of the anchor; it is cut.
    cut = np.flatnonzero(new)
    lens = np.diff(np.append(cut, len(start)))
    inner = np.arange(len(start)) - np.repeat(cut, lens)
    cut = np.flatnonzero(inner % (w - 1) == 0)
    end = np.append(cut[1:], len(start)) - 1
    r = row[cut]
    return least[cut], r, start[cut] - off[r], start[end] - off[r]


def _split(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by ``where`` and the first and end row of each value in it."""
    o = np.argsort(where, kind="stable")
    w = where[o]
    cut = _heads(w)
    return o, cut, np.append(cut, len(w))[1:] if len(w) else cut


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(cut: np.ndarray, n: int) -> np.ndarray:
    """Where the runs that begin at ``cut`` end."""
    return np.append(cut[1:], n) if len(cut) else cut


def _bytes_of(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of several stretches one after the other, and where each begins and the last ends."""
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return text[np.repeat(begin - total[:-1], size) + np.arange(total[-1])], total


def equal_to(text: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether stretch i has the bytes of stretch other[i]."""
    same = size == size[other]
    i = np.flatnonzero(same & (other != np.arange(len(other))))
    for x in range(0, len(i), 1 << 16):
        j = i[x : x + (1 << 16)]
        mine, total = _bytes_of(text, begin[j], size[j])
        theirs, _ = _bytes_of(text, begin[other[j]], size[j])
        differ = np.add.reduceat(mine != theirs, total[:-1]) if len(j) else np.zeros(0)
        same[j[differ > 0]] = False
    return same


def firsts(text: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches that stand for themselves, stretches equal byte by byte to one of a smaller document), ``name`` a hash of the bytes."""
    o = np.lexsort((doc, name))
    cut = _heads(name[o])
    head = np.empty(len(o), np.int64)
    head[o] = np.repeat(o[cut], np.diff(np.append(cut, len(o)))) if len(o) else o
    gone = (doc > doc[head]) & equal_to(text, begin, size, head) if len(o) else np.zeros(0, bool)
    return np.flatnonzero(~gone), np.flatnonzero(gone)


def _fingerprints(batches: Iterator[pa.RecordBatch], buckets: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """bucket, fps, docs: the distinct anchors of each document."""
    fps: list[np.ndarray] = []
    docs: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        fp, doc = (np.concatenate(fps) >> U(16)) & KEPT_BITS, np.concatenate(docs)
        fps.clear()
        docs.clear()
        o, cut, end = _split((fp % U(buckets)).astype(np.int64))
        fp, doc = fp[o], doc[o]
        rows = [(int(fp[x] % U(buckets)), packed(fp[x:y]), packed(doc[x:y].astype(np.int64))) for x, y in zip(cut, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "fps", "docs"])

    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for a, _, buf, off in K.chunks(batch.column("text")):
            fp, row, _, _ = anchors(buf, off, length, k)
            fps.append(fp)
            docs.append(ids[a + row])
            if sum(map(len, fps)) >= PACK_ANCHORS:
                yield flush()
    if fps:
        yield flush()


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (K.mix(doc.astype(np.int64).view(U)) % U(groups)).astype(np.int64)


def _shared(bucket: pa.Table, groups: int, hot: int) -> pa.Table:
    """grp, fps, docs: the anchors that stand in two documents or more, dealt by document."""
    fp = unpacked([x.as_py() for x in bucket.column("fps")], U)
    doc = unpacked([x.as_py() for x in bucket.column("docs")], np.int64)
    o = np.lexsort((doc, fp))
    fp, doc = fp[o], doc[o]
    once = _heads(fp, doc)
    fp, doc = fp[once], doc[once]
    cut = _heads(fp)
    n = np.diff(np.append(cut, len(fp)))
    times = np.repeat(n, n) if len(fp) else np.zeros(0, np.int64)
    fp, doc, times = fp[times > 1], doc[times > 1], times[times > 1]
    fp = np.where(times >= hot, fp | IS_HOT, fp)
    g = group_of(doc, groups)
    o, cut, end = _split(g)
    fp, doc, g = fp[o], doc[o], g[o]
    return pa.table({
        "grp": pa.array(g[cut].astype(np.int32)), "fps": pa.array([packed(fp[x:y]) for x, y in zip(cut, end, strict=True)], pa.binary()),
        "docs": pa.array([packed(doc[x:y]) for x, y in zip(cut, end, strict=True)], pa.binary()),
    })


def _pair(fp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return K.mix((fp & KEPT_BITS) + doc.astype(np.int64).view(U) * U(K.BASE))


def _known(pairs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of ``q`` are in the sorted ``pairs``."""
    if not len(pairs):
        return np.zeros(len(q), bool)
    at = np.searchsorted(pairs, q)
    at[at == len(pairs)] = 0
    return pairs[at] == q


def opened(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Ids, whether they are there, all text bytes, and where each text starts, of packed documents."""
    get = lambda c: docs.column(c).to_pylist()
    ids, lens = unpacked(get("ids"), np.int64), unpacked(get("lens"), np.uint32).astype(np.int64)
    raw = b"".join(pa.decompress(t, n, "zstd", asbytes=True) if n else b"" for t, n in zip(get("text"), get("n_raw"), strict=True))
    return ids, np.frombuffer(b"".join(get("there")), bool), raw, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def bases(ids: np.ndarray, there: np.ndarray, raw: bytes, off: np.ndarray) -> np.ndarray:
    """What is added to places in each text, so that different texts of one doc_id have places of their own; equal texts share theirs."""
    base = np.zeros(len(ids), np.int64)
    o = np.argsort(ids, kind="stable")
    cut = _heads(ids[o])
    for x, y in zip(cut, _ends(cut, len(o)), strict=True):
        if y - x > 1:
            at, seen = 0, {}
            for text, i in sorted((raw[off[i] : off[i + 1]], i) for i in o[x:y].tolist() if there[i]):
                if text not in seen:
                    seen[text] = at
                    at += len(text)
                base[i] = seen[text]
    return base


def whole_copies(ids: np.ndarray, there: np.ndarray, raw: bytes, off: np.ndarray, marks: pa.Table) -> np.ndarray:
    """Which texts an earlier document has as a whole; ``marks`` has such documents and the digests of the texts."""
    copies: dict[int, set[bytes]] = {}
    for i, d in zip(marks.column("copy").to_pylist(), marks.column("digest").to_pylist(), strict=True):
        if i is not None:
            copies.setdefault(i, set()).add(d)
    out = np.zeros(len(ids), bool)
    for k in np.flatnonzero(np.isin(ids, np.fromiter(copies, np.int64, len(copies))) & there):
        out[k] = hashlib.sha256(raw[off[k] : off[k + 1]]).digest()[:8] in copies[int(ids[k])]
    return out


ROWS = [("bucket", pa.int32()), ("fps", pa.binary()), ("docs", pa.binary()), ("lows", pa.binary()), ("counts", pa.binary()), ("n_raw", pa.int64()), ("bytes", pa.binary())]


def _stretches(docs: pa.Table, marks: pa.Table, buckets: int, groups: int, length: int, k: int) -> pa.Table:
    """ROWS: the stretches around shared anchors by deal; texts that an earlier document has as a whole are left out.

    In the row of deal ``buckets`` + group are those that an earlier document of the same group has too, without their bytes.
    """
    fp = unpacked([x for x in marks.column("fps").to_pylist() if x is not None], U)
    doc = unpacked([x for x in marks.column("docs").to_pylist() if x is not None], np.int64)
    pairs, hot = np.sort(_pair(fp, doc)), np.sort(_pair(fp, doc)[fp & IS_HOT > 0])
    ids, there, raw, off = opened(docs)
    use = there & ~whole_copies(ids, there, raw, off, marks)
    base = bases(ids, there, raw, off)
    texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(raw)])
    if not use.all():
        ids, base, texts = ids[use], base[use], texts.filter(pa.array(use))
    out: dict[str, list] = {c: [] for c in ("fp", "doc", "low", "count", "text", "size", "name")}
    for a, _, buf, off in K.chunks(texts):
        fp, row, lo, hi = anchors(buf, off, length, k)
        mine = _pair(fp >> U(16), ids[a + row])
        keep, apart = _known(pairs, mine), _known(hot, mine)
        run = K.prefix(buf)
        one = np.flatnonzero(keep & ~apart)
        many = np.flatnonzero(keep & apart)  # windows of a hot anchor are stretches of their own, named by their bytes
        n = hi[many] - lo[many] + 1
        each = np.repeat(many, n)
        step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        r = np.concatenate([row[one], row[each]])
        low = np.concatenate([lo[one], lo[each] + step])
        count = np.concatenate([hi[one] - lo[one] + 1, np.ones(len(each), np.int64)])
        begin, size = off[r] + low, count + length - 1
        name = K.span(run, begin, begin + size)
        text, _ = _bytes_of(buf, begin, size)
        for c, v in (("fp", np.concatenate([fp[one], name[len(one) :]])), ("doc", ids[a + r]), ("low", low + base[a + r]), ("count", count), ("text", text), ("size", size), ("name", name)):
            out[c].append(v)
    rows = []
    if out["fp"]:
        fp, doc, low, count, text, size, name = (np.concatenate(out[c]) for c in out)
        begin = np.cumsum(size) - size
        keep, gone = firsts(text, begin, size, name, doc)
        where = (fp[keep] % U(buckets)).astype(np.int64)
        keep = keep[np.lexsort((fp[keep], where))]
        where = (fp[keep] % U(buckets)).astype(np.int64)
        cut = _heads(where)
        for x, y in zip(cut, _ends(cut, len(where)), strict=True):
            i = keep[x:y]
            piece, _ = _bytes_of(text, begin[i], size[i])
            rows.append((int(where[x]), packed(fp[i]), packed(doc[i]), packed(low[i]), packed(count[i].astype(np.uint8)), len(piece), pa.compress(piece.tobytes(), "zstd", asbytes=True)))
        if len(gone):
            mine = int(group_of(doc[gone[:1]], groups)[0])
            rows.append((buckets + mine, b"", packed(doc[gone]), packed(low[gone]), packed(count[gone].astype(np.uint8)), 0, b""))
    return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(ROWS)})


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b), by sorting them."""
    o = np.lexsort((b, a))
    x, y = a[o], b[o]
    new = np.concatenate([[False], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    out = np.empty(len(a), np.int64)
    out[o] = np.cumsum(new)
    return out


def _alone(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank)[rank] == 1


def doubling(text: np.ndarray, begin: np.ndarray, count: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For windows begin[i] .. begin[i] + count[i] - 1 of stretch i, whether an equal window belongs to a smaller owner.

    Prefixes of 8, 16, 32 ... bytes and last of ``length`` bytes are ranked from pairs
    of the ranks before; positions with a rank of their own take no further part.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    rank = np.zeros(n, U)
    for i in range(8):
        rank = rank << U(8) | padded[i : i + n].astype(U)
    total = int(count.sum())
    first = np.cumsum(count) - count
    window = np.repeat(begin - first, count) + np.arange(total)
    who = np.repeat(owner, count)
    live = np.arange(total)  # windows still in question
    # Ranks are kept for the places that live windows will ask for; at each size those are all places within them.
    size = min(8, length)
    while size < length and len(live):
        step = min(size, length - size)
        span = length - size - step  # places behind a window's start whose rank the coming rounds need
        offsets = np.arange(span + 1)
        places = np.unique((window[live][:, None] + offsets[None, :]).ravel()) if len(live) * (span + 1) < 4_000_000 else np.flatnonzero(_covered(window[live], span, n))
        fresh = _rank(rank[places], rank[np.minimum(places + step, n - 1)])
        rank = np.zeros(n, np.int64)
        rank[places] = fresh
        single = np.zeros(n, bool)
        single[places] = _alone(fresh)
        live = live[~single[window[live]]]  # unique already as a shorter prefix: unique at full length
        size += step
    dup = np.zeros(total, bool)
    if len(live):
        r = rank[window[live]].astype(np.int64)
        o = np.lexsort((who[live], r))
        ro = r[o]
        head = np.concatenate([[True], ro[1:] != ro[:-1]])
        smallest = who[live][o][head][np.cumsum(head) - 1]
        dup[live[o]] = who[live][o] > smallest
    return dup


def _covered(start: np.ndarray, span: int, n: int) -> np.ndarray:
    c = np.zeros(n + span + 2, np.int32)
    np.add.at(c, start, 1)
    np.add.at(c, start + span + 1, -1)
    return (np.cumsum(c) > 0)[:n]


def _find(bucket: pa.Table, buckets: int, groups: int, length: int) -> pa.Table:
    """grp, docs, starts, ends: byte ranges that a smaller document has too."""
    get = lambda c: bucket.column(c).to_pylist()
    doc, low = unpacked(get("docs"), np.int64), unpacked(get("lows"), np.int64)
    count = unpacked(get("counts"), np.uint8).astype(np.int64)
    if bucket.column("bucket")[0].as_py() >= buckets:  # known as gone already
        return _marks(doc, low, low + count + length - 1, groups)
    fp = unpacked(get("fps"), U)
    text = np.frombuffer(b"".join(pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(get("bytes"), get("n_raw"), strict=True) if n), np.uint8)
    size = count + length - 1
    begin = np.cumsum(size) - size
    # Of equal stretches those of the smallest document stand for all; anchors of one document left are settled.
    rep, gone = firsts(text, begin, size, K.span(K.prefix(text), begin, begin + size), doc)
    rep = rep[np.lexsort((doc[rep], fp[rep]))]
    cut = _heads(fp[rep])
    end = _ends(cut, len(rep))
    open_ = rep[np.repeat(doc[rep][cut] != doc[rep][end - 1], end - cut)] if len(rep) else rep
    docs, starts, ends = [doc[gone]], [low[gone]], [low[gone] + size[gone]]
    at = 0
    change = _heads(fp[open_])
    while at < len(open_):
        # Anchors are handled some 20,000 stretches at a time, whole anchors together.
        later = change[np.searchsorted(change, at + 20_000) :]
        i = open_[at : later[0] if len(later) else len(open_)]
        at += len(i)
        piece, total = _bytes_of(text, begin[i], size[i])
        dup = doubling(piece, total[:-1], count[i], doc[i], length)
        if not dup.any():
            continue
        who = np.repeat(np.arange(len(i)), count[i])
        place = np.arange(len(dup)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
        p = np.flatnonzero(dup)
        new = np.concatenate([[True], (np.diff(p) != 1) | (who[p][1:] != who[p][:-1])])
        a, b = p[new], p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
        docs.append(doc[i][who[a]])
        starts.append(low[i][who[a]] + place[a])
        ends.append(low[i][who[b]] + place[b] + length)
    return _marks(*map(np.concatenate, (docs, starts, ends)), groups)


def _marks(d: np.ndarray, s: np.ndarray, e: np.ndarray, groups: int) -> pa.Table:
    o, cut, end = _split(group_of(d, groups))
    d, s, e = d[o], s[o], e[o]
    part = lambda v: pa.array([packed(v[x:y].astype(np.int64)) for x, y in zip(cut, end, strict=True)], pa.binary())
    return pa.table({"grp": pa.array(group_of(d[cut], groups).astype(np.int32)), "docs": part(d), "starts": part(s), "ends": part(e)})


def _result(docs: pa.Table, marks: pa.Table, length: int) -> pa.Table:
    get = lambda c: [x for x in marks.column(c).to_pylist() if x is not None]
    doc, start, end = (unpacked(get(c), np.int64) for c in ("docs", "starts", "ends"))
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    rows: list[tuple] = []
    ids, there, all_bytes, off = opened(docs)
    copy, base = whole_copies(ids, there, all_bytes, off, marks), bases(ids, there, all_bytes, off)
    for at_doc, (i, known) in enumerate(zip(ids.tolist(), there.tolist(), strict=True)):
        raw = all_bytes[off[at_doc] : off[at_doc + 1]]
        n, first = len(raw), int(base[at_doc])
        if copy[at_doc] and n >= length:
            rows.append((i, n, n, 1, hashlib.sha256(b"").hexdigest(), [(0, n)]))
            continue
        a, b = (np.searchsorted(doc, i), np.searchsorted(doc, i, "right")) if known else (0, 0)
        spans: list[list[int]] = []
        for s, e in zip((start[a:b] - first).tolist(), (end[a:b] - first).tolist(), strict=True):
            if s < 0 or e > n:  # a place in another text of this doc_id
                continue
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        kept, at = hashlib.sha256(), 0
        for s, e in spans:
            kept.update(raw[at:s])
            at = e
        kept.update(raw[at:])
        rows.append((i if known else None, n, sum(e - s for s, e in spans), len(spans), kept.hexdigest(), spans))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    out = {c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(kinds.items())}
    out["spans"] = pa.array([[{"start": s, "end": e} for s, e in r[5]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table(out)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets), one row a row of ``docs``."""
    if not 8 <= k <= length <= 200:
        raise ValueError("8 <= k <= length <= 200 is needed")
    src = docs.select("doc_id", "text")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * partitions(docs.sparkSession), -(-size // DEAL_BYTES))
    known = src.where("doc_id is not null")
    # Texts equal to one of an earlier document as a whole: one digest a document, pre-aggregated.
    digest = known.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    earliest = digest.groupBy("d").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"), F.count("*").alias("n")).where("m < x").drop("x")
    copies = salted_join(digest, earliest, ["d"], "doc_id").where("doc_id > m").select("doc_id", F.substring(F.unhex("d"), 1, 8).alias("digest")).distinct()
    fps = known.mapInArrow(partial(_fingerprints, buckets=n, length=length, k=k), "bucket int, fps binary, docs binary")
    shared = fps.groupBy("bucket").applyInArrow(lambda t: _shared(t, n, hot), "grp int, fps binary, docs binary")
    dealt = src.mapInArrow(partial(_dealt, groups=n), "grp int, ids binary, there binary, lens binary, n_raw long, text binary")
    copy_rows = stored(copies.mapInArrow(partial(_dealt_ids, groups=n), "grp int, copy long, digest binary"))
    none = lambda *cs: [F.lit(None).cast("binary").alias(c) for c in cs]
    no_copy = [F.lit(None).cast("long").alias("copy"), *none("digest")]
    marks = shared.select("grp", "fps", "docs", *no_copy).unionByName(copy_rows.select("grp", *none("fps", "docs"), "copy", "digest"))
    kinds = "bucket int, fps binary, docs binary, lows binary, counts binary, n_raw long, bytes binary"
    stretches = dealt.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(lambda d, m: _stretches(d, m, n, n, length, k), kinds)
    found = stored(stretches.groupBy("bucket").applyInArrow(lambda t: _find(t, n, n, length), "grp int, docs binary, starts binary, ends binary"))
    last = found.select("grp", "docs", "starts", "ends", *no_copy).unionByName(copy_rows.select("grp", *none("docs", "starts", "ends"), "copy", "digest"))
    return dealt.groupBy("grp").cogroup(last.groupBy("grp")).applyInArrow(lambda d, m: _result(d, m, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def _dealt(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """The documents of a batch by group, ids and compressed texts packed: one row a group."""
    for batch in batches:
        there = ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = np.array(batch.column("doc_id").fill_null(0), np.int64)
        g = group_of(ids, groups)
        o, cut, end = _split(g)
        buf, off = K.text_buffer(batch.column("text").take(pa.array(o)))
        rows = []
        for x, y in zip(cut, end, strict=True):
            raw = buf[off[x] : off[y]].tobytes()
            rows.append((int(g[o[x]]), packed(ids[o[x:y]]), there[o[x:y]].tobytes(), packed(np.diff(off[x : y + 1]).astype(np.uint32)), len(raw), pa.compress(raw, "zstd", asbytes=True)))
        kinds = {"grp": pa.int32(), "ids": pa.binary(), "there": pa.binary(), "lens": pa.binary(), "n_raw": pa.int64(), "text": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds.values())], list(kinds))


def _dealt_ids(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.array(batch.column("doc_id"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(group_of(ids, groups).astype(np.int32)), batch.column("doc_id"), batch.column("digest")], ["grp", "copy", "digest"])

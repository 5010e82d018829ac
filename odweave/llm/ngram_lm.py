"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, looked up by mapped file.

Documents are encoded in blocks: a block holds the hashes of its distinct words and its tokens as places
in that list. What a level of the model needs is one exchange. A block sends its distinct n-grams (sorted
64-bit hashes, cut into slices by their leading bits) with its own counts; the task of a slice merges all
blocks' arrays into the sorted array of the corpus, maps that from a file of its own that has no name, and answers
each block's slice in place. Hashes are dealt evenly whatever words are frequent, and a block sends each n-gram once.

The answer also names one owner block for each n-gram of the corpus. The owner knows the words of its n-grams, so
it counts the n-gram once towards its suffix (continuation count) and its context (total, and types met
once, twice, more often), which are the values of the next lower level. After the lowest level every block has
all that its tokens need, and only blocks and answers meet once more. Blocks stand in a bucketed table, so they do not move.

    p(w | h) = (max(c(hw) - D(c), 0) + (D1 N1(h) + D2 N2(h) + D3 N3(h)) p(w | shorter h)) / c(h)

down to 1 / (V + 1) for every word, so unknown ones have a share. D are the usual estimates from counts of counts, and
0.5, 1, 1.5 where these do not exist. The arrays of all levels make a ``Model`` that scores other documents as well.

A text's words are followed by one end token and preceded by start marks, which are contexts only. Null and
blank texts are one end token. Every row counts, repeated rows too; a null doc_id counts as the empty string where it decides what
is held out. A text is encoded whole, a very long one as a block of its own. Without training documents all words are unknown. An
empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial, reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch
from . import kernels as K
from .common import partitions, stored

U = K.U
ORDER = 2
#: Tokens of a block, and of a slice of the hash range (times the number of slices: all tokens).
BLOCK, SLICE = 1 << 21, 1 << 21
END, START = U(0x3C79AC492BA7B653), U(0x1C69B3F74AC4AE35)
_STEP = U(0x9FB21C651E98DF25)

BLOCKS = "block long, n_tokens long, ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"
SENT = "slice int, block long, keys binary, vals array<binary>"
ANSWERS = "slice int, block long, keys binary, vals array<binary>, owned binary, stats array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Level(NamedTuple):
    """Answers of a level (rows without a block are the model's arrays) and its sums over the corpus."""

    answers: DataFrame
    ones: list[int]  # n-grams counted once, twice, three and four times, three times or more
    types: int
    total: int
    tokens: int


class Model(NamedTuple):
    """The arrays of each level, the lowest first, and how many leading bits cut them into slices."""

    levels: list[Level]
    bits: int


# Packed arrays.


def pack(a: np.ndarray) -> bytes:
    """Whole numbers by byte planes, as many as the largest needs."""
    a = np.ascontiguousarray(a).astype("<u8")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U)


def mapped(a: np.ndarray) -> np.ndarray:
    """The array from a file of this worker, which goes with its last reader."""
    if not a.size:
        return a
    with tempfile.TemporaryFile() as f:
        a.tofile(f)
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)


# Blocks.


def _encode(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    first, made = TaskContext.get().partitionId() << 32, 0
    hashes: list[np.ndarray] = []
    ids: list[pa.Array] = []
    held: list[pa.Array] = []
    sizes: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        words, at, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        # Frequent words first, so most places are small numbers; sorted among those about as frequent, so most differences are.
        order = np.argsort(-np.log2(n).astype(int), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lists = [pa.array([pa.concat_arrays(x).to_pylist()], kind) for x, kind in ((ids, pa.list_(pa.int64())), (held, pa.list_(pa.bool_())))]
        row = [pa.array([first + made], pa.int64()), pa.array([len(at)], pa.int64()), *lists, pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
               pa.array([pack_keys(words[order])], pa.binary()), pa.array([pack(place[at])], pa.binary())]
        return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        for a, b, buf, off in K.chunks(batch.column("text")):
            h, d = K.word_hashes(buf, off)
            n = np.bincount(d, minlength=b - a)
            hashes.append(np.insert(h, np.cumsum(n), END))
            sizes.append((n + 1).astype(np.int32))
            ids.append(batch.column("doc_id").slice(a, b - a))
            held.append(batch.column("held").slice(a, b - a))
            if sum(map(len, hashes)) >= size:
                yield block()
                made += 1
                for x in (hashes, ids, held, sizes):
                    x.clear()
    if hashes:
        yield block()


def encoded(docs: DataFrame, held_out: Column, size: int = BLOCK) -> DataFrame:
    """The documents in blocks, in a table whose rows are dealt by block, so that answers come to them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held")).mapInArrow(partial(_encode, size=size), BLOCKS)
    spark, name = docs.sparkSession, f"odweave_blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").bucketBy(partitions(spark), "block").option("path", scratch(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name goes, files and frame stay
    return blocks


class Grams(NamedTuple):
    """Of one level: the key of the n-gram that ends at each token, and the key of its context."""

    key: np.ndarray
    context: np.ndarray


def grams(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[Grams]:
    h = words[tokens]
    begin = np.cumsum(sizes) - sizes
    out, start = [Grams(h, np.zeros(0, U))], START
    for _ in range(order - 1):
        context = np.roll(out[-1].key, 1)
        context[begin] = start
        out.append(Grams(K.mix(context * _STEP + h), context))
        start = K.mix(np.array([start]) * _STEP + START)[0]
    return out


class Places(NamedTuple):
    """What a block asks for at a level: sorted distinct keys (its n-grams, and below the top also the context that begins a text), and by token the place of its n-gram and of its context in the level above."""

    keys: np.ndarray
    own: np.ndarray
    context: np.ndarray


def places(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[Places]:
    """The levels of a block. Tokens are looked up by the place of their word or by one sort a level, never one by one."""
    g = grams(words, tokens, sizes, order)
    begin = np.cumsum(sizes) - sizes
    out = []
    for k in range(1, order + 1):
        below = k < order and len(tokens)
        each = words if k == 1 else g[k - 1].key
        keys, at = np.unique(np.append(each, g[k].context[begin[0]]) if below else each, return_inverse=True)
        own = at[tokens] if k == 1 else at[: len(tokens)]
        context = np.zeros(0, np.int64)
        if below:
            context = np.roll(own, 1)
            context[begin] = at[-1]
        out.append(Places(keys, own, context))
    return out


def _arrays(row: dict, order: int) -> tuple[list[Places], np.ndarray, np.ndarray]:
    """The levels of a block, the sizes of its documents, and which tokens are to be learned."""
    sizes = np.array(row["sizes"], np.int64)
    p = places(unpack_keys(row["words"]), unpack(row["tokens"]).astype(np.int64), sizes, order)
    return p, sizes, np.repeat(~np.array(row["held"], bool), sizes)


def _slices(block: int, keys: np.ndarray, vals: list[np.ndarray], bits: int) -> pa.RecordBatch:
    at = (keys >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([at[a] for a, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()),
         pa.array([[pack(v[a:b]) for v in vals] for a, b in spans], pa.list_(pa.binary()))], ["slice", "block", "keys", "vals"])


def _top(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each block's n-grams of the highest order and how often its training texts have them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            levels, _, learn = _arrays(row, order)
            keys, at, _ = levels[-1]
            vals = [np.bincount(at, weights=learn, minlength=len(keys))]
            yield _slices(row["block"], keys, vals if order > 1 else [*vals, *[np.zeros(len(keys))] * 4, *vals], bits)


def _together(answers: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's answers of one level in the order of its keys."""
    rows = sorted(answers.select(["slice", "vals", "owned"]).to_pylist(), key=lambda r: r["slice"])
    vals = [np.concatenate([unpack(r["vals"][i]) for r in rows]).astype(np.int64) for i in range(len(rows[0]["vals"]))]
    return vals, np.concatenate([unpack(r["owned"]) for r in rows]).astype(bool)


def _lower(left: pa.Table, right: pa.Table, k: int, order: int, bits: int) -> pa.Table:
    """From the answers of level k + 1 what the block adds to level k: a value for each n-gram it owns."""
    if not left.num_rows:
        return pa.Table.from_batches([_slices(0, np.zeros(0, U), [], 0)]).slice(0, 0)
    row = left.to_pylist()[0]
    levels, _, learn = _arrays(row, order)
    (keys, own, before), above = levels[k - 1], levels[k]
    (count, *_), owned = _together(right)
    # One token for each n-gram of the level above; the contexts that begin a text end in no token and own nothing.
    token = np.zeros(len(above.keys), np.int64)
    token[above.own] = np.arange(len(above.own))
    count, token = count[owned], token[owned]
    n = len(keys)
    suffix, context = own[token], before[token]
    vals = [np.bincount(suffix, minlength=n), np.bincount(context, weights=count, minlength=n)]
    vals += [np.bincount(context[least], minlength=n) for least in (count == 1, count == 2, count >= 3)]
    if k == 1:
        vals.append(np.bincount(own, weights=learn, minlength=n))
    return pa.Table.from_batches([_slices(row["block"], keys, vals, bits)])


# Slices.


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice: sums over all blocks, each block's own slice of them, and the slice of the model."""
    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int64())]
    for part, group in groupby(rows, key=lambda r: r["slice"]):
        blocks, keys, vals = [], [], []
        for r in group:
            blocks.append(r["block"])
            keys.append(unpack_keys(r["keys"]))
            vals.append([unpack(v).astype(np.int64) for v in r["vals"]])
        cut = np.cumsum([0, *map(len, keys)])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        width = max(map(len, vals))
        own = [np.concatenate([v[i] if i < len(v) else np.zeros(len(k), np.int64) for v, k in zip(vals, keys, strict=True)]) for i in range(width)]
        sums = np.stack([np.bincount(at, weights=v, minlength=len(every)).astype(np.int64) for v in own])
        with_count = np.flatnonzero(own[0])[::-1]
        owner = np.full(len(every), -1)
        owner[at[with_count]] = with_count  # written from the last to the first: the first block stays
        owned = np.zeros(len(at), bool)
        owned[owner[owner >= 0]] = True
        c = sums[0]
        stats = [int((c == i).sum()) for i in (1, 2, 3, 4)] + [int((c >= 3).sum()), int((c > 0).sum()), int(c.sum()), int(sums[-1].sum())]
        table, model = mapped(every), mapped(sums)
        seen = np.flatnonzero(sums.any(0))  # what only a query has is no part of the model
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
            (part, None, pack_keys(every[seen]), [pack(s[seen]) for s in sums], None, stats), kinds, strict=True)], names)
        del every, sums, own, at, vals
        for i, b in enumerate(blocks):
            if b is not None:
                found = np.searchsorted(table, keys[i])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                    (part, b, None, [pack(s[found]) for s in model], pack(owned[cut[i] : cut[i + 1]]), None), kinds, strict=True)], names)


def answered(sent: DataFrame, bits: int, known: DataFrame | None = None) -> Level:
    """One exchange: what blocks have sent, and the arrays of a known model, summed and sent back."""
    if known is not None:
        sent = sent.unionByName(known.where("block is null").select("slice", "block", "keys", "vals"))
    dealt = sent.repartitionById(1 << bits, "slice").sortWithinPartitions("slice", F.col("block").asc_nulls_first())
    out = stored(dealt.mapInArrow(_answer, ANSWERS))
    s = out.where("block is null").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(8)]).first()
    return Level(out, [*s[:5]], s[5], s[6], s[7])


def discounts(ones: list[int]) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, 3 or more."""
    n1, n2, n3, n4 = ones[:4]
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d >= 0).all() else np.array([0, 0.5, 1, 1.5])


def _score(left: pa.Table, right: pa.Table, order: int, cut: list[np.ndarray], lowest: tuple[float, float, int, int]) -> pa.Table:
    """log10 probabilities of a block's documents; ``lowest`` is what the lowest level has for all words."""
    ids, held, sizes, n, known, base, score = [], [], np.zeros(0, np.int64), *[np.zeros(0)] * 4
    share, total, types, trained = lowest
    if left.num_rows:
        row = left.to_pylist()[0]
        levels, sizes, _ = _arrays(row, order)
        ids, held, begin = row["ids"], row["held"], np.cumsum(sizes) - sizes
        p, context = np.zeros(0), None
        for k in range(1, order + 1):
            vals, _ = _together(right.filter(pc.equal(right["level"], k)))
            _, at, here = levels[k - 1]
            count = vals[0][at]
            rest = np.maximum(count - cut[k - 1][np.minimum(count, 3)], 0)
            if k == 1:
                p = (rest / total if total else 0) + share / (types + 1)
                c = vals[-1][at]
            else:
                free = context[1] * cut[k - 1][1] + context[2] * cut[k - 1][2] + context[3] * cut[k - 1][3]
                p = np.where(context[0] > 0, (rest + free * p) / np.maximum(context[0], 1), p)
            if k < order:
                context = [v[here] for v in vals[1:5]]
        n = sizes
        known = np.add.reduceat((c > 0).astype(np.int64), begin)
        base = np.add.reduceat(np.log10((c + 0.5) / (trained + 0.5 * (types + 1))), begin)
        score = np.add.reduceat(np.log10(p), begin)
    return pa.table([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([trained] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                    [c.split()[0] for c in SCORES.split(", ")])


def language_model(docs: DataFrame, held_out: Column, order: int = ORDER, model: Model | None = None, block: int = BLOCK, slice_tokens: int = SLICE) -> tuple[DataFrame, Model]:
    """Scores of all documents, and the model learned from those that are not held out.

    With ``model`` nothing is learned: hold all documents out, and they are scored by it. Score columns: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (unigrams with half a count added), score.
    """
    blocks = encoded(docs, held_out, block)
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = model.bits if model else max(0, math.ceil(math.log2(max(partitions(docs.sparkSession), tokens / slice_tokens))))
    known = lambda k: model.levels[k - 1].answers if model else None
    levels = [answered(blocks.mapInArrow(partial(_top, order=order, bits=bits), SENT), bits, known(order))]
    for k in range(order - 1, 0, -1):
        own = levels[0].answers.where("block is not null").drop("keys", "stats")
        sent = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(partial(_lower, k=k, order=order, bits=bits), SENT)
        levels.insert(0, answered(sent, bits, known(k)))
    low = levels[0]
    cut = [discounts(x.ones) for x in levels]
    # Of the lowest level: the share left for words in general, all its counts, distinct words, and training tokens.
    left = (cut[0][1] * low.ones[0] + cut[0][2] * low.ones[1] + cut[0][3] * low.ones[4]) / low.total if low.total else 1.0
    every = reduce(DataFrame.unionByName, [x.answers.where("block is not null").select(F.lit(k + 1).alias("level"), "slice", "block", "vals", "owned") for k, x in enumerate(levels)])
    scores = blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(partial(_score, order=order, cut=cut, lowest=(left, low.total, low.types, low.tokens)), SCORES)
    return scores, Model(levels, bits)


def every_fifth(doc_id: str = "doc_id") -> Column:
    """Whether the checksum of the doc_id leaves 1 modulo 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1

"""MinHash near-dedup with SuperMinHash signatures.

Every shingle of a document walks a random permutation of the registers; at step j
it offers j + r_j to the register it then stands on, and a register keeps its
minimum. The ranks of one shingle are so correlated over the registers (each step
has its own interval), which gives less variance than independent hashes, and a
document stops after step j once all its registers are below j + 1. Signatures are
cut into bands; documents that share a band are candidates; links are confirmed on
the full shingle sets; union-find groups them.

Documents with one and the same set are one node from the start, so exact copies,
however many, cost one row each. In a band the candidates are compared with one
document, the most central one. Of the components that this leaves apart, pairs with a
shingle that few documents have are found by it; documents whose other shingles are too
few for any link drop out (exact bounds), and what remains is compared across
components only. Members of one leader are dealt to
several tasks by a salt, each with the leader once; a task holds one leader's set.

Null and blank texts have no shingles and link with nothing; ties in the choice of
a leader go to the smaller key; a repeated row joins its twin's component. Rows of one
doc_id with different texts are linked each by its own text. Rows without a doc_id are
linked too; a component is named after its smallest doc_id (null if it has none) and
they are never its kept one. A very long text takes its arrays' memory in one task. An empty table gives no rows. Other columns of the input
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import noded, partitions, passing, salted_join, stored
from .graph import components

U, MASK = K.U, (1 << 64) - 1
SHINGLE = 5
REGISTERS, ROWS = 96, 4
#: Members of a leader that go to one task.
SALT_MEMBERS = 256
#: Documents that may share a rare shingle; rounds in which the documents left apart are narrowed down.
RARE, ROUNDS = 4, 3
#: Share of the rows beyond which a round has left so many that another is not worth its shuffles.
WORTH = 0.75


def signatures(x: np.ndarray, off: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of each row's distinct values; rows without values keep infinity."""
    n = len(off) - 1
    sig = np.full(n * m, np.inf)
    doc = np.repeat(np.arange(n), np.diff(off))
    perm: np.ndarray | None = None
    for j in range(m):
        r = K.mix(x + U((2 * j + 1) * 0xA0761D6478BD642F & MASK))
        k = j + (K.mix(x ^ U((2 * j + 2) * 0xE7037ED1A0B428DB & MASK)) % U(m - j)).astype(np.int64)
        value = j + (r >> U(11)).astype(np.float64) / float(1 << 53)
        if j == 0:
            np.minimum.at(sig, doc * m + k, value)
        else:
            rows = np.arange(len(x))
            at = perm[rows, k].copy()
            perm[rows, k] = perm[:, j]
            perm[:, j] = at
            np.minimum.at(sig, doc * m + at, value)
        open_ = (sig.reshape(n, m) >= j + 1).any(1)
        stay = open_[doc]
        if not stay.any():
            break
        if j == 0:
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
            rows, first = np.arange(len(perm)), k[stay]
            perm[:, 0] = first
            perm[rows, first] = 0
        elif not stay.all():
            perm = perm[stay]
        x, doc = x[stay], doc[stay]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(U).reshape(len(sig), -1, rows)
    key = np.tile(np.arange(1, bits.shape[1] + 1, dtype=U), (len(sig), 1)) * U(K.BASE)
    for i in range(rows):
        key = K.mix(key + bits[:, :, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int, m: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in K.chunks(batch.column("text")):
            h, d = K.word_hashes(buf, off)
            x, at = K.row_sets(*K.shingles(h, d, b - a, k), b - a)
            keys = band_keys(signatures(x, at, m), rows)
            digest = [hashlib.blake2b(x[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(at[:-1], at[1:], strict=True)]
            width = keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * (b - a) + 1, width), pa.int32()), pa.array(keys.ravel()))
            ids = [batch.column(c).slice(a, b - a) for c in ("node", "doc_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(at)), pa.array(digest, pa.binary()), lists], ["node", "doc_id", "n_shingles", "digest", "keys"])


def by_leader(pairs: DataFrame, texts: DataFrame, *carry: str) -> DataFrame:
    """Rows (a, salt, b, text, carry): each leader a (b null) before its members b, whole (a, salt) groups to a partition.

    ``pairs`` has a and b; ``texts`` has doc_id and text. A leader with many members is
    repeated once for every SALT_MEMBERS of them and so spread over tasks.
    """
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = salted_join(pairs, many, ["a"], "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SALT_MEMBERS)).cast("int"))
    salted = stored(salted.select("a", "salt", "b", *carry))
    lead = salted.select("a", "salt").distinct().select("a", "salt", F.lit(None).cast("long").alias("b"), *[F.lit(None).cast(salted.schema[c].dataType).alias(c) for c in carry], F.col("a").alias("doc_id"))
    needed = salted.select("a", "salt", "b", *carry, F.col("b").alias("doc_id")).unionByName(lead)
    rows = needed.join(texts.select("doc_id", "text"), "doc_id").select("a", "salt", "b", "text", *carry)
    return rows.repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    leader: np.ndarray = np.zeros(0, U)
    for batch in batches:
        a_ids, b_ids = batch.column("a"), batch.column("b").to_pylist()
        hit: list[int] = []
        for lo, hi, buf, off in K.chunks(batch.column("text")):
            h, d = K.word_hashes(buf, off)
            x, at = K.row_sets(*K.shingles(h, d, hi - lo, k), hi - lo)
            for i in range(hi - lo):
                mine = x[at[i] : at[i + 1]]
                if b_ids[lo + i] is None:
                    leader = mine
                    continue
                n, m = len(mine), len(leader)
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                pos = np.searchsorted(leader, mine)
                pos[pos == m] = 0
                both = int((leader[pos] == mine).sum()) if m else 0
                if both and 100 * both >= percent * (n + m - both):
                    hit.append(lo + i)
        take = pa.array(hit, pa.int64())
        yield pa.RecordBatch.from_arrays([a_ids.take(take), batch.column("b").take(take)], ["a", "b"])


@passing
def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    return by_leader(pairs, texts).mapInArrow(partial(_confirm, k=k, percent=percent), "a long, b long")


def _shingle_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, off in K.chunks(batch.column("text")):
            h, d = K.word_hashes(buf, off)
            x, at = K.row_sets(*K.shingles(h, d, b - a, k), b - a)
            ids = batch.column("doc_id").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), np.diff(at))))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), ids], ["h", "rep"])


@passing
def narrowed(placed: DataFrame, texts: DataFrame, k: int, percent: int, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b that share a rare shingle and can have a link; rows key, rep, n, c, m that can have one without it).

    A shingle is rare if at most ``rare`` of these documents have it, so the pairs it
    gives grow with the documents and not with a family's square. Shingles of the same
    few documents are counted together. Two documents without a common rare shingle
    share at most the smaller m, the number of their other shingles; copies with edits
    of their own miss the similarity by that bound and leave uncompared.
    """
    reps = placed.select("rep", "n", "c").distinct()
    rows = stored(texts.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(partial(_shingle_rows, k=k), "h long, rep long"))
    few = stored(rows.groupBy("h").agg(F.count("*").alias("f"), F.min("rep").alias("one")).where(f"f <= {rare}"))
    scarce = stored(rows.join(few.where("f > 1").select("h"), "h"))
    own = few.where("f = 1").select(F.col("one").alias("rep")).unionByName(scarce.select("rep")).groupBy("rep").agg(F.count("*").alias("s"))
    sized = stored(reps.join(own, "rep", "left").withColumn("m", F.col("n") - F.coalesce("s", F.lit(0))).drop("s"))
    holders = scarce.groupBy("h").agg(F.sort_array(F.collect_list("rep")).alias("reps")).groupBy("reps").agg(F.count("*").alias("s"))
    two = holders.select("s", F.explode(F.expr("flatten(transform(reps, (x, i) -> transform(slice(reps, i + 2, size(reps)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b", "s")
    side = lambda x: sized.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("m").alias(f"m{x}"))
    pairs = two.groupBy("a", "b").agg(F.sum("s").alias("s")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.withColumn("both", F.least(F.col("s") + F.least("ma", "mb"), "na", "nb")).where(f"ca <> cb and 100 * both >= {percent} * (na + nb - both)")
    least = placed.groupBy("key").agg(F.min("n").alias("low"), F.count("*").alias("size"))
    bounded = salted_join(placed.join(sized.select("rep", "m"), "rep"), least, ["key"], "rep", "size")
    # The best partner of a document has no more shingles than it has to, and not fewer than the smallest of the band.
    return pairs.select("a", "b"), bounded.where(f"100 * m >= {percent} * (n + greatest(low, m) - m)").select("key", "rep", "n", "c", "m")


@passing
def grouped(docs: DataFrame, percent: int = 85, k: int = SHINGLE, m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """node, doc_id, n_shingles, component: one row a row of ``docs`` (node, doc_id, text), with a key of the row's group, null without words."""
    src = docs.select("node", "doc_id", "text")
    signed = stored(src.mapInArrow(partial(_sign, k=k, m=m, rows=rows), "node long, doc_id long, n_shingles long, digest binary, keys array<long>"))
    nodes = stored(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("node").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    bands = nodes.select("rep", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = stored(salted_join(bands, shared, ["key"], "rep", "size"))
    central = bands.groupBy("rep").agg(F.sum("size").alias("weight"))
    leader = bands.join(central, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), F.col("n").alias("ln"))).alias("x"), F.max("size").alias("size")).select("key", "size", (-F.col("x.minus")).alias("a"), "x.ln")
    near = f"100 * least(n, ln) >= {percent} * greatest(n, ln)"
    texts = src.select(F.col("node").alias("doc_id"), "text")
    texts = stored(texts.join(bands.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    first = stored(salted_join(bands.drop("size"), leader, ["key"], "rep", "size").where(f"a <> rep and {near}").select("a", F.col("rep").alias("b")).distinct())
    links = confirmed(first, texts, k, percent)
    label = components(links)
    # What the leaders left apart: members of one band in different components, whose pair is still unseen.
    placed = bands.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    several = lambda rows: rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    open_ = lambda rows: stored(salted_join(rows, several(rows), ["key"], "rep", "size").drop("size"))
    scarce: list[DataFrame] = []
    placed = open_(placed)
    left = placed.count()
    for _ in range(ROUNDS):  # who has left makes nobody's shingle common any more, so the bound tightens
        pairs, placed = narrowed(placed.select("key", "rep", "n", "c"), texts, k, percent)
        scarce.append(pairs)
        placed = open_(placed)
        before, left = left, placed.count()
        if left > WORTH * before or not left:  # a round more would narrow little; what is left is compared either way
            break
    other = placed.select("key", F.col("rep").alias("rep2"), F.col("n").alias("ln"), F.col("c").alias("c2"), F.col("m").alias("m2"))
    fits = f"100 * least(m, m2) >= {percent} * (n + ln - least(m, m2))"
    rest = placed.join(other, "key").where(f"c < c2 and {near} and {fits}").select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    rest = reduce(DataFrame.unionByName, scarce, rest).distinct()
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(seen, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = confirmed(rest, texts, k, percent)
        if not more.isEmpty():
            label = components(links.unionByName(more))
    placed = nodes.join(label, nodes["rep"] == label["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"))
    size = signed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    meant = salted_join(signed.where("digest is not null").select("node", "doc_id", "n_shingles", "digest"), size.join(placed, "digest"), ["digest"], "node")
    bare = signed.where("digest is null").select("node", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    return meant.select("node", "doc_id", "n_shingles", "component").unionByName(bare)


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = SHINGLE, m: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``; see the module.

    ``percent`` is the least 100 * intersection / union of a link. With 24 bands of 4
    registers a pair at 0.85 shares no band with probability 2e-8, at 0.8 with 4e-6.
    """
    found = grouped(noded(docs.select("doc_id", "text")), percent, k, m, rows)
    first = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    meant = salted_join(found.where("component is not null"), first, ["component"], "node").withColumn("component_id", F.coalesce("least", "doc_id"))
    both = meant.select("doc_id", "n_shingles", "component_id").unionByName(found.where("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

"""Mixing sources to target weights, in DataFrame functions alone.

A multivariate hypergeometric splitting tree: every source is cut into blocks
of words, the blocks lie in shards by hash, and the number of words a source
has still to give is split over the shards level by level, each time by a
hypergeometric draw of the left half's share. Within a shard the blocks stand
in the order of a hash and are taken from the front until the shard's quota is
met, the last block in part. So the quotas add up exactly, no block is drawn
twice, no step sorts a whole source, and a source that holds most of the corpus
lies in as many tasks as there are shards.

A source whose target exceeds its size is first taken whole as often as it fits;
the draw settles the rest. Texts are counted whole, however long, block by block. Null sources are a source of their own, last in
order. Null or blank texts have size 0 and take 0. A corpus without words takes
nothing. Repeated rows, and rows without a doc_id, are separate documents. All draws are hashes of the seed
and the place, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2
#: Words in a block, and blocks that a shard of an even corpus has.
BLOCK_WORDS, SHARD_BLOCKS = 32, 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> target: the weighted share of each, at most cap times its size, the excess reshared by weight.

    The fixed point of resharing is min(cap * size, weight * level); the level
    follows from running sums over the sources in the order in which they fill up.
    The frame has one row a source, counted before, not one a document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("_fill", F.col("source").isNull(), "source")
    before, all_ = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    limit = F.col("source_size") * float(cap)
    level = (F.sum("source_size").over(all_) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("_w", w)
        .withColumn("_fill", limit / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("_open", F.min(F.when(F.col("_fill") >= F.col("_level"), F.struct("_fill", F.col("source").isNull(), "source", "_level"))).over(all_)["_level"])  # the first source that does not fill up sets the level
        .withColumn("target", F.least(limit, F.col("_w") * F.coalesce(F.col("_open"), F.lit(math.inf))))
        .select("source", "source_size", "target")
    )


#: Values of a distribution that are summed one by one; a wider one is drawn by rejection, of so many tries in a row each fails with 0.3 or so.
WALK, TRIES = 512, 128
# 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), the table mountain hat of the ratio of uniforms.
HAT = (1.7155277699214135, 0.8989161620588988)


def _growth(x: str, k: str) -> str:
    """SQL: ln((x + k)! / x!) - k ln(x + 1) + k. Nothing large cancels: factorials of large numbers enter by log1p(k / (x + 1)) alone."""
    exact = lambda v: f"if({v} <= 20, ln(factorial(cast(least({v}, 20) as int))), ({v} + 0.5D) * ln({v} + 1.0D) - {v} - 1 + 0.9189385332046727D + {tail(v)})"
    tail = lambda v: f"(1 / (12 * ({v} + 1.0D)) - 1 / (360 * pow({v} + 1.0D, 3)))"
    y = f"({x} + {k})"
    return f"if(least({x}, {y}) < 13, {exact(y)} - {exact(x)} - {k} * ln({x} + 1.0D) + {k}, ({y} + 0.5D) * log1p({k} / ({x} + 1.0D)) + {tail(y)} - {tail(x)})"


def log_ratio(k: str) -> str:
    """SQL: log of the probability of _m + k over that of the mode _m, from the columns lw, rw, quota and _m."""
    step = "ln((_m + 1.0D) / (lw - _m + 1.0D) * ((rw - quota + _m + 1.0D) / (quota - _m + 1.0D)))"
    terms = f"array(struct(_m as x, {k} as k), struct(lw - _m as x, -{k} as k), struct(quota - _m as x, -{k} as k), struct(rw - quota + _m as x, {k} as k))"
    return f"aggregate({terms}, -{k} * {step}, (s, g) -> s - {_growth('g.x', 'g.k')})"


def hypergeometric(df: DataFrame) -> DataFrame:
    """Adds take: how many of ``quota`` items taken from lw + rw ones come from the lw, a draw fixed by the number ``key``.

    Probabilities are relative to the mode. A distribution that is at most WALK wide (nine
    deviations each way) is inverted at a uniform number, a wider one drawn by the ratio of
    uniforms; both give the distribution itself, whatever its size.
    """
    u = lambda i, j: f"((shiftrightunsigned(xxhash64(key, {i}, {j}), 12) + 0.5D) / 4503599627370496.0D)"
    mean = "(cast(quota as double) * lw / (lw + rw))"
    var = f"({mean} * rw / (lw + rw) * (lw + rw - quota) / greatest(lw + rw - 1, 1))"
    ready = (
        df.withColumn("_lo", F.expr("greatest(0L, quota - rw)")).withColumn("_hi", F.expr("least(lw, quota)"))
        .withColumn("_mean", F.expr(f"if(lw + rw > 0, {mean}, 0.0D)")).withColumn("_var", F.expr(f"if(lw + rw > 0, {var}, 0.0D)"))
        .withColumn("_m", F.expr("greatest(_lo, least(_hi, cast(floor((quota + 1.0D) * (lw + 1.0D) / (lw + rw + 2.0D)) as bigint)))"))
        .withColumn("_a", F.expr("greatest(_lo, cast(floor(_mean - 9 * sqrt(_var) - 2) as bigint))")).withColumn("_b", F.expr("least(_hi, cast(ceil(_mean + 9 * sqrt(_var) + 2) as bigint))"))
    )
    # Values in question, each with its log ratio: all of a narrow distribution, or those that the tries of a wide one hit upon.
    all_ = f"transform(sequence(_a, greatest(_a, least(_b, _a + {WALK}))), j -> struct(0.0D as x, j as j))"
    tries = f"transform(sequence(0, {TRIES - 1}), i -> struct({u('i', 1)} as x, {u('i', 2)} as y))"
    hit = f"transform({tries}, t -> struct(2 * ln(t.x) as x, cast(floor(_mean + 0.5D + ({HAT[0]}D * sqrt(_var + 0.5D) + {HAT[1]}D) * (t.y - 0.5D) / t.x) as bigint) as j))"
    values = f"transform(filter(if(_b - _a <= {WALK}, {all_}, {hit}), t -> t.j between _lo and _hi), t -> struct(t.j as j, t.x as x, {log_ratio('(t.j - _m)')} as p))"
    walk = f"aggregate(_values, struct(0.0D as c, _lo as v, aggregate(_values, 0.0D, (s, e) -> s + exp(e.p)) * {u(-1, 0)} as upto), (acc, e) -> if(acc.c >= acc.upto, acc, struct(acc.c + exp(e.p) as c, e.j as v, acc.upto as upto)), acc -> acc.v)"
    reject = "coalesce(get(filter(_values, t -> t.x <= t.p), 0).j, _m)"
    take = f"case when _lo >= _hi then _lo when _b - _a <= {WALK} then {walk} else {reject} end"
    ready = ready.withColumn("_values", F.explode(F.array(F.expr(values))))  # the explode of one array keeps it a column of its own
    return ready.withColumn("take", F.expr(take)).drop("_lo", "_hi", "_mean", "_var", "_m", "_a", "_b", "_values")


def quotas(shards: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, shard, words) of all shards and (source, draw) -> (source, shard, quota).

    ``shards`` has source, draw (words to take of the source) and words of each of
    the 2 ** depth shards, empty ones left out.
    """
    level = shards.select("source", F.lit(0).cast("long").alias("node"), F.col("draw").alias("quota")).distinct()
    for d in range(1, depth + 1):
        child = F.shiftright("shard", depth - d)
        held = shards.groupBy("source", child.alias("child")).agg(F.sum("words").alias("held")).select("source", F.shiftright("child", 1).alias("node"), (F.col("child") % 2).alias("side"), "held")
        held = held.groupBy("source", "node").agg(F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("held"))), F.lit(0)).cast("long").alias("lw"), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("held"))), F.lit(0)).cast("long").alias("rw"))
        level = (
            level.alias("v").join(held.alias("h"), F.col("v.source").eqNullSafe(F.col("h.source")) & (F.col("v.node") == F.col("h.node")))
            .select("v.source", "v.node", "quota", "lw", "rw")
            .withColumn("key", F.xxhash64(F.lit(seed), F.lit(d), F.coalesce("source", F.lit("\0")), F.col("node")))
        )
        level = (
            hypergeometric(level)
            .select("source", F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("take").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("quota") - F.col("take")).alias("quota")))).alias("x"))
            .select("source", "x.node", "x.quota").where("quota > 0")
        )
        if d % 2 == 0:
            level = stored(level)  # plans do not grow with the depth
    return level.select("source", F.col("node").alias("shard"), "quota")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: one row a row of ``docs``: doc_id, source, size, source_size, target, taken.
    blocks: what the draw gives beside whole copies: doc_id, shard, place (order
    within the shard), first_word, n_words; disjoint blocks, shuffled within each shard.
    """
    # The size is all that is needed of a text: one narrow scan, then rows of a few bytes.
    # Repeated rows are told apart by their rank among equals.
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    sized = stored(sized.groupBy("doc_id", "source", "size", "_h").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_twin"), "_h"))
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = stored(
        targets(per, weights, share, cap)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("draw", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    )
    total = plan.agg(F.sum(F.col("source_size"))).first()[0] or 0
    depth = max(3, math.ceil(math.log2(max(1, total / block_words / SHARD_BLOCKS))))
    blocks = (
        sized.where("size > 0")
        .select("doc_id", "source", "size", "_h", "_twin", F.explode(F.expr(f"sequence(0L, (size - 1) div {block_words})")).alias("block"))
        .select(
            "doc_id", "source", "_h", "_twin", (F.col("block") * block_words).alias("first_word"),
            F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).cast("int").alias("n"),
            F.xxhash64(F.lit(seed), "doc_id", "_h", "_twin", "block").alias("_key"),
        )
        .withColumn("shard", F.shiftrightunsigned("_key", 64 - depth))
    )
    shards = stored(blocks.groupBy("source", "shard").agg(F.sum("n").alias("words")))
    same = lambda a, b: a.eqNullSafe(b)
    drawn_from = shards.alias("s").join(plan.alias("p"), same(F.col("s.source"), F.col("p.source"))).where("draw > 0").select("s.source", "shard", "words", "draw")
    quota = stored(quotas(drawn_from, depth, seed))
    place = Window.partitionBy("source", "shard").orderBy("_key", "doc_id", "_h", "_twin", "first_word")
    taken = (
        blocks.alias("b").join(quota.alias("q"), same(F.col("b.source"), F.col("q.source")) & (F.col("b.shard") == F.col("q.shard")))
        .select("doc_id", "b.source", "_h", "_twin", "first_word", "n", "_key", "b.shard", "quota")
        .withColumn("_left", F.col("quota") - F.coalesce(F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where("_left > 0")
        .withColumn("n_words", F.least("n", "_left").cast("long"))
    )
    drawn = taken.groupBy(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("_h").alias("h"), F.col("_twin").alias("t")).agg(F.sum("n_words").alias("drawn"))
    out = (
        sized.alias("z").join(plan.alias("p"), same(F.col("z.source"), F.col("p.source")))
        .select("z.doc_id", "z.source", "size", "_h", "_twin", "source_size", "target", "copies")
        .join(drawn, same(F.col("doc_id"), F.col("d")) & same(F.col("source"), F.col("s")) & (F.col("_h") == F.col("h")) & (F.col("_twin") == F.col("t")), "left")
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.coalesce("drawn", F.lit(0))).cast("long").alias("taken"), "_h", "_twin")
    )
    shuffled = taken.select("doc_id", "source", "shard", F.row_number().over(place).alias("place"), "first_word", "n_words")
    return out, shuffled

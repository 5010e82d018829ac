"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame functions alone.

Every document gets counts for plain rules and one score: the mean, over its
hashed words and word pairs, of log P(bucket | trusted target) - log P(bucket |
raw corpus). Both multinomials are counted over all rows. A document is kept if
it passes the plain rules and its score reaches a fixed threshold; nothing is
drawn at random, so a rerun gives the same rows.

Nulls and empty texts have no words: all counts are 0 and the base rule fails.
Texts are read whole, a very long one in one task. Repeated rows are scored one by one; a row without a doc_id is trusted by none. Columns of the input beside the named ones
are not looked at. An empty corpus gives an empty result; without trusted
documents every ratio is 0, so the plain rules decide alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doubles_literal, words_column

#: Buckets of the hashed n-grams; the only thing that reaches the driver is one row a bucket.
BUCKETS = 8192
#: Mean log ratio a document has to reach, in nats an n-gram.
THRESHOLD = -0.06
#: Words a document needs, and the largest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def with_words(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, a document's words and their hashes.

    Each explode of a one-element array keeps its input a column: the optimizer would
    otherwise copy the split into every use, inside the lambdas once a word.
    """
    return docs.select(*columns, F.explode(F.array(F.expr(words_column()))).alias("words")).select(
        *columns, "words", F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("hashes")
    )


def hashed(buckets: int = BUCKETS) -> str:
    """SQL: buckets of a document's words, then of its word pairs; ``buckets`` is a power of two."""
    one = f"transform(hashes, h -> cast(h & {buckets - 1} as int))"
    two = f"transform(sequence(1, size(hashes) - 1), i -> cast(xxhash64(hashes[i - 1], hashes[i]) & {buckets - 1} as int))"
    return f"if(size(hashes) < 2, {one}, concat({one}, {two}))"


#: Ids of trusted documents up to which they are broadcast (some 100 MB at most as a hash table); more of them meet the texts in a join of Spark's choice.
BROADCAST_IDS = 1_000_000


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, broadcast_ids: int = BROADCAST_IDS) -> list[float]:
    """Log ratio by bucket, from counts over every document.

    ``trusted`` has the doc_id of documents known to be good; all of them are the
    target. Their ids are counted first: up to ``broadcast_ids`` they go to every task and no
    text moves; beyond that Spark chooses the join, and in a shuffled one rows without a doc_id, which meet nothing, are dealt out by their text.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_has"), F.lit(1).alias("_good")).distinct()
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    keyed = docs.select("text", F.coalesce("doc_id", F.xxhash64("text")).alias("_key"), F.col("doc_id").isNotNull().alias("_any"))
    marked = (
        with_words(keyed.join(ids, (F.col("_key") == F.col("_id")) & (F.col("_any") == F.col("_has")), "left"), "_good")
        .select("_good", F.explode(F.expr(hashed(buckets))).alias("bucket"))
    )
    rows = marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_good").alias("good")).collect()  # one row a bucket
    raw, good = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    n_raw, n_good = sum(raw), sum(good)
    if not n_good:
        return [0.0] * buckets
    # One pseudo-count, spread as the raw corpus is, keeps unseen buckets finite and strongly negative.
    prior = [(r + 0.5) / (n_raw + 0.5 * buckets) for r in raw]
    return [math.log((g + 20 * p) / (n_good + 20)) - math.log(p) for g, p in zip(good, prior, strict=True)]


def repeated_words() -> Column:
    """Words that lie in a window of three which its text has twice or more."""
    # Distinct windows are counted by hash set; only a text that repeats one sorts its windows.
    # Sorted by hash, then place, a window is repeated if a neighbour has the same hash; its three
    # places overlap the next repeated window by what is missing to three.
    return F.expr("""
      case when size(hashes) < 4 then 0L else
      aggregate(array(transform(sequence(0, size(hashes) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]))), 0L,
        (acc, h) -> if(size(array_distinct(h)) = size(h), 0L,
          aggregate(array(sort_array(transform(h, (x, i) -> struct(x as h, i as p)))), 0L, (a0, s) ->
            aggregate(
              sort_array(transform(filter(s, (x, i) -> x.h = get(s, i - 1).h or x.h = get(s, i + 1).h), x -> x.p)),
              struct(0L as n, -3 as last),
              (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last),
              a -> a.n)))) end""")


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, llr and kept, one row a row of ``docs``; ``carry`` names columns to keep beside them."""
    carry = [c for c in carry or [] if c not in ("doc_id", "text")]
    table = doubles_literal(log_ratios(docs, trusted, buckets))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = "filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return (
        with_words(docs.select("doc_id", "text", F.struct(*carry).alias("_carry")) if carry else docs, "doc_id", "text", *(["_carry"] if carry else []))
        .select(
            "doc_id",
            *(["text", "_carry"] if carry else []),
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            F.expr(f"cast(aggregate(array({lines}), 0, (a, x) -> size(x) - size(array_distinct(x))) as long)").alias("n_dup_lines"),
            repeated_words().cast("long").alias("n_repeat_words"),
            F.expr(f"""if(size(words) = 0, 0.0D, aggregate({hashed(buckets)}, 0.0D, (a, b) -> a + get({table}, b))
                       / (2 * size(words) - 1))""").alias("llr"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
        .select("*", *([F.col("_carry")[c].alias(c) for c in carry]))
        .drop("_carry")
    )

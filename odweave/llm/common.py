"""What the operators of this folder share: tables, keys of rows, joins that a hot key does not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import passing
from ..sources.storage import store as stored

#: White space that ends a word: blank and 0x09 to 0x0D. Everything else, no-break spaces included, is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noded(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with a key ``node`` (long) of each doc_id and text.

    The key is the doc_id wherever one text alone has it; rows without a doc_id, and rows of
    a doc_id with several texts, get a hash of both. Equal rows have one key.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("doc_id is null or lo < hi")
    odd = stored(several.select(F.col("doc_id").alias("_odd"), F.lit(True).alias("_is_odd")))
    if odd.isEmpty():
        return docs.withColumn("node", F.col("doc_id"))
    # Rows without a doc_id meet nothing in the join; dealt out by their hash they do not fill one task.
    j = docs.withColumn("_key", F.coalesce("doc_id", F.xxhash64(h, F.lit(1)))).join(odd, F.col("_key") == F.col("_odd"), "left")
    strange = F.col("doc_id").isNull() | F.coalesce("_is_odd", F.lit(False))
    return j.withColumn("node", F.when(strange, F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), h)).otherwise(F.col("doc_id"))).drop("_key", "_odd", "_is_odd")


#: A key that more than 1 / HOT_SHARE of the rows have is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, n: str = "n") -> DataFrame:
    """big.join(small, keys) where a few keys may hold most rows of ``big``.

    ``small`` has one row a key and tells in ``n`` how many rows of ``big`` have it. The rows
    of a hot key are dealt out by a hash of ``by``, its row of ``small`` is there once for
    each part. What is broadcast are the hot keys and their numbers of parts, HOT_SHARE at most.
    """
    small = stored(small)
    total = small.agg(F.sum(n)).first()[0] or 0
    part = max(64, total // HOT_SHARE)
    hot = F.broadcast(small.where(F.col(n) > part).select(*keys, F.ceil(F.col(n) / part).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = small.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_column(text: str = "text") -> str:
    """SQL for the words of a text, null and blank texts giving an empty array."""
    # Spark's SQL reads \f as the letter f.
    trimmed = f"btrim(coalesce({text}, ''), '\\u0020\\t\\n\\u000b\\u000c\\r')"
    return f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+'))"


def word_count(text: str = "text"):
    """Number of words of a text column; null counts 0."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def doubles_literal(values) -> str:
    """SQL for a fixed array of numbers; the optimizer folds it to one literal."""
    return "from_json('[" + ",".join(f"{float(v):.9g}" for v in values) + "]', 'array<double>')"

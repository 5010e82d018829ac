"""The corpus pipeline: five stages over documents, each one of the operators of ``odweave.llm``.

Every stage reads what the one before has kept, and its decisions hold: documents
that fail the quality rules go; lines that an earlier document has too go, and with
them documents without a word left; one document of each group of near copies stays;
documents that hold a benchmark item go; of the rest the mix takes so many words
of each text. A row that the mix takes nothing of is left out of the result. The
input has the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odweave.llm import decontam, line_join, mixing, quality_llr, superminhash
from odweave.llm.common import noded, passing, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    # The row travels as one struct, so no column of it can clash with what is counted.
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return quality_llr.quality(whole, good, carry=["_row"]).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_join.without_lines(docs).select("row.*")
    return left.where(r"text rlike '[^\\x20\\x09-\\x0D]'").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = noded(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    groups = superminhash.grouped(whole, percent=80)
    # Of a group the row with the smallest doc_id stays, rows without one come last; of equal rows, which share a node, one.
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    stays = groups.where("component is not null").groupBy("component").agg(F.min(rank).alias("x")).select("x.node")
    gone = stored(groups.where("component is not null").select("node").join(stays, "node", "left_anti").distinct())
    many = stored(groups.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").join(gone, "node", "left_anti").select("node"))
    left = whole.select("node", "row").join(gone.unionByName(many), "node", "left_anti").select("row.*")
    if many.isEmpty():
        return left
    one = whole.join(many, "node", "left_semi").groupBy("node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return left.unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(docs)
    # A row meets its own draw: equal rows by their number, as mix() tells them apart.
    key = ["doc_id", "source", "_h"]
    own = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull()).alias("_k")]
    narrow = docs.select("doc_id", "lang", "source", "n_chars", *own)
    narrow = narrow.withColumn("_twin", F.row_number().over(Window.partitionBy(*key).orderBy("lang", "n_chars")))
    taken = rows.where("taken > 0").select(*[F.col(c).alias(f"_k{c}") for c in [*key, "_twin"]], "size", "source_size", "target", "taken")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in [*key, "_twin"]])
    # Texts move once: both hashes are the key of their grouping (equal rows have one text) and of the join.
    texts = docs.select(*own, "text").where("text is not null").groupBy("_h", "_k").agg(F.first("text").alias("text"))
    mixed = narrow.join(taken, same).select("_h", "_k", "doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "taken")
    return mixed.join(texts, ["_h", "_k"]).select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
#: Hash-based draws and edit distances over lines cannot be written in SQL of another engine.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each one's rows stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = (passing(stage) if i < len(STAGES) - 1 else stage)(spark, docs, sf_dir)
    return docs

"""What each filter removes in every order of the filters, by walking the trie of orders depth first.

The state after a prefix of an order depends on which filters have run, not on their
sequence. Each unordered state is therefore visited once: its survivors are persisted, one
aggregation of them counts what every filter still to come removes (an edge), and its
children are filtered out of it, one below the other, so no more survivor frames are
held at once than there are filters. All orders are then read off these edges.

Counts are by part. ``losses`` are conditions whose removals are counted beside all. A
condition that is null counts as not met. Nothing but the number of filters bounds the
work on the driver: 2 ** n states, n below ten or so.

Rows are counted one by one, repeated rows too; a null part is the empty string; an empty table
gives no rows. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch
from .common import salted_join, stored, words_column


def edges(rows: DataFrame, filters: str, losses: list[str]) -> DataFrame:
    """part, state, filter, survivors, removed and one count a loss, for every state and filter to come.

    ``rows`` has part, one boolean ``fails_<letter>`` a filter and one boolean a loss; a state is its letters in order.
    """
    path = scratch(rows.sparkSession, "edges")
    seen: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        seen.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [f for f in filters if f not in state]
        # One shape for all states: Spark compiles it once.
        found = survivors.groupBy("part").agg(F.count("*").alias("survivors"), *[F.struct(
            F.lit(f).alias("filter"), F.count_if(f"fails_{f}").alias("removed"), *[F.count_if(F.col(f"fails_{f}") & F.col(x)).alias(x) for x in losses]).alias(f) for f in filters])
        each = found.select("part", F.lit(state).alias("state"), "survivors", F.explode(F.array(*filters)).alias("e")).select("part", "state", "survivors", "e.*")
        each.where(F.col("filter").isin(left)).write.mode("append").parquet(path)
        for f in left:
            child = "".join(sorted(state + f))
            if child not in seen and len(child) < len(filters):
                visit(child, survivors.where(~F.col(f"fails_{f}")))
        survivors.unpersist()

    visit("", rows)
    return rows.sparkSession.read.parquet(path)


def audit(docs: DataFrame, part: Column, filters: dict[str, Column], losses: dict[str, Column]) -> DataFrame:
    """One row a part, order of the filters and step.

    ``filters`` maps one-letter names to the condition under which a row fails. Columns: part,
    filter_order, step, kept, removed, redundant (fails, removed earlier), unique_fails (fails
    this filter only), one column a loss, shapley (removals of the step's filter over all orders).
    """
    letters, names = "".join(sorted(filters)), list(losses)
    rows = stored(docs.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        *[F.coalesce(c, F.lit(False)).alias(f"fails_{f}") for f, c in filters.items()],
        *[F.coalesce(c, F.lit(False)).alias(x) for x, c in losses.items()],
    ))
    fails = F.array(*[F.when(F.col(f"fails_{f}"), F.lit(f)) for f in letters])
    total = rows.groupBy("part").agg(*[F.struct(
        F.count_if(f"fails_{f}").alias("failing"), F.count_if(F.array_join(fails, "") == f).alias("unique_fails")).alias(f) for f in letters])
    # A state's edge lies on as many orders as its letters, and those after the edge, can be sequenced.
    ways = F.create_map(*[F.lit(x) for k in range(len(letters)) for x in (k, factorial(k) * factorial(len(letters) - 1 - k))])
    edge = stored(edges(rows, letters, names)).withColumnRenamed("part", "_part")
    shapley = edge.groupBy("_part", "filter").agg(F.sum(F.col("removed") * ways[F.length("state")]).alias("shapley"))
    steps = [F.struct(F.lit("".join(p)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("_f"), F.lit("".join(sorted(p[:k]))).alias("_state"))
             for p in permutations(letters) for k, f in enumerate(p)]
    of = F.create_map(*[x for f in letters for x in (F.lit(f), F.col(f))])
    grid = total.select("part", F.explode(F.array(*steps)).alias("s"), of.alias("_of")).select("part", "s.*", F.col("_of")[F.col("s._f")].alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")  # noqa: E731  no survivors, no row
    j = grid.join(edge, (F.col("part") == F.col("_part")) & (F.col("_state") == F.col("state")) & (F.col("_f") == F.col("filter")), "left").drop("_part", "filter")
    j = j.join(shapley, (F.col("part") == F.col("_part")) & (F.col("_f") == F.col("filter")), "left")
    return j.select(
        "part", "filter_order", "step", (zero("survivors") - zero("removed")).alias("kept"), zero("removed").alias("removed"),
        (F.col("_all.failing") - zero("removed")).alias("redundant"), F.col("_all.unique_fails").alias("unique_fails"),
        *[zero(x).alias(x) for x in names], zero("shapley").alias("shapley"),
    )


def quality_conditions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, fails_A to fails_E, good and toxic of every document.

    A: under 100 words; B: under 80 % of the words distinct; C: more than 10 % of the characters are A-Z; D: one of
    ``#$%&*|``; E: a smaller doc_id has the same text. A null text is empty. Rows without a doc_id are no copies of
    others, have no labels, and others are no copies of theirs. A text is read once; copies meet by its digest, and those of a text that very many
    share are dealt out. Long texts take their words' memory in one task.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", "lang", text.alias("text"), F.explode(F.array(F.expr(words_column()))).alias("words"))
    n = F.size("words")
    known = stored(words.select(
        "doc_id", "lang", F.unhex(F.sha2("text", 256)).alias("digest"), (n < 100).alias("fails_A"), (100 * F.size(F.array_distinct("words")) < 80 * n).alias("fails_B"),
        (100 * (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))) > 10 * F.length("text")).alias("fails_C"), F.col("text").rlike("[#$%&*|]").alias("fails_D"),
    ))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = salted_join(known.where("doc_id is not null").select("digest", "doc_id"), first, ["digest"], "doc_id").where("first < doc_id").select("doc_id", "digest").distinct()
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without a doc_id meet nothing; dealt out by their digest they do not fill one task.
    key = F.coalesce("doc_id", F.xxhash64("digest"))
    marked = known.withColumn("_key", key).join(copies.select(F.col("doc_id").alias("_copy"), F.col("digest").alias("_digest")), (F.col("_key") == F.col("_copy")) & F.col("doc_id").isNotNull() & (F.col("digest") == F.col("_digest")), "left")
    marked = marked.join(label, (F.col("_key") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    return marked.select("lang", *[f"fails_{f}" for f in "ABCD"], F.col("_copy").isNotNull().alias("fails_E"), "good", "toxic")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters by language."""
    rows = quality_conditions(docs, labels)
    return audit(rows, F.col("lang"), {f: F.col(f"fails_{f}") for f in "ABCDE"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})

"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a fixed 48-bit hash of its id and text. A source that shall give q whole passes and r words
more takes every document q times, and once more those whose hash lies under the source's threshold.
The threshold is found without sorting: words are summed by source and hash bucket, the running sums of
the bounded number of buckets show in which bucket the budget ends, and only the rows of that bucket are
dealt to finer buckets, level after level. Budgets nest: a larger budget only adds documents.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of one
hash (copies under one id) at the threshold share what is left in proportion to their sizes; a null id hashes like the
empty text, so that one id, or null, may have a third of all rows; sources without words get target 0; a very long text
counts whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3.0
#: Hex digits of the hash that each level of buckets uses: 4096 buckets a source and level.
DIGITS, LEVELS = 3, 4
#: Sources whose plan (some hundred bytes each) is broadcast at most.
BROADCAST_SOURCES = 50_000


def size_and_hash() -> tuple[Column, Column]:
    """``size``: words of ``text``; ``h``: the hash of ``doc_id`` and ``text`` in hex digits."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return (
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(both.cast("binary")), 1, DIGITS * LEVELS).alias("h"),
    )


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).select("doc_id", "source", *size_and_hash())


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target). One row a source: its share of all words by weight, no more than ``most`` times its own words.

    What a capped source can't take is shared by weight among the others. A source is capped if its
    cap per weight lies under the share per weight that remains once all sources with a smaller cap
    per weight are capped; so one ordered pass finds the fixed point of that resharing.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("at", F.row_number().over(order)).withColumn("level", level)
    share = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct("at", "level"))).over(every)["level"]
    leveled = leveled.withColumn("share", share)
    return leveled.select("source", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("share"))).alias("target"))


def thresholds(scratch: Scratch, sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, passes, cut, rest, tied): documents with h < cut get one pass more, those with h = cut share ``rest`` words of their ``tied`` words."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.select("source", passes.alias("passes"), F.lit("").alias("cut"), (F.round("target").cast("long") - passes * F.col("source_size")).alias("rest"), F.col("source_size").alias("tied"), F.lit(False).alias("one"))
    for level in range(LEVELS):
        width = DIGITS * (level + 1)
        rows = sized
        if level:
            edge = state.where("rest > 0 and not one").select(F.col("source").alias("s"), F.col("cut").alias("c"))
            rows = sized.join(edge, sized["source"].eqNullSafe(edge["s"]) & (F.substring("h", 1, width - DIGITS) == edge["c"]), "left_semi")
        histogram = rows.groupBy("source", F.substring("h", 1, width).alias("bucket")).agg(F.sum("size").alias("n"), (F.min("h") == F.max("h")).alias("single"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        goal = state.select(F.col("source").alias("s"), F.col("rest").alias("goal"))
        found = histogram.withColumn("upto", upto).join(goal, F.col("source").eqNullSafe(F.col("s"))).where("upto > goal and upto - n <= goal")
        found = found.select("s", "bucket", (F.col("upto") - F.col("n")).alias("under"), F.col("n").alias("held"), "single")
        state = scratch.save(
            state.join(found, state["source"].eqNullSafe(found["s"]), "left").select(
                "source", "passes", F.coalesce("bucket", "cut").alias("cut"), (F.col("rest") - F.coalesce("under", F.lit(0))).alias("rest"), F.coalesce("held", "tied").alias("tied"), F.coalesce("single", "one").alias("one")
            ),
            f"level{level}",
        )
        if state.where("rest > 0 and not one").isEmpty():
            break
    return state


def planned(scratch: Scratch, sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """(of, source_size, target, passes, cut, rest, tied): one row a source."""
    goals = scratch.save(targets(sized, weights, most), "targets")
    cuts = thresholds(scratch, sized, goals)
    plan = goals.join(cuts.withColumnRenamed("source", "s"), goals["source"].eqNullSafe(F.col("s"))).select(F.col("source").alias("of"), "source_size", "target", "passes", "cut", "rest", "tied")
    plan = scratch.save(plan, "plan")
    # Documents stay where they are if the plan is small; with very many sources both sides are dealt by source.
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def taken() -> Column:
    """The words that the mix takes of a document, from its size and hash and its source's plan."""
    prefix = F.substring(F.col("h"), F.lit(1), F.length("cut"))
    more = F.when(prefix < F.col("cut"), F.col("size")).when((prefix == F.col("cut")) & (F.col("tied") > 0), F.floor(F.col("size") * F.col("rest") / F.col("tied"))).otherwise(0)
    return (F.col("size") * F.col("passes") + more).cast("long")


def mix(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): ``taken`` counts the words that the mix takes of the document, repeats included."""
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(sizes(docs, doc_id, text, source), "sizes")
    plan = planned(scratch, sized, weights, most)
    return sized.join(plan, sized["source"].eqNullSafe(plan["of"])).select("doc_id", "source", "size", "source_size", "target", taken().alias("taken"))


def mixed_rows(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    The one document a source whose hash is the threshold, and which is taken in part, counts as whole if half
    of it or more is taken. Rows without words go. Only the plan (a row a source) is joined: texts don't move.
    """
    scratch = Scratch(spark, "mixing")
    plan = planned(scratch, scratch.save(sizes(docs, doc_id, text, source), "sizes"), weights, most)
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    inner = inner.select("row", "source", *size_and_hash())
    found = inner.join(plan, inner["source"].eqNullSafe(plan["of"])).withColumn("copies", F.when(F.col("size") > 0, F.round(taken() / F.col("size"))).otherwise(0).cast("int"))
    return found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

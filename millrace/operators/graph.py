"""Iteration and graphs. Each round's frame is checkpointed, so plans stay short and executors may go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import collatz_step
from ..functions.ordered import number_rows
from ..storage import settle


def iterate(start: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rounds: int | None = None) -> DataFrame:
    """``step`` (rows going round) gives (rows that leave, rows that go round again); ends when none are left or after ``rounds``."""
    left, moving, n, width = None, start, 0, start.rdd.getNumPartitions()
    while rounds is None or n < rounds:
        done, moving = step(moving)
        # One pass for both: rows that go on are marked, written once, and split.
        both = settle(done.withColumn("__on", F.lit(False)).unionByName(moving.withColumn("__on", F.lit(True))).coalesce(width))
        done, moving, n = both.where("not __on").drop("__on"), both.where("__on").drop("__on"), n + 1
        left = done if left is None else left.unionByName(done)
        if moving.isEmpty():
            return left
    return left.unionByName(moving) if left is not None else moving


def loop_epochs(df: DataFrame, summary: int = 1, epoch: str = "epoch") -> DataFrame:
    """The time that a row has after a trip round the loop."""
    return df.withColumn(epoch, F.col(epoch) + summary)


def enter(df: DataFrame, at: Column | None = None, epoch: str = "epoch", inner: str = "inner") -> DataFrame:
    """Into a nested scope: time gets an inner coordinate (0, or ``at``)."""
    return df.withColumn(inner, (at if at is not None else F.lit(0)).cast("long"))


def leave(df: DataFrame, inner: str = "inner") -> DataFrame:
    return df.drop(inner)


def not_after(outer_a: Column, inner_a: Column, outer_b: Column, inner_b: Column) -> Column:
    """The partial order of nested times: both coordinates."""
    return (outer_a <= outer_b) & (inner_a <= inner_b)


def collatz(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the number of steps until the value is at most 1."""
    start = df.select("*", F.col(value).cast("long").alias("__x"), F.lit(0).alias("steps"))

    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        ended = (F.col("__x") <= 1) | F.col("__x").isNull()
        # Sixteen steps a round; a value that has reached 1 stays there. A fold keeps the plan short.
        grown = F.aggregate(
            F.sequence(F.lit(1), F.lit(16)),
            F.struct(F.col("__x").alias("x"), F.col("steps").alias("n")),
            lambda a, _: F.struct(F.when(a["x"] > 1, collatz_step(a["x"])).otherwise(a["x"]).alias("x"), (a["n"] + F.when(a["x"] > 1, 1).otherwise(0)).alias("n")),
        )
        moved = rows.where(~ended).withColumn("__s", grown).withColumns({"__x": F.col("__s.x"), "steps": F.col("__s.n")}).drop("__s")
        return rows.where(ended), moved

    return iterate(start, step).drop("__x")


def bfs(edges: DataFrame, root: Column, src: str = "src", dst: str = "dst", levels: int | None = None) -> DataFrame:
    """(node, level, parent) of every node that the root reaches; of equal parents, the least."""
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    spark = edges.sparkSession
    seen = settle(spark.range(1).select(root.alias("node")).select("node", F.lit(0).alias("level"), F.col("node").alias("parent")))
    front, level = seen, 0
    while levels is None or level < levels:
        level += 1
        found = front.select(F.col("node").alias("s")).join(pairs, "s").groupBy(F.col("d").alias("node")).agg(F.min("s").alias("parent"))
        front = settle(found.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level"), "parent"))
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front)) if level % 8 == 0 else seen.unionByName(front)
    return seen


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that each node is connected to.

    Alternating star steps: neighbours larger than a node are hung on its least neighbour, then smaller ones.
    Rounds grow with the logarithm of the nodes, and a node of high degree is one row after the partial minimum.
    """
    own = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = settle(own.select("a").union(own.select("b")).distinct().withColumnRenamed("a", "node"))
    links = settle(own.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (mark := links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()) != before:
        before = mark
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hung = large.join(least, F.col("a") == F.col("u"))
        links = settle(hung.select("a", F.col("m").alias("b")).union(hung.select("b", "m")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return nodes.join(links, nodes["node"] == links["a"], "left").select("node", F.coalesce("b", "node").alias("component"))


def spanning_roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) forest edges: one for each node that isn't its component's least."""
    return connected_components(edges, src, dst).where("node <> component").withColumnRenamed("component", "root")


def _placed(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """(s, d, n, k, degree): each different edge, how often it is given, its place among the node's edges and their number; and the nodes."""
    counted = edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    degrees = counted.groupBy(F.col("s").alias("of")).agg(F.count(F.lit(1)).alias("degree"))
    placed = number_rows(counted, "d", by=["s"], out="k").withColumn("k", F.col("k") - 1)
    out = settle(placed.join(degrees, F.col("s").eqNullSafe(F.col("of"))).drop("of"))
    return out, out.select(F.col("s").alias("node")).union(out.select("d")).distinct()


def _share(rank: str) -> Column:
    """What an edge is sent of its node's rank."""
    spread = F.floor(F.col(rank) * 5 / 6).cast("long")
    return (F.floor(spread / F.col("degree")) + F.when(F.col("k") < spread % F.col("degree"), 1).otherwise(0)) * F.col("n")


def pagerank_incremental(edges: DataFrame, rounds: int | None = None, src: str = "src", dst: str = "dst", base: int = 1000, least: int = 6) -> DataFrame:
    """(node, rank): ``pagerank`` by changes. A node keeps what it is sent until that changes its rank by ``least``; only nodes of new rank send, and what they send is the difference.

    Ends when no rank changes, or after ``rounds``.
    """
    out, nodes = _placed(edges, src, dst)
    state = settle(nodes.select("node", F.lit(0).cast("long").alias("before"), F.lit(base).cast("long").alias("rank"), F.lit(base).cast("long").alias("total")))
    n = 0
    while rounds is None or n < rounds:
        changed = state.where("rank <> before").select(F.col("node").alias("of"), "before", "rank")
        if changed.isEmpty():
            break
        sent = out.join(changed, F.col("s") == F.col("of")).groupBy(F.col("d").alias("to")).agg(F.sum(_share("rank") - _share("before")).alias("got"))
        grown = state.join(sent, F.col("node") == F.col("to"), "left").select("node", "rank", (F.col("total") + F.coalesce("got", F.lit(0))).alias("total"))
        after = F.when(F.abs(F.col("total") - F.col("rank")) >= least, F.col("total")).otherwise(F.col("rank"))
        state, n = settle(grown.select("node", F.col("rank").alias("before"), after.cast("long").alias("rank"), F.col("total").cast("long").alias("total"))), n + 1
    return state.select("node", "rank")


def pagerank(edges: DataFrame, rounds: int = 10, src: str = "src", dst: str = "dst", base: int = 1000) -> DataFrame:
    """(node, rank) in whole numbers: five sixths of a node's rank go to its neighbours, the remainder of the division to the first of them in order.

    Every rank starts at ``base`` and is ``base`` plus what the node is sent. An edge given twice counts twice.
    """
    out, nodes = _placed(edges, src, dst)
    ranks = settle(nodes.select("node", F.lit(base).cast("long").alias("rank")))
    for _ in range(rounds):
        sent = out.join(ranks, out["s"] == ranks["node"]).groupBy(F.col("d").alias("to")).agg(F.sum(_share("rank")).alias("got"))
        ranks = settle(ranks.join(sent, F.col("node") == F.col("to"), "left").select("node", (F.lit(base) + F.coalesce("got", F.lit(0))).cast("long").alias("rank")))
    return ranks


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, neighbours): each node's neighbours in order."""
    return edges.groupBy(src).agg(F.sort_array(F.collect_list(dst)).alias("neighbours"))

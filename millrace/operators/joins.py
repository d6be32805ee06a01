"""Inner joins of keyed rows, and lookups.

``join`` meets rows across epochs, ``timestamp_join`` within an epoch. ``concat_join`` and
``timestamp_concat`` pair single items: each arrival consumes the one waiting match, and an arrival that
finds its own side waiting takes that row's place. Lookup tables are broadcast by Spark where their measured
size allows it, never by a hint here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import fold_ordered


def join(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """All pairs of rows of a key."""
    return left.join(right, [key] if isinstance(key, str) else list(key))


def timestamp_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], epoch: str = "epoch") -> DataFrame:
    return join(left, right, [epoch, *([key] if isinstance(key, str) else key)])


def joined_telemetry(left: str = "l", right: str = "r") -> dict[str, Column]:
    """Of a joined row: the earlier start, the longer latency."""
    return {"start_ns": F.least(f"{left}.start_ns", f"{right}.start_ns"), "latency_ns": F.greatest(f"{left}.latency_ns", f"{right}.latency_ns")}


def _sides(left: DataFrame, right: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, str]:
    """Both inputs as one stream: keys, order, side (0 or 1), and the row as l or r."""
    l, r = (F.struct(*(F.col(c) for c in df.columns)) for df in (left, right))
    none_l, none_r = (F.lit(None).cast(df.schema) for df in (left, right))
    both = left.select(*key, F.col(order).alias("__o"), F.lit(0).alias("__s"), l.alias("l"), none_r.alias("r"))
    both = both.unionByName(right.select(*key, F.col(order).alias("__o"), F.lit(1).alias("__s"), none_l.alias("l"), r.alias("r")))
    kind = lambda df: T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).simpleString()
    return both, f"l {kind(left)}, r {kind(right)}"


def concat_join(left: DataFrame, right: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """(l, r): single-item pairs in order of arrival (ties: left first).

    Pairs form only where the side changes: the last row of a run of one side waits, unless it was itself
    consumed. A run of two rows or more always leaves one waiting; after runs of a single row, one waits after every
    other of them. So windows over a key's rows say it all, in one shuffle.
    """
    both, _ = _sides(left, right, key, order)
    arrival = Window.partitionBy(*key).orderBy("__o", "__s")
    side, before = F.col("__s"), F.lag("__s").over(arrival)
    turns = both.select(
        *key, "__s", "l", "r", F.row_number().over(arrival).alias("__n"), (before.isNull() | (before != side)).alias("__new"),
        F.lag("l").over(arrival).alias("__l"), F.lag("r").over(arrival).alias("__r"),
    ).where("__new")
    by_run = Window.partitionBy(*key).orderBy("__n")
    runs = turns.withColumn("__run", F.row_number().over(by_run)).withColumn("__long", F.col("__n") - F.lag("__n").over(by_run) >= 2)
    last_long = F.max(F.when(F.col("__long"), F.col("__run") - 1)).over(by_run.rowsBetween(Window.unboundedPreceding, 0))
    waits = F.when(last_long.isNotNull(), (F.col("__run") - 1 - last_long) % 2 == 0).otherwise(F.col("__run") % 2 == 0)
    pairs = runs.withColumn("__waits", waits).where("__waits")
    return pairs.select(F.when(side == 1, F.col("__l")).otherwise(F.col("l")).alias("l"), F.when(side == 1, F.col("r")).otherwise(F.col("__r")).alias("r"))


def concat_unique(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``concat_join`` where each side has a key at most once: then it is a plain inner join."""
    return join(left, right, key)


def timestamp_concat(left: DataFrame, right: DataFrame, key: Sequence[str], order: str, epoch: str = "epoch") -> DataFrame:
    return concat_join(left, right, [epoch, *key], order)


def counted_join(left: DataFrame, right: DataFrame, key: Sequence[str], order: str, count: str) -> DataFrame:
    """(l, r): pairs until both sides of a key have seen as many rows as their first row's ``count`` says; then both are forgotten."""
    both, schema = _sides(left, right, key, order)

    def step(state, row):
        side, own = row["__s"], row["l"] if row["__s"] == 0 else row["r"]
        state[side].append(own)
        if state[side + 2] is None:
            state[side + 2] = own[count]
        pairs = [{"l": own, "r": x} if side == 0 else {"l": x, "r": own} for x in state[1 - side]]
        if len(state[0]) == state[2] and len(state[1]) == state[3]:
            state = [[], [], None, None]
        return state, pairs

    return fold_ordered(both, key, ["__o", "__s"], lambda: [[], [], None, None], step, schema)


def zip_by_position(left: DataFrame, right: DataFrame, left_items: str, right_items: str, keep: str) -> DataFrame:
    """Elements of two arrays at the same place: (keep, position, l, r)."""
    a = left.select(keep, F.posexplode(left_items).alias("position", "l"))
    b = right.select(keep, F.posexplode(right_items).alias("position", "r"))
    return a.join(b, [keep, "position"])


def member(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(key), key, "left_semi")


def flag_member(df: DataFrame, other: DataFrame, key: str, out: str = "is_member") -> DataFrame:
    """All rows, and whether the other table has their key."""
    keys = other.select(F.col(key).alias("__k")).distinct()
    return df.join(keys, df[key] == keys["__k"], "left").withColumn(out, F.col("__k").isNotNull()).drop("__k")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """All rows with the table's value of their key, or the default."""
    found = df.join(table.select(key, value), key, "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, default))


def fallback_lookup(df: DataFrame, table: DataFrame, first: str, second: str, value: str, keys: Sequence[str] = (), default: str = "default", otherwise: Column | None = None) -> DataFrame:
    """The value of (first, second), else of (default, second), (first, default), (default, default)."""
    out, tries = df, []
    for n, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        t = table.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(first).alias("__a"), F.col(second).alias("__b"), F.col(value).alias(f"__v{n}"))
        on = (F.col("__a") == (F.lit(default) if a else F.col(first))) & (F.col("__b") == (F.lit(default) if b else F.col(second)))
        for i, k in enumerate(keys):
            on = on & (F.col(k) == F.col(f"__k{i}"))
        out = out.join(t, on, "left").drop("__a", "__b", *(f"__k{i}" for i in range(len(keys))))
        tries.append(F.col(f"__v{n}"))
    return out.withColumn(value, F.coalesce(*tries, *([otherwise] if otherwise is not None else []))).drop(*(f"__v{n}" for n in range(4)))


join_local, timestamp_join_local, concat_local, timestamp_concat_local = join, timestamp_join, concat_join, timestamp_concat

"""Keyed state in streams: the count-bounded and folding operators, micro-batch by micro-batch.

State lives in Spark's state store, so it survives executors, and the rows of a key beyond the open group
aren't kept. Rows of a key within a micro-batch are taken in the order of the ``order`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that ``transformWithState`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_state_store(spark) -> None:
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)


def _ordered(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> list[dict]:
    frames = list(rows)
    return pd.concat(frames).sort_values(list(order), kind="stable").to_dict("records") if frames else []


class Fold(StatefulProcessor):
    """A key's state is a row of ``state_schema`` (given and returned as a tuple)."""

    def __init__(self, state_schema: str, start: Callable[[], tuple], step: Callable[[tuple, dict], tuple[tuple | None, Iterable[dict]]], order: Sequence[str]):
        self.state_schema, self.start, self.step, self.order = state_schema, start, step, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else self.start()
        out: list[dict] = []
        for row in _ordered(rows, self.order):
            after, emitted = self.step(state, row)
            out.extend(emitted)
            state = self.start() if after is None else after
        self.state.update(state)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


class CountBounded(StatefulProcessor):
    """Gathers ``count`` rows of a key, then emits their aggregate and forgets them."""

    def __init__(self, row_schema: str, columns: Sequence[str], count: int, agg: Callable[[tuple, pd.DataFrame], dict], order: Sequence[str]):
        self.row_schema, self.columns, self.count, self.agg, self.order = row_schema, list(columns), count, agg, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.row_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        out = []
        for row in _ordered(rows, self.order):
            held.append(tuple(row[c] for c in self.columns))
            if len(held) == self.count:
                out.append(self.agg(key, pd.DataFrame(held, columns=self.columns)))
                held = []
        self.rows.clear()
        if held:
            self.rows.put(held)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: Sequence[str], order: Sequence[str], state_schema: str, start: Callable[[], tuple], step: Callable[[tuple, dict], tuple[tuple | None, Iterable[dict]]], schema: str) -> DataFrame:
    """``step`` (state, row) gives the next state (None to start anew) and rows to emit."""
    use_state_store(df.sparkSession)
    return df.groupBy(*key).transformWithStateInPandas(statefulProcessor=Fold(state_schema, start, step, order), outputStructType=schema, outputMode="Append", timeMode="None")


def aggregate_stream(df: DataFrame, key: Sequence[str], count: int, order: Sequence[str], agg: Callable[[tuple, pd.DataFrame], dict], schema: str) -> DataFrame:
    """The streaming twin of ``aggregates.aggregate``."""
    use_state_store(df.sparkSession)
    rest = [f for f in df.schema if f.name not in key]
    row_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    processor = CountBounded(row_schema, [f.name for f in rest], count, agg, order)
    return df.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")

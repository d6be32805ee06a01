"""Arbitrary folds over keyed rows in order, for what built-in aggregates can't say.

Rows are dealt by key and sorted; a task then streams over them with the state of one key at a time, so
memory doesn't grow with a key's rows. The rows of one key are still one task's work: the fold is
sequential by nature. Prefer the columnar operators where the fold is algebraic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

ROWS = 4096


def fold_ordered(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, dict], tuple[Any, Iterable[dict]]],
    schema: str,
    finish: Callable[[tuple, Any], Iterable[dict]] | None = None,
) -> DataFrame:
    """``step`` (state, row) gives the next state and rows to emit; ``finish`` (key, state) may emit more at a key's end."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        current, state, out = None, None, []

        def packed():
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in key)
                if current is None or own != current:
                    if current is not None and finish:
                        out.extend(finish(current, state))
                    current, state = own, start()
                state, emitted = step(state, row)
                out.extend(emitted)
                if len(out) >= ROWS:
                    yield packed()
                    out = []
        if current is not None and finish:
            out.extend(finish(current, state))
        if out:
            yield packed()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)

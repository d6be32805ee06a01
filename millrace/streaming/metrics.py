"""What streams report of themselves, gathered by a listener."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, batch long, rows long, rows_a_second double, trigger_ms long, watermark string, dropped long"


@dataclass
class Metrics(StreamingQueryListener):
    """One record a micro-batch; ``dropped`` counts rows that came after the watermark."""

    records: list[tuple] = field(default_factory=list)
    ended: list[str] = field(default_factory=list)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.records.append((p.name or str(p.id), int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond), int(p.durationMs.get("triggerExecution", 0)), p.eventTime.get("watermark"), int(late)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, SCHEMA)


def attach(spark: SparkSession) -> Metrics:
    found = Metrics()
    spark.streams.addListener(found)
    return found


def to_json(metrics: Metrics) -> str:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return "\n".join(json.dumps(dict(zip(names, r))) for r in metrics.records)

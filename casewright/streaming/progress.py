"""Progress of streams as ingestion events."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

EVENT = "event_id string, source_path string, source_type string, status string, error_message string, started_at timestamp, duration_ms long, rows long, notes string"


class ProgressRows(StreamingQueryListener):
    """Appends a row for every batch with input, and one for a query that ends with an error, to a Parquet table.

    An event's id is made of the run and the batch number, so a reader can drop what was written twice.
    """

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] = ()):
        self.spark, self.path, self.names = spark, path, names
        self.known: dict[str, str | None] = {}

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], EVENT).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.known[str(event.runId)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows == 0 or self.names and p.name not in self.names:
            return
        started = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        sources = ", ".join(s.description for s in p.sources)
        notes = json.dumps({"batch": p.batchId, "rows_per_second": p.processedRowsPerSecond}, sort_keys=True)
        self._append((f"{p.runId}-{p.batchId}", sources, "stream", "success", None, started, int(p.durationMs.get("triggerExecution", 0)), p.numInputRows, notes))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.known.pop(str(event.runId), None)
        if event.exception is not None and (not self.names or name in self.names):
            self._append((f"{event.runId}-end", name, "stream", "failed", event.exception[:500], datetime.now(), 0, 0, None))

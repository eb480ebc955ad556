"""A query's sign of life as a status file that other sessions read (`operators.export.history`, `effective`)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from lettermill.sources import versions


class StatusFiles(StreamingQueryListener):
    """Writes folder/<run>.json, one object of `export.STATUS`, at every start, progress, idle trigger and end of a query; each time as a whole, by replacing the file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.runs: dict[str, dict] = {}

    def _write(self, run: str, **changes: object) -> None:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00")
        status = self.runs.setdefault(run, {"run": run, "state": "running", "phase": "starting", "started_at": now, "messages": 0})
        status |= changes | {"updated_at": now}
        versions.replace_text(self.spark, f"{self.folder}/{run}.json", json.dumps(status))

    def onQueryStarted(self, event) -> None:
        self._write(str(event.runId), state="running", phase="starting")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self._write(run, phase=f"batch {p.batchId}", messages=self.runs.get(run, {}).get("messages", 0) + max(0, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        self._write(str(event.runId), phase="idle")

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._write(run, state="failed" if event.exception else "finished", phase=(event.exception or "done").split("\n")[0][:500])
        self.runs.pop(run, None)


def watch(spark: SparkSession, folder: str) -> StatusFiles:
    """Status files of all streaming queries of this session; `spark.streams.removeListener` ends it."""
    listener = StatusFiles(spark, folder)
    spark.streams.addListener(listener)
    return listener



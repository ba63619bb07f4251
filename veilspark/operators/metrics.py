"""Counters of what was served and refused."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql.streaming.listener import StreamingQueryListener

from ..errors import Cause

COUNTERS = ("statements", "served", "rejected", "fields", "fields_masked", "fields_nulled", "values_masked", "stream_batches", "rescued", "metadata", "reloads")


#: The name of the count of rows beside those of masked values.
ROWS = "rows of result"


class Metrics:
    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.causes: Counter[str] = Counter()
        self.lock = Lock()

    def add(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.counts[name] += n

    def reject(self, cause: Cause) -> None:
        with self.lock:
            self.counts["rejected"] += 1
            self.causes[cause.value] += 1

    def as_dict(self) -> dict[str, int]:
        return {name: self.counts[name] for name in COUNTERS} | {f"rejected_{c.value}": self.causes[c.value] for c in Cause}

    def prometheus(self) -> str:
        lines = [f"veilspark_{k} {self.counts[k]}" for k in COUNTERS]
        return "\n".join(lines + [f'veilspark_rejections{{cause="{c.value}"}} {self.causes[c.value]}' for c in Cause]) + "\n"


class StreamCounter(StreamingQueryListener):
    """Adds the masked values of each micro-batch of observed streams to the metrics."""

    PREFIX = "veilspark-"

    def __init__(self, metrics: Metrics) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if name.startswith(self.PREFIX):
                self.metrics.add("values_masked", sum(v for k, v in row.asDict().items() if k != ROWS))
                self.metrics.add("stream_batches")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

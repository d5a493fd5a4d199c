"""Pipeline counters (A12): figures observed on the way, added up over micro-batches.

``counted`` puts named counts on a DataFrame; they are computed while its
rows flow, without a pass of their own, in batch and stream alike.
``CounterListener`` adds up what the micro-batches of all queries report;
``totals`` reads the same from one query that has ended.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def counted(df: DataFrame, stage: str, **counts: Column) -> DataFrame:
    """``df`` with counts of the rows for which a condition holds; ``F.lit(True)`` counts all."""
    return df.observe(stage, *[F.count_if(c).alias(n) for n, c in counts.items()])


def _add(into: Counter, metrics: dict) -> None:
    for stage, row in metrics.items():
        for name, n in row.asDict().items():
            into[f"{stage}.{name}"] += n or 0


def totals(query: StreamingQuery) -> dict[str, int]:
    """Counts of a query that has ended, by ``stage.name``; covers the progress reports that Spark keeps (100 by default)."""
    found: Counter = Counter()
    for progress in query.recentProgress:
        _add(found, progress.observedMetrics)
    return dict(found)


class CounterListener(StreamingQueryListener):
    """Adds up the counts of all queries of a session; ``failed`` counts queries that ended with an error."""

    def __init__(self) -> None:
        self.lock, self.counts, self.ended, self.failed = threading.Lock(), Counter(), set(), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.lock:
            _add(self.counts, event.progress.observedMetrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(str(event.runId))
            self.failed += event.exception is not None

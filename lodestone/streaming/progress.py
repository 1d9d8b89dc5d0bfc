"""Progress of an indexing run as a stream: events in, state per step and snapshots out."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EVENT = "tag string, name string, label string, message string, worker string, elapsed_ms double, since_start_ms double, residency_mb double, input_rows map<string, long>, derived_rows map<string, long>"
#: Events that came so long after the latest one are late: their steps' state is gone.
LATE = "10 minutes"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of JSON lines that appear in a directory."""
    return spark.readStream.schema(EVENT).json(path)


def step_state(events: DataFrame) -> DataFrame:
    """Per step: the last elapsed time, the most memory, the number of events; also over a batch."""
    steps = events.where("tag = 'step'")
    return steps.groupBy("label").agg(F.max_by("elapsed_ms", "since_start_ms").alias("elapsed_ms"), F.max("residency_mb").alias("residency_mb"), F.count("*").alias("n_events"), F.max("since_start_ms").alias("last_ms"))


def snapshots(state: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, name: str = "progress") -> StreamingQuery:
    """Each change of the state given to ``take`` as a small frame; the state itself is kept by Spark in the checkpoint."""
    return state.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", checkpoint).foreachBatch(take).start()


def windowed(events: DataFrame, at: str, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """(window start, event_type, n, total) of events by time, in a stream with a watermark for late ones."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def merged_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """(key, began, ended) with overlapping intervals of a key merged."""
    before = W.partitionBy(key).orderBy("began", "ended").rowsBetween(W.unboundedPreceding, -1)
    marked = intervals.withColumn("_new", (F.col("began") > F.coalesce(F.max("ended").over(before), F.col("began") - 1)).cast("int"))
    island = marked.withColumn("_i", F.sum("_new").over(W.partitionBy(key).orderBy("began", "ended")))
    return island.groupBy(key, "_i").agg(F.min("began").alias("began"), F.max("ended").alias("ended")).drop("_i")


def gaps(intervals: DataFrame, key: str, span_ms: float, least_ms: float = 300.0) -> DataFrame:
    """(key, gap_from, gap_to) of the span that no interval of a key covers, at least so wide."""
    merged = merged_intervals(intervals, key)
    order = W.partitionBy(key).orderBy("began")
    inner = merged.select(key, F.lag("ended", 1, 0.0).over(order).alias("gap_from"), F.col("began").alias("gap_to"))
    tail = merged.groupBy(key).agg(F.max("ended").alias("gap_from")).withColumn("gap_to", F.lit(span_ms))
    return inner.unionByName(tail).where(F.col("gap_to") - F.col("gap_from") >= least_ms)


class Heartbeat(StreamingQueryListener):
    """The latest progress of each running stream, for a display that must show signs of life."""

    def __init__(self) -> None:
        self.latest: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = "started"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.latest[str(event.progress.id)] = f"{event.progress.numInputRows} rows"

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = "idle"

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.latest[str(event.id)] = "ended"


class Jobs:
    """A registry of background jobs: one per key at a time, the oldest finished ones forgotten beyond a bound."""

    def __init__(self, workers: int = 2, kept: int = 128) -> None:
        self.pool, self.kept = ThreadPoolExecutor(workers), kept
        self.jobs: OrderedDict[str, tuple[str, Future]] = OrderedDict()
        self.lock = threading.Lock()

    def start(self, key: str, work: Callable[[], object]) -> str:
        """The id of the running job of a key, or of a new one."""
        with self.lock:
            for job, (own, future) in self.jobs.items():
                if own == key and not future.done():
                    return job
            job = uuid.uuid4().hex
            self.jobs[job] = (key, self.pool.submit(work))
            done = [j for j, (_, f) in self.jobs.items() if f.done()]
            for j in done[: max(0, len(self.jobs) - self.kept)]:
                del self.jobs[j]
            return job

    def state(self, job: str) -> str:
        if job not in self.jobs:
            return "unknown"
        future = self.jobs[job][1]
        return "running" if not future.done() else "failed" if future.exception() else "done"

    def result(self, job: str) -> object:
        return self.jobs[job][1].result()

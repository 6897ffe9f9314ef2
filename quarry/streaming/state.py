"""Stateful operators: rate windows, sessions, and index upkeep from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.postings import Index
from ..plans.registry import query
from ..sources.tables import table, tokens


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, CAST(greatest(count(*) - 2, 0) AS BIGINT) AS rejected FROM events GROUP BY ALL")
def rate_tumbling(spark, sf_dir):
    """Clock-aligned windows with a limit of two (approximates the anchored ones)."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - 2, F.lit(0)).alias("rejected"))


class Window:
    """A key's window: it begins with the first event after the last window's end, and takes ``limit`` events."""

    def __init__(self, window_us: int, limit: int, start: int | None = None, n: int = 0):
        self.window, self.limit, self.start, self.n = window_us, limit, start, n

    def take(self, at: int) -> bool:
        if self.start is None or at - self.start > self.window:
            self.start, self.n = at, 0
        self.n += 1
        return self.n <= self.limit


def rate_anchored_rows(events: DataFrame, window_s: int, limit: int) -> DataFrame:
    """(event_id, user_id, accepted): a fold over each key's events in order. A key's events stream through one task, which holds one window, not the events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = object(), None
        for batch in batches:
            out = []
            for user, at in zip(batch["user_id"].to_pylist(), batch["us"].to_pylist(), strict=True):
                if user != key:
                    key, now = user, Window(window_s * 1_000_000, limit)
                out.append(now.take(at))
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["user_id"], pa.array(out, pa.bool_())], ["event_id", "user_id", "accepted"])

    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
    return rows.mapInArrow(run, "event_id long, user_id long, accepted boolean")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, n, t AS start, 1 AS k FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN t - start > 86400000000 THEN t ELSE start END, CASE WHEN t - start > 86400000000 THEN 1 ELSE k + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, user_id, k <= 2 AS accepted FROM r""")
def rate_anchored(spark, sf_dir):
    """Two events a day and user, counted from a window's first event."""
    return rate_anchored_rows(table(spark, sf_dir, "events"), 86400, 2)


def rate_stream(events: DataFrame, window_s: int = 60, limit: int = 100) -> DataFrame:
    """The same over a stream with a watermark on ``ts``; a key's state goes after two windows without an event."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = Window(window_s * 1_000_000, limit, *(state.get if state.exists else (None, 0)))
        pdf = pd.concat(list(frames)).sort_values(["us", "event_id"])
        pdf["accepted"] = [window.take(int(t)) for t in pdf["us"]]
        state.update((window.start, window.n))
        state.setTimeoutTimestamp(max(int(pdf["us"].max() // 1000) + 2 * window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf[["event_id", "user_id", "accepted"]]

    rows = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, accepted boolean", "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def maintain_index(spark: SparkSession, source: str, schema, index: Index, checkpoint: str):
    """Keeps an index up to date from a file stream of documents (doc_id, source, text, deleted): the last row of a key in a batch
    counts. A batch is one generation, numbered after the batch, so a replay overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("_n", F.monotonically_increasing_id()).groupBy("doc_id").agg(F.max_by(F.struct("source", "text", "deleted"), "_n").alias("r")).select(F.col("doc_id").alias("key"), "r.*").persist()
        rows = last.where("not coalesce(deleted, false)").select("key", F.col("source").alias("spec"), tokens(F.substring_index("text", "\n", 1)).alias("title"), tokens(F.col("text")).alias("body"))
        Index(spark, index.path, index.generation + number).update(rows, last.where("coalesce(deleted, false)").select("key"))
        last.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame) -> DataFrame:
    """Counts of a stream by hour and type; events two hours late are dropped."""
    return events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def heartbeat(rows: DataFrame, name: str) -> DataFrame:
    """Rows with counters that a listener or the query's progress shows while they flow."""
    return rows.observe(name, F.count(F.lit(1)).alias("seen"))

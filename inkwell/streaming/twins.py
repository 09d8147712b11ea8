"""Streaming forms of the folds and windows. Event time is the server's clock; the watermark tolerates two minutes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.functions import folds
from inkwell.operators.risk import reason_family
from inkwell.operators.views import add_counts, count_views
from inkwell.sources.versions import VersionedTable

LATENESS = "2 minutes"


def with_event_time(df: DataFrame, ms: str, name: str = "event_time", lateness: str = LATENESS) -> DataFrame:
    """Event time from a column of milliseconds, with the watermark."""
    return df.withColumn(name, F.timestamp_millis(ms)).withWatermark(name, lateness)


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: str, step: folds.Step, ttl_ms: int, ts: str) -> DataFrame:
    """The streaming twin of :func:`inkwell.functions.folds.ordered_fold` over a watermarked stream.

    Rows of a micro-batch are taken in order within their key; state ends ``ttl_ms`` after the key's last event. ``ts``
    is the event's millisecond column.
    """
    added = T.StructType.fromDDL(outputs)
    names = [f.name for f in df.schema.fields]
    schema = T.StructType(df.schema.fields + added.fields)
    made_names = [f.name for f in added.fields]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")
        held = pickle.loads(state.get[0]) if state.exists else None
        made = []
        for row in rows[list(inputs)].itertuples(index=False, name=None):
            held, out = step(held, row)
            made.append(out)
        state.update((pickle.dumps(held),))
        state.setTimeoutTimestamp(max(int(rows[ts].max()) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.concat([rows[names].reset_index(drop=True), pd.DataFrame(made, columns=made_names)], axis=1)

    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_first(df: DataFrame, keys: Sequence[str], ttl: int, ts: str, tie: str) -> DataFrame:
    return stream_fold(df, keys, [ts, tie], [ts], "kept boolean", folds.throttle_step(ttl), ttl, ts)


def anchored_rate(df: DataFrame, keys: Sequence[str], window: int, threshold: str, ts: str, tie: str) -> DataFrame:
    return stream_fold(df, keys, [ts, tie], [ts, threshold], "rate_count long, rate_exceeded boolean", folds.anchored_step(window), window, ts)


def sliding_admission(df: DataFrame, keys: Sequence[str], limit: int, window: int, ts: str, tie: str) -> DataFrame:
    return stream_fold(df, keys, [ts, tie], [ts], "allowed boolean, admitted long, retry_ms long", folds.sliding_step(limit, window), window, ts)


def duplicate_sessions(df: DataFrame, keys: Sequence[str], gap_seconds: int, event_time: str = "event_time") -> DataFrame:
    """Sizes of gap sessions of equal texts, closed by the watermark."""
    return df.groupBy(*keys, F.session_window(event_time, f"{gap_seconds} seconds")).agg(F.count("*").alias("observed"))


def risk_reason_stats(df: DataFrame, event_time: str = "event_time", width: str = "1 minute") -> DataFrame:
    """Rejections by minute, scene, reason family and decision."""
    rows = df.where(F.col("decision") != "accept")
    return rows.groupBy(F.window(event_time, width), "scene", reason_family(F.col("reason")).alias("family"), "decision").agg(F.count("*").alias("n"))


def merged_stream(rows: DataFrame, table: VersionedTable, change: Callable[[DataFrame, DataFrame], DataFrame], touched: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, columns: Sequence[str] | None = None, mode: str = "append"):
    """Start a stream that commits ``change(stored rows, batch)`` to a versioned table, for the stored rows whose keys ``touched(batch)``
    names. A batch writes what it changes, and the table's manifest keeps the batch's number, so a batch counts once."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            VersionedTable(batch.sparkSession, table.path).apply(lambda stored: change(stored, batch), touched(batch), columns, note=(name, batch_id))
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view_table(spark: SparkSession, path: str, buckets: int = 16) -> VersionedTable:
    """View counters ``(article_id, views)``; an empty table the first time."""
    table = VersionedTable(spark, path)
    return table if table.version() >= 0 else VersionedTable.create(spark.createDataFrame([], "article_id long, views long"), path, ["article_id"], buckets)


def count_views_into(accepted: DataFrame, articles: DataFrame, path: str, checkpoint: str):
    """Start a stream that adds accepted view events to the counters of :func:`view_table` at ``path``."""
    counts = lambda batch: count_views(batch, articles)
    return merged_stream(accepted, view_table(accepted.sparkSession, path), lambda stored, batch: add_counts(stored, counts(batch)), counts, "views", checkpoint, ["views"])


def reason_stats_into(audit: DataFrame, table: VersionedTable, checkpoint: str):
    """Start a stream that keeps :func:`risk_reason_stats` by minute in a versioned table with the key (start, scene, family,
    decision): Spark's own state sums the minutes that are still open, and a batch writes the sums that it changed."""
    sums = risk_reason_stats(audit).select(F.col("window.start").alias("start"), "scene", "family", "decision", "n")
    return merged_stream(sums, table, lambda stored, batch: batch.select(*stored.columns), lambda batch: batch, "reasons", checkpoint, ["n"], "update")

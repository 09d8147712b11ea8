"""Stateful streams: the steps of :mod:`inkwell.functions.folds` with typed state and event-time timers.

A key's state is a value (throttle, anchored window) or a list (the admitted events of a sliding window) in the state store, and a
timer ends it once the watermark has passed the last event by the time that resets the step. The state store has to be RocksDB
(:func:`rocksdb`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkwell.functions import folds

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class FoldProcessor(StatefulProcessor):
    """Rows of a batch in order within their key, through ``step``. ``form`` is what the state is: a list of times, or a value of
    one or two numbers. Rows of an earlier time than those of earlier batches come late: they meet the state as it is."""

    def __init__(self, step: folds.Step, form: str, order: Sequence[str], inputs: Sequence[str], names: Sequence[str], added: Sequence[str], ts: str, reset: int):
        self.step, self.form, self.order, self.inputs, self.names, self.added, self.ts, self.reset = step, form, list(order), list(inputs), list(names), list(added), ts, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long") if self.form == "list" else handle.getValueState("held", "first long, second long")

    def load(self):
        if not self.held.exists():
            return None
        if self.form == "list":
            return deque(r[0] for r in self.held.get())
        first, second = self.held.get()
        return first if self.form == "one" else (first, second)

    def save(self, state) -> None:
        if self.form == "list":
            self.held.put([(int(t),) for t in state])
        else:
            self.held.update((int(state), 0) if self.form == "one" else tuple(map(int, state)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        state, made = self.load(), []
        for row in batch[self.inputs].itertuples(index=False, name=None):
            state, out = self.step(state, row)
            made.append(out)
        self.save(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(batch[self.ts].max()) + self.reset, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.concat([batch[self.names].reset_index(drop=True), pd.DataFrame(made, columns=self.added)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: str, step: folds.Step, form: str, reset: int, ts: str) -> DataFrame:
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType(df.schema.fields + added.fields)
    processor = FoldProcessor(step, form, order, inputs, df.columns, added.names, ts, reset)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def throttle_first(df: DataFrame, keys: Sequence[str], ttl: int, ts: str, tie: str) -> DataFrame:
    """``df`` has event time and a watermark (:func:`inkwell.streaming.twins.with_event_time`); so have the others."""
    return stream_fold(df, keys, [ts, tie], [ts], "kept boolean", folds.throttle_step(ttl), "one", ttl, ts)


def anchored_rate(df: DataFrame, keys: Sequence[str], window: int, threshold: str, ts: str, tie: str) -> DataFrame:
    return stream_fold(df, keys, [ts, tie], [ts, threshold], "rate_count long, rate_exceeded boolean", folds.anchored_step(window), "two", window, ts)


def sliding_admission(df: DataFrame, keys: Sequence[str], limit: int, window: int, ts: str, tie: str) -> DataFrame:
    return stream_fold(df, keys, [ts, tie], [ts], "allowed boolean, admitted long, retry_ms long", folds.sliding_step(limit, window), "list", window, ts)

"""Ordered folds per key, for decisions that depend on earlier decisions, and the steps they share with streams.

A fold sorts each key's rows within its partition and reads them as a stream: a task holds one key's small state and one
Arrow batch, however many rows a key has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.functions.checkpoint import checkpointed

Step = Callable[[object, tuple], tuple[object, tuple]]


@dataclass(frozen=True)
class Silences:
    """Where the hot keys' rows fall apart into segments: ``spans(keys, __slot, __segment)``, a row for each slot of ``reset`` with rows."""

    keys: tuple[str, ...]
    ts: str
    reset: int
    spans: DataFrame
    few: bool

    def marked(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__segment``, the first slot of a row's segment; 0 for the rows of keys that are not split."""
        names = [f"__k{i}" for i in range(len(self.keys))]
        spans = self.spans.toDF(*names, "__at", "__segment")
        on = _slot(F.col(self.ts), self.reset) == F.col("__at")
        for k, n in zip(self.keys, names, strict=True):
            on = on & F.col(k).eqNullSafe(F.col(n))
        joined = df.join(F.broadcast(spans) if self.few else spans, on, "left")
        return joined.select(*df.columns, F.coalesce("__segment", F.lit(0).cast("long")).alias("__segment"))


def _slot(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def silences(df: DataFrame, keys: Sequence[str], ts: str, reset: int, split_rows: int = 1_000_000, max_broadcast_rows: int = 200_000) -> Silences | None:
    """Cut the keys of more than ``split_rows`` rows at silences of more than ``reset``; None if there is no such key.

    Two rows of one slot of length ``reset`` are less than that apart, so a cut lies between slots: of a hot key there is one
    narrow row a slot, with its first and last time, and the gap to the slot before decides. A fold whose state a longer
    silence resets gives the same rows on these segments as on whole keys, and a hot key's segments go to many tasks. More
    rows than the fold looks at (inactive ones) only make fewer cuts. Reads the keys and times of ``df`` once, those of hot keys
    twice, and no more columns.
    """
    hot = checkpointed(df.groupBy(*keys).count().where(F.col("count") > split_rows).drop("count"))
    if hot.isEmpty():
        return None
    on, other = F.lit(True), hot.toDF(*[f"__k{i}" for i in range(len(keys))])
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    slots = df.select(*keys, ts).join(other, on, "left_semi").groupBy(*keys, _slot(F.col(ts), reset).alias("__slot")).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    w = W.partitionBy(*keys).orderBy("__slot")
    last = F.lag("__hi").over(w)
    cut = F.when(last.isNull() | (F.col("__lo") - last > reset), F.col("__slot"))
    spans = slots.withColumn("__cut", cut).withColumn("__segment", F.max("__cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = checkpointed(spans.select(*keys, "__slot", "__segment"))
    return Silences(tuple(keys), ts, reset, spans, spans.count() <= max_broadcast_rows)


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: str, step: Step, active: Column | None = None, split: Silences | None = None
) -> DataFrame:
    """Add ``outputs`` by ``step(state, inputs) -> (state, outputs)`` over each key's rows in ``order``; the state starts as
    None. Rows that are not ``active`` pass through with null outputs and leave the state alone. With ``split`` (of the same keys
    and time, and a silence after which ``step`` starts anew) a hot key's segments are folded each by itself."""
    if split is not None:
        marked = ordered_fold(split.marked(df), [*keys, "__segment"], order, inputs, outputs, step, active)
        return marked.drop("__segment")
    added = T._parse_datatype_string(outputs)
    schema = T.StructType(df.schema.fields + added.fields)
    arrow = to_arrow_schema(schema)
    names = df.columns
    src = df.withColumn("__on", F.coalesce(active, F.lit(False)) if active is not None else F.lit(True))
    src = src.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    none = (None,) * len(added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*keys, *inputs)]
            out = []
            for on, row in zip(b.column("__on").to_pylist(), zip(*cols, strict=True), strict=True):
                k = row[: len(keys)]
                if k != key:
                    key, state = k, None
                if on:
                    state, made = step(state, row[len(keys) :])
                    out.append(made)
                else:
                    out.append(none)
            made = list(zip(*out, strict=True)) if out else [[] for _ in added.fields]
            arrays = [b.column(n) for n in names] + [pa.array(list(m), arrow.field(f.name).type) for m, f in zip(made, added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow)

    return src.mapInArrow(run, schema)


def throttle_step(ttl: int) -> Step:
    """Keep the first event, then none until ``ttl`` after the kept one; an event exactly ``ttl`` later is still held back."""

    def step(kept, row):
        (ts,) = row
        if kept is None or ts > kept + ttl:
            return ts, (True,)
        return kept, (False,)

    return step


def anchored_step(window: int) -> Step:
    """Count events in a window that starts at its first event and is not renewed; its end still belongs to it.
    ``threshold`` comes with each row; the event over it counts too."""

    def step(state, row):
        ts, threshold = row
        start, n = state if state is not None and ts <= state[0] + window else (ts, 0)
        return (start, n + 1), (n + 1, n + 1 > threshold)

    return step


def anchored_chain_step(windows: Sequence[int]) -> Step:
    """Counters like :func:`anchored_step` of one key, one after the other: the first one that is exceeded stops the chain, so
    later ones do not see the event. The thresholds come with each row. Gives the number of that counter, or None."""

    def step(state, row):
        ts, *thresholds = row
        held = list(state) if state is not None else [None] * len(windows)
        for k, (window, threshold) in enumerate(zip(windows, thresholds, strict=True)):
            start, n = held[k] if held[k] is not None and ts <= held[k][0] + window else (ts, 0)
            held[k] = (start, n + 1)
            if n + 1 > threshold:
                return tuple(held), (k,)
        return tuple(held), (None,)

    return step


def sliding_step(limit: int, window: int) -> Step:
    """Admit while fewer than ``limit`` admitted events lie in (now - window, now]; refused events leave no trace."""

    def step(state, row):
        (ts,) = row
        held = state if state is not None else deque()
        while held and held[0] <= ts - window:
            held.popleft()
        if len(held) >= limit:
            return held, (False, len(held), max(held[0] + window - ts, 1000))
        held.append(ts)
        return held, (True, len(held), 0)

    return step


def backoff_step(threshold: int, counter_ttl: int, level_ttl: int, ladder: Sequence[int]) -> Step:
    """Failures in a window from the first one lock the key for ``ladder[level - 1]`` (the last from there on).

    An attempt during a lock is refused and counts for nothing; a success clears everything. State: (failures, their
    start, level, its start, locked until). All times are in milliseconds; a lock's last instant still locks.
    """

    def step(state, row):
        ts, success = row
        n, start, level, level_start, until = state or (0, 0, 0, 0, None)
        if until is not None and ts <= until:
            return (n, start, level, level_start, until), ("locked", level, until - ts)
        if success:
            return None, ("ok", 0, 0)
        if n == 0 or ts > start + counter_ttl:
            n, start = 0, ts
        n += 1
        if n < threshold:
            return (n, start, level, level_start, None), ("failed", level, 0)
        if level == 0 or ts > level_start + level_ttl:
            level, level_start = 0, ts
        level += 1
        wait = ladder[min(level, len(ladder)) - 1]
        return (0, 0, level, level_start, ts + wait), ("lock", level, wait)

    return step


def challenge_step(threshold: int, window: int) -> Step:
    """Failures of a challenge; at ``threshold`` the challenge ends and every later attempt is void."""

    def step(state, row):
        ts, success = row
        start, n, over = state or (ts, 0, False)
        if over:
            return (start, n, True), ("void", n)
        if success:
            return (start, n, False), ("ok", n)
        if n == 0 or ts > start + window:
            start, n = ts, 0
        n += 1
        return (start, n, n >= threshold), ("invalidated" if n >= threshold else "failed", n)

    return step


def samples_step(seconds: int, max_distance: int, max_samples: int, max_percent: int) -> Step:
    """How many of the newest ``max_samples`` earlier rows of the last ``seconds`` are near: lengths within ``max_percent`` of
    the longer and hashes within ``max_distance`` bits. State: the samples, oldest first."""

    def step(state, row):
        ts, size, value = row
        held = state if state is not None else deque(maxlen=max_samples)
        while held and held[0][0] < ts - seconds:
            held.popleft()
        near = sum(100 * abs(size - n) <= max_percent * max(size, n) and ((value ^ h) & (2**64 - 1)).bit_count() <= max_distance for _, n, h in held)
        held.append((ts, size, value))
        return held, (near,)

    return step

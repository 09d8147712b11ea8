"""Stateful streams against batch folds over several starts, and counters that survive batches being run again."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import rates
from inkwell.plans.stream_queries import folded, in_slices
from inkwell.sources.versions import VersionedTable
from inkwell.streaming import stateful, twins

WINDOW = 60_000


@pytest.fixture(scope="module")
def bursts(spark):
    rng, rows, now = random.Random(6), [], 1_700_000_000_000
    for i in range(240):
        now += rng.choice([0, 500, 5000, 20_000, WINDOW, WINDOW + 1]) if i % 60 else 30 * WINDOW  # timers end state in between
        rows.append((i, rng.choice("abc"), now, 4))
    return spark.createDataFrame(rows, "id long, k string, ts long, limit long")


@pytest.mark.parametrize("name", ["throttle", "anchored", "sliding"])
def test_streams_started_again_equal_batches(spark, bursts, name):
    stream, batch = {
        "throttle": (lambda s: stateful.throttle_first(s, ["k"], WINDOW, "ts", "id"), lambda: rates.throttle_first(bursts, ["k"], WINDOW)),
        "anchored": (lambda s: stateful.anchored_rate(s, ["k"], WINDOW, "limit", "ts", "id"), lambda: rates.anchored_rate(bursts, ["k"], WINDOW, "limit")),
        "sliding": (lambda s: stateful.sliding_admission(s, ["k"], 3, WINDOW, "ts", "id"), lambda: rates.sliding_admission(bursts, ["k"], 3, WINDOW)),
    }[name]
    got, want = folded(spark, bursts, "ts", stream), batch()
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_timers_end_the_state_of_silent_keys(spark, tmp_path):
    """A processor by itself: one timer a key, at the last event and the time that resets the step."""

    class Handle:
        def __init__(self):
            self.timers, self.state = [], None

        def getListState(self, name, schema):
            return self

        def exists(self):
            return self.state is not None

        def get(self):
            return iter(self.state)

        def put(self, rows):
            self.state = rows

        def clear(self):
            self.state = None

        def listTimers(self):
            return iter(list(self.timers))

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    import pandas as pd

    from inkwell.functions import folds

    p, handle = stateful.FoldProcessor(folds.sliding_step(2, 100), "list", ["ts"], ["ts"], ["ts"], ["allowed", "admitted", "retry_ms"], "ts", 100), Handle()
    p.init(handle)
    made = [list(p.handleInputRows(("a",), iter([pd.DataFrame({"ts": ts})]), Times()))[0]["allowed"].tolist() for ts in ([20, 10], [30, 115])]
    assert made == [[True, True], [False, True]]
    assert handle.state == [(20,), (115,)] and handle.timers == [216]
    assert list(p.handleExpiredTimer(("a",), Times(), None)) == [] and handle.state is None


def test_a_batch_that_runs_again_counts_once(spark):
    articles = spark.range(1, 6).select("id", F.lit("published").alias("status"))
    events = spark.range(300).select("id", (F.col("id") % 7).alias("article_id"))
    want = {i: sum(1 for e in range(300) if e % 7 == i) for i in range(1, 6)}
    run = lambda base: twins.count_views_into(spark.readStream.schema(events.schema).parquet(f"{base}/in"), articles, f"{base}/v", f"{base}/c")
    base = in_slices(spark, events, "id", run)
    read = lambda: {r.article_id: r.views for r in twins.view_table(spark, f"{base}/v").read().collect()}
    assert read() == want
    table = VersionedTable(spark, f"{base}/v")
    last = table.version()
    commits = sorted((f for f in glob.glob(f"{base}/c/commits/*")), key=lambda f: int(os.path.basename(f)))
    os.remove(f"{base}/c/commits/.{os.path.basename(commits[-1])}.crc")
    os.remove(commits[-1])  # the driver died after the batch was stored and before the stream knew
    run(base).awaitTermination()
    assert read() == want and table.version() == last
    delta = table.manifest()["deltas"]
    assert {d["kind"] for d in delta} == {"put", "patch"}
    assert all(d["columns"] == ["article_id", "views"] for d in delta)


def test_notes_are_kept_apart(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([(1, 0)], "k long, n long"), str(tmp_path / "t"), ["k"], 2)
    touched = spark.createDataFrame([(1,)], "k long")
    for note in (("a", 0), ("a", 0), ("b", 0), ("a", 1), ("a", 0)):
        table.apply(lambda rows: rows.withColumn("n", F.col("n") + 1), touched, ["n"], note=note)
    assert table.read().collect()[0].n == 3

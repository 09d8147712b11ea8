"""Folds against plain loops on random events, in batch and as streams."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from inkwell.functions import columns as C, folds
from inkwell.operators import rates, risk
from inkwell.operators.moderation import behavior
from inkwell.streaming import twins

random.seed(3)
EVENTS = [(i, random.choice("abc"), random.randrange(0, 400_000), random.random() < 0.3) for i in range(300)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, "id long, k string, ts long, success boolean")


def ordered(key):
    return sorted((e for e in EVENTS if e[1] == key), key=lambda e: (e[2], e[0]))


def test_throttle(events):
    want = {}
    for k in "abc":
        last = None
        for i, _, ts, _ in ordered(k):
            want[i] = last is None or ts > last + 60_000
            last = ts if want[i] else last
    assert {r.id: r.kept for r in rates.throttle_first(events, ["k"], 60_000).collect()} == want


def test_sliding(events):
    want = {}
    for k in "abc":
        held = deque()
        for i, _, ts, _ in ordered(k):
            while held and held[0] <= ts - 60_000:
                held.popleft()
            if len(held) >= 3:
                want[i] = (False, 3, max(1000, held[0] + 60_000 - ts))
            else:
                held.append(ts)
                want[i] = (True, len(held), 0)
    got = rates.sliding_admission(events, ["k"], 3, 60_000)
    assert {r.id: (r.allowed, r.admitted, r.retry_ms) for r in got.collect()} == want


def test_chain_keeps_earlier_admissions(spark):
    rows = [(1, "a", "u", 0), (2, "a", "u", 1), (3, "a", "v", 2), (4, "a", "w", 3), (5, None, "w", 4)]
    df = spark.createDataFrame(rows, "id long, ip string, user string, ts long")
    rules = [rates.Rule("ip", ("ip",), 3, 1000), rates.Rule("user", ("user",), 1, 1000), rates.Rule("off", ("user",), 0, 1000)]
    got = {r.id: r.refused_by for r in rates.admission_chain(df, rules).collect()}
    assert got == {1: None, 2: "user", 3: None, 4: "ip", 5: None}


def test_rules_of_a_scene():
    brief = lambda scene, settings=None: [(r.name, r.limit, r.window_ms // 1000) for r in rates.rules_for(scene, settings)]
    assert brief("comment_submit") == [("ip", 20, 600), ("user", 10, 300), ("user_article", 5, 300)]
    assert brief("comment_report") == [("ip", 30, 86400), ("user", 10, 86400), ("ip_comment", 2, 86400)]
    assert brief("comment_submit", {"user": {"limit": 7, "window_seconds": 0}, "ip": None})[:2] == [("ip", 20, 600), ("user", 7, 300)]
    assert brief("account_login", {"disabled": True}) == []


def test_limit_keys_use_separate_dimensions(spark):
    """User 10001 on article or comment 20002 from one address, with and without white space around it."""
    row = spark.range(1).select(*[C.rate_key(*[F.lit(p) for p in parts]).alias(n) for n, parts in {"ip": [" 127.0.0.1 "], "same": ["127.0.0.1"], "user": [10001], "user_article": [10001, 20002], "ip_comment": ["127.0.0.1", 20002], "none": [" "], "unknown": ["unknown"]}.items()]).first()
    assert row.ip == row.same and row.none == row.unknown
    assert len({row.ip, row.user, row.user_article, row.ip_comment, row.none}) == 5


def test_backoff(spark):
    rows = [(i, "u", t, ok) for i, (t, ok) in enumerate([(0, False), (10, False), (20, True), (30, False), (40, False), (50, False), (300_051, False), (300_052, False), (1_200_060, True)])]
    df = spark.createDataFrame(rows, "id long, k string, ts long, success boolean")
    got = [(r.outcome, r.level, r.wait_ms) for r in rates.failure_backoff(df, ["k"], 2, 100_000, 10_000_000).orderBy("id").collect()]
    assert got == [("failed", 0, 0), ("lock", 1, 300_000), ("locked", 1, 299_990), ("locked", 1, 299_980), ("locked", 1, 299_970), ("locked", 1, 299_960), ("failed", 1, 0), ("lock", 2, 900_000), ("ok", 0, 0)]


def test_challenge(spark):
    df = spark.createDataFrame([(i, "c", i * 10, False) for i in range(4)], "id long, k string, ts long, success boolean")
    assert [r.outcome for r in rates.challenge_failures(df, ["k"], 3, 1000).orderBy("id").collect()] == ["failed", "failed", "invalidated", "void"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, k string, ts long")
    assert rates.throttle_first(df, ["k"], 10).collect() == []


def test_stream_equals_batch(spark, events, tmp_path):
    src = events.withColumn("limit", F.lit(4).cast("long"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = twins.with_event_time(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts")
    for k, (name, make, batch) in enumerate(
        [
            ("throttle", lambda s: twins.throttle_first(s, ["k"], 60_000, "ts", "id").select("id", "kept"), rates.throttle_first(src, ["k"], 60_000).select("id", "kept")),
            ("sliding", lambda s: twins.sliding_admission(s, ["k"], 3, 60_000, "ts", "id").select("id", "allowed"), rates.sliding_admission(src, ["k"], 3, 60_000).select("id", "allowed")),
            ("anchored", lambda s: twins.anchored_rate(s, ["k"], 60_000, "limit", "ts", "id").select("id", "rate_count"), rates.anchored_rate(src, ["k"], 60_000, "limit").select("id", "rate_count")),
        ]
    ):
        q = make(stream).writeStream.format("memory").queryName(f"twin_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(spark.table(f"twin_{name}").collect()) == sorted(batch.collect())


def test_count_views_stream(spark, tmp_path):
    articles = spark.createDataFrame([(1, "published"), (2, "draft")], "id long, status string")
    spark.createDataFrame([("1",), ("1",), ("2",), ("x",)], "article_id string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("article_id string").parquet(str(tmp_path / "in"))
    twins.count_views_into(s, articles, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in twins.view_table(spark, str(tmp_path / "out")).read().collect()] == [(1, 2)]


def test_decisions_in_order(spark):
    base = dict(scene="view-log", target_id="t", fp="f", ip="1", user_agent="Mozilla Chrome/1", sf_mode="navigate", sf_site="same-origin", sf_dest="d", accept_language="zh", lang="zh", screen="", perf_nav="", referer="")
    base |= dict(sample_count=10, duration_ms=5000, speed_std=1.0, jerk_mean=1.0, click_count=0, click_dwell_ms=0, keydown_count=0, key_flight_ms=0, wheel_count=0, flags=0, server_ms=0, client_ms=0, nonce=1)
    cases = [{}, {"nonce": 1}, {"nonce": 2, "server_ms": 10}, {"fp": "g", "nonce": 3, "user_agent": ""}, {"fp": "h", "nonce": 4, "duration_ms": 10}, {"fp": "", "nonce": 5}, {"client_ms": 200_000, "nonce": 6}, {"fp": "i", "nonce": 7, "scene": "share-create", "duration_ms": 10}]
    rows = [base | c | {"request_id": k} for k, c in enumerate(cases)]
    got = {r.request_id: (r.decision, r.reason) for r in risk.risk_decisions(spark.createDataFrame(rows)).collect()}
    assert got == {
        0: ("accept", "ACCEPTED"), 1: ("bad_request", "NONCE_REPLAY"), 2: ("silent", "L3_DEDUP"), 3: ("silent", "L1_UA"), 4: ("silent", "VIEWLOG_DWELL_TOO_SHORT"),
        5: ("bad_request", "FINGERPRINT_BAD"), 6: ("bad_request", "TS_SKEW"), 7: ("silent", "L4_BEHAVIOR:DWELL_TOO_SHORT"),
    }


def bursts(key, n, rng, window):
    """Events of one key in bursts with silences between them, some of exactly the window's length."""
    ts, out = 1_000_000 - 10 * window, []
    for _ in range(n):
        ts += rng.choice([0, 1, window // 3, window // 3, window - 1, window, window + 1, 5 * window])
        out.append((key, ts))
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_segments_between_silences_fold_alike(spark, broadcast, monkeypatch):
    window, rng = 60_000, random.Random(7)
    rows = bursts("hot", 600, rng, window) + bursts(None, 300, rng, window) + bursts("cold", 20, rng, window)
    df = spark.createDataFrame([(i, k, t, i % 11 > 0) for i, (k, t) in enumerate(rows)], "id long, k string, ts long, on boolean").withColumn("limit", F.lit(4).cast("long"))
    split = folds.silences(df, ["k"], "ts", window, 100, broadcast)
    marked = split.marked(df)
    assert marked.count() == df.count()
    segments = {(r.k, r.n) for r in marked.groupBy("k").agg(F.countDistinct("__segment").alias("n")).collect()}
    assert all(n == 1 if k == "cold" else n > 30 for k, n in segments)
    for make in (
        lambda s: rates.throttle_first(df, ["k"], window, active=F.col("on"), split_rows=s),
        lambda s: rates.sliding_admission(df, ["k"], 3, window, active=F.col("on"), split_rows=s),
        lambda s: rates.anchored_rate(df, ["k"], window, "limit", split_rows=s),
    ):
        assert sorted(map(repr, make(100).collect())) == sorted(map(repr, make(None).collect()))


def test_a_hot_key_lies_in_many_tasks(spark):
    rows = bursts("hot", 2000, random.Random(8), 60_000)
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "id long, k string, ts long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = lambda s: rates.throttle_first(df, ["k"], 60_000, split_rows=s).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks(None)) == 1
        many = tasks(100)
        assert len(many) == 4 and max(r["count"] for r in many) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_hot_key_needs_no_split(events):
    assert folds.silences(events, ["k"], "ts", 60_000) is None


def test_chain_and_decisions_split_alike(spark):
    rng = random.Random(9)
    rows = [(i, t, f"u{i % 2}") for i, (_, t) in enumerate(bursts("x", 400, rng, 60_000))]
    df = spark.createDataFrame(rows, "id long, ts long, user string").withColumn("ip", F.lit("1"))
    rules = [rates.Rule("ip", ("ip",), 3, 60_000), rates.Rule("user", ("user",), 2, 120_000)]
    want, got = (sorted(rates.admission_chain(df, rules, split_rows=s).collect()) for s in (None, 50))
    assert got == want and {r.refused_by for r in got} == {None, "ip", "user"}


def test_time_slices_count_what_a_window_has(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice("aab"), 10_000 + rng.randrange(-20_000, 3000) // rng.choice([1, 100])) for i in range(600)]
    df = spark.createDataFrame(rows, "comment_id long, k string, ts_s long")
    for seconds in (7, 60, 600):
        got = {r.comment_id: r.n for r in behavior.with_previous(df, ["k"], seconds).collect()}
        assert got == {i: sum(k2 == k and t - seconds <= t2 <= t and (t2, j) < (t, i) for j, k2, t2 in rows) for i, k, t in rows}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = behavior.with_previous(df.where("k = 'a'"), ["k"], 60)
        assert one.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

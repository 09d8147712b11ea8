"""Registered streams. The table arrives in slices of time; after each slice the stream is started again from its checkpoint and
runs until it has read all there is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.functions import columns as C
from inkwell.functions.checkpoint import shared_dir
from inkwell.operators import risk
from inkwell.plans import maintenance_queries, risk_queries  # noqa: F401  their SQL is used here
from inkwell.plans.registry import ORACLES, query
from inkwell.plans.views import view, with_views
from inkwell.sources.tables import AUDIT, read_risk_audit
from inkwell.sources.versions import VersionedTable
from inkwell.streaming import stateful, twins

SLICES = 3


def in_slices(spark: SparkSession, df: DataFrame, ts: str, run: Callable[[str], object], write: Callable[[DataFrame, str], None] | None = None, restart: bool = True) -> str:
    """Write ``df`` slice by slice into one folder and call ``run(base)``, which starts a stream over ``base/in``, after each; or,
    without ``restart``, after the last one."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    for k in range(SLICES):
        a, b = low + (high - low + 1) * k // SLICES, low + (high - low + 1) * (k + 1) // SLICES
        part = df.where((F.col(ts) >= a) & (F.col(ts) < b))
        (write or (lambda d, at: d.write.mode("append").parquet(at)))(part, f"{base}/in")
        if restart or k == SLICES - 1:
            run(base).awaitTermination()
    return base


def folded(spark: SparkSession, df: DataFrame, ts: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stateful stream over the slices, and what it has written in all."""

    def run(base: str):
        stream = twins.with_event_time(spark.readStream.schema(df.schema).parquet(f"{base}/in"), ts)
        out = fold(stream).drop("event_time")
        return out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()

    with stateful.rocksdb(spark):
        base = in_slices(spark, df, ts, run)
    return spark.read.parquet(f"{base}/out")


@query("stream_throttle_first", ORACLES["throttle_first_nonce"])
def _(spark, sf):
    rows = view(spark, sf, "risk_request").select("request_id", "scene", "nonce", "server_ms")
    return folded(spark, rows, "server_ms", lambda s: stateful.throttle_first(s, ["scene", "nonce"], 60_000, "server_ms", "request_id")).select("request_id", "kept")


@query("stream_anchored_rate", ORACLES["anchored_rate"])
def _(spark, sf):
    rows = view(spark, sf, "risk_request").select("request_id", "scene", "ip", "server_ms", F.lit(3).cast("long").alias("limit"))
    out = folded(spark, rows, "server_ms", lambda s: stateful.anchored_rate(s, ["scene", "ip"], 60_000, "limit", "server_ms", "request_id"))
    return out.select("request_id", "rate_count", "rate_exceeded")


@query("stream_sliding_admission", ORACLES["sliding_admission"])
def _(spark, sf):
    rows = view(spark, sf, "attempt").select("attempt_id", "username", "ts_ms")
    out = folded(spark, rows, "ts_ms", lambda s: stateful.sliding_admission(s, ["username"], 3, 120_000, "ts_ms", "attempt_id"))
    return out.select("attempt_id", "allowed", "admitted", "retry_ms", C.retry_after_seconds(F.col("retry_ms")).alias("retry_seconds"))


@query("stream_count_views", ORACLES["count_views"])
def _(spark, sf):
    article, event = view(spark, sf, "article").select("id", "status"), view(spark, sf, "view_event").select("event_id", "article_id")
    read = lambda base: spark.readStream.schema(event.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = lambda base: twins.count_views_into(read(base), article, f"{base}/views", f"{base}/checkpoint")
    base = in_slices(spark, event, "event_id", run, lambda part, at: part.coalesce(2).write.mode("append").parquet(at), restart=False)
    return twins.view_table(spark, f"{base}/views").read()


def _audit(spark, sf) -> DataFrame:
    """Risk events of every request that a hard rule or a skewed clock decides, in the columns of the audit log."""
    r = view(spark, sf, "risk_request")
    reason = F.coalesce(F.when(risk.skewed(F.col("server_ms"), F.col("client_ms")), F.lit("TS_SKEW")), risk.l1_reason(), F.lit("ACCEPTED"))
    r = r.withColumn("reject_reason", reason)
    return r.select(F.lit("risk").alias("event"), "scene", "target_id", F.col("fp").alias("fingerprint_id"), "ip", "user_agent", F.when(F.col("reject_reason") == "ACCEPTED", 0).otherwise(1).alias("decision"), "reject_reason", F.lit(80).alias("score"), F.col("client_ms").alias("client_ts"), F.col("server_ms").alias("server_ts"))


_AUDIT = f""", a as (select *, case when abs(server_ms - client_ms) > 120000 then 'TS_SKEW' else coalesce(case when user_agent = '' or {' or '.join(f"contains(lower(user_agent), '{x}')" for x in risk.UA_BLOCKED)} then 'L1_UA'
when perf_nav = 'prerender' then 'L1_PRERENDER' when sf_mode <> '' and sf_mode not in ('cors', 'same-origin', 'navigate', 'no-cors') then 'L1_HEADER' end, 'ACCEPTED') end as reject_reason from risk_request)"""


def _json(df: DataFrame, at: str) -> None:
    df.write.mode("append").json(at)


@query("stream_risk_audit", with_views("risk_request", _AUDIT + " select scene, fp as fingerprint_id, ip, user_agent, reject_reason, client_ms as client_ts, server_ms as server_ts from a"))
def _(spark, sf):
    """The log of risk events followed as JSON lines and stored as Parquet."""

    def run(base: str):
        rows = read_risk_audit(spark, f"{base}/in", stream=True).drop("ts")
        return rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    base = in_slices(spark, _audit(spark, sf), "server_ts", run, _json)
    return spark.read.schema(AUDIT).parquet(f"{base}/out").select("scene", "fingerprint_id", "ip", "user_agent", "reject_reason", "client_ts", "server_ts")


@query(
    "stream_risk_reason_stats",
    with_views("risk_request", _AUDIT + " select server_ms // 60000 * 60000 as start_ms, scene, split_part(reject_reason, ':', 1) as family, 'silent' as decision, count(*) as n from a where reject_reason <> 'ACCEPTED' group by all"),
)
def _(spark, sf):
    """Rejections by minute, kept up to date in a versioned table."""

    def run(base: str):
        at = f"{base}/stats"
        empty = spark.createDataFrame([], "start timestamp, scene string, family string, decision string, n long")
        table = VersionedTable(spark, at) if VersionedTable(spark, at).version() >= 0 else VersionedTable.create(empty, at, ["start", "scene", "family", "decision"], 8)
        log = read_risk_audit(spark, f"{base}/in", stream=True)
        rows = log.select("scene", F.col("reject_reason").alias("reason"), F.when(F.col("decision") == 0, "accept").otherwise("silent").alias("decision"), F.col("ts").alias("event_time")).withWatermark("event_time", twins.LATENESS)
        return twins.reason_stats_into(rows, table, f"{base}/checkpoint")

    base = in_slices(spark, _audit(spark, sf), "server_ts", run, _json)
    return VersionedTable(spark, f"{base}/stats").read().select(F.unix_millis("start").alias("start_ms"), "scene", "family", "decision", "n")

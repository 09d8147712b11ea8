"""Request-risk scoring over a table or stream of decoded requests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inkwell.operators.rates import SPLIT_ROWS, anchored_chain, throttle_first

# User-agent marks, fetch modes, scores and limits.
UA_BLOCKED = "bot spider crawl slurp googlebot baiduspider bingbot yandexbot duckduckbot headless phantomjs curl wget python-requests go-http-client".split()
UA_KNOWN = "chrome/ safari/ firefox/ edg/ micromessenger mqqbrowser ucbrowser".split()
FETCH_MODES = ("cors", "same-origin", "navigate", "no-cors")
L2_START, L2_MIN, BEHAVIOR_MIN, VIEW_MIN = 80, 60, 50, 60
MIN_DWELL_MS = 3000
SKEW_MS = 120_000
NONCE_TTL_MS = DEDUP_TTL_MS = 60_000
PLACEHOLDER = "0" * 32
#: scene -> requests per address and minute, per address and hour, per fingerprint and minute
RATE_LIMITS = {"share-create": (20, 120, 10), None: (30, 300, 10)}
META_BYTES, UA_BYTES = 128, 512


def _any_of(col: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(col, F.lit(p))
    return hit


def cut_bytes(col: Column, n: int) -> Column:
    """The first ``n`` bytes of the UTF-8 text; a character cut in two is dropped."""
    return F.when(F.octet_length(col) <= n, col).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(col, "UTF-8"), 1, n), "UTF-8"), "�+$", ""))


def apply_client_meta(df: DataFrame, meta: str = "client_meta") -> DataFrame:
    """Fill six blank columns from a JSON text, each value cut to 128 bytes; bad JSON is ignored."""
    fields = {"tz": "tz", "lang": "lang", "langs": "langs", "screen": "screen", "viewport": "viewport", "perfNav": "perf_nav"}
    m = F.from_json(F.col(meta), ", ".join(f"{f} string" for f in fields))
    for f, c in fields.items():
        have = F.col(c) if c in df.columns else F.lit(None).cast("string")
        df = df.withColumn(c, F.coalesce(F.nullif(have, F.lit("")), cut_bytes(m[f], META_BYTES), F.lit("")))
    return df


#: Fixed layout: 52 big-endian bytes of a 64-byte summary.
SUMMARY = np.dtype(
    [("sample_count", ">u2"), ("duration_ms", ">u4"), ("mouse_path_len_px", ">u4"), ("mouse_speed_mean", ">f4"), ("speed_std", ">f4"), ("jerk_mean", ">f4"), ("mouse_max_dy", ">f4"), ("click_count", ">u2")]
    + [("click_dwell_ms", ">u4"), ("keydown_count", ">u2"), ("key_flight_ms", ">u4"), ("wheel_count", ">u2"), ("wheel_delta_sum", ">i4"), ("focus_changes", ">u2"), ("visibility_hidden_ms", ">u4"), ("flags", ">u2")]
)
_SUMMARY_TYPES = {"u2": "int", "u4": "long", "i4": "int", "f4": "float"}
SUMMARY_SCHEMA = ", ".join(f"{n} {_SUMMARY_TYPES[SUMMARY[n].str[1:]]}" for n in SUMMARY.names)


def _decode_summaries(blob: pd.Series) -> pd.DataFrame:
    ok = blob.map(lambda b: b is not None and len(b) >= 64).to_numpy(bool)
    raw = b"".join(bytes(b[: SUMMARY.itemsize]) if good else bytes(SUMMARY.itemsize) for b, good in zip(blob, ok, strict=True))
    a = np.frombuffer(raw, SUMMARY)
    column = lambda n: pd.Series(a[n].astype("float32")) if SUMMARY[n].kind == "f" else pd.Series(a[n].astype("int64")).astype("Int64")
    return pd.DataFrame({n: column(n).where(ok) for n in SUMMARY.names})


def decode_behavior_summary(blob: Column) -> Column:
    """A 64-byte summary to a struct of its fields; null or shorter gives nulls, of a longer one the prefix counts."""
    return F.pandas_udf(_decode_summaries, SUMMARY_SCHEMA)(blob)


def l1_reason() -> Column:
    """The first hard rule that a request breaks, else null. Reads user_agent, perf_nav and sf_mode."""
    ua = F.coalesce("user_agent", F.lit(""))
    mode = F.coalesce("sf_mode", F.lit(""))
    return F.when((ua == "") | _any_of(F.lower(ua), UA_BLOCKED), "L1_UA").when(F.col("perf_nav") == "prerender", "L1_PRERENDER").when((mode != "") & ~mode.isin(*FETCH_MODES), "L1_HEADER")


def l1_blocklist(df: DataFrame) -> DataFrame:
    return df.withColumn("l1_reason", l1_reason())


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long")


def l2_score() -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    primary = F.regexp_replace(F.lower("lang"), "^([^-]+)-.*$", "$1")
    both = ~blank("lang") & ~blank("accept_language")
    same = F.contains(F.lower("accept_language"), primary)
    w, h = (F.regexp_extract("screen", r"^([0-9]+)x([0-9]+)$", k).try_cast("long") for k in (1, 2))
    internal = (F.col("sf_site") == "same-origin") | (blank("sf_site") & F.startswith(F.coalesce("referer", F.lit("")), F.lit("https://")))
    ua = F.lower(F.coalesce("user_agent", F.lit("")))
    score = (
        F.lit(L2_START)
        - points(both & ~same, 30)
        - points((w < 320) | (h < 480), 20)
        - sum((points(blank(c), 15) for c in ("sf_mode", "sf_site", "sf_dest", "accept_language")), F.lit(0))
        + points(internal, 5)
        + points(both & same, 3)
        + points(_any_of(ua, UA_KNOWN), 3)
        + points(F.col("perf_nav") == "navigate", 5)
    )
    return _clamped(score)


def behavior_columns() -> tuple[Column, Column]:
    """Behaviour score and reason of a summary; a null ``duration_ms`` means that there is none."""
    c = F.col
    total = c("sample_count") + c("click_count") + c("keydown_count") + c("wheel_count")
    left = c("flags").bitwiseAND(3) != 0
    enough = c("sample_count") > 20
    rules = [
        ((c("speed_std") < 0.05) & enough, -40, "SPEED_CONST"),
        ((c("jerk_mean") < 0.001) & enough, -30, "JERK_LOW"),
        ((c("click_count") > 0) & (c("click_dwell_ms") < 30), -25, "CLICK_FAST"),
        ((c("keydown_count") > 5) & (c("key_flight_ms") > 0) & (c("key_flight_ms") < 30), -30, "KEY_FAST"),
        (left, 10, "HUMAN_FOCUS_HINT"),
    ]
    full = _clamped(F.lit(100) + sum((F.when(cond, n).otherwise(0) for cond, n, _ in rules), F.lit(0)))
    names = F.concat_ws(",", *[F.when(cond, name) for cond, _, name in rules])
    text = F.concat(F.lit("score="), full.cast("string"), F.when(names != "", F.concat(F.lit("|"), names)).otherwise(""))
    grades = [
        (c("duration_ms").isNull(), 30, "NO_SUMMARY"),
        (c("duration_ms") < MIN_DWELL_MS, 0, "DWELL_TOO_SHORT"),
        ((total == 0) & (c("flags") == 0) & (c("duration_ms") >= 2500), 30, "ALL_ZERO_LONG"),
        (left & (c("sample_count") < 5), 70, "EARLY_LEAVE_OK"),
        ((c("sample_count") < 5) & (total > 0), 60, "WEAK_SAMPLES"),
        (total == 0, 50, "NO_INTERACTION"),
    ]
    score, reason = F, F
    for cond, n, name in grades:
        score, reason = score.when(cond, n), reason.when(cond, name)
    return score.otherwise(full).cast("long"), reason.otherwise(text)


def behavior_score(df: DataFrame) -> DataFrame:
    score, reason = behavior_columns()
    return df.withColumn("behavior_score", score).withColumn("behavior_reason", reason)


def combined_score(scene: Column, l2: Column, behavior: Column) -> Column:
    """View requests weigh 70 to 30, others 60 to 40, in whole numbers."""
    weighed = F.when(scene == "view-log", l2 * 70 + behavior * 30).otherwise(l2 * 60 + behavior * 40)
    return _clamped(F.floor(weighed / 100))


def skewed(server_ms: Column, client_ms: Column, tolerance: int = SKEW_MS) -> Column:
    return F.abs(server_ms - client_ms) > tolerance


def _limit(k: int, scale: dict | None = None) -> Column:
    limits = scale or RATE_LIMITS
    out = F
    for scene, values in limits.items():
        if scene is not None:
            out = out.when(F.col("scene") == scene, values[k])
    return (out.otherwise(limits[None][k]) if out is not F else F.lit(limits[None][k])).cast("long")


def risk_rate_chain(df: DataFrame, limits: dict | None = None, active: Column | None = None, ts: str = "server_ms", tie: str = "request_id", split_rows: int | None = SPLIT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Address per minute, address per hour, fingerprint per minute; the first one exceeded stops the chain, so later
    counters do not see the request. The two windows of an address are one fold. Adds ``rate_reason`` (null if none)."""
    out = df.withColumn("rate_reason", F.lit(None).cast("string"))
    on, source = active if active is not None else F.lit(True), source if source is not None else df
    for column, windows, first, reason in (("ip", (60_000, 3_600_000), 0, "L3_RATE_IP"), ("fp", (60_000,), 2, "L3_RATE_FP")):
        names = [f"__limit{k}" for k in range(len(windows))]
        for k, name in enumerate(names):
            out = out.withColumn(name, _limit(first + k, limits))
        out = anchored_chain(out, ["scene", column], windows, names, ts, tie, on & F.col("rate_reason").isNull(), "__over", split_rows, source)
        out = out.withColumn("rate_reason", F.when(F.col("__over").isNotNull(), reason).otherwise(F.col("rate_reason"))).drop("__over", *names)
    return out


def risk_decisions(requests: DataFrame, limits: dict | None = None, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Every request's ``decision``, ``reason`` and ``score``, through all layers in order.

    A request that a layer decides rides along without touching the state of later layers. ``token_target_id``, where
    there is one, must equal ``target_id``.
    """
    columns = requests.columns
    target = (F.col("token_target_id") != F.col("target_id")) if "token_target_id" in columns else F.lit(False)
    bad = F.when(F.coalesce("fp", F.lit("")) == "", "FINGERPRINT_BAD").when(target, "TARGET_MISMATCH").when(skewed(F.col("server_ms"), F.col("client_ms")), "TS_SKEW")
    df = requests.withColumn("reason", bad).withColumn("decision", F.when(F.col("reason").isNotNull(), "bad_request")).withColumn("score", F.lit(0).cast("long"))

    def settle(df: DataFrame, reason: Column, decision: str, score: Column | None = None) -> DataFrame:
        fresh = F.col("reason").isNull() & reason.isNotNull()
        df = df.withColumn("__r", F.when(fresh, reason))
        if score is not None:
            df = df.withColumn("score", F.when(F.col("__r").isNotNull(), score).otherwise(F.col("score")))
        return df.withColumn("decision", F.when(F.col("__r").isNotNull(), decision).otherwise(F.col("decision"))).withColumn("reason", F.coalesce("reason", "__r")).drop("__r")

    alive = F.col("reason").isNull()
    df = throttle_first(df, ["scene", "nonce"], NONCE_TTL_MS, "server_ms", "request_id", alive, "__kept", split_rows, requests)
    df = settle(df, F.when(~F.col("__kept"), "NONCE_REPLAY"), "bad_request").drop("__kept")
    df = settle(df, l1_reason(), "silent", F.lit(L2_START).cast("long"))
    df = df.withColumn("__l2", l2_score()).withColumn("score", F.when(alive, F.col("__l2")).otherwise(F.col("score")))
    df = settle(df, F.when(F.col("__l2") < L2_MIN, "L2_SCORE"), "silent")
    df = risk_rate_chain(df, limits, alive, split_rows=split_rows, source=requests)
    df = settle(df, F.col("rate_reason"), "rate_limited").drop("rate_reason")
    score, reason = behavior_columns()
    df = df.withColumn("__b", score).withColumn("__br", reason)
    real, viewing = F.col("target_id") != PLACEHOLDER, F.col("scene") == "view-log"
    df = settle(df, F.when(real & viewing & (F.col("__br") == "DWELL_TOO_SHORT"), "VIEWLOG_DWELL_TOO_SHORT"), "silent")
    weighed = F.when(real, combined_score(F.col("scene"), F.col("__l2"), F.col("__b"))).otherwise(_clamped(F.floor((F.col("__l2") * 60 + F.col("__b") * 40) / 100)))
    df = df.withColumn("score", F.when(alive, weighed).otherwise(F.col("score")))
    df = settle(df, F.when(real & viewing & (F.col("score") < VIEW_MIN), F.concat(F.lit("VIEWLOG_COMBINED:"), "__br")).when(real & ~viewing & (F.col("__b") < BEHAVIOR_MIN), F.concat(F.lit("L4_BEHAVIOR:"), "__br")), "silent")
    df = throttle_first(df, ["scene", "fp", "target_id"], DEDUP_TTL_MS, "server_ms", "request_id", alive & real, "__kept", split_rows, requests)
    df = settle(df, F.when(~F.col("__kept"), "L3_DEDUP"), "silent")
    df = df.withColumn("decision", F.coalesce("decision", F.lit("accept"))).withColumn("reason", F.coalesce("reason", F.lit("ACCEPTED")))
    return df.select(*columns, "decision", "reason", "score")


def audit_level(df: DataFrame) -> DataFrame:
    """Log level of a decision, and the user agent cut to 512 bytes."""
    expected = F.col("reason").isin("L1_UA", "L1_PRERENDER", "L1_HEADER", "L3_DEDUP", "VIEWLOG_DWELL_TOO_SHORT") | F.startswith("reason", F.lit("VIEWLOG_COMBINED:"))
    level = F.when((F.col("decision") == "accept") | ((F.col("decision") == "silent") & expected), "info").otherwise("warn")
    return df.withColumn("level", level).withColumn("user_agent", cut_bytes(F.col("user_agent"), UA_BYTES))


def reason_family(col: Column) -> Column:
    return F.substring_index(col, ":", 1)


def risk_reason_stats(audit: DataFrame) -> DataFrame:
    """Rejections by scene, reason family and decision."""
    return audit.where(F.col("decision") != "accept").groupBy("scene", reason_family(F.col("reason")).alias("family"), "decision").agg(F.count("*").alias("n"))


def redact_log(df: DataFrame, query: str = "query", headers: str | None = None) -> DataFrame:
    """Values of sensitive query parameters and headers replaced by a mark; names stay, order stays."""

    def sensitive(name: Column) -> Column:
        n = F.replace(F.lower(name), F.lit("_"), F.lit("-"))
        exact = n.isin("code", "otp", "totp", "password", "authorization", "cookie", "set-cookie", "loginchallenge", "login-challenge")
        return exact | _any_of(n, ["token", "secret", "password", "code", "credential"])

    def one(pair: Column) -> Column:
        name = F.substring_index(pair, "=", 1)
        return F.when(sensitive(F.coalesce(F.try_url_decode(name), name)), F.concat(name, F.lit("=[REDACTED]"))).otherwise(pair)

    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    out = df.withColumn(query, F.array_join(F.transform(parts, one), "&"))
    if headers:
        out = out.withColumn(headers, F.transform_values(headers, lambda k, v: F.when(sensitive(k), F.lit("[REDACTED]")).otherwise(v)))
    return out

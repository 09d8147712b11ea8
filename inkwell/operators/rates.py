"""Rate analysis: replay of limiters over event tables. Times are milliseconds unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from inkwell.functions import folds

#: Milliseconds of the lock ladder, 5 min, 15 min, 1 h, 6 h.
LADDER = (300_000, 900_000, 3_600_000, 21_600_000)


@dataclass(frozen=True)
class Rule:
    name: str
    keys: tuple[str, ...]
    limit: int
    window_ms: int


#: Rows of a key from which on it is cut at silences and folded in many tasks.
SPLIT_ROWS = 1_000_000


def silences(source: DataFrame | None, df: DataFrame, keys: Sequence[str], ts: str, reset: int, split_rows: int | None) -> folds.Silences | None:
    """The segments of hot keys, found in ``source``: the rows before any fold, if ``df`` is the result of some. None: no splitting."""
    return folds.silences(source if source is not None else df, keys, ts, reset, split_rows) if split_rows is not None else None


# Per scene the limits in the order in which they are checked: name, key columns, events, seconds.
LIMITS = {
    "account_login": [("ip", ("ip",), 8, 600), ("username", ("username",), 5, 1800), ("username_ip", ("username", "ip"), 3, 600)],
    "bind_dynamic_code": [("ip", ("ip",), 6, 600), ("challenge", ("challenge",), 4, 180)],
    "verify_dynamic_code": [("ip", ("ip",), 10, 600), ("challenge", ("challenge",), 4, 180)],
    "comment_submit": [("ip", ("ip",), 20, 600), ("user", ("user_id",), 10, 300), ("user_article", ("user_id", "article_id"), 5, 300)],
    "comment_report": [("ip", ("ip",), 30, 86_400), ("user", ("user_id",), 10, 86_400), ("ip_comment", ("ip", "comment_id"), 2, 86_400)],
    "bug_feedback": [("ip", ("ip",), 3, 3600)],
}


def rules_for(scene: str, settings: dict | None = None) -> list[Rule]:
    """The rules of a scene for :func:`admission_chain`. ``settings`` may be ``disabled`` (no rules) and may give a rule's ``limit`` and
    ``window_seconds``; what is absent or not positive is the scene's own."""
    settings = settings or {}
    if settings.get("disabled"):
        return []
    given = lambda name, field, default: value if (value := (settings.get(name) or {}).get(field) or 0) > 0 else default
    return [Rule(name, keys, given(name, "limit", limit), 1000 * given(name, "window_seconds", seconds)) for name, keys, limit, seconds in LIMITS[scene]]


def throttle_first(df: DataFrame, keys: Sequence[str], ttl: int, ts: str = "ts", tie: str = "id", active=None, out: str = "kept", split_rows: int | None = SPLIT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Add ``kept``: the first event of a key and each one more than ``ttl`` after the last kept one. A key of more than
    ``split_rows`` rows is folded in segments, between silences that reset it."""
    split = silences(source, df, keys, ts, ttl, split_rows)
    return folds.ordered_fold(df, keys, [ts, tie], [ts], f"{out} boolean", folds.throttle_step(ttl), active, split)


def anchored_rate(df: DataFrame, keys: Sequence[str], window: int, threshold: str, ts: str = "ts", tie: str = "id", active=None, out: str = "rate", split_rows: int | None = SPLIT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Add ``<out>_count`` and ``<out>_exceeded``: the event's number in its key's window and whether it is over the
    threshold column. Hot keys are folded in segments."""
    split = silences(source, df, keys, ts, window, split_rows)
    return folds.ordered_fold(df, keys, [ts, tie], [ts, threshold], f"{out}_count long, {out}_exceeded boolean", folds.anchored_step(window), active, split)


def anchored_chain(df: DataFrame, keys: Sequence[str], windows: Sequence[int], thresholds: Sequence[str], ts: str = "ts", tie: str = "id", active=None, out: str = "exceeded", split_rows: int | None = SPLIT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the number of the first of several windows of one key that the event exceeds, null if none. One shuffle for all."""
    split = silences(source, df, keys, ts, max(windows), split_rows)
    return folds.ordered_fold(df, keys, [ts, tie], [ts, *thresholds], f"{out} int", folds.anchored_chain_step(windows), active, split)


def sliding_admission(df: DataFrame, keys: Sequence[str], limit: int, window: int, ts: str = "ts", tie: str = "id", active=None, prefix: str = "", split_rows: int | None = SPLIT_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Add ``allowed``, ``admitted`` (admitted events in the window) and ``retry_ms`` (at least a second when refused). Hot keys are
    folded in segments."""
    split = silences(source, df, keys, ts, window, split_rows)
    return folds.ordered_fold(df, keys, [ts, tie], [ts], f"{prefix}allowed boolean, {prefix}admitted long, {prefix}retry_ms long", folds.sliding_step(limit, window), active, split)


def admission_chain(df: DataFrame, rules: Sequence[Rule], ts: str = "ts", tie: str = "id", split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Rules in order up to the first refusal; earlier rules keep their admission. A rule without key columns, limit or
    window is skipped, and so is a row whose key is null. Adds ``refused_by`` (null if admitted) and ``retry_ms``.

    One shuffle per rule, as every rule has its own key. Refused rows ride along without touching later state. Hot keys are cut
    at silences of all their rows, found before the first rule.
    """
    out = df.withColumn("refused_by", F.lit(None).cast("string")).withColumn("retry_ms", F.lit(0).cast("long"))
    for r in rules:
        if not r.keys or r.limit <= 0 or r.window_ms <= 0:
            continue
        alive = F.col("refused_by").isNull()
        for k in r.keys:
            alive = alive & F.col(k).isNotNull()
        out = sliding_admission(out, r.keys, r.limit, r.window_ms, ts, tie, alive, "__r_", split_rows, df)
        no = F.coalesce(~F.col("__r_allowed"), F.lit(False))
        out = out.withColumn("refused_by", F.when(no, r.name).otherwise(F.col("refused_by"))).withColumn("retry_ms", F.when(no, F.col("__r_retry_ms")).otherwise(F.col("retry_ms")))
        out = out.drop("__r_allowed", "__r_admitted", "__r_retry_ms")
    return out


# A lock's level outlives every silence in what it reports, and an ended challenge stays ended: these two are not split.


def failure_backoff(df: DataFrame, keys: Sequence[str], threshold: int, counter_ttl: int, level_ttl: int, ladder: Sequence[int] = LADDER, ts: str = "ts", tie: str = "id", success: str = "success") -> DataFrame:
    """Add ``outcome`` (ok, failed, lock, locked), ``level`` and ``wait_ms``."""
    return folds.ordered_fold(df, keys, [ts, tie], [ts, success], "outcome string, level long, wait_ms long", folds.backoff_step(threshold, counter_ttl, level_ttl, ladder))


def challenge_failures(df: DataFrame, keys: Sequence[str], threshold: int, window: int, ts: str = "ts", tie: str = "id", success: str = "success") -> DataFrame:
    """Add ``outcome`` (ok, failed, invalidated, void) and ``failures``."""
    return folds.ordered_fold(df, keys, [ts, tie], [ts, success], "outcome string, failures long", folds.challenge_step(threshold, window))

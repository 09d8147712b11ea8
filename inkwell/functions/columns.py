"""Column functions shared by the operators: excerpts, times, handles, levels, keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "Asia/Shanghai"
#: Time layouts by precision.
LAYOUTS = {"day": "yyyy-MM-dd", "minute": "yyyy-MM-dd HH:mm", "second": "yyyy-MM-dd HH:mm:ss"}


def truncate_runes(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def excerpt(col: Column, n: int = 48) -> Column:
    """White space collapsed, cut at ``n`` code points, with dots only if something was cut. Null stays null."""
    flat = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def format_time(col: Column, precision: str, source_zone: str | None = "UTC") -> Column:
    """Local business time; ``source_zone`` None says that the clock already shows it."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(col, source_zone), ZONE) if source_zone else col
    return F.date_format(local, LAYOUTS[precision])


def parse_time_or_minute(col: Column) -> Column:
    """A time to the second, or else to the minute; blank is null, and so is what has neither layout."""
    text = F.nullif(F.trim(col), F.lit(""))
    return F.coalesce(F.try_to_timestamp(text, F.lit(LAYOUTS["second"])), F.try_to_timestamp(text, F.lit(LAYOUTS["minute"])))


def normalize_handle(col: Column) -> Column:
    """Trimmed; 1 to 99999 padded to five digits, other positive numbers in canonical form, anything else unchanged."""
    text = F.trim(col)
    number = F.when(text.rlike("^[0-9]+$"), text).try_cast("decimal(38,0)").try_cast("long")
    return F.when(number.between(1, 99999), F.lpad(number.cast("string"), 5, "0")).when(number > 0, number.cast("string")).otherwise(text)


def pad_handle(number: Column) -> Column:
    return F.when(number < 100000, F.lpad(number.cast("string"), 5, "0")).otherwise(number.cast("string"))


def effective_disabled(flag: Column, until: Column, now) -> Column:
    """Disabled by the flag until a time that is open or still to come."""
    return F.coalesce(flag, F.lit(False)) & (until.isNull() | (until > F.lit(now).cast(until_type())))


def until_type() -> str:
    return "timestamp_ntz"


#: Level names and their aliases.
LEVELS = {"block": "block", "reject": "block", "rejected": "block", "review": "review", "pending": "review", "notice": "notice", "allow": "allow", "approved": "allow"}


def normalize_level(col: Column) -> Column:
    """The level's own name, blank for an unknown one or null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.lower(F.trim(col))], F.lit(""))


def retry_after_seconds(ms: Column) -> Column:
    """Whole seconds, rounded up, at least one."""
    return F.greatest(F.ceil(ms / 1000).cast("long"), F.lit(1).cast("long"))


def rate_key(*cols: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased identity parts; a blank part counts as ``unknown``."""
    parts = [F.coalesce(F.nullif(F.lower(F.trim(c.cast("string"))), F.lit("")), F.lit("unknown")) for c in cols]
    return F.sha2(F.concat_ws(":", *[F.sha2(p, 256) for p in parts]) if len(parts) > 1 else parts[0], 256)

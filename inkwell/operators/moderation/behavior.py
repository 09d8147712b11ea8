"""Behaviour signals: frequency, duplicates, near duplicates. Times are whole seconds; history is the comment table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from inkwell.functions import folds
from inkwell.functions.text import simhash64


def with_previous(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts_s", tie: str = "comment_id", out: str = "n") -> DataFrame:
    """Add ``out``: earlier rows of the key at or after ``ts - seconds``. Of rows in the same second, those of a smaller id are
    earlier.

    Time is cut into slices as long as the window, and (key, slice) is what rows are dealt by: a row counts in its own slice,
    and a narrow copy of it is seen from the next one. A hot key is as many tasks as slices.
    """
    width = F.lit(seconds + 1).cast("long")
    at = F.col(ts) - F.pmod(F.col(ts), width)
    own = df.withColumn("__slice", at).withColumn("__own", F.lit(True))
    seen = df.select(*keys, ts, tie, (at + width).alias("__slice"), F.lit(False).alias("__own"))
    both = own.unionByName(seen, allowMissingColumns=True)
    w = W.partitionBy(*keys, "__slice").orderBy(ts)
    before = F.count("*").over(w.rangeBetween(-seconds, -1))
    same = F.row_number().over(W.partitionBy(*keys, "__slice", ts).orderBy(tie)) - 1
    return both.withColumn(out, before + same).where("__own").drop("__slice", "__own")


def frequency_signals(comments: DataFrame, user_seconds: int = 600, user_at: int = 6, ip_seconds: int = 600, ip_at: int = 12) -> DataFrame:
    """``(comment_id, category)``: too many comments of a user or address, this one included. User 0 and blank
    addresses are not looked at."""
    user = with_previous(comments.where("user_id <> 0").select("comment_id", "user_id", "ts_s"), ["user_id"], user_seconds)
    ip = with_previous(comments.where("trim(ip) <> ''").select("comment_id", "ip", "ts_s"), ["ip"], ip_seconds)
    return user.where(F.col("n") + 1 >= user_at).select("comment_id", F.lit("user_frequency").alias("category")).unionByName(ip.where(F.col("n") + 1 >= ip_at).select("comment_id", F.lit("ip_frequency").alias("category")))


def duplicate_counts(comments: DataFrame, gap: int = 86400, ts: str = "ts_s", tie: str = "comment_id") -> DataFrame:
    """Add ``observed``: the comment's number in its session of equal texts by one user under one article. Every record
    renews the session, which ends after ``gap`` seconds of silence; a gap of exactly that length still belongs. ``text_hash``, the
    SHA-256 of ``compact``, may stand in its place."""
    rows = comments.where("user_id <> 0 and article_id <> 0").withColumn("__text", F.col("text_hash") if "text_hash" in comments.columns else F.sha2("compact", 256))
    w = W.partitionBy("user_id", "article_id", "__text").orderBy(ts, tie)
    fresh = F.when(F.col(ts) - F.lag(ts).over(w) > gap, 1).otherwise(0)
    rows = rows.withColumn("__new", fresh).withColumn("__session", F.sum("__new").over(w))
    return rows.withColumn("observed", F.row_number().over(W.partitionBy("user_id", "article_id", "__text", "__session").orderBy(ts, tie)).cast("long")).drop("__text", "__new", "__session")


def duplicate_signals(comments: DataFrame, gap: int = 86400, review_at: int = 2, block_at: int = 4) -> DataFrame:
    rows = duplicate_counts(comments, gap).where(F.col("observed") >= review_at)
    block = F.col("observed") >= block_at
    return rows.select("comment_id", F.when(block, "block").otherwise("review").alias("level"), F.when(block, "duplicate_block").otherwise("duplicate_review").alias("evidence"))


def near_duplicate_counts(comments: DataFrame, seconds: int = 86400, max_distance: int = 10, min_runes: int = 12, max_samples: int = 100, max_percent: int = 30, ts: str = "ts_s", tie: str = "comment_id", split_rows: int | None = 1_000_000) -> DataFrame:
    """``(comment_id, similar)``: earlier comments of the user under the article that are nearly equal, of comments with
    enough text.

    Of the window's earlier comments with enough text the newest ``max_samples`` count. One fold over each pair's comments
    in order, which holds those samples and no more; no comment is paired with all that came before it. A pair with more than
    ``split_rows`` comments is cut at silences of more than ``seconds``. ``runes`` and ``simhash`` of ``compact`` may stand in its place.
    """
    known = "simhash" in comments.columns
    rows = comments.where("user_id <> 0 and article_id <> 0").withColumn("__runes", F.col("runes") if known else F.length("compact")).where(F.col("__runes") >= min_runes)
    rows = rows.select("comment_id", "user_id", "article_id", F.col(ts).alias("__ts"), F.col(tie).alias("__tie"), "__runes", (F.col("simhash") if known else simhash64(F.col("compact"))).alias("__hash"))
    step = folds.samples_step(seconds, max_distance, max_samples, max_percent)
    pair = ["user_id", "article_id"]
    split = folds.silences(comments.where("user_id <> 0 and article_id <> 0").select(*pair, F.col(ts).alias("__ts")), pair, "__ts", seconds, split_rows) if split_rows is not None else None
    return folds.ordered_fold(rows, pair, ["__ts", "__tie"], ["__ts", "__runes", "__hash"], "similar long", step, None, split).select("comment_id", "similar")


def near_duplicate_signals(comments: DataFrame, review_at: int = 2, **limits: int) -> DataFrame:
    return near_duplicate_counts(comments, **limits).where(F.col("similar") + 1 >= review_at).select("comment_id", "similar")

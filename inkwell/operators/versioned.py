"""Table maintenance on :class:`inkwell.sources.versions.VersionedTable`: the functions of :mod:`inkwell.operators.maintenance` on
the rows that a change names, committed as deltas. Each returns the new version, or one a table.

What decides is the same code; here stand the rows that it needs and the columns that it may set.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from inkwell.operators import maintenance as M
from inkwell.sources.versions import VersionedTable


def _ids(ids: DataFrame, name: str = "id") -> DataFrame:
    return ids.select(F.col(ids.columns[0]).alias(name)).distinct()


def upsert_users(users: VersionedTable, changes: DataFrame) -> int:
    """Keyed by (provider, provider_user_id)."""
    names = [n for n in ("avatar_url", "profile_url", "email", "update_time", "display_name", "handle") if n in users.columns()]
    return users.apply(lambda rows: M.upsert_users(rows, changes), changes, names)


def upsert_images(images: VersionedTable, changes: DataFrame) -> int:
    """Keyed by object_key."""
    names = [n for n in changes.columns if n in images.columns() and n not in ("id", "object_key", "create_time")]
    return images.apply(lambda rows: M.upsert_images(rows, changes), changes, names)


def insert_ignore_images(images: VersionedTable, changes: DataFrame) -> int:
    """Keyed by object_key."""
    return images.apply(lambda rows: M.insert_ignore_images(rows, changes), changes)


def publish_drafts(articles: VersionedTable, ids: DataFrame, now: datetime) -> int:
    wanted = _ids(ids)
    edited = articles.lookup(wanted).where("status = 'draft' and published_id is not null").select(F.col("published_id").alias("id"))
    return articles.apply(lambda rows: M.publish_drafts(rows, wanted, now), wanted.union(edited).distinct())


def delete_articles(articles: VersionedTable, refs: VersionedTable, comments: VersionedTable, ids: DataFrame) -> tuple[int, int, int]:
    """Articles go last, so that a run that breaks off can be repeated: what is left to do is found by them."""
    wanted = _ids(ids)
    gone = articles.lookup(wanted).where("status = 'published' and tag_id is not null").select("id")
    none = lambda rows: rows.where(F.lit(False))
    by_article = gone.withColumnRenamed("id", "article_id")
    r = refs.apply(none, by_article, by=["article_id"])
    c = comments.apply(none, by_article, by=["article_id"])
    articles.apply(none, gone.withColumnRenamed("id", "published_id"), by=["published_id"])
    return articles.apply(none, gone), r, c


def delete_comments(comments: VersionedTable, ids: DataFrame) -> int:
    wanted = _ids(ids)
    return comments.apply(lambda rows: M.delete_comments(rows, wanted), wanted)


def delete_images(images: VersionedTable, refs: VersionedTable, ids: DataFrame) -> tuple[int, int]:
    """Images are keyed by object_key and found by id; references go first."""
    wanted = _ids(ids)
    none = lambda rows: rows.where(F.lit(False))
    r = refs.apply(none, wanted.withColumnRenamed("id", "image_id"), by=["image_id"])
    return images.apply(none, wanted, by=["id"]), r


def write_back_views(articles: VersionedTable, counts: DataFrame) -> int:
    return articles.apply(lambda rows: M.write_back_views(rows, counts), counts.select(F.col("article_id").alias("id")), ["view_num"])


def set_comment_status(comments: VersionedTable, ids: DataFrame, status: str, now: datetime | None = None) -> int:
    wanted = _ids(ids)
    names = ["status", *(n for n in ("update_time",) if n in comments.columns())]
    return comments.apply(lambda rows: M.set_comment_status(rows, wanted, status, now), wanted, names)


def set_permission(users: VersionedTable, changes: DataFrame) -> int:
    """Keyed by id."""
    names = [n for n in ("comment_disabled", "disabled_until", "disabled_reason") if n in changes.columns and n in users.columns()]
    return users.apply(lambda rows: M.set_permission(rows, changes), changes, names)


def bump_session(users: VersionedTable, ids: DataFrame) -> int:
    """Keyed by id."""
    wanted = _ids(ids)
    return users.apply(lambda rows: M.bump_session(rows, wanted), wanted, ["session_version"])


def resolve_reports(reports: VersionedTable, comments: VersionedTable, actions: DataFrame) -> tuple[int, int]:
    """Comments first: while a report is pending, the same actions can be given again."""
    named = actions.select("comment_id").distinct()
    pending = reports.read().join(named, "comment_id", "left_semi")
    found = comments.apply(lambda rows: M.resolve_reports(pending, rows, actions)[1], named.withColumnRenamed("comment_id", "id"), ["status"])
    none = pending.select(F.col("comment_id").alias("id"), F.lit("").alias("status")).where(F.lit(False))
    return reports.apply(lambda rows: M.resolve_reports(rows, none, actions)[0], named, ["status"], by=["comment_id"]), found


def escalate_reported(reports: DataFrame, comments: VersionedTable, threshold: int = 3) -> int:
    pending = reports.where(F.col("status") == "pending").groupBy(F.col("comment_id").alias("id")).count()
    return comments.apply(lambda rows: M.escalate_reported(reports, rows, threshold), pending.where(F.col("count") >= threshold), ["status"])


def append_comments(comments: VersionedTable, decided: DataFrame, users: DataFrame) -> int:
    """An id that is already there is an error; nothing of the table is read but the buckets of the new ids."""
    M.require(comments.lookup(decided), "repeated comment")
    return comments.apply(lambda rows: M.append_comments(rows, decided, users), decided)


def append_reports(reports: VersionedTable, new: DataFrame) -> int:
    """Keyed by (comment_id, reporter_id)."""
    return reports.apply(lambda rows: M.append_reports(rows, new), new)

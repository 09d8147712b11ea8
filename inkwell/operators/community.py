"""Users, comments, reports and image usage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions.columns import effective_disabled, excerpt, pad_handle
from inkwell.operators.catalog import page_of, rows_by_keys


def user_list(users: DataFrame, comments: DataFrame, now: datetime, handle: str = "", name: str = "", provider: str = "", permission: str = "", page: int = 1, page_size: int = 10) -> DataFrame:
    """Users with their comment count and last comment. ``name`` is a LIKE fragment whose wildcards stay wildcards.
    Comments are aggregated before the join, and only for the filtered users' key."""
    rows = users
    if handle:
        rows = rows.where(F.col("handle") == handle)
    if name:
        rows = rows.where(F.col("display_name").like(f"%{name}%"))
    if provider:
        rows = rows.where(F.col("provider") == provider)
    off = effective_disabled(F.col("comment_disabled"), F.col("disabled_until"), now)
    if permission:
        rows = rows.where({"disabled": off, "normal": ~off}[permission])
    stats = comments.groupBy("user_id").agg(F.count("*").alias("comment_count"), F.max("create_time").alias("last_comment_time"))
    rows = rows.join(stats, rows.id == stats.user_id, "left").drop("user_id").withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))
    return page_of(rows, [F.desc("create_time"), F.desc("id")], page, page_size)


def effective_permission(users: DataFrame, now: datetime) -> DataFrame:
    """``disabled`` at ``now``, with its end, which is null when not disabled."""
    off = effective_disabled(F.col("comment_disabled"), F.col("disabled_until"), now)
    out = users.withColumn("disabled", off).withColumn("disabled_until", F.when(off, F.col("disabled_until")))
    return out.withColumn("disabled_reason", F.when(off, F.col("disabled_reason")).otherwise("")) if "disabled_reason" in users.columns else out


def next_user_handle(users: DataFrame, offset: int = 0) -> DataFrame:
    """One row: the handle after the largest numeric one, moved on by ``offset``."""
    number = F.when(F.col("handle").rlike("^[0-9]+$"), F.col("handle")).try_cast("long")
    top = users.agg(F.coalesce(F.max(F.when(number > 0, number)), F.lit(0).cast("long")).alias("top"))
    return top.select(pad_handle(F.col("top") + offset + 1).alias("handle"))


def _users(users: DataFrame, prefix: str, key: str) -> DataFrame:
    return users.select(F.col("id").alias(key), F.col("display_name").alias(f"{prefix}_name"), F.col("handle").alias(f"{prefix}_handle"))


def comment_admin_list(comments: DataFrame, articles: DataFrame, users: DataFrame, article_id: int | None = None, title: str = "", content: str = "", status: str = "", handle: str = "", start: datetime | None = None, end: datetime | None = None, page: int = 1, page_size: int = 10) -> DataFrame:
    """Comments with article, author and replied user; filters are joined by and, both ends of the time count."""
    if start is not None and end is not None and end < start:
        raise ValueError("the end is before the start")
    rows = comments
    if article_id is not None:
        rows = rows.where(F.col("article_id") == article_id)
    if content:
        rows = rows.where(F.contains(F.lower("content"), F.lit(content.lower())))
    if status:
        rows = rows.where(F.col("status") == status)
    if start is not None:
        rows = rows.where(F.col("create_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("create_time") <= F.lit(end).cast("timestamp_ntz"))
    rows = rows.join(articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title")), "article_id", "left")
    if title:
        rows = rows.where(F.contains(F.lower("article_title"), F.lit(title.lower())))
    rows = rows.join(_users(users, "author", "user_id"), "user_id", "left")
    if handle:
        rows = rows.where(F.col("author_handle") == handle)
    rows = rows.join(_users(users, "reply_to", "reply_to_user_id"), "reply_to_user_id", "left")
    if "moderation_reasons" in comments.columns:
        rows = rows.withColumn("moderation_reasons", F.when(F.col("status").isin("pending", "rejected"), F.col("moderation_reasons")))
    return page_of(rows, [F.desc("create_time"), F.desc("id")], page, page_size)


def approved(comments: DataFrame) -> DataFrame:
    return comments.where(F.col("status") == "approved")


def approved_comments(comments: DataFrame, users: DataFrame, article_ids: DataFrame | None = None) -> DataFrame:
    """Approved comments with author, replied user and an excerpt of the replied comment, oldest first."""
    rows = approved(comments)
    if article_ids is not None:
        rows = rows_by_keys(rows, article_ids, "article_id")
    said = comments.select(F.col("id").alias("reply_to_comment_id"), excerpt(F.col("content")).alias("reply_to_excerpt"))
    rows = rows.join(_users(users, "author", "user_id"), "user_id", "left").join(_users(users, "reply_to", "reply_to_user_id"), "reply_to_user_id", "left")
    rows = rows.join(said, "reply_to_comment_id", "left")
    return rows.select("id", "article_id", "parent_id", "content", "create_time", "author_name", "author_handle", "reply_to_name", "reply_to_excerpt").orderBy("create_time", "id")


def approved_parents(comments: DataFrame, article_ids: DataFrame | None = None, page: int = 1, page_size: int = 10) -> DataFrame:
    """A page of approved top-level comments of every article at once, oldest first, with the article's total."""
    rows = approved(comments).where(F.col("parent_id") == 0)
    if article_ids is not None:
        rows = rows_by_keys(rows, article_ids, "article_id")
    totals = rows.groupBy("article_id").agg(F.count("*").alias("total"))
    first = (page - 1) * page_size
    n = F.row_number().over(W.partitionBy("article_id").orderBy("create_time", "id"))
    ranked = rows.withColumn("position", n).where((F.col("position") > first) & (F.col("position") <= first + page_size))
    return ranked.join(totals, "article_id").select("id", "article_id", "user_id", "content", "create_time", "position", "total")


def reply_pages(comments: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """A page of approved replies of every approved top-level comment, with ``has_more`` and ``next_page``.

    One window pass for all parents. A parent without replies on the page gives no row.
    """
    parents = approved(comments).where(F.col("parent_id") == 0).select(F.col("id").alias("parent_id"))
    replies = approved(comments).where(F.col("parent_id") != 0).join(parents, "parent_id", "left_semi")
    w = W.partitionBy("parent_id")
    ranked = replies.withColumn("position", F.row_number().over(w.orderBy("create_time", "id"))).withColumn("total", F.count("*").over(w))
    first = (page - 1) * page_size
    ranked = ranked.where((F.col("position") > first) & (F.col("position") <= first + page_size))
    more = F.col("total") > first + page_size
    return ranked.withColumn("has_more", more).withColumn("next_page", F.when(more, page + 1)).select("parent_id", "id", "user_id", "content", "create_time", "position", "total", "has_more", "next_page")


def comment_thread(comments: DataFrame, article_ids: DataFrame | None = None, page: int = 1, page_size: int = 10, reply_size: int = 10) -> DataFrame:
    """A page of parents per article, each with its first page of replies nested."""
    parents = approved_parents(comments, article_ids, page, page_size)
    replies = reply_pages(comments, 1, reply_size).groupBy("parent_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "user_id", "content"))), lambda x: x["id"]).alias("reply_ids"),
        F.max("total").alias("reply_total"),
        F.bool_or("has_more").alias("has_more"),
    )
    out = parents.join(replies, parents.id == replies.parent_id, "left").drop("parent_id")
    return out.withColumn("reply_ids", F.coalesce("reply_ids", F.array().cast("array<long>"))).withColumn("reply_total", F.coalesce("reply_total", F.lit(0))).withColumn("has_more", F.coalesce("has_more", F.lit(False)))


def report_list(reports: DataFrame, comments: DataFrame, users: DataFrame, articles: DataFrame, query: str = "", reporter: str = "", author: str = "", status: str = "", page: int = 1, page_size: int = 10) -> DataFrame:
    """Reports with comment, article, reporter and author. ``query`` is found in the comment's id or its text."""
    rows = reports.where(F.col("status") == status) if status else reports
    said = comments.select(F.col("id").alias("comment_id"), "article_id", F.col("user_id").alias("author_id"), F.col("content").alias("comment_content"))
    rows = rows.join(said, "comment_id", "left")
    if query:
        hit = F.contains(F.col("comment_id").cast("string"), F.lit(query)) | F.contains(F.lower("comment_content"), F.lit(query.lower()))
        rows = rows.where(F.coalesce(hit, F.lit(False)))
    rows = rows.join(articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title")), "article_id", "left")
    rows = rows.join(_users(users, "reporter", "reporter_id"), "reporter_id", "left").join(_users(users, "author", "author_id"), "author_id", "left")
    if reporter:
        rows = rows.where(F.col("reporter_handle") == reporter)
    if author:
        rows = rows.where(F.col("author_handle") == author)
    return page_of(rows, [F.desc("create_time"), F.desc("id")], page, page_size)


def reported_by(reports: DataFrame, reporter_id: int, comment_ids: DataFrame) -> DataFrame:
    """Which of the comments the user has reported, each once."""
    return rows_by_keys(reports.where(F.col("reporter_id") == reporter_id), comment_ids, "comment_id").select("comment_id").distinct()


def image_list(images: DataFrame, refs: DataFrame, status: str = "", keyword: str = "", page: int = 1, page_size: int = 10) -> DataFrame:
    """Images with the sum of their reference counts, latest update first."""
    rows = images.where(F.col("status") == status) if status else images
    if keyword:
        name = F.col("image_name") if "image_name" in images.columns else F.col("object_key")
        rows = rows.where(F.contains(name, F.lit(keyword)) | F.contains(F.col("url"), F.lit(keyword)))
    used = refs.groupBy(F.col("image_id").alias("id")).agg(F.sum("ref_count").alias("ref_total"))
    rows = rows.join(used, "id", "left").withColumn("ref_total", F.coalesce("ref_total", F.lit(0)))
    return page_of(rows, [F.desc("update_time"), F.desc("id")], page, page_size)


def image_references(refs: DataFrame, articles: DataFrame, image_ids: DataFrame | None = None) -> DataFrame:
    """Reference rows with article titles, newest first, and the image's total count."""
    rows = rows_by_keys(refs, image_ids, "image_id") if image_ids is not None else refs
    totals = rows.groupBy("image_id").agg(F.sum("ref_count").alias("image_total"))
    titled = rows.join(articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title")), "article_id", "left")
    return titled.join(totals, "image_id").orderBy("image_id", F.desc("create_time"), F.desc("id"))


def image_reference_counts(images: DataFrame, refs: DataFrame, force: bool = False) -> DataFrame:
    """Reference rows of every image, and whether it may be deleted."""
    n = refs.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n"))
    out = images.select("id").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("deletable", F.lit(force) | (F.col("n") == 0))


#: The fields of the three profile documents.
DOCUMENTS = {
    "about_me_info": "name string, job string, workLife string, address string",
    "web_site_info": "domainInfo string, blogContent string, websiteLocation string, statement string",
    "contact_me_info": "email array<string>",
}


def flatten_profile(admins: DataFrame) -> DataFrame:
    """Three JSON texts to nine columns, e-mail addresses joined by commas. Bad JSON gives nulls."""
    parsed = admins.select("id", *[F.from_json(c, s).alias(c) for c, s in DOCUMENTS.items()])
    plain = [F.col(f"{c}.{f.split()[0]}") for c, s in DOCUMENTS.items() for f in s.split(", ") if f.endswith(" string")]
    return parsed.select("id", *plain, F.array_join("contact_me_info.email", ",").alias("email"))


def merge_profile_json(admins: DataFrame, changes: DataFrame) -> DataFrame:
    """Patch the JSON documents field by field; a blank or missing change leaves the field alone."""
    out = admins.alias("a").join(changes.alias("c"), "id", "left")

    def patched(column: str, schema: str) -> Column:
        old, new = F.from_json(F.col(f"a.{column}"), schema), F.from_json(F.col(f"c.{column}"), schema)
        fields = []
        for f in schema.split(", "):
            name, kind = f.split(" ", 1)
            value = F.when(F.size(new[name]) > 0, new[name]) if kind.startswith("array") else F.nullif(F.trim(new[name]), F.lit(""))
            fields.append(F.coalesce(value, old[name]).alias(name))
        return F.when(F.col(f"c.{column}").isNull(), F.col(f"a.{column}")).otherwise(F.to_json(F.struct(*fields))).alias(column)

    return out.select("id", *[patched(c, s) for c, s in DOCUMENTS.items()])

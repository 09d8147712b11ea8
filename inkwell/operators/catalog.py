"""Catalogue queries over articles, tags, links and site dynamics. All are lazy DataFrame to DataFrame functions.

Ties the reference leaves open are settled by id. Paging is 1-based; ``total`` counts the rows before paging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ORDERS = {"time": "create_time", "views": "view_num"}


def page_of(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 10, total: bool = True) -> DataFrame:
    """One page of ``df`` in ``order`` (a top-k, not a global sort), with the number of all rows as ``total``."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    out = df
    if total:
        out = out.withColumn("total", df.agg(F.count("*")).scalar())
    return out.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def published(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("status") == "published")


def with_tag_name(articles: DataFrame, tags: DataFrame) -> DataFrame:
    names = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    return articles.join(names, "tag_id", "left").withColumn("tag_name", F.coalesce("tag_name", F.lit("")))


def article_list(articles: DataFrame, tags: DataFrame, order: str = "time", page: int = 1, page_size: int = 10) -> DataFrame:
    """Published articles, newest or most viewed first."""
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}")
    rows = with_tag_name(published(articles), tags).select("id", "title", "summary", "view_num", "create_time", "update_time", "tag_name")
    return page_of(rows, [F.desc(ORDERS[order]), F.desc("id")], page, page_size)


def article_detail(articles: DataFrame, tags: DataFrame, ids: DataFrame | None = None, status: str = "published") -> DataFrame:
    rows = articles.where(F.col("status") == status)
    if ids is not None:
        rows = rows_by_keys(rows, ids, "id")
    return with_tag_name(rows, tags).select("id", "title", "summary", "content", "view_num", "create_time", "update_time", "tag_id", "tag_name")


def articles_by_tag(articles: DataFrame, tags: DataFrame, tag: str, page: int = 1, page_size: int = 10) -> DataFrame:
    """Published articles of a tag, newest first; a tag that does not exist is an error."""
    found = tags.where(F.col("name") == tag)
    if found.isEmpty():
        raise LookupError(f"no tag {tag!r}")
    rows = published(articles).join(found.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_id")
    return page_of(rows.select("id", "title", "summary", "view_num", "create_time", "tag_name"), [F.desc("create_time"), F.desc("id")], page, page_size)


def tag_article_counts(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Published articles per tag, tags without any left out, most first. Counted before the join with the names."""
    counts = published(articles).where(F.col("tag_id").isNotNull()).groupBy("tag_id").agg(F.count("*").alias("article_count"))
    return counts.join(tags, counts.tag_id == tags.id).select(tags.id, tags.name, "article_count").orderBy(F.desc("article_count"), "id")


def fold_text(col: Column) -> Column:
    """Letters without case or accents."""
    return F.lower(F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), "ß", "ss"))


_ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"


def search_articles(articles: DataFrame, tags: DataFrame, word: str, page: int = 1, page_size: int = 10) -> DataFrame:
    """Published articles with ``word`` in the title (without case or accents) or content (as it stands); title hits
    first, then most viewed. The word is trimmed and matched literally; a blank word finds nothing."""
    word = word.strip()
    title = F.contains(F.collate(F.col("title"), "UNICODE_CI_AI"), F.collate(F.lit(word), "UNICODE_CI_AI"))
    rows = with_tag_name(published(articles), tags).withColumn("in_title", title)
    rows = rows.where(F.col("in_title") | F.contains(F.col("content"), F.lit(word))) if word else rows.where(F.lit(False))
    rows = rows.select("id", "title", "summary", "view_num", "create_time", "tag_name", "in_title")
    return page_of(rows, [F.desc("in_title"), F.desc("view_num"), F.desc("id")], page, page_size)


def hot_articles(articles: DataFrame, live: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The ``k`` most viewed published articles, by live views where there are any."""
    rows = live_view_num(published(articles), live) if live is not None else published(articles)
    return rows.select("id", "title", "view_num").orderBy(F.desc("view_num"), "id").limit(k)


def live_view_num(articles: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored views replaced by the live counter where one exists, zero included. ``counts(article_id, views)``."""
    c = counts.select(F.col("article_id").alias("id"), F.col("views").alias("__live"))
    return articles.join(c, "id", "left").withColumn("view_num", F.coalesce("__live", "view_num")).drop("__live").select(*articles.columns)


def timeline(articles: DataFrame) -> DataFrame:
    """One row per year, latest first, with its articles, newest first, as an array."""
    item = F.struct((-F.unix_micros(F.col("create_time").cast("timestamp"))).alias("o"), (-F.col("id")).alias("p"), "id", "title", "create_time")
    years = published(articles).groupBy(F.year("create_time").alias("year")).agg(F.array_sort(F.collect_list(item)).alias("a"))
    return years.select("year", F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["create_time"].alias("create_time"))).alias("articles")).orderBy(F.desc("year"))


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("status").agg(F.count("*").alias("n"))


def rows_by_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among the (single-column) keys; no keys give no rows."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def time_view_projection(articles: DataFrame) -> DataFrame:
    return published(articles).select("id", "view_num", F.unix_millis(F.col("create_time").cast("timestamp")).alias("create_ms"))


def draft_list(articles: DataFrame, tags: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    rows = with_tag_name(articles.where(F.col("status") == "draft"), tags)
    kind = F.when(F.col("published_id").isNotNull(), "edit").otherwise("new").alias("type")
    return page_of(rows.select("id", "title", "published_id", kind, "tag_name", "update_time"), [F.desc("update_time"), F.desc("id")], page, page_size)


def draft_of_article(articles: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The draft of each published article that has one."""
    drafts = articles.where((F.col("status") == "draft") & F.col("published_id").isNotNull())
    if ids is not None:
        drafts = rows_by_keys(drafts, ids, "published_id")
    live = published(articles).select(F.col("id").alias("published_id"), F.col("title").alias("published_title"))
    return live.join(drafts.select("published_id", F.col("id").alias("draft_id"), F.col("title").alias("draft_title")), "published_id")


def site_dynamics(rows: DataFrame, published_only: bool = True) -> DataFrame:
    rows = rows.where(F.col("status") == "published") if published_only else rows
    return rows.orderBy("sort_order", F.desc("event_time"), F.desc("id"))


def link_list(links: DataFrame) -> DataFrame:
    return links.orderBy("update_time", "id")

"""View counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def count_views(accepted: DataFrame, articles: DataFrame) -> DataFrame:
    """Accepted view events per published article: ``(article_id, views)``. Ids that are not positive whole numbers are
    dropped. Events are counted before they meet the articles, so a hot article is one row in the join."""
    text = F.col("article_id").cast("string")
    article = F.when(text.rlike("^[0-9]+$"), text).try_cast("long")
    counts = accepted.select(article.alias("article_id")).where("article_id > 0").groupBy("article_id").agg(F.count("*").alias("views"))
    return counts.join(articles.where(F.col("status") == "published").select(F.col("id").alias("article_id")), "article_id", "left_semi")


def add_counts(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Counters of a batch added to stored ones."""
    return stored.unionByName(more).groupBy("article_id").agg(F.sum("views").alias("views"))

"""Registered queries of maintenance on versioned tables: every table is written once, changed by deltas and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from inkwell.functions.checkpoint import shared_dir
from inkwell.operators import versioned as V
from inkwell.plans.maintenance_queries import _COUNTS, _image_changes
from inkwell.plans.registry import ORACLES, query
from inkwell.plans.views import view, with_views
from inkwell.sources.versions import VersionedTable


def stored(spark: SparkSession, df: DataFrame, keys: list[str]) -> VersionedTable:
    return VersionedTable.create(df, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", keys)


@query("versioned_upsert_images", ORACLES["upsert_images"])
def _(spark, sf):
    image, changes = _image_changes(spark, sf)
    table = stored(spark, image, ["object_key"])
    V.upsert_images(table, changes)
    return table.read()


#: Ids of comments repeat where a conversation has more than a hundred turns; a keyed table takes one row of each.
_ORDER = "article_id, parent_id, reply_to_comment_id, user_id, reply_to_user_id, content, status, ip, create_time"
_ONCE = f", once as (select * exclude (n) from (select *, row_number() over (partition by id order by {_ORDER}) as n from comment) where n = 1)"


def _comments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("id").orderBy(*_ORDER.split(", ")))
    return view(spark, sf, "comment").withColumn("n", n).where("n = 1").drop("n")


@query("versioned_delete_comments", with_views("comment", f"{_ONCE} select * from once where status <> 'rejected'"))
def _(spark, sf):
    c = _comments(spark, sf)
    table = stored(spark, c, ["id"])
    V.delete_comments(table, c.where("status = 'rejected'").select("id"))
    return table.read()


@query("versioned_write_back_views", ORACLES["write_back_views"])
def _(spark, sf):
    table = stored(spark, view(spark, sf, "article"), ["id"])
    V.write_back_views(table, view(spark, sf, "view_event").groupBy("article_id").agg(F.count("*").alias("views")))
    return table.read()


@query("versioned_publish_drafts", ORACLES["publish_drafts"])
def _(spark, sf):
    from inkwell.plans.maintenance_queries import NOW, _articles

    a = _articles(spark, sf)
    table = stored(spark, a, ["id"])
    V.publish_drafts(table, a.where("status = 'draft'").select("id"), NOW)
    return table.read()


@query(
    "versioned_comment_history",
    with_views(
        "comment comment_report",
        _ONCE
        + """, one as (select * replace (case when status = 'pending' then 'approved' else status end as status) from once),
two as (select * from one where status <> 'rejected'),
three as (select * replace (case when status = 'approved' and id in (select comment_id from comment_report where status = 'pending' group by comment_id having count(*) >= 3) then 'pending' else status end as status) from two),
four as (select * from three union all select id * 1000, article_id, parent_id, reply_to_comment_id, user_id, reply_to_user_id, content, 'rejected', ip, create_time from three where parent_id = 0)
select 0 as version, * from once union all select 1, * from one union all select 2, * from two union all select 4, * from three union all select 5, * from four""",
    ),
)
def _(spark, sf):
    """Five versions of one table, with a compaction between them (version 3), all read back."""
    c = _comments(spark, sf)
    table = stored(spark, c, ["id"])
    V.set_comment_status(table, c.where("status = 'pending'").select("id"), "approved")
    V.delete_comments(table, c.where("status = 'rejected'").select("id"))
    table.compact(0.0)
    V.escalate_reported(view(spark, sf, "comment_report"), table)
    roots = table.read().where("parent_id = 0")
    new = roots.withColumn("id", F.col("id") * 1000).withColumn("status", F.lit("rejected"))
    table.append_deltas(table.manifest(), [("put", new, table.columns())])
    out = None
    for v in (0, 1, 2, 4, 5):
        part = table.read(v).select(F.lit(v).alias("version"), "*")
        out = part if out is None else out.unionByName(part)
    return out

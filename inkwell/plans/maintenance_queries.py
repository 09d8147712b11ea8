"""Registered image, maintenance and view-count queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from inkwell.operators import images, maintenance as M, views
from inkwell.plans.registry import query
from inkwell.plans.views import view, with_views

NOW = datetime(2024, 3, 1)
_NOW = "timestamp '2024-03-01 00:00:00'"
BASE = "https://img.example.com/base"


def _v(spark, sf, names):
    return [view(spark, sf, n) for n in names.split()]


_FOUND = r"""f as (select article_id, trim(u, '<>') as url from article_md, unnest(regexp_extract_all(content, '!\[[^\]]*]\(\s*(<[^>]+>|[^\s)]+)(?:\s+["''][^"'']*["''])?\s*\)', 1)) t(u)),
g as (select article_id, url, 'markdown' as ref_type, count(*) as ref_count from f where url <> '' and not starts_with(lower(url), 'data:') group by article_id, url)"""
_KEY = "case when starts_with(lower(url), 'https://img.example.com/base/') then 'img/' || replace(substr(url, 30), '%20', ' ') end"


@query("extract_image_refs", with_views("article_md", f", {_FOUND} select * from g"))
def _(spark, sf):
    return images.extract_image_refs(view(spark, sf, "article_md"))


@query("object_key", with_views("article_md", f", {_FOUND} select distinct url, {_KEY} as object_key from g"))
def _(spark, sf):
    urls = images.extract_image_refs(view(spark, sf, "article_md"), html=False).select("url").distinct()
    return urls.withColumn("object_key", images.object_key(F.col("url"), BASE, "img"))


_SYNC = f", {_FOUND}, k as (select article_id, ref_type, ref_count, url, {_KEY} as object_key from g)"


def _sync(spark, sf):
    md, image, ref = _v(spark, sf, "article_md article_image image_reference")
    old = ref.groupBy("article_id", F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".png")).alias("object_key"), "ref_type").agg(F.sum("ref_count").alias("ref_count"))
    return images.sync_image_refs(md.where("article_id > 50"), image, old, BASE, "img")


@query(
    "sync_image_refs",
    with_views(
        "article_md image_reference",
        _SYNC
        + """ select article_id, object_key, ref_type, cast(sum(ref_count) as bigint) as ref_count from k where object_key is not null and article_id > 50 group by article_id, object_key, ref_type
union all select article_id, concat('img/', cast(image_id as string), '.png'), ref_type, cast(sum(ref_count) as bigint) from image_reference
where article_id not in (select article_id from article_md where article_id > 50) group by article_id, image_id, ref_type""",
    ),
)
def _(spark, sf):
    return _sync(spark, sf)[0].select("article_id", "object_key", "ref_type", F.col("ref_count").cast("long").alias("ref_count"))


@query(
    "sync_image_inserts",
    with_views(
        "article_md article_image",
        _SYNC
        + """ select object_key, min(url) as url, regexp_extract(object_key, '([^/]*)$', 1) as image_name, 'image/png' as mime, 'used' as status from k
where object_key is not null and article_id > 50 and object_key not in (select object_key from article_image) group by object_key""",
    ),
)
def _(spark, sf):
    return _sync(spark, sf)[1]


@query(
    "refresh_image_status",
    with_views(
        "article_image image_reference",
        "select * replace (case when size % 2 = 1 then status when id in (select image_id from image_reference where ref_type = 'html') then 'used' else 'unused' end as status) from article_image",
    ),
)
def _(spark, sf):
    image, ref = _v(spark, sf, "article_image image_reference")
    return images.refresh_image_status(image, ref.where("ref_type = 'html'"), image.where("size % 2 = 0").select("id"))


@query("changed_article_paths", with_views("comment", "select distinct 'https://site.example/article-detail/' || cast(article_id as string) as path from comment"))
def _(spark, sf):
    return images.changed_article_paths(view(spark, sf, "comment").select("article_id"), "https://site.example/")


@query(
    "upsert_users",
    with_views(
        "site_user",
        """, c as (select provider, provider_user_id, case when id % 2 = 0 then '' else display_name || '!' end as display_name, 'h' || id as handle from site_user where session_version = 2
union all select 'new', provider_user_id, display_name, 'n' || id from site_user where session_version = 3)
select u.id, coalesce(u.provider, c.provider) as provider, coalesce(u.provider_user_id, c.provider_user_id) as provider_user_id, coalesce(nullif(c.display_name, ''), u.display_name) as display_name, coalesce(u.handle, c.handle) as handle
from site_user u full join c on u.provider = c.provider and u.provider_user_id = c.provider_user_id""",
    ),
)
def _(spark, sf):
    u = view(spark, sf, "site_user")
    one = u.where("session_version = 2").selectExpr("provider", "provider_user_id", "case when id % 2 = 0 then '' else concat(display_name, '!') end as display_name", "concat('h', id) as handle")
    two = u.where("session_version = 3").selectExpr("'new' as provider", "provider_user_id", "display_name", "concat('n', id) as handle")
    return M.upsert_users(u.select("id", "provider", "provider_user_id", "display_name", "handle"), one.unionByName(two))


_IMG_CHANGES = "select id + 1000000 as id, case when size % 3 = 0 then object_key else 'new/' || object_key end as object_key, url || '?v=2' as url, 'used' as status, size + 1 as size, update_time + interval '1' day as update_time from article_image"


def _image_changes(spark, sf):
    image = view(spark, sf, "article_image")
    return image, image.selectExpr("id + 1000000 as id", "case when size % 3 = 0 then object_key else 'new/' || object_key end as object_key", "url || '?v=2' as url", "'used' as status", "size + 1 as size", "update_time + interval '1' day as update_time")


@query(
    "upsert_images",
    with_views(
        "article_image",
        f""", c as ({_IMG_CHANGES}) select coalesce(i.id, c.id) as id, coalesce(i.object_key, c.object_key) as object_key, coalesce(c.url, i.url) as url, coalesce(c.status, i.status) as status, coalesce(c.size, i.size) as size, coalesce(c.update_time, i.update_time) as update_time
from article_image i full join c on i.object_key = c.object_key""",
    ),
)
def _(spark, sf):
    return M.upsert_images(*_image_changes(spark, sf))


@query("insert_ignore_images", with_views("article_image", f", c as ({_IMG_CHANGES}) select * from article_image union all select id, object_key, url, status, size, update_time from c where object_key not in (select object_key from article_image)"))
def _(spark, sf):
    return M.insert_ignore_images(*_image_changes(spark, sf))


_ART = "id, title, summary, content, view_num, status, published_id, tag_id, create_time, update_time"
_DRAFTS = "select id as seq, id + 1000000 as new_id, case when id % 3 = 0 then id end as id, case when id % 3 = 1 then published_id end as published_id, case when id % 2 = 0 then ' ' else 'T' || id end as title, summary, content, tag_id from article where status = 'draft'"


def _articles(spark, sf):
    return view(spark, sf, "article").select(*_ART.split(", "))


@query(
    "save_drafts",
    with_views(
        "article",
        f""", d as ({_DRAFTS}), h as (select * from article where status = 'draft'),
f as (select d.*, coalesce(a.id, b.id) as target, coalesce(nullif(trim(d.title), ''), a.title, b.title) as t from d left join h a on d.id = a.id left join h b on d.published_id = b.published_id),
n as (select seq, row_number() over (order by seq) as k from f where t is null),
c as (select coalesce(target, new_id) as id, coalesce(t, '草稿' || ((select count(*) from h) + n.k)) as title, summary, content, tag_id, published_id from f left join n using (seq))
select coalesce(a.id, c.id) as id, coalesce(c.title, a.title) as title, case when c.id is null then a.summary else c.summary end as summary, case when c.id is null then a.content else c.content end as content,
coalesce(a.view_num, 0) as view_num, coalesce(a.status, 'draft') as status, case when a.id is null then c.published_id else a.published_id end as published_id, case when c.id is null then a.tag_id else c.tag_id end as tag_id,
coalesce(a.create_time, {_NOW}) as create_time, case when c.id is null then a.update_time else {_NOW} end as update_time from article a full join c on a.id = c.id""",
    ),
)
def _(spark, sf):
    a = _articles(spark, sf)
    d = a.where("status = 'draft'").selectExpr("id as seq", "id + 1000000 as new_id", "case when id % 3 = 0 then id end as id", "case when id % 3 = 1 then published_id end as published_id", "case when id % 2 = 0 then ' ' else concat('T', id) end as title", "summary", "content", "tag_id")
    return M.save_drafts(a, d, NOW)


@query(
    "publish_drafts",
    with_views(
        "article",
        f""", d as (select * from article where status = 'draft'), e as (select * from d where published_id is not null)
select a.id, coalesce(e.title, a.title) as title, coalesce(e.summary, a.summary) as summary, coalesce(e.content, a.content) as content, a.view_num, a.status, a.published_id, case when e.id is null then a.tag_id else e.tag_id end as tag_id, a.create_time,
case when e.id is null then a.update_time else {_NOW} end as update_time from article a left join e on a.id = e.published_id where a.status = 'published'
union all select id, title, summary, content, 0, 'published', null, tag_id, {_NOW}, {_NOW} from d where published_id is null""",
    ),
)
def _(spark, sf):
    a = _articles(spark, sf)
    return M.publish_drafts(a, a.where("status = 'draft'").select("id"), NOW)


_GONE = "gone as (select id from article where status = 'published' and tag_id is not null and id in (select article_id from comment))"


def _deleted(spark, sf, k):
    a, r, c = _v(spark, sf, "article image_reference comment")
    return M.delete_articles(a, r, c, c.select("article_id"))[k]


@query("delete_articles", with_views("article comment", f", {_GONE} select * from article where id not in (select id from gone) and (published_id is null or published_id not in (select id from gone))"))
def _(spark, sf):
    return _deleted(spark, sf, 0)


@query("delete_articles_refs", with_views("article comment image_reference", f", {_GONE} select * from image_reference where article_id not in (select id from gone)"))
def _(spark, sf):
    return _deleted(spark, sf, 1)


@query("delete_articles_comments", with_views("article comment", f", {_GONE} select * from comment where article_id not in (select id from gone)"))
def _(spark, sf):
    return _deleted(spark, sf, 2)


@query("delete_comments", with_views("comment", "select * from comment where status <> 'rejected'"))
def _(spark, sf):
    c = view(spark, sf, "comment")
    return M.delete_comments(c, c.where("status = 'rejected'").select("id"))


@query("delete_images", with_views("article_image image_reference", "select * from image_reference where image_id not in (select id from article_image where status = 'unused')"))
def _(spark, sf):
    i, r = _v(spark, sf, "article_image image_reference")
    return M.delete_images(i, r, i.where("status = 'unused'").select("id"))[1]


@query("retag_articles", with_views("article comment", "select * replace (case when status = 'published' and id in (select article_id from comment) then 6 else tag_id end as tag_id) from article"))
def _(spark, sf):
    a, t, c = _v(spark, sf, "article tag comment")
    return M.retag_articles(a, t, c.select("article_id"), "fresh")[0]


_COUNTS = "select article_id, count(*) as views from view_event group by article_id"


@query("write_back_views", with_views("article view_event", f", c as ({_COUNTS}) select a.* replace (case when status = 'published' then coalesce(c.views, view_num) else view_num end as view_num) from article a left join c on a.id = c.article_id"))
def _(spark, sf):
    a, e = _v(spark, sf, "article view_event")
    return M.write_back_views(a, e.groupBy("article_id").agg(F.count("*").alias("views")))


@query(
    "append_site_dynamics",
    with_views(
        "site_dynamic link",
        """select id, content, status, sort_order, event_time from site_dynamic
union all select id + 1000, name, 'published', (select max(sort_order) from site_dynamic) + row_number() over (order by id), timestamp '2024-05-06 00:00:00' from link""",
    ),
)
def _(spark, sf):
    d, link = _v(spark, sf, "site_dynamic link")
    new = link.selectExpr("id + 1000 as id", "concat(' ', name, ' ') as content", "'published' as status", "'2024-05-06' as event_day")
    return M.append_site_dynamics(d, new)


@query("reorder_site_dynamics", with_views("site_dynamic", "select * replace (row_number() over (order by content) as sort_order) from site_dynamic"))
def _(spark, sf):
    from pyspark.sql import Window as W

    d = view(spark, sf, "site_dynamic")
    return M.reorder_site_dynamics(d, d.select("id", F.row_number().over(W.orderBy("content")).alias("position")))


@query("merge_site_dynamics", with_views("site_dynamic", "select * replace (case when sort_order = 2 then content || '*' else content end as content) from site_dynamic where sort_order <> 1"))
def _(spark, sf):
    d = view(spark, sf, "site_dynamic")
    return M.merge_site_dynamics(d, d.where("sort_order = 2").withColumn("content", F.concat("content", F.lit("*"))), d.where("sort_order = 1"))


@query("set_comment_status", with_views("comment", "select * replace (case when status = 'pending' then 'approved' else status end as status) from comment"))
def _(spark, sf):
    c = view(spark, sf, "comment")
    return M.set_comment_status(c, c.where("status = 'pending'").select("id"), "approved", NOW)


@query("set_permission", with_views("site_user", f"select * replace (true as comment_disabled, case when provider = 'github' then {_NOW} else disabled_until end as disabled_until) from site_user where provider = 'github' union all select * from site_user where provider <> 'github'"))
def _(spark, sf):
    u = view(spark, sf, "site_user")
    return M.set_permission(u, u.where("provider = 'github'").select("id", F.lit(True).alias("comment_disabled"), F.lit(NOW).cast("timestamp_ntz").alias("disabled_until")))


@query("bump_session", with_views("site_user", "select * replace (case when comment_disabled then session_version + 1 else session_version end as session_version) from site_user"))
def _(spark, sf):
    u = view(spark, sf, "site_user")
    return M.bump_session(u, u.where("comment_disabled").select("id"))


_ACTIONS = "a as (select comment_id, comment_id % 200 = 1 as accept from comment_report where status = 'pending' group by comment_id)"


def _resolved(spark, sf, k):
    r, c = _v(spark, sf, "comment_report comment")
    return M.resolve_reports(r, c, r.where("status = 'pending'").selectExpr("comment_id", "comment_id % 200 = 1 as accept").distinct())[k]


@query("resolve_reports", with_views("comment_report", f", {_ACTIONS} select r.* replace (case when status = 'pending' and accept then 'accepted' when status = 'pending' then 'rejected' else status end as status) from comment_report r left join a using (comment_id)"))
def _(spark, sf):
    return _resolved(spark, sf, 0)


@query("resolve_reports_comments", with_views("comment_report comment", f", {_ACTIONS} select c.* replace (case when accept then 'rejected' when not accept then 'approved' else status end as status) from comment c left join a on c.id = a.comment_id"))
def _(spark, sf):
    return _resolved(spark, sf, 1)


@query(
    "escalate_reported",
    with_views("comment_report comment", "select * replace (case when status = 'approved' and id in (select comment_id from comment_report where status = 'pending' group by comment_id having count(*) >= 3) then 'pending' else status end as status) from comment"),
)
def _(spark, sf):
    return M.escalate_reported(*_v(spark, sf, "comment_report comment"))


@query("escalation_points", with_views("comment_report", "select comment_id, id as report_id, create_time from (select *, row_number() over (partition by comment_id order by create_time, id) as n from comment_report where status = 'pending') where n = 3"))
def _(spark, sf):
    return M.escalation_points(view(spark, sf, "comment_report"))


_REPLY_REQ = "select id as request_id, case when id % 19 = 0 then article_id + 1 else article_id end as article_id, case when id % 3 = 0 then 0 when id % 17 = 0 then -id else reply_to_comment_id end as parent_id, case when id % 4 = 0 then 0 when id % 5 = 0 then id else reply_to_comment_id end as reply_to_comment_id from comment"


@query(
    "resolve_reply_targets",
    with_views(
        "comment",
        f""", n as ({_REPLY_REQ}),
j as (select n.*, p.article_id as pa, p.status as ps, p.user_id as pu, p.parent_id as pp, p.id as pid, r.article_id as ra, r.status as rs, r.user_id as ru, r.parent_id as rp, r.id as rid from n left join comment p on n.parent_id = p.id left join comment r on n.reply_to_comment_id = r.id),
k as (select *, case when parent_id <> 0 then case when pp <> 0 then pp else parent_id end when reply_to_comment_id <> 0 then case when rp <> 0 then rp else reply_to_comment_id end else 0 end as root from j),
e as (select *, case when parent_id <> 0 and pid is null then 'comment_not_found' when parent_id <> 0 and (pa <> article_id or ps <> 'approved') then 'invalid_comment'
  when reply_to_comment_id <> 0 and rid is null then 'comment_not_found' when reply_to_comment_id <> 0 and (ra <> article_id or rs <> 'approved' or (reply_to_comment_id <> root and rp <> root)) then 'invalid_comment' else '' end as error from k)
select request_id, article_id, case when error = '' then root end as root_id, case when error = '' then case when reply_to_comment_id <> 0 then reply_to_comment_id when parent_id <> 0 then parent_id else 0 end end as reply_comment_id,
case when error = '' then case when reply_to_comment_id <> 0 then ru when parent_id <> 0 then pu else 0 end end as reply_user_id, error from e""",
    ),
)
def _(spark, sf):
    c = view(spark, sf, "comment")
    cols = ["id as request_id", "case when id % 19 = 0 then article_id + 1 else article_id end as article_id", "case when id % 3 = 0 then 0 when id % 17 = 0 then -id else reply_to_comment_id end as parent_id", "case when id % 4 = 0 then 0 when id % 5 = 0 then id else reply_to_comment_id end as reply_to_comment_id"]
    return M.resolve_reply_targets(c.selectExpr(*cols), c)


@query(
    "comment_eligibility",
    with_views(
        "comment site_user article",
        """, q as (select id as request_id, user_id, id % 4 as session_version, article_id, case when id % 13 = 0 then ' ' else content end as content from comment)
select request_id, case when u.id is null then 'unauthorized' when (q.session_version > 0 and q.session_version <> u.session_version) or (q.session_version = 0 and u.session_version > 1) then 'session_invalid'
when comment_disabled and (disabled_until is null or disabled_until > timestamp '2024-02-10 00:00:00') then 'forbidden' when a.id is null then 'article_not_found' when trim(q.content) = '' then 'invalid_comment' else '' end as error
from q left join site_user u on q.user_id = u.id left join article a on q.article_id = a.id and a.status = 'published'""",
    ),
)
def _(spark, sf):
    c, u, a = _v(spark, sf, "comment site_user article")
    q = c.selectExpr("id as request_id", "user_id", "id % 4 as session_version", "article_id", "case when id % 13 = 0 then ' ' else content end as content")
    return M.comment_eligibility(q, u, a, datetime(2024, 2, 10))


@query(
    "report_eligibility",
    with_views(
        "comment comment_report",
        """, q as (select id as request_id, case when id % 9 = 0 then -1 else id end as comment_id, id % 150 + 1 as reporter_id from comment)
select request_id, q.comment_id, q.reporter_id, case when c.id is null then 'comment_not_found' when c.status <> 'approved' then 'invalid_comment' when c.user_id = q.reporter_id then 'forbidden'
when exists (select 1 from comment_report r where r.comment_id = q.comment_id and r.reporter_id = q.reporter_id) then 'already_reported' else '' end as error from q left join comment c on q.comment_id = c.id""",
    ),
)
def _(spark, sf):
    c, r = _v(spark, sf, "comment comment_report")
    return M.report_eligibility(c.selectExpr("id as request_id", "case when id % 9 = 0 then -1 else id end as comment_id", "id % 150 + 1 as reporter_id"), c, r)


@query(
    "link_merge",
    with_views(
        "link",
        """select id, case when id % 3 = 0 then name || ' b' else name end as name, url, case when id % 3 = 0 then timestamp '2024-03-01 00:00:00' else update_time end as update_time from link where id % 5 <> 4 or id % 3 = 0
union all select id + 1000000, 'n' || id, 'u' || id, timestamp '2024-03-01 00:00:00' from link""",
    ),
)
def _(spark, sf):
    link = view(spark, sf, "link")
    stamp = "timestamp_ntz '2024-03-01 00:00:00' as update_time"
    changes = link.where("id % 3 = 0").selectExpr("id", "concat(name, ' b') as name", "'  ' as url", stamp).unionByName(link.selectExpr("id + 1000000 as id", "concat('n', id) as name", "concat('u', id) as url", stamp))
    return M.link_merge(link, changes, link.where("id % 5 = 4 and id % 3 <> 0"))


@query(
    "upsert_articles",
    with_views(
        "article view_event",
        f""", v as ({_COUNTS}), c as (select case when id % 2 = 0 then id else id + 1000000 end as id, case when id % 4 = 0 then '' else title || '!' end as title, summary, ' ' as content from article where status = 'published')
select coalesce(a.id, c.id) as id, coalesce(nullif(c.title, ''), a.title) as title, coalesce(c.summary, a.summary) as summary, coalesce(a.content, ' ') as content,
case when a.id is null then 0 when c.id is null then a.view_num else coalesce(v.views, a.view_num) end as view_num, coalesce(a.status, 'published') as status, a.published_id, case when c.id is null then a.tag_id else 6 end as tag_id,
coalesce(a.create_time, {_NOW}) as create_time, case when c.id is null then a.update_time else {_NOW} end as update_time from article a full join c on a.id = c.id left join v on v.article_id = c.id""",
    ),
)
def _(spark, sf):
    a, t, e = _articles(spark, sf), view(spark, sf, "tag"), view(spark, sf, "view_event")
    changes = a.where("status = 'published'").selectExpr("case when id % 2 = 0 then id else id + 1000000 end as id", "case when id % 4 = 0 then '' else concat(title, '!') end as title", "summary", "' ' as content", "'fresh' as tag")
    return M.upsert_articles(a, t, changes, e.groupBy("article_id").agg(F.count("*").alias("views")), NOW)[0]


_CMT = "id, article_id, parent_id, user_id, reply_to_user_id, reply_to_comment_id, content, status, ip, create_time"


@query(
    "append_comments",
    with_views(
        "comment site_user",
        f"""select {_CMT}, cast(null as varchar) as author_name, cast(null as varchar) as moderation_reasons from comment
union all select c.id + 1000000, article_id, parent_id, user_id, reply_to_user_id, reply_to_comment_id, content, 'pending', ip, c.create_time, u.display_name, '["a","b"]' from comment c left join site_user u on c.user_id = u.id where status = 'approved'""",
    ),
)
def _(spark, sf):
    c, u = _v(spark, sf, "comment site_user")
    decided = c.where("status = 'approved'").selectExpr(*[{"id": "id + 1000000 as id", "status": "'pending' as status"}.get(n, n) for n in _CMT.split(", ")], "array('a', 'b') as reasons")
    return M.append_comments(c.selectExpr(*_CMT.split(", "), "cast(null as string) as author_name", "cast(null as string) as moderation_reasons"), decided, u)


@query(
    "append_reports",
    with_views(
        "comment_report",
        """, n as (select id + 1000000 as id, comment_id, reporter_id % 40 as reporter_id, create_time from comment_report),
f as (select *, row_number() over (partition by comment_id, reporter_id order by id) as k from n)
select id, comment_id, reporter_id, status, create_time from comment_report union all
select id, comment_id, reporter_id, 'pending', create_time from f where k = 1 and not exists (select 1 from comment_report r where r.comment_id = f.comment_id and r.reporter_id = f.reporter_id)""",
    ),
)
def _(spark, sf):
    r = view(spark, sf, "comment_report")
    return M.append_reports(r, r.selectExpr("id + 1000000 as id", "comment_id", "reporter_id % 40 as reporter_id", "create_time"))


@query(
    "merge_profile_json",
    with_views("site_user", """select id, case when id % 2 = 0 then handle else display_name end as name, handle as address, case when id % 2 = 0 then 'x@y.example' else 'a@b.example' end as email from site_user"""),
)
def _(spark, sf):
    from inkwell.operators.community import DOCUMENTS, merge_profile_json

    u = view(spark, sf, "site_user")
    null = F.lit(None).cast("string")
    admins = u.select("id", F.to_json(F.struct(F.col("display_name").alias("name"), F.col("handle").alias("address"))).alias("about_me_info"), null.alias("web_site_info"), F.lit('{"email":["a@b.example"]}').alias("contact_me_info"))
    even = u.where("id % 2 = 0")
    changes = even.select("id", F.to_json(F.struct(F.col("handle").alias("name"), F.lit(" ").alias("address"))).alias("about_me_info"), null.alias("web_site_info"), F.lit('{"email":["x@y.example"]}').alias("contact_me_info"))
    out = merge_profile_json(admins, changes)
    about, mail = F.from_json("about_me_info", DOCUMENTS["about_me_info"]), F.from_json("contact_me_info", DOCUMENTS["contact_me_info"])
    return out.select("id", about["name"].alias("name"), about["address"].alias("address"), F.array_join(mail["email"], ",").alias("email"))


@query(
    "normalize_provider_profiles",
    with_views(
        "site_user",
        """, t as (select max(try_cast(handle as bigint)) as top from site_user where regexp_full_match(handle, '[0-9]+')),
r as (select id as seq, provider, case when id % 3 = 0 then provider_user_id else 'x' || id end as pid, case when id % 5 = 0 then 'login' || id else display_name end as name from site_user where provider = 'google' and id % 5 <> 0
union all select id, provider, case when id % 3 = 0 then provider_user_id else cast(id + 900000000 as string) end, case when id % 5 = 0 then 'login' || id else display_name end from site_user where provider = 'github'),
n as (select seq, row_number() over (order by seq) as k from r where seq % 3 <> 0 and pid <> '0')
select seq, provider, pid as provider_user_id, name as display_name, coalesce(case when top + k < 100000 then lpad(cast(top + k as string), 5, '0') else cast(top + k as string) end, '') as handle from r left join n using (seq), t where pid <> '0'""",
    ),
)
def _(spark, sf):
    u = view(spark, sf, "site_user")
    github = F.to_json(F.struct(F.expr("case when id % 3 = 0 then cast(provider_user_id as bigint) else id + 900000000 end").alias("id"), F.concat(F.lit("login"), "id").alias("login"), F.expr("case when id % 5 = 0 then ' ' else display_name end").alias("name")))
    google = F.to_json(F.struct(F.expr("case when id % 3 = 0 then provider_user_id else concat('x', id) end").alias("sub"), F.expr("case when id % 5 = 0 then ' ' else display_name end").alias("name")))
    raw = u.select(F.col("id").alias("seq"), "provider", F.when(F.col("provider") == "github", github).otherwise(google).alias("body"))
    return M.normalize_provider_profiles(raw, u).select("seq", "provider", "provider_user_id", "display_name", "handle")


@query("count_views", with_views("article view_event", "select article_id, count(*) as views from view_event where article_id in (select id from article where status = 'published') group by article_id"))
def _(spark, sf):
    a, e = _v(spark, sf, "article view_event")
    return views.count_views(e, a)


@query("live_view_num", with_views("article view_event", f", c as ({_COUNTS}) select a.* replace (coalesce(c.views, view_num) as view_num) from article a left join c on a.id = c.article_id"))
def _(spark, sf):
    from inkwell.operators.catalog import live_view_num

    a, e = _v(spark, sf, "article view_event")
    return live_view_num(a, e.groupBy("article_id").agg(F.count("*").alias("views")))

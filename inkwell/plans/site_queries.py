"""Registered catalogue, community and image queries over the derived site tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from inkwell.functions import columns as C
from inkwell.functions.checkpoint import shared_dir
from inkwell.operators import catalog, community, search_index
from inkwell.plans.registry import query
from inkwell.plans.views import view, with_views

NOW = datetime(2024, 2, 10)
_PUB = "from article where status = 'published'"
_TAGGED = "from article a left join tag t on a.tag_id = t.id"


def _views(spark, sf, names):
    return [view(spark, sf, n) for n in names.split()]


for _order, _key in (("time", "create_time"), ("views", "view_num")):

    def _list(spark, sf, order=_order):
        return catalog.article_list(*_views(spark, sf, "article tag"), order=order, page=2, page_size=20)

    query(
        f"article_list_by_{_order}",
        with_views(
            "article tag",
            f"""select a.id, title, summary, view_num, create_time, update_time, coalesce(t.name, '') as tag_name, (select count(*) {_PUB}) as total
{_TAGGED} where status = 'published' order by a.{_key} desc, a.id desc limit 20 offset 20""",
        ),
    )(_list)


@query("article_detail", with_views("article tag", f"select a.id, title, summary, content, view_num, create_time, update_time, tag_id, coalesce(t.name, '') as tag_name {_TAGGED} where status = 'published'"))
def _(spark, sf):
    return catalog.article_detail(*_views(spark, sf, "article tag"))


@query(
    "articles_by_tag",
    with_views(
        "article tag",
        """select a.id, title, summary, view_num, create_time, t.name as tag_name, count(*) over () as total
from article a join tag t on a.tag_id = t.id where status = 'published' and t.name = 'en' order by create_time desc, a.id desc limit 10""",
    ),
)
def _(spark, sf):
    return catalog.articles_by_tag(*_views(spark, sf, "article tag"), tag="en")


@query("tag_article_counts", with_views("article tag", "select t.id, t.name, count(*) as article_count from article a join tag t on a.tag_id = t.id where status = 'published' group by t.id, t.name"))
def tag_article_counts(spark, sf):
    return catalog.tag_article_counts(*_views(spark, sf, "article tag"))


@query(
    "search_articles",
    with_views(
        "article tag",
        f""", r as (select a.id, title, summary, view_num, create_time, coalesce(t.name, '') as tag_name, contains(strip_accents(lower(title)), 'then') as in_title, content {_TAGGED} where status = 'published')
select id, title, summary, view_num, create_time, tag_name, in_title, count(*) over () as total from r
where in_title or contains(content, 'then') order by in_title desc, view_num desc, id desc limit 50""",
    ),
)
def _(spark, sf):
    return catalog.search_articles(*_views(spark, sf, "article tag"), word=" then ", page_size=50)


_SEARCHED = ("then", "ing the", "Über", "zq", "no such words")
_ONE = """(select '{w}' as word, * from (select id, title, summary, view_num, create_time, tag_name, in_title, count(*) over () as total from (select a.id, title, summary, view_num, create_time, coalesce(t.name, '') as tag_name, content,
  contains(strip_accents(lower(title)), strip_accents(lower('{w}'))) as in_title from article a left join tag t on a.tag_id = t.id where status = 'published') where in_title or contains(content, '{w}') order by in_title desc, view_num desc, id desc limit 20))"""


@query("indexed_search", with_views("article tag", " union all ".join(_ONE.format(w=w) for w in _SEARCHED)))
def _(spark, sf):
    """The article table sorted by id, its trigram index, and searches of frequent, rare, short and absent words."""
    article, tag = _views(spark, sf, "article tag")
    base = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    article.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{base}/article")
    stored = spark.read.parquet(f"{base}/article")
    search_index.add_to_index(stored, f"{base}/index")
    index, out = search_index.open_index(spark, f"{base}/index"), None
    for w in _SEARCHED:
        rows = search_index.indexed_search(stored, tag, index, w, page_size=20).select(F.lit(w).alias("word"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "hot_articles",
    with_views(
        "article view_event",
        """, c as (select article_id, count(*) as views from view_event group by article_id)
select a.id, title, coalesce(c.views, a.view_num) as view_num from article a left join c on a.id = c.article_id where status = 'published' order by 3 desc, 1 limit 3""",
    ),
)
def _(spark, sf):
    article, views = _views(spark, sf, "article view_event")
    return catalog.hot_articles(article, views.groupBy("article_id").agg(F.count("*").alias("views")))


@query(
    "timeline",
    with_views(
        "article",
        f"select year, string_agg(id || ':' || title, '|' order by create_time desc, id desc) as articles from (select *, year(create_time) as year {_PUB}) group by year",
    ),
)
def _(spark, sf):
    t = catalog.timeline(view(spark, sf, "article"))
    return t.select(F.col("year").cast("long"), F.array_join(F.transform("articles", lambda x: F.concat_ws(":", x["id"].cast("string"), x["title"])), "|").alias("articles"))


@query("article_counts", with_views("article", "select status, count(*) as n from article group by status"))
def _(spark, sf):
    return catalog.article_counts(view(spark, sf, "article"))


@query("articles_by_ids", with_views("article comment", "select * from article where id in (select article_id from comment where status = 'approved')"))
def _(spark, sf):
    article, comment = _views(spark, sf, "article comment")
    return catalog.rows_by_keys(article, comment.where("status = 'approved'").select("article_id"), "id").select(*article.columns)


@query("comments_by_ids", with_views("comment comment_report", "select * from comment where id in (select comment_id from comment_report)"))
def _(spark, sf):
    comment, report = _views(spark, sf, "comment comment_report")
    return catalog.rows_by_keys(comment, report.select("comment_id"), "id").select(*comment.columns)


@query("images_by_keys", with_views("article_image image_reference", "select * from article_image where object_key in (select concat('img/', cast(image_id as string), '.png') from image_reference)"))
def _(spark, sf):
    image, ref = _views(spark, sf, "article_image image_reference")
    keys = ref.select(F.concat(F.lit("img/"), F.col("image_id").cast("string"), F.lit(".png")).alias("key"))
    return catalog.rows_by_keys(image, keys, "object_key").select(*image.columns)


@query("time_view_projection", with_views("article", f"select id, view_num, epoch_ms(create_time) as create_ms {_PUB}"))
def _(spark, sf):
    return catalog.time_view_projection(view(spark, sf, "article"))


@query(
    "draft_list",
    with_views(
        "article tag",
        f"""select a.id, title, published_id, case when published_id is null then 'new' else 'edit' end as type, coalesce(t.name, '') as tag_name, update_time, count(*) over () as total
{_TAGGED} where status = 'draft' order by update_time desc, a.id desc limit 20""",
    ),
)
def _(spark, sf):
    return catalog.draft_list(*_views(spark, sf, "article tag"), page_size=20)


@query("draft_of_article", with_views("article", "select p.id as published_id, p.title as published_title, d.id as draft_id, d.title as draft_title from article p join article d on d.published_id = p.id and d.status = 'draft' where p.status = 'published'"))
def _(spark, sf):
    return catalog.draft_of_article(view(spark, sf, "article"))


@query("site_dynamics", with_views("site_dynamic", "select * from site_dynamic where status = 'published'"))
def _(spark, sf):
    return catalog.site_dynamics(view(spark, sf, "site_dynamic"))


@query("link_list", with_views("link", "select * from link"))
def _(spark, sf):
    return catalog.link_list(view(spark, sf, "link"))


_OFF = "(comment_disabled and (disabled_until is null or disabled_until > timestamp '2024-02-10 00:00:00'))"


@query(
    "user_list",
    with_views(
        "site_user comment",
        f""", s as (select user_id, count(*) as comment_count, max(create_time) as last_comment_time from comment group by user_id)
select u.*, coalesce(comment_count, 0) as comment_count, last_comment_time, count(*) over () as total from site_user u left join s on u.id = s.user_id
where provider = 'github' and not {_OFF} order by create_time desc, id desc limit 100""",
    ),
)
def _(spark, sf):
    return community.user_list(*_views(spark, sf, "site_user comment"), now=NOW, provider="github", permission="normal", page_size=100)


@query("effective_permission", with_views("site_user", f"select * replace (case when {_OFF} then disabled_until end as disabled_until), {_OFF} as disabled from site_user"))
def _(spark, sf):
    return community.effective_permission(view(spark, sf, "site_user"), NOW)


@query("next_user_handle", with_views("site_user", "select lpad(cast(max(try_cast(handle as bigint)) + 3 as string), 5, '0') as handle from site_user where regexp_full_match(handle, '[0-9]+')"))
def _(spark, sf):
    return community.next_user_handle(view(spark, sf, "site_user"), 2)


@query(
    "normalize_handle",
    with_views(
        "site_user",
        """, h as (select id, concat(' ', ltrim(handle, '0'), ' ') as raw from site_user)
select id, case when regexp_full_match(trim(raw), '[0-9]+') and cast(trim(raw) as bigint) between 1 and 99999 then lpad(trim(raw), 5, '0') else trim(raw) end as handle from h""",
    ),
)
def _(spark, sf):
    raw = view(spark, sf, "site_user").select("id", F.concat(F.lit(" "), F.ltrim("handle", F.lit("0")), F.lit(" ")).alias("raw"))
    return raw.select("id", C.normalize_handle(F.col("raw")).alias("handle"))


@query(
    "comment_admin_list",
    with_views(
        "comment article site_user",
        """select c.*, a.title as article_title, u.display_name as author_name, u.handle as author_handle, r.display_name as reply_to_name, r.handle as reply_to_handle, count(*) over () as total
from comment c left join article a on c.article_id = a.id left join site_user u on c.user_id = u.id left join site_user r on c.reply_to_user_id = r.id
where c.status = 'approved' and contains(lower(c.content), 'then') and c.create_time between timestamp '2024-01-01 01:00:00' and timestamp '2024-06-01 00:00:00'
order by c.create_time desc, c.id desc limit 50""",
    ),
)
def _(spark, sf):
    return community.comment_admin_list(*_views(spark, sf, "comment article site_user"), status="approved", content="Then", start=datetime(2024, 1, 1, 1), end=datetime(2024, 6, 1), page_size=50)


@query(
    "approved_comments",
    with_views(
        "comment site_user",
        r""", x as (select id, trim(regexp_replace(content, '\s+', ' ', 'g')) as t from comment)
select c.id, c.article_id, c.parent_id, c.content, c.create_time, u.display_name as author_name, u.handle as author_handle, r.display_name as reply_to_name,
case when length(x.t) > 48 then substr(x.t, 1, 48) || '...' else x.t end as reply_to_excerpt
from comment c left join site_user u on c.user_id = u.id left join site_user r on c.reply_to_user_id = r.id left join x on c.reply_to_comment_id = x.id where c.status = 'approved'""",
    ),
)
def _(spark, sf):
    return community.approved_comments(*_views(spark, sf, "comment site_user"))


_PARENTS = "select id, article_id, user_id, content, create_time, row_number() over (partition by article_id order by create_time, id) as position, count(*) over (partition by article_id) as total from comment where status = 'approved' and parent_id = 0"


@query("approved_parents", with_views("comment", f"select * from ({_PARENTS}) where position between 3 and 4"))
def _(spark, sf):
    return community.approved_parents(view(spark, sf, "comment"), page=2, page_size=2)


@query("approved_parents_second", with_views("comment", f"select * from ({_PARENTS}) where position = 2"))
def _(spark, sf):
    """A page that has rows: the second parent of every article."""
    return community.approved_parents(view(spark, sf, "comment"), page=2, page_size=1)


_REPLIES = """select parent_id, id, user_id, content, create_time, row_number() over (partition by parent_id order by create_time, id) as position, count(*) over (partition by parent_id) as total
from comment where status = 'approved' and parent_id in (select id from comment where status = 'approved' and parent_id = 0)"""


@query("reply_pages", with_views("comment", f"select *, total > 2 as has_more, case when total > 2 then 2 end as next_page from ({_REPLIES}) where position <= 2"))
def _(spark, sf):
    return community.reply_pages(view(spark, sf, "comment"), page_size=2)


@query(
    "comment_thread",
    with_views(
        "comment",
        f""", p as ({_PARENTS}), r as (select parent_id, string_agg(cast(id as string), ',' order by position) as ids, max(total) as reply_total from ({_REPLIES}) where position <= 2 group by parent_id)
select p.*, coalesce(ids, '') as reply_ids, coalesce(reply_total, 0) as reply_total, coalesce(reply_total > 2, false) as has_more from p left join r on p.id = r.parent_id where position <= 3""",
    ),
)
def _(spark, sf):
    t = community.comment_thread(view(spark, sf, "comment"), page_size=3, reply_size=2)
    return t.withColumn("reply_ids", F.array_join(F.col("reply_ids").cast("array<string>"), ","))


@query(
    "report_list",
    with_views(
        "comment_report comment site_user article",
        """select p.*, c.article_id, c.user_id as author_id, c.content as comment_content, a.title as article_title, u.display_name as reporter_name, u.handle as reporter_handle, v.display_name as author_name, v.handle as author_handle, count(*) over () as total
from comment_report p left join comment c on p.comment_id = c.id left join article a on c.article_id = a.id left join site_user u on p.reporter_id = u.id left join site_user v on c.user_id = v.id
where contains(cast(p.comment_id as string), '01') or contains(lower(c.content), '01') order by p.create_time desc, p.id desc limit 50""",
    ),
)
def _(spark, sf):
    return community.report_list(*_views(spark, sf, "comment_report comment site_user article"), query="01", page_size=50)


@query("reported_by", with_views("comment_report comment", "select distinct comment_id from comment_report where reporter_id = 7 and comment_id in (select id from comment)"))
def _(spark, sf):
    report, comment = _views(spark, sf, "comment_report comment")
    return community.reported_by(report, 7, comment.select("id"))


@query(
    "image_list",
    with_views(
        "article_image image_reference",
        """, s as (select image_id, sum(ref_count) as n from image_reference group by image_id)
select i.*, cast(coalesce(n, 0) as bigint) as ref_total, count(*) over () as total from article_image i left join s on i.id = s.image_id
where contains(object_key, '1') or contains(url, '1') order by update_time desc, id desc limit 50""",
    ),
)
def _(spark, sf):
    return community.image_list(*_views(spark, sf, "article_image image_reference"), keyword="1", page_size=50)


@query(
    "image_references",
    with_views("image_reference article", "select r.*, a.title as article_title, cast(sum(ref_count) over (partition by image_id) as bigint) as image_total from image_reference r left join article a on r.article_id = a.id"),
)
def _(spark, sf):
    return community.image_references(*_views(spark, sf, "image_reference article"))


@query("image_reference_counts", with_views("article_image image_reference", "select i.id, count(r.id) as n, count(r.id) = 0 as deletable from article_image i left join image_reference r on r.image_id = i.id group by i.id"))
def _(spark, sf):
    return community.image_reference_counts(*_views(spark, sf, "article_image image_reference"))


@query(
    "flatten_profile",
    with_views(
        "site_user",
        """select id, display_name as name, cast(null as varchar) as job, handle as "workLife", cast(null as varchar) as address, provider as "domainInfo", cast(null as varchar) as "blogContent",
cast(null as varchar) as "websiteLocation", cast(null as varchar) as statement, handle || '@a.example,' || handle || '@b.example' as email from site_user""",
    ),
)
def _(spark, sf):
    mail = F.array(F.concat("handle", F.lit("@a.example")), F.concat("handle", F.lit("@b.example")))
    admins = view(spark, sf, "site_user").select(
        "id",
        F.to_json(F.struct(F.col("display_name").alias("name"), F.col("handle").alias("workLife"))).alias("about_me_info"),
        F.to_json(F.struct(F.col("provider").alias("domainInfo"))).alias("web_site_info"),
        F.to_json(F.struct(mail.alias("email"))).alias("contact_me_info"),
    )
    return community.flatten_profile(admins)


@query(
    "excerpt",
    with_views("article", r", x as (select id, trim(regexp_replace(content, '\s+', ' ', 'g')) as t, content from article) select id, case when length(t) > 48 then substr(t, 1, 48) || '...' else t end as excerpt, substr(content, 1, 20) as cut from x"),
)
def _(spark, sf):
    return view(spark, sf, "article").select("id", C.excerpt(F.col("content")).alias("excerpt"), C.truncate_runes(F.col("content"), 20).alias("cut"))


@query(
    "format_time",
    with_views(
        "article",
        """select id, strftime(create_time + interval '8' hour, '%Y-%m-%d') as day, strftime(create_time + interval '8' hour, '%Y-%m-%d %H:%M') as minute, strftime(create_time + interval '8' hour, '%Y-%m-%d %H:%M:%S') as second from article""",
    ),
)
def _(spark, sf):
    t = F.col("create_time").cast("timestamp")
    return view(spark, sf, "article").select("id", *[C.format_time(t, p).alias(p) for p in ("day", "minute", "second")])


@query(
    "parse_time_or_minute",
    with_views(
        "article",
        """select id, case when id % 3 = 2 then null when id % 3 = 1 then date_trunc('minute', create_time) else create_time end as t from article""",
    ),
)
def _(spark, sf):
    text = F.expr("case when id % 3 = 2 then ' ' when id % 3 = 1 then date_format(create_time, 'yyyy-MM-dd HH:mm') else date_format(create_time, 'yyyy-MM-dd HH:mm:ss') end")
    return view(spark, sf, "article").select("id", C.parse_time_or_minute(text).cast("timestamp_ntz").alias("t"))

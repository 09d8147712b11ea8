"""Table maintenance as snapshot merges: each function takes tables and changes and returns the new table.

Where the reference refuses a whole call, an error is raised before anything is returned; the checks are small
aggregates. A caller persists the result with :func:`inkwell.sources.tables.write_snapshot`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions.columns import pad_handle
from inkwell.functions.numbering import numbered


def merge(target: DataFrame, changes: DataFrame, keys: list[str], update: dict[str, Column], insert: bool = True) -> DataFrame:
    """Full outer merge on ``keys``: where both sides exist ``update`` (over ``t.`` and ``c.`` columns) replaces columns of
    the target; rows of ``changes`` alone are inserted, or ignored. One shuffle on the keys."""
    t, c = target.withColumn("__t", F.lit(True)).alias("t"), changes.withColumn("__c", F.lit(True)).alias("c")
    on = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys]
    joined = t.join(c, on, "full_outer" if insert else "left")
    both, old = F.col("__t") & F.col("__c"), F.col("__t")
    out = []
    for name in target.columns:
        new = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
        value = F.when(both, update[name]).when(old, F.col(f"t.{name}")) if name in update else F.when(old, F.col(f"t.{name}"))
        out.append((value.otherwise(new) if insert else value).cast(target.schema[name].dataType).alias(name))
    return joined.select(*out)


def require(condition_rows: DataFrame, message: str) -> None:
    """Raise if there is any such row."""
    if not condition_rows.isEmpty():
        raise ValueError(message)


def trimmed(col: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(col), F.lit(""))


def filled(col: Column) -> Column:
    """The text as it is, null if blank."""
    return F.when(F.trim(col) != "", col)


def upsert_users(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or refresh provider users; a blank new name keeps the old one, a handle is only set where none was."""
    c = lambda n: F.col(f"c.{n}")
    update = {n: c(n) for n in ("avatar_url", "profile_url", "email", "update_time") if n in users.columns}
    update["display_name"] = F.coalesce(F.nullif(c("display_name"), F.lit("")), F.col("t.display_name"))
    update["handle"] = F.when(F.coalesce("t.handle", F.lit("")) == "", c("handle")).otherwise(F.col("t.handle"))
    return merge(users, changes, ["provider", "provider_user_id"], update)


def upsert_images(images: DataFrame, changes: DataFrame) -> DataFrame:
    """On a known object key overwrite everything but the id, key and create time."""
    kept = {"id", "object_key", "create_time"}
    return merge(images, changes, ["object_key"], {n: F.col(f"c.{n}") for n in changes.columns if n in images.columns and n not in kept})


def insert_ignore_images(images: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert images with new object keys; of equal keys in the batch the smallest id."""
    n = F.row_number().over(W.partitionBy("object_key").orderBy("id"))
    fresh = changes.withColumn("__n", n).where("__n = 1").join(images.select("object_key"), "object_key", "left_anti")
    return images.unionByName(fresh.select(*images.columns))


def save_drafts(articles: DataFrame, drafts: DataFrame, now: datetime) -> DataFrame:
    """Create or overwrite drafts, found by id or else by the published article they edit.

    ``drafts(seq, new_id, id, published_id, title, summary, content, tag_id)``. A blank title keeps the existing one, or
    becomes the next numbered draft title; numbers go on within the batch in order of ``seq``.
    """
    have = articles.where(F.col("status") == "draft")
    by_id = have.select(F.col("id").alias("id"), F.col("id").alias("__a"), F.col("title").alias("__ta"))
    by_pub = have.where(F.col("published_id").isNotNull()).select("published_id", F.col("id").alias("__b"), F.col("title").alias("__tb"))
    found = drafts.join(by_id, "id", "left").join(by_pub, "published_id", "left")
    found = found.withColumn("__target", F.coalesce("__a", "__b")).withColumn("__title", F.coalesce(trimmed(F.col("title")), F.coalesce("__ta", "__tb")))
    blank = found.where(F.col("__title").isNull())
    found = found.join(numbered(blank.select("seq"), "seq", "__k"), "seq", "left")  # blank new drafts of one batch
    title = F.coalesce("__title", F.concat(F.lit("草稿"), (have.agg(F.count("*")).scalar() + F.col("__k")).cast("string")))
    stamp = F.lit(now).cast(articles.schema["update_time"].dataType)
    changes = found.select(
        F.coalesce("__target", "new_id").alias("id"), title.alias("title"), "summary", "content", "tag_id", "published_id", F.lit("draft").alias("status"), F.lit(0).cast("long").alias("view_num"), stamp.alias("create_time"), stamp.alias("update_time")
    )
    return merge(articles, changes, ["id"], {n: F.col(f"c.{n}") for n in ("title", "summary", "content", "tag_id", "update_time")})


def publish_drafts(articles: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """New drafts become articles in place; drafts of an article are copied onto it (views and create time stay) and go."""
    stamp = F.lit(now).cast(articles.schema["update_time"].dataType)
    chosen = articles.where(F.col("status") == "draft").join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi")
    fresh = chosen.where(F.col("published_id").isNull()).withColumn("status", F.lit("published")).withColumn("view_num", F.lit(0).cast(articles.schema["view_num"].dataType)).withColumn("create_time", stamp).withColumn("update_time", stamp)
    edits = chosen.where(F.col("published_id").isNotNull()).select(F.col("published_id").alias("id"), "title", "summary", "content", "tag_id")
    rest = articles.join(chosen.select("id"), "id", "left_anti")
    update = {n: F.col(f"c.{n}") for n in ("title", "summary", "content", "tag_id")} | {"update_time": stamp}
    return merge(rest, edits, ["id"], update, insert=False).unionByName(fresh.select(*articles.columns))


def delete_articles(articles: DataFrame, refs: DataFrame, comments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete articles that exist and have a tag, with their drafts, image references and comments."""
    gone = articles.where((F.col("status") == "published") & F.col("tag_id").isNotNull()).join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_semi").select("id")
    left = articles.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "published_id"), "published_id", "left_anti").select(*articles.columns)
    by_article = gone.withColumnRenamed("id", "article_id")
    return left, refs.join(by_article, "article_id", "left_anti").select(*refs.columns), comments.join(by_article, "article_id", "left_anti").select(*comments.columns)


def delete_comments(comments: DataFrame, ids: DataFrame) -> DataFrame:
    """All or nothing: an unknown id is an error. Replies stay."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    require(wanted.join(comments.select("id"), "id", "left_anti"), "unknown comment")
    return comments.join(wanted, "id", "left_anti").select(*comments.columns)


def delete_images(images: DataFrame, refs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return images.join(gone, "id", "left_anti").select(*images.columns), refs.join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti").select(*refs.columns)


def ensure_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with the missing names added; ids go on from the largest, by name."""
    fresh = names.select(F.col(names.columns[0]).alias("name")).where("name is not null and name <> ''").distinct().join(tags.select("name"), "name", "left_anti")
    largest = tags.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return tags.unionByName(numbered(fresh, "name", "__k").select((F.col("__k") + largest).cast(tags.schema["id"].dataType).alias("id"), "name"))


def retag_articles(articles: DataFrame, tags: DataFrame, ids: DataFrame, name: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Set a tag, made if need be, on published articles, whose live view counts are written back first."""
    spark = articles.sparkSession
    new_tags = ensure_tags(tags, spark.createDataFrame([(name,)], "name string"))
    rows = write_back_views(articles, counts) if counts is not None else articles
    change = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("tag_id", new_tags.where(F.col("name") == name).agg(F.min("id")).scalar())
    hit = F.when(F.col("t.status") == "published", F.col("c.tag_id")).otherwise(F.col("t.tag_id"))
    return merge(rows, change, ["id"], {"tag_id": hit}, insert=False), new_tags


def write_back_views(articles: DataFrame, counts: DataFrame) -> DataFrame:
    """View counts of published articles set from ``counts(article_id, views)``."""
    c = counts.select(F.col("article_id").alias("id"), F.col("views").alias("view_num"))
    return merge(articles, c, ["id"], {"view_num": F.when(F.col("t.status") == "published", F.col("c.view_num")).otherwise(F.col("t.view_num"))}, insert=False)


def append_site_dynamics(rows: DataFrame, new: DataFrame, max_runes: int = 500) -> DataFrame:
    """Append entries ``(id, content, status, event_day)`` in order of id after the largest sort order."""
    trimmed = new.withColumn("content", F.trim("content")).withColumn("event_time", F.try_to_timestamp("event_day", F.lit("yyyy-MM-dd")).cast(rows.schema["event_time"].dataType))
    require(trimmed.where((F.col("content") == "") | (F.length("content") > max_runes) | F.col("event_time").isNull()), "bad content or day")
    order = F.col("__k") + rows.agg(F.coalesce(F.max("sort_order"), F.lit(0))).scalar()
    return rows.unionByName(numbered(trimmed, "id", "__k").withColumn("sort_order", order.cast(rows.schema["sort_order"].dataType)).select(*rows.columns))


def reorder_site_dynamics(rows: DataFrame, order: DataFrame) -> DataFrame:
    """``order(id, position)``: positions from 1. Unknown and repeated ids are errors."""
    require(order.groupBy("id").count().where("count > 1"), "repeated id")
    require(order.join(rows.select("id"), "id", "left_anti"), "unknown id")
    return merge(rows, order.select("id", F.col("position").alias("sort_order")), ["id"], {"sort_order": F.col("c.sort_order")}, insert=False)


def merge_site_dynamics(rows: DataFrame, updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """Update content, status and event time by id and delete by id; an unknown id is an error."""
    for part in (updates, deletes):
        require(part.select("id").join(rows.select("id"), "id", "left_anti"), "unknown id")
    kept = rows.join(deletes.select("id").distinct(), "id", "left_anti").select(*rows.columns)
    return merge(kept, updates, ["id"], {n: F.col(f"c.{n}") for n in ("content", "status", "event_time")}, insert=False)


STATUSES = ("approved", "pending", "rejected")


def set_comment_status(comments: DataFrame, ids: DataFrame, status: str, now: datetime | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    require(wanted.join(comments.select("id"), "id", "left_anti"), "unknown comment")
    update = {"status": F.lit(status)} | ({"update_time": F.lit(now)} if now is not None and "update_time" in comments.columns else {})
    return merge(comments, wanted, ["id"], update, insert=False)


def set_permission(users: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(id, comment_disabled, disabled_until)`` and, where both have it, the reason."""
    names = [n for n in ("comment_disabled", "disabled_until", "disabled_reason") if n in changes.columns and n in users.columns]
    return merge(users, changes, ["id"], {n: F.col(f"c.{n}") for n in names}, insert=False)


def bump_session(users: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return merge(users, wanted, ["id"], {"session_version": F.col("t.session_version") + 1}, insert=False)


def resolve_reports(reports: DataFrame, comments: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``actions(comment_id, accept)``: the comment's pending reports are accepted and it is rejected, or the other way."""
    pending = reports.where(F.col("status") == "pending").select("comment_id").distinct()
    require(actions.join(pending, "comment_id", "left_anti"), "no pending report")
    a = actions.select("comment_id", F.col("accept").alias("__accept"))
    joined = reports.join(a, "comment_id", "left")
    status = F.when((F.col("status") == "pending") & F.col("__accept"), "accepted").when((F.col("status") == "pending") & ~F.col("__accept"), "rejected").otherwise(F.col("status"))
    new_reports = joined.withColumn("status", status).select(*reports.columns)
    change = a.select(F.col("comment_id").alias("id"), F.when(F.col("__accept"), "rejected").otherwise("approved").alias("status"))
    return new_reports, merge(comments, change, ["id"], {"status": F.col("c.status")}, insert=False)


def escalate_reported(reports: DataFrame, comments: DataFrame, threshold: int = 3) -> DataFrame:
    """Approved comments with at least ``threshold`` pending reports become pending."""
    many = reports.where(F.col("status") == "pending").groupBy(F.col("comment_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return merge(comments, many, ["id"], {"status": F.when(F.col("t.status") == "approved", "pending").otherwise(F.col("t.status"))}, insert=False)


def escalation_points(reports: DataFrame, threshold: int = 3) -> DataFrame:
    """The pending report that reaches the threshold, per comment."""
    n = F.row_number().over(W.partitionBy("comment_id").orderBy("create_time", "id"))
    return reports.where(F.col("status") == "pending").withColumn("n", n).where(F.col("n") == threshold).select("comment_id", F.col("id").alias("report_id"), "create_time")


def resolve_reply_targets(new: DataFrame, comments: DataFrame) -> DataFrame:
    """Validate and flatten replies to two levels.

    ``new(request_id, article_id, parent_id, reply_to_comment_id)`` with 0 for none. Adds ``root_id``, ``reply_comment_id``,
    ``reply_user_id`` and ``error`` (``comment_not_found``, ``invalid_comment`` or blank).
    """
    side = lambda p, key: comments.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("article_id", "status", "user_id", "parent_id")], F.lit(True).alias(f"{p}_found"))
    j = new.join(side("p", "parent_id"), "parent_id", "left").join(side("r", "reply_to_comment_id"), "reply_to_comment_id", "left")
    has_p, has_r = F.col("parent_id") != 0, F.col("reply_to_comment_id") != 0
    lost = (has_p & F.col("p_found").isNull()) | (has_r & F.col("r_found").isNull())
    root_p = F.when(F.col("p_parent_id") != 0, F.col("p_parent_id")).otherwise(F.col("parent_id"))
    root_r = F.when(F.col("r_parent_id") != 0, F.col("r_parent_id")).otherwise(F.col("reply_to_comment_id"))
    root = F.when(has_p, root_p).when(has_r, root_r).otherwise(0)
    wrong_p = has_p & ((F.col("p_article_id") != F.col("article_id")) | (F.col("p_status") != "approved"))
    wrong_r = has_r & ((F.col("r_article_id") != F.col("article_id")) | (F.col("r_status") != "approved") | ((F.col("reply_to_comment_id") != root) & (F.col("r_parent_id") != root)))
    error = (
        F.when(has_p & F.col("p_found").isNull(), "comment_not_found")
        .when(wrong_p, "invalid_comment")
        .when(has_r & F.col("r_found").isNull(), "comment_not_found")
        .when(wrong_r, "invalid_comment")
        .otherwise("")
    )
    ok = error == ""
    return j.select(
        "request_id",
        "article_id",
        F.when(ok, root).alias("root_id"),
        F.when(ok, F.when(has_r, F.col("reply_to_comment_id")).when(has_p, F.col("parent_id")).otherwise(0)).alias("reply_comment_id"),
        F.when(ok, F.when(has_r, F.col("r_user_id")).when(has_p, F.col("p_user_id")).otherwise(0)).alias("reply_user_id"),
        error.alias("error"),
    )


def comment_eligibility(requests: DataFrame, users: DataFrame, articles: DataFrame, now: datetime) -> DataFrame:
    """First failing check of a comment request: user, session, permission, article, content. Blank where none fails.

    ``requests(request_id, user_id, session_version, article_id, content)``; a session version of 0 or null is absent.
    """
    from inkwell.functions.columns import effective_disabled

    u = users.select(F.col("id").alias("user_id"), F.col("session_version").alias("__s"), "comment_disabled", "disabled_until", F.lit(True).alias("__u"))
    a = articles.where(F.col("status") == "published").select(F.col("id").alias("article_id"), F.lit(True).alias("__a"))
    j = requests.join(u, "user_id", "left").join(a, "article_id", "left")
    given = F.coalesce("session_version", F.lit(0))
    stale = F.when(given > 0, given != F.col("__s")).otherwise(F.col("__s") > 1)
    error = (
        F.when(F.col("__u").isNull(), "unauthorized")
        .when(stale, "session_invalid")
        .when(effective_disabled(F.col("comment_disabled"), F.col("disabled_until"), now), "forbidden")
        .when(F.col("__a").isNull(), "article_not_found")
        .when(F.coalesce(F.trim("content"), F.lit("")) == "", "invalid_comment")
        .otherwise("")
    )
    return j.select("request_id", error.alias("error"))


def report_eligibility(requests: DataFrame, comments: DataFrame, reports: DataFrame) -> DataFrame:
    """First failing check of a report request: comment exists, is approved, is another user's, is not yet reported."""
    c = comments.select(F.col("id").alias("comment_id"), F.col("status").alias("__status"), F.col("user_id").alias("__author"))
    r = reports.select("comment_id", "reporter_id", F.lit(True).alias("__again")).distinct()
    j = requests.join(c, "comment_id", "left").join(r, ["comment_id", "reporter_id"], "left")
    error = F.when(F.col("__status").isNull(), "comment_not_found").when(F.col("__status") != "approved", "invalid_comment").when(F.col("__author") == F.col("reporter_id"), "forbidden").when(F.col("__again"), "already_reported").otherwise("")
    return j.select("request_id", "comment_id", "reporter_id", error.alias("error"))


def link_merge(links: DataFrame, changes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Add, update (blank fields are left alone) and delete links by id; names and addresses must stay unique."""
    kept = links.join(deletes.select("id").distinct(), "id", "left_anti").select(*links.columns)
    update = {n: F.coalesce(filled(F.col(f"c.{n}")), F.col(f"t.{n}")) for n in ("name", "url")} | {"update_time": F.col("c.update_time")}
    out = merge(kept, changes, ["id"], update)
    for n in ("name", "url"):
        require(out.groupBy(n).count().where("count > 1"), f"repeated {n}")
    return out


def upsert_articles(articles: DataFrame, tags: DataFrame, changes: DataFrame, counts: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Add or update published articles. ``changes(id, title, summary, content, tag)``; returns articles and tags.

    An update leaves fields alone whose new value is blank and carries the live view count over. A new article starts
    at zero views with all times now. Image references follow with :func:`inkwell.operators.images.sync_image_refs`.
    """
    new_tags = ensure_tags(tags, changes.select("tag"))
    stamp = F.lit(now).cast(articles.schema["update_time"].dataType)
    c = changes.join(new_tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag")), "tag", "left")
    c = c.join(counts.select(F.col("article_id").alias("id"), F.col("views").alias("__views")), "id", "left")
    c = c.select("id", "title", "summary", "content", "tag_id", "__views", F.lit("published").alias("status"), F.lit(0).alias("view_num"), stamp.alias("create_time"), stamp.alias("update_time"))
    live = F.col("t.status") == "published"
    keep = lambda n, new: F.when(live, F.coalesce(new, F.col(f"t.{n}"))).otherwise(F.col(f"t.{n}"))
    update = {n: keep(n, filled(F.col(f"c.{n}"))) for n in ("title", "summary", "content")}
    update |= {"tag_id": keep("tag_id", F.col("c.tag_id")), "view_num": keep("view_num", F.col("c.__views")), "update_time": keep("update_time", F.col("c.update_time"))}
    return merge(articles, c, ["id"], update), new_tags


def append_comments(comments: DataFrame, decided: DataFrame, users: DataFrame) -> DataFrame:
    """New comments: the author's name cut to 80 code points, status and encoded reasons from the decision.

    ``decided(id, article_id, parent_id, user_id, reply_to_user_id, reply_to_comment_id, content, status, reasons, ip, create_time)``.
    """
    named = decided.join(users.select(F.col("id").alias("user_id"), F.substring("display_name", 1, 80).alias("author_name")), "user_id", "left")
    named = named.withColumn("moderation_reasons", F.to_json("reasons")).drop("reasons")
    return comments.unionByName(named, allowMissingColumns=True)


def append_reports(reports: DataFrame, new: DataFrame) -> DataFrame:
    """New pending reports, reasons trimmed and cut to 200 code points; one per comment and reporter, the first by id."""
    n = F.row_number().over(W.partitionBy("comment_id", "reporter_id").orderBy("id"))
    fresh = new.withColumn("__n", n).where("__n = 1").drop("__n").join(reports.select("comment_id", "reporter_id"), ["comment_id", "reporter_id"], "left_anti")
    fresh = fresh.withColumn("status", F.lit("pending"))
    if "reason" in fresh.columns:
        fresh = fresh.withColumn("reason", F.substring(F.trim("reason"), 1, 200))
    return reports.unionByName(fresh.select(*reports.columns))


GITHUB = "id long, login string, name string, avatar_url string, html_url string, email string"
GOOGLE = "sub string, name string, picture string, profile string, email string"


def normalize_provider_profiles(raw: DataFrame, users: DataFrame) -> DataFrame:
    """Provider JSON ``raw(seq, provider, body)`` to user rows. A missing id or name is rejected; GitHub names fall back
    to the login. New users get consecutive handles in order of ``seq``; ready for :func:`upsert_users`."""
    g, o = F.from_json("body", GITHUB), F.from_json("body", GOOGLE)
    github = raw.where(F.col("provider") == "github").select(
        "seq", "provider", F.nullif(g["id"], F.lit(0)).cast("string").alias("provider_user_id"), F.coalesce(trimmed(g["name"]), trimmed(g["login"])).alias("display_name"), g["avatar_url"].alias("avatar_url"), g["html_url"].alias("profile_url"), g["email"].alias("email")
    )
    google = raw.where(F.col("provider") == "google").select("seq", "provider", F.nullif(o["sub"], F.lit("")).alias("provider_user_id"), trimmed(o["name"]).alias("display_name"), o["picture"].alias("avatar_url"), o["profile"].alias("profile_url"), o["email"].alias("email"))
    rows = github.unionByName(google).where("provider_user_id is not null and display_name is not null")
    fresh = numbered(rows.join(users.select("provider", "provider_user_id"), ["provider", "provider_user_id"], "left_anti").select("seq"), "seq", "k")
    number = F.when(F.col("handle").rlike("^[0-9]+$"), F.col("handle")).try_cast("long")
    top = users.agg(F.coalesce(F.max(F.when(number > 0, number)), F.lit(0).cast("long"))).scalar()
    return rows.join(fresh, "seq", "left").withColumn("handle", F.coalesce(pad_handle(top + F.col("k")), F.lit(""))).drop("k")

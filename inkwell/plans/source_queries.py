"""Registered queries of readers, writers and policies. Their files are derived from the tables and lie in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.functions import columns as C, text
from inkwell.functions.checkpoint import shared_dir
from inkwell.operators import images
from inkwell.operators.moderation import decision, lexicon
from inkwell.plans.moderation_queries import EVALUATION, POLICY
from inkwell.plans.registry import query
from inkwell.plans.views import view, with_views
from inkwell.sources import policy, tables


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/sources-{uuid.uuid4().hex}"


@query("read_table", with_views("link", "select id, name, url, strftime(update_time, '%Y-%m-%d %H:%M:%S') as created, strftime(update_time, '%Y-%m-%d %H:%M:%S') as updated from link"))
def _(spark, sf):
    base = _folder(spark)
    view(spark, sf, "link").withColumn("create_time", F.col("update_time")).withColumn("id", F.col("id").cast("string")).withColumn("more", F.lit(1)).write.parquet(f"{base}/link.parquet")
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return tables.read_table(spark, base, "link").select("id", "name", "url", time("create_time").alias("created"), time("update_time").alias("updated"))


@query("read_corpus", with_views("corpus_case", "select cast(id as varchar) as id, category || ' text ' || id as text, expected, category, 'a,b' as tags, '' as note from corpus_case"))
def _(spark, sf):
    cases = view(spark, sf, "corpus_case").select(F.col("id").cast("string").alias("id"), F.concat("category", F.lit(" text "), "id").alias("text"), "expected", "category", F.lit("a,b").alias("tags"), F.lit("").alias("note"))
    files = 8
    lines = cases.select(F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file"), F.lit(2).alias("k"), F.concat_ws("\t", *tables.CORPUS).alias("line"))
    heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("# derived cases").alias("line")), F.struct(F.lit(1).alias("k"), F.lit("\t".join(tables.CORPUS)).alias("line")))).alias("x")).select("file", "x.*")
    base = _folder(spark)
    lines.unionByName(heads).repartitionById(files, F.col("file")).sortWithinPartitions("k").select("line").write.text(f"{base}/corpus")
    return tables.read_corpus(spark, f"{base}/corpus").drop("corpus")


_MARKS = [("lexicon_block", "purchase"), ("lexicon_review", "worthless"), ("lexicon_review", "pathetic"), ("lexicon_review", "signup"), ("lexicon_review", "er"), ("lexicon_review", "k"), ("fuzzy", "paylaod"), ("fuzzy", "clikc"),
          ("risk_phrase", "topicerror"), ("technical", "payload"), ("actionable", "click"), ("unambiguous_benign", "signup"), ("reporting", "error"), ("severe", "worthless")]


@query(
    "policy_tables",
    with_views(
        "comment_in",
        f""", t as (select * from (values {", ".join(f"('{k}', '{w}')" for k, w in _MARKS)}) t(kind, term)), c as (select comment_id, regexp_replace(lower(content), '[\\s\\pP\\pS]', '', 'g') as x from comment_in)
select kind, term, count(comment_id) as comments from t left join c on contains(x, term) group by kind, term""",
    ),
)
def _(spark, sf):
    terms = policy.policy_tables(spark, POLICY)["term"].select("kind", "term")
    compact = view(spark, sf, "comment_in").select("comment_id", text.compact_text(F.lower("content")).alias("text"))
    held = lexicon.term_hits(compact, terms, ["comment_id"]).groupBy("kind", "term").agg(F.count_distinct("comment_id").alias("n"))
    return terms.join(held, ["kind", "term"], "left").select("kind", "term", F.coalesce("n", F.lit(0)).alias("comments"))


@query(
    "validate_policy",
    with_views(
        "comment_in",
        """select comment_id, case when comment_id % 4 > 2 then 'lexicon.fuzzy.max_distance must be at most 2' when comment_id % 19 > 16 then 'behavior_rules.near_duplicate.max_hamming_distance must be at most 16'
when comment_id % 53 > 50 then 'behavior_rules.near_duplicate.max_length_difference_percent must be at most 50' when comment_id % 7 = 0 then 'combination_rules[0]: id is required' else '' end as error from comment_in""",
    ),
)
def _(spark, sf):
    k = F.col("comment_id")
    number = lambda n: (k % n).cast("string")
    rule = F.when(k % 7 == 0, " ").otherwise("r")
    body = F.concat(
        F.lit('{"lexicon":{"fuzzy":{"max_distance":'), number(4), F.lit(',"candidate_words":{"spam":["abcdef"]}}},"behavior_rules":{"near_duplicate":{"max_hamming_distance":'), number(19),
        F.lit(',"max_length_difference_percent":'), number(53), F.lit('}},"combination_rules":[{"id":"'), rule, F.lit('","subjects":["a"],"predicates":["b"]}]}'),
    )
    return view(spark, sf, "comment_in").select("comment_id", policy.policy_error(body).alias("error"))


@query("read_risk_audit", with_views("risk_request", "select scene, cast(request_id % 2 as integer) as decision, count(*) as n, cast(sum(sample_count) as bigint) as score, epoch_ms(min(server_ms)) is not null as dated, max(server_ms) as last_ms from risk_request group by all"))
def _(spark, sf):
    base = _folder(spark)
    r = view(spark, sf, "risk_request")
    r.select(F.lit("risk").alias("event"), "scene", "target_id", F.col("fp").alias("fingerprint_id"), "ip", "user_agent", F.expr("cast(request_id % 2 as int)").alias("decision"), F.lit("x").alias("reject_reason"), F.col("sample_count").alias("score"), F.col("client_ms").alias("client_ts"), F.col("server_ms").alias("server_ts")).write.json(base)
    a = tables.read_risk_audit(spark, base)
    last = F.max(F.unix_millis("ts")).alias("last_ms")
    return a.groupBy("scene", "decision").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("long")).alias("score"), F.bool_and(F.col("ts").isNotNull()).alias("dated"), last)


@query("read_access_log", with_views("risk_request", "select '/' || scene as path, cast(200 + request_id % 3 as integer) as status, user_agent, count(*) as n, max(duration_ms / 1000.0::double) as slowest from risk_request group by all"))
def _(spark, sf):
    base = _folder(spark)
    r = view(spark, sf, "risk_request")
    r.select(F.concat(F.lit("/"), "scene").alias("path"), F.expr("cast(200 + request_id % 3 as int)").alias("status"), F.lit("GET").alias("method"), F.lit("").alias("query"), "ip", F.col("user_agent").alias("user-agent"), (F.col("duration_ms") / F.lit(1000.0)).alias("cost"), F.lit("t").alias("time")).write.json(base)
    return tables.read_access_log(spark, base).groupBy("path", "status", "user_agent").agg(F.count("*").alias("n"), F.max("cost").alias("slowest"))


@query("write_snapshot", with_views("article", "select id, view_num + 1 as view_num, status from article"))
def _(spark, sf):
    base = _folder(spark)
    a = view(spark, sf, "article").select("id", "view_num", "status")
    old = tables.write_snapshot(a, base, ["status"])
    new = tables.write_snapshot(spark.read.parquet(old).withColumn("view_num", F.col("view_num") + 1), base, ["status"])
    return spark.read.parquet(new).select("id", "view_num", "status")


@query("write_eval_report", with_views("corpus_case", EVALUATION))
def _(spark, sf):
    base = _folder(spark)
    cases = view(spark, sf, "corpus_case")
    tables.write_eval_report(decision.judged_cases(cases), decision.evaluate_corpus(cases), base)
    return spark.read.parquet(f"{base}/summary")


_KIND = "page_id % 6"


@query(
    "image_asset_audit",
    f"""with f as (select page_id, {_KIND} as k, '<svg>' || coalesce(url, '') || case when page_id % 4 = 0 then '<script>' else '' end as svg, octet_length(encode(coalesce(html, ''))) as bytes from pages)
select 'img/' || page_id || case k when 0 then '.png' when 1 then '.jpg' when 2 then '.svg' when 3 then '.txt' when 4 then '.gif' else '.webp' end as path,
  case k when 0 then 8 + bytes when 1 then 3 + bytes when 2 then octet_length(encode(svg)) when 3 then bytes when 4 then bytes else 12 + bytes end as size,
  case k when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/svg+xml' when 4 then 'image/gif' when 5 then 'image/webp' end as mime,
  case when k = 3 then 'unsupported' when k = 2 and regexp_matches(svg, '(?is)<\\s*(script|iframe|object|embed|link|meta)\\b|\\bon[a-z]+\\s*=|javascript:') then 'unsafe_svg' else '' end as reason,
  not (k = 3 or (k = 2 and regexp_matches(svg, '(?is)<\\s*(script|iframe|object|embed|link|meta)\\b|\\bon[a-z]+\\s*=|javascript:'))) as allowed
from f""",
)
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    html, k = F.coalesce("html", F.lit("")).cast("binary"), F.col("page_id") % 6
    svg = F.concat(F.lit("<svg>"), F.coalesce("url", F.lit("")), F.when(F.col("page_id") % 4 == 0, "<script>").otherwise("")).cast("binary")
    magic = lambda digits: F.concat(F.unhex(F.lit(digits)), html)
    content = F.when(k == 0, magic("89504E470D0A1A0A")).when(k == 1, magic("FFD8FF")).when(k == 2, svg).when(k == 5, magic("524946460000000057454250")).otherwise(html)
    name = F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.when(k == 0, ".png").when(k == 1, ".jpg").when(k == 2, ".svg").when(k == 3, ".txt").when(k == 4, ".gif").otherwise(".webp"))
    return images.image_asset_audit(p.select(name.alias("path"), content.alias("content")))


@query("retry_after_seconds", with_views("attempt", "select attempt_id, greatest(cast(ceil((ts_ms % 7000 - 1500) / 1000.0) as bigint), 1) as seconds from attempt"))
def _(spark, sf):
    return view(spark, sf, "attempt").select("attempt_id", C.retry_after_seconds(F.col("ts_ms") % 7000 - 1500).alias("seconds"))

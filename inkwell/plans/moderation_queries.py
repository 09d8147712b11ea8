"""Registered moderation queries. The Latin word lists suit the driver's texts; Chinese rules are tested by golden rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from inkwell.functions import columns as C, text
from inkwell.operators.moderation import behavior, decision, lexicon, pipeline, structure
from inkwell.plans.registry import query
from inkwell.plans.views import view, with_views
from inkwell.sources.policy import policy_tables

POLICY = {
    "lexicon": {"custom_words": {"block": {"gambling": ["purchase"]}, "review": {"abuse": ["worthless", "pathetic"], "custom": ["signup", "er", "k"]}}, "fuzzy": {"candidate_words": {"spam_fraud": ["paylaod", "clikc"]}}},
    "structure_patterns": {"risk_phrases": ["topicerror"], "risk_patterns": ["payload.*ms"]},
    "combination_rules": [
        {"id": "note_click", "category": "spam_fraud", "subjects": ["note", "topic"], "predicates": ["click", "error"], "level": "review"},
        {"id": "view_load", "subjects": ["view"], "predicates": ["payload", "view"], "level": "notice"},
    ],
    "semantic_rules": {"contexts": {"technical_markers": ["payload"], "actionable_markers": ["click"], "unambiguous_benign_markers": ["signup"], "reporting_markers": ["error"]}, "abuse_policy": {"severe_markers": ["worthless"]}},
    "behavior_rules": {"user_frequency": {"window_seconds": 600, "review_threshold": 4}, "ip_frequency": {"window_seconds": 300, "review_threshold": 4}},
    "decision": {"rule_scores": {"lexicon:abuse:review": 50, "context.spam_fraud": 60, "structure": 30, "notice": 5}},
}


def _in(spark, sf):
    return view(spark, sf, "comment_in")


@query("normalize_text", with_views("comment_in", "select comment_id, lower(content) as normalized from comment_in"))
def _(spark, sf):
    return _in(spark, sf).select("comment_id", text.normalize_text(F.col("content")).alias("normalized"))


@query("compact_text", with_views("comment_in", r"select comment_id, regexp_replace(content, '[\s\pP\pS]', '', 'g') as compact from comment_in"))
def _(spark, sf):
    return _in(spark, sf).select("comment_id", text.compact_text(F.col("content")).alias("compact"))


@query("confusable_skeleton", with_views("comment_in", "select comment_id, replace(replace(content, 'о', 'o'), 'е', 'e') as skeleton from (select comment_id, replace(replace(content, 'o', 'о'), 'e', 'е') as content from comment_in)"))
def _(spark, sf):
    return _in(spark, sf).select("comment_id", text.confusable_skeleton(F.translate("content", "oe", "ое")).alias("skeleton"))


def _folded(value: str) -> str:
    """SQL that replaces the pairs one after the other, which is the same as at once where their matches do not overlap."""
    return reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1]}')", [*text.PINYIN, *text.INITIALS], value)


_SPELT = " ".join(a for a, _ in text.PINYIN[::5])


@query("fold_pinyin", with_views("comment_in", f"select comment_id, {_folded('event')} as folded from (select comment_id, lower('ziqun ' || case comment_id % 3 when 0 then '{_SPELT} ' when 1 then 'd0g 刷f ' else '' end || content) as event from comment_in)"))
def _(spark, sf):
    more = F.expr(f"case comment_id % 3 when 0 then '{_SPELT} ' when 1 then 'd0g 刷f ' else '' end")
    return _in(spark, sf).select("comment_id", text.pinyin_folded(F.lower(F.concat(F.lit("ziqun "), more, "content"))).alias("folded"))


@query("decoded_urls", with_views("comment_in", "select comment_id, 'http://site' || user_id || '.example.com/aa' as decoded from comment_in"))
def _(spark, sf):
    hidden = F.concat(F.lit("see "), F.base64(F.concat(F.lit("http://site"), F.col("user_id").cast("string"), F.lit(".example.com/aa")).cast("binary")), F.lit(" now"))
    return _in(spark, sf).select("comment_id", text.analysis(hidden).alias("a")).select("comment_id", F.array_join("a.decoded", ",").alias("decoded"))


@query(
    "text_views",
    with_views(
        "comment_in",
        rf""", v as (select comment_id, lower(c) as n, regexp_replace(lower(c), '[\s\pP\pS]', '', 'g') as k from (select comment_id, content || case when comment_id % 4 = 0 then ' сasino ziyuan' else '' end as c from comment_in)),
w as (select *, translate(k, '{text.CONFUSABLE_FROM}', '{text.CONFUSABLE_TO}') as s, {_folded('k')} as p from v)
select comment_id, n || '|' || k || case when s <> k then '|' || s else '' end || case when p <> k then '|' || p else '' end as views from w""",
    ),
)
def _(spark, sf):
    content = F.concat("content", F.expr("case when comment_id % 4 = 0 then ' сasino ziyuan' else '' end"))
    return _in(spark, sf).select("comment_id", text.analysis(content).alias("a")).select("comment_id", F.array_join(text.text_views("a"), "|").alias("views"))


_MARK = r"[\s\x{85}\x{a0}\pZ\x{1c}-\x{1f}\x{0b}]"


@query(
    "split_clauses",
    with_views(
        "article",
        rf""", t as (select id, coalesce(content, '') as v from article), p as (select id, v, i, substr(v, i, 1) as c, lower(substr(v, greatest(i - 8, 1), least(i - 1, 8))) as before from t, unnest(generate_series(1, length(v))) u(i)),
s as (select id, i, c, contains('。！？；：.!?;:' || chr(10) || chr(13), c)
  and not (c in (':', '：') and i > 1 and ((c = ':' and regexp_matches(before, '(https?|hxxps?)$')) or regexp_matches(regexp_replace(before, '[\s\x{{85}}\x{{a0}}\pZ\pP\pS]', '', 'g'), '(vx|v信|微信|微信号|wx|qq|企鹅|账号|联系方式)$')))
  and not (c = '.' and i > 1 and regexp_full_match(substr(v, i - 1, 3), '[\pL\p{{Nd}}_-][.][\pL\p{{Nd}}_-]')) as cut from p),
g as (select id, c, cut, sum(cast(cut as integer)) over (partition by id order by i) as part from s)
select t.id, greatest(count(distinct part) filter (not cut and not regexp_matches(c, '{_MARK}')), 1) as n from t left join g on g.id = t.id group by t.id""",
    ),
)
def _(spark, sf):
    return view(spark, sf, "article").select("id", F.size(text.analysis(F.col("content"))["clauses"]).cast("long").alias("n"))


_TERMS = "select * from (values ('then', 'spam_fraud', 'review'), ('the', 'custom', ''), ('of', 'sensitive', ''), ('worthless', 'profanity', 'block'), ('a', 'abuse', 'review'), ('er', 'drugs', '')) w(term, category, level)"


def _terms(spark):
    rows = [("then", "spam_fraud", "review"), ("the", "custom", ""), ("of", "sensitive", ""), ("worthless", "profanity", "block"), ("a", "abuse", "review"), ("er", "drugs", "")]
    return spark.createDataFrame(rows, "term string, category string, level string")


_HITS = f""", w as ({_TERMS}), t as (select id, lower(content) as v from comment), p as (select id, v, i from t, unnest(generate_series(1, length(v))) u(i)),
h as (select id, v, i, w.* from p join w on substr(p.v, p.i, length(w.term)) = w.term),
k as (select * from h where not (length(term) <= 2 and ((i > 1 and regexp_matches(substr(v, i - 1, 1), '[A-Za-z0-9_]')) or regexp_matches(substr(v, i + length(term), 1), '[A-Za-z0-9_]'))))
select distinct id as comment_id, case category when 'profanity' then 'abuse' else category end as category, case when level <> '' then level when category in ('drugs') then 'block' else 'review' end as level, term as evidence from k"""


@query("lexicon_signals", with_views("comment", _HITS))
def _(spark, sf):
    views = view(spark, sf, "comment").select(F.col("id").alias("comment_id"), F.lit(0).alias("view_no"), F.lower("content").alias("text"))
    return lexicon.lexicon_signals(views, _terms(spark)).drop("seq")


@query(
    "lexicon_level",
    with_views("comment", f", w as ({_TERMS}) select id as comment_id, term, case category when 'profanity' then 'abuse' else category end as category, case when level <> '' then level when category = 'custom' then 'notice' when category = 'drugs' then 'block' else 'review' end as level from comment, w where contains(lower(content), term)"),
)
def _(spark, sf):
    texts = view(spark, sf, "comment").select(F.col("id").alias("comment_id"), F.lower("content").alias("text"))
    hits = lexicon.term_hits(texts, _terms(spark), ["comment_id"]).drop("pos").distinct()
    return lexicon.lexicon_level(hits, spark.createDataFrame([("custom", "notice")], "category string, override string"))


@query("fuzzy_signals")
def _(spark, sf):
    words = [("spam", "paylaod"), ("spam", "clikc"), ("spam", "purchaze")]
    return pipeline.per_text(_in(spark, sf), lambda texts: lexicon.fuzzy_signals(_parts(texts), words, 1, 4))


def _parts(texts):
    return texts.select("comment_id", F.explode("a.clauses").alias("c")).select("comment_id", "c.*")


def _clauses(spark, texts):
    marks = policy_tables(spark, POLICY)["term"].where("kind not like 'lexicon%'").select("kind", "term")
    return structure.clause_benign(_parts(texts), marks, ["purchase"])


_CL = r"regexp_replace(lower(c), '[\s\pP\pS]', '', 'g')"
_DOT = r"regexp_replace({}, '([\pL\p{{Nd}}_-])[.]([\pL\p{{Nd}}_-])', '\1·\2', 'g')"  # a dot inside a name ends no clause
_INSIDE = r"regexp_replace(" + _DOT.format(_DOT.format("content")) + r", '(?i)(https?|hxxps?|vx|v信|微信|微信号|wx|qq|企鹅|账号|联系方式):', '\1·', 'g')"
_PARTS = f""", p as (select comment_id, list_filter(list_transform(regexp_split_to_array({_INSIDE}, '[.\\n\\r!?;:。！？；：]'), lambda x: trim(x)), lambda x: x <> '') as l from comment_in),
c as (select comment_id, i as clause, l[i] as c from p, unnest(generate_series(1, len(l))) t(i))"""


@query(
    "clause_benign",
    with_views(
        "comment_in",
        _PARTS + f""" select comment_id, clause, case when {_CL} = '' then true when contains(lower(c), 'purchase') then false when contains({_CL}, 'signup') then true when contains({_CL}, 'click') then false
else contains({_CL}, 'error') or contains({_CL}, 'payload') end as benign from c""",
    ),
)
def _(spark, sf):
    return pipeline.per_text(_in(spark, sf), lambda texts: _clauses(spark, texts).select("comment_id", "clause", "benign"))


@query("structure_signals")
def _(spark, sf):
    t = policy_tables(spark, POLICY)["term"].where("kind = 'risk_phrase'").select("kind", "term")
    flat = lambda texts: texts.select("comment_id", "a.normalized", "a.compact", "a.decoded")
    return pipeline.per_text(_in(spark, sf), lambda texts: structure.structure_signals(flat(texts), _clauses(spark, texts), t, ["payload.*ms"], {"url": "review"}))


@query(
    "text_quality",
    with_views(
        "comment_in",
        """, t as (select comment_id, case comment_id % 5 when 0 then '' when 1 then repeat(cast(user_id as string), 5) when 2 then 'ab' || comment_id when 3 then 'aaaaaa' || user_id else content end as c from comment_in),
x as (select comment_id, c, length(c) as n, length(regexp_replace(c, '\\pN', '', 'g')) as rest, (select max(k) from (select count(*) as k from unnest(string_split(c, '')) u(ch) group by ch)) as top from t)
select comment_id, case when n = 0 then 'no_words' when n >= 5 and rest = 0 then 'numeric' when n >= 5 and (n - rest) * 10 >= n * 6 then 'number_like' when n >= 6 and top * 4 >= n * 3 then 'repeated' end as quality from x""",
    ),
)
def _(spark, sf):
    c = F.expr("case comment_id % 5 when 0 then '' when 1 then repeat(cast(user_id as string), 5) when 2 then concat('ab', comment_id) when 3 then concat('aaaaaa', user_id) else content end")
    return _in(spark, sf).select("comment_id", structure.text_quality(c).alias("quality"))


_RULES = "select * from (values (0, 'r0', 'spam', 'review', 'note', 'click'), (0, 'r0', 'spam', 'review', 'note', 'error'), (0, 'r0', 'spam', 'review', 'topic', 'click'), (0, 'r0', 'spam', 'review', 'topic', 'error'), (1, 'r1', 'load', 'notice', 'view', 'payload')) r(no, rule_id, category, level, s, p)"


@query(
    "combination_signals",
    with_views("comment_in", _PARTS + f", r as ({_RULES}) select comment_id, category, level, s || '+' || p as evidence, rule_id, min(clause) as clause from c join r on contains({_CL}, s) and contains({_CL}, p) group by all"),
)
def _(spark, sf):
    rules = spark.createDataFrame([(0, "r0", "spam", "review", ["note", "topic"], ["click", "error"]), (1, "r1", "load", "notice", ["view"], ["payload", "view"])], "rule_no long, id string, category string, level string, subjects array<string>, predicates array<string>")
    found = pipeline.per_text(_in(spark, sf), lambda texts: structure.combination_signals(_parts(texts).withColumn("benign", F.lit(False)), rules))
    return found.select("comment_id", "category", "level", "evidence", "rule_id", F.col("clause").cast("long").alias("clause"))


_SIG = "select row_number() over (order by comment_id, seq, tie, source, category, level, score) as rid, * from signal_in"


@query(
    "signal_scores",
    with_views(
        "signal_in",
        """select comment_id, seq, tie, source, category, level, score as raw, case when source = 'lexicon' and category = 'abuse' and level = 'review' then 50 when source = 'context' and category = 'spam_fraud' then 60
when source = 'structure' and level = 'block' then 90 when source = 'structure' then 30 when level = 'notice' then 5 when level = 'block' then 80 when level = 'review' then 40 else 0 end as score from signal_in""",
    ),
)
def _(spark, sf):
    s = view(spark, sf, "signal_in").withColumnRenamed("score", "raw").withColumn("rule_id", F.lit(""))
    scores = spark.createDataFrame([("lexicon.abuse.review", 50), ("context.spam_fraud", 60), ("structure.block", 90), ("structure", 30), ("notice", 5)], "key string, score long")
    return decision.signal_scores(s, scores).drop("rule_id")


@query("normalize_level", with_views("signal_in", "select comment_id, seq, tie, source, category, score, case level when 'block' then 'block' when 'review' then 'review' else 'notice' end as level from signal_in"))
def _(spark, sf):
    raw = F.expr("case level when 'block' then ' Rejected' when 'review' then 'PENDING ' else level end")
    return view(spark, sf, "signal_in").withColumn("level", C.normalize_level(raw))


@query(
    "decide",
    with_views(
        "signal_in",
        """, o as (select *, row_number() over (partition by comment_id order by seq, tie, source, category, level, score) as n, source || ':' || category || ':' || level as reason from signal_in),
f as (select comment_id, min(n) filter (level = 'block') as b, bool_or(level = 'review') as rev, sum(score) as total from o group by comment_id)
select f.comment_id, case when b is not null then 'rejected' when rev then 'pending' else 'approved' end as status,
cast(case when b is not null then greatest((select score from o where o.comment_id = f.comment_id and o.n = b), 80) when rev then least(greatest(total, 40), 79) else total end as bigint) as score,
case when b is not null then 'block_signal' when rev then 'review_signal' else 'no_risk_signal' end as decision,
(select string_agg(reason, ';' order by n) from o where o.comment_id = f.comment_id and (b is null or o.n <= b)) as reasons from f""",
    ),
)
def _(spark, sf):
    s = view(spark, sf, "signal_in").withColumn("reason", decision.format_reason(F.col("source"), F.col("category"), F.col("level"), F.lit("")))
    out = decision.decide(s, order=("seq", "tie", "source", "category", "level"))
    return out.withColumn("reasons", F.array_join("reasons", ";"))


@query(
    "frequency_signals",
    with_views(
        "comment_in",
        """, u as (select a.comment_id, count(b.comment_id) as n from comment_in a left join comment_in b on a.user_id = b.user_id and b.ts_s between a.ts_s - 600 and a.ts_s and (b.ts_s < a.ts_s or b.comment_id < a.comment_id) where a.user_id <> 0 group by a.comment_id),
i as (select a.comment_id, count(b.comment_id) as n from comment_in a left join comment_in b on a.ip = b.ip and b.ts_s between a.ts_s - 600 and a.ts_s and (b.ts_s < a.ts_s or b.comment_id < a.comment_id) group by a.comment_id)
select comment_id, 'user_frequency' as category from u where n + 1 >= 4 union all select comment_id, 'ip_frequency' from i where n + 1 >= 8""",
    ),
)
def _(spark, sf):
    return behavior.frequency_signals(_in(spark, sf), 600, 4, 600, 8)


@query(
    "duplicate_signals",
    with_views(
        "comment_in",
        r""", c as (select *, regexp_replace(content, '[\s\pP\pS\d]', '', 'g') as k from comment_in where user_id <> 0 and article_id <> 0),
g as (select *, case when ts_s - lag(ts_s) over (partition by user_id, article_id, k order by ts_s, comment_id) > 3600 then 1 else 0 end as fresh from c),
s as (select *, sum(fresh) over (partition by user_id, article_id, k order by ts_s, comment_id rows unbounded preceding) as session from g),
n as (select comment_id, row_number() over (partition by user_id, article_id, k, session order by ts_s, comment_id) as observed from s)
select comment_id, case when observed >= 4 then 'block' else 'review' end as level, case when observed >= 4 then 'duplicate_block' else 'duplicate_review' end as evidence from n where observed >= 2""",
    ),
)
def _(spark, sf):
    c = _in(spark, sf).withColumn("compact", F.regexp_replace("content", r"[\s\p{P}\p{S}\d]", ""))
    return behavior.duplicate_signals(c, 3600)


_SIMHASH = r""", k as (select comment_id, user_id, article_id, ts_s, regexp_replace(lower(content), '[\s\pP\pS]', '', 'g') as k from comment_in),
g as (select k, unnest(case when length(k) <= 2 then [k] else list_transform(generate_series(1, length(k) - 1), lambda i: substr(k, i, 2)) end) as g from (select distinct k from k where k <> '')),
f as (select g, list_reduce([cast(14695981039346656037 as hugeint)] || list_transform(string_split(regexp_replace(hex(encode(g)), '(..)', '\1,', 'g'), ','), lambda x: case when x = '' then cast(-1 as hugeint) else cast(cast('0x' || x as integer) as hugeint) end),
  lambda h, b: case when b < 0 then h else (xor(h, b) * 1099511628211) % 18446744073709551616 end) as h from (select distinct g from g)),
w as (select k, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as w from g join f using (g), unnest(generate_series(0, 63)) u(b) group by k, b),
s as (select k, sum(case when w < 0 then 0 when b = 63 then -(cast(1 as hugeint) << 63) else cast(1 as hugeint) << b end) as hash from w group by k)"""


@query("simhash64", with_views("comment_in", _SIMHASH + " select comment_id, cast(coalesce(hash, 0) as bigint) as hash from k left join s using (k)"))
def _(spark, sf):
    return _in(spark, sf).select("comment_id", text.simhash64(text.compact_text(F.lower("content"))).alias("hash"))


@query(
    "near_duplicate_signals",
    with_views(
        "comment_in",
        _SIMHASH
        + """, e as (select comment_id, user_id, article_id, ts_s, length(k) as runes, cast(hash as bigint) as hash from k join s using (k) where user_id <> 0 and article_id <> 0 and length(k) >= 12),
r as (select a.comment_id, 100 * abs(a.runes - b.runes) <= 30 * greatest(a.runes, b.runes) and bit_count(xor(a.hash, b.hash)) <= 10 as near, row_number() over (partition by a.comment_id order by b.ts_s desc, b.comment_id desc) as newest
  from e a join e b using (user_id, article_id) where b.ts_s >= a.ts_s - 7200 and (b.ts_s < a.ts_s or (b.ts_s = a.ts_s and b.comment_id < a.comment_id)))
select comment_id, count(*) filter (near) as similar from r where newest <= 100 group by comment_id having count(*) filter (near) + 1 >= 2""",
    ),
)
def _(spark, sf):
    c = _in(spark, sf).withColumn("compact", text.compact_text(F.lower("content")))
    return behavior.near_duplicate_signals(c, 2, seconds=7200)


@query("suppress_by_context")
def _(spark, sf):
    m = pipeline.moderate(_in(spark, sf), POLICY, with_behavior=False)
    return m.suppressed.select("comment_id", "source", "category", "level", "evidence", "rule_id", "clause", "score")


@query("moderate")
def moderate(spark, sf):
    return pipeline.moderate(_in(spark, sf), POLICY).results


@query("moderate_articles")
def _(spark, sf):
    a = view(spark, sf, "comment").select(F.col("id").alias("comment_id"), "user_id", "article_id", "ip", "content", F.unix_seconds(F.col("create_time").cast("timestamp")).alias("ts_s"))
    return pipeline.moderate(a, POLICY, _terms(spark)).results


@query("moderation_trace")
def _(spark, sf):
    t = pipeline.moderation_trace(pipeline.moderate(_in(spark, sf), POLICY))
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    return t.select("*", size("clauses").alias("n_clauses"), size("detected").alias("n_detected"), size("signals").alias("n_signals"), size("suppressed").alias("n_suppressed"))


@query("moderation_preview")
def _(spark, sf):
    lines = view(spark, sf, "comment_in").select(F.col("comment_id").alias("line"), "content")
    return pipeline.moderation_preview(lines, POLICY, max_lines=1 << 40)[1]


@query("decisions_on_disabled", with_views("comment_in", "select comment_id, 'pending' as status, 0 as score, 'disabled' as decision, 'moderation_disabled' as reasons from comment_in"))
def _(spark, sf):
    return decision.on_disabled(_in(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


@query("decisions_on_error", with_views("comment_in", "select comment_id, 'rejected' as status, 40 as score, 'error' as decision, 'moderation_error:x' as reasons from comment_in"))
def _(spark, sf):
    return decision.on_error(_in(spark, sf).select("comment_id", F.lit("x").alias("error")), "Rejected").withColumn("reasons", F.array_join("reasons", ","))


@query(
    "label_reasons",
    with_views("signal_in", "select comment_id, seq, tie, source, category, level, score, case source when 'lexicon' then '敏感词库命中' when 'structure' then '结构规则命中' else '上下文规则命中' end || '：' || case when source = 'context' then 'a + b' else 'a+b' end || '（' || case category when 'abuse' then 'abuse' when 'url' then '链接' else '营销/诈骗' end || '，' || case level when 'review' then '待人工复核' when 'block' then '建议拒绝' else level end || '）' as label, '[\"' || source || '\",\"x\"]' as encoded, source || '|x' as decoded from signal_in"),
)
def _(spark, sf):
    reason = F.concat_ws(":", "source", "category", "level", F.lit("a+b"))
    coded = decision.encode_reasons(F.array(F.col("source"), F.lit(" x "), F.lit(" ")))
    return view(spark, sf, "signal_in").withColumn("label", decision.label_reason(reason)).withColumn("encoded", coded).withColumn("decoded", F.array_join(decision.decode_reasons(F.col("encoded")), "|"))


@query("moderation_reason_stats", with_views("signal_in", "select source, category, level, count(*) as n, cast(sum(score) as bigint) as score from signal_in group by rollup (source, category, level)"))
def _(spark, sf):
    return decision.moderation_reason_stats(view(spark, sf, "signal_in"))


_WRONG = "case expected when 'approved' then actual <> 'approved' when 'risk' then actual = 'approved' else actual <> expected end"


EVALUATION = f"""select corpus, count(*) as total, count(*) filter (actual = 'approved') as approved, count(*) filter (actual = 'pending') as pending, count(*) filter (actual = 'rejected') as rejected,
count(*) filter (corpus = 'normal' and expected = 'approved' and {_WRONG}) as false_positive, count(*) filter (corpus = 'violation' and expected <> 'approved' and actual = 'approved') as false_negative,
count(*) filter ({_WRONG}) as mismatch, 0 as manual_edge from corpus_case group by corpus"""


@query("evaluate_corpus", with_views("corpus_case", EVALUATION))
def _(spark, sf):
    return decision.evaluate_corpus(view(spark, sf, "corpus_case"))


@query("wrong_by_category", with_views("corpus_case", f"select category, count(*) as wrong from corpus_case where {_WRONG} group by category"))
def _(spark, sf):
    return decision.wrong_by_category(view(spark, sf, "corpus_case"))

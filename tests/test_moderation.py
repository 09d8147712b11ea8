"""Golden rows of the moderation operators."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import columns as C, text as T
from inkwell.operators.moderation import decision, lexicon, pipeline, structure
from inkwell.sources import policy, tables

RULE = {"id": "rank_trade", "category": "spam_fraud", "subjects": ["段位"], "predicates": ["把号给我"], "level": "review"}
SPAM = {"id": "commercial_spam", "category": "spam_fraud", "subjects": ["资源"], "predicates": ["主页", "处理"], "level": "review"}


def comments(spark, *texts):
    return spark.createDataFrame([(k, 0, 0, "", t, k) for k, t in enumerate(texts, 1)], "comment_id long, user_id long, article_id long, ip string, content string, ts_s long")


def test_text_goldens():
    assert T.compact(T.normalize("低價岀售长期稳定的會員位置")) == "低价出售长期稳定的会员位置"
    assert T.skeleton("cаsinо рromo") == "casino promo"
    assert len(T.split_clauses("文档展示 vx:test_user 作为反垃圾样例")) == 1
    far = lambda a, b: bin((T.simhash_of(T.compact(T.normalize(a))) ^ T.simhash_of(T.compact(T.normalize(b)))) & ((1 << 64) - 1)).count("1")
    assert far("领取内部课程资料，回复我即可", "领取内部课程资料，私信我即可") <= 10 < far("领取内部课程资料，回复我即可", "今天天气不错适合出去散步")
    assert T.simhash_of("") == 0
    assert T.analyse(None)["clauses"][0]["compact"] == ""


def test_fuzzy():
    assert lexicon.closest_window(["论文伐写可以按时交付"], "论文代写", 1) == ("论文伐写", 1)
    assert lexicon.closest_window(["论文代写可以"], "论文代写", 1) is None
    rng = random.Random(4)
    for word, distance in (("abca", 1), ("abcda", 2), ("аbc", 1)):
        texts = ["".join(rng.choice("abcdа") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
        for text, got in zip(texts, lexicon.closest_windows(texts, word, distance), strict=True):
            assert (None if got is None else (got[1], (got[0] + 1) // 2)) == lexicon.closest_window([text], word, distance)


def test_anchors_leave_few_places(spark):
    """Rows that meet the dictionary are places of a term's rarest pair: at least five times fewer than places and keys."""
    rng = random.Random(12)
    words = ["the", "then", "of", "and", "table", "notice", "reading", "quartz", "zebra", "ox", "q", "'", "a{b", "back\\slash"]
    prose = ["the", "and", "other", "notes", "in", "tables", "here", "reads", "quickly", "oxen", "it's", "a{bc", "back\\slashes", "{}"]
    texts = [" ".join(rng.choice(prose) for _ in range(40)) for _ in range(200)] + ["", "q", "quartz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = spark.createDataFrame([(w,) for w in [*words, "", None]], "term string")
    hits = sorted((r.id, r.pos, r.term) for r in lexicon.term_hits(df, terms, ["id"]).collect())
    assert hits == sorted((i, at + 1, w) for i, t in enumerate(texts) for w in words for at in range(len(t)) if t.startswith(w, at))
    _, anchors, reach, width = lexicon.anchored_terms(df, terms)
    few = lexicon.anchor_places(df, ["id"], anchors, reach, width).count()
    every = lexicon.anchor_places(df, ["id"], None, reach, width).count()
    assert few * 5 <= every
    some = ["reading", "quartz", "table"]
    anchors = lexicon.rarest_pairs(df, some, share=1)
    count = lambda pair: sum(t.count(pair) for t in texts)
    assert all(count(pair) == min(count(w[i : i + 2]) for i in range(len(w) - 1)) and w[off : off + 2] == pair for w, (pair, off) in anchors.items())


def test_dictionaries_beyond_the_bound_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abcabc ab"), (2, "b")], "id long, text string")
    terms = spark.createDataFrame([("abc",), ("b",), ("bc",)], "term string")
    want = sorted(map(tuple, lexicon.term_hits(df, terms, ["id"], context=True).collect()))
    monkeypatch.setattr(lexicon, "MAX_BROADCAST_TERMS", 2)
    assert sorted(map(tuple, lexicon.term_hits(df, terms, ["id"], context=True).collect())) == want


@pytest.mark.parametrize("distance", [1, 2])
def test_pieces_lose_no_near_miss(spark, distance):
    rng = random.Random(distance)
    words = ["abcda", "bbаcd", "dcbaab", "abab"]
    rows = []
    for k in range(300):
        compact = "".join(rng.choice("abcdа") for _ in range(rng.randrange(0, 14)))
        rows.append((k, 1, compact, T.skeleton(compact)))
    df = spark.createDataFrame(rows, "comment_id long, clause int, compact string, skeleton string")
    want = set()
    for k, _, compact, skeleton in rows:
        for w in words:
            x, y = (lexicon.closest_windows([v], w, distance)[0] for v in (compact, skeleton if skeleton != compact else ""))
            if m := y if x is None or (y is not None and y[0] < x[0]) else x:
                want.add((k, w, f"{m[1]}~{w}(d={(m[0] + 1) // 2})"))
    got = {(r.comment_id, r.word, r.evidence) for r in lexicon.fuzzy_signals(df, [("c", w) for w in words], distance).collect()}
    assert got == want and len(got) > 50


def test_tables_dealt_alike_join_without_an_exchange(spark):
    from inkwell.functions.checkpoint import co_partitioned, settings

    one = co_partitioned(spark.range(100).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("no")), "id")
    two = co_partitioned(one.where("no > 1").groupBy("id", "no").count(), "id")
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__requireAllClusterKeysForCoPartition="false"):
        plan = one.join(two, ["id", "no"], "left").unionByName(one.withColumn("count", F.lit(1).cast("long"))).groupBy("id").agg(F.sum("count"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_gray_golden(spark):
    rules = [SPAM]
    p = {"combination_rules": rules, "decision": {"rule_scores": {"context:spam_fraud:commercial_spam:review": 60}}}
    m = pipeline.moderate(comments(spark, "如果有人在评论区暗示去主页拿资源，应该怎么处理？", "普通评论而已"), p, with_behavior=False)
    got = {r.comment_id: (r.status, r.score, r.reasons) for r in m.results.collect()}
    assert got[1] == ("pending", 79, ["context:spam_fraud:review:commercial_spam:资源+主页", "context:spam_fraud:review:commercial_spam:资源+处理"])
    assert got[2] == ("approved", 0, [])


def test_combination_is_not_approved(spark):
    m = pipeline.moderate(comments(spark, "想上段位的把号给我"), {"combination_rules": [RULE]}, with_behavior=False)
    assert m.results.first().status != "approved"
    assert m.signals.first().rule_id == "rank_trade"


def test_abuse_context(spark):
    p = {"lexicon": {"custom_words": {"review": {"abuse": ["笨蛋", "滚出去"]}}}, "semantic_rules": {"abuse_policy": {"severe_markers": ["滚出去"]}}}
    m = pipeline.moderate(comments(spark, "你这个笨蛋呀呀呀", "你给我滚出去吧"), p, with_behavior=False)
    got = {r.comment_id: r.status for r in m.results.collect()}
    assert got == {1: "approved", 2: "pending"}
    assert [(r.comment_id, r.evidence) for r in m.suppressed.collect()] == [(1, "笨蛋")]
    assert m.signals.where("source = 'semantic'").first().evidence == "笨蛋"


CHEAP = {"custom_words": {"review": {"spam_fraud": ["低价出售", "免费领"]}}}


def test_contexts_come_from_the_policy(spark):
    text = "风险研究引用低价出售作为样例"
    m = pipeline.moderate(comments(spark, text), {"lexicon": CHEAP, "semantic_rules": {"contexts": {"reporting_markers": ["风险研究"]}}}, with_behavior=False)
    assert m.results.first().status == "approved" and m.signals.where("source = 'semantic'").count() == 1
    assert [(r.source, r.evidence) for r in m.suppressed.collect()] == [("lexicon", "低价出售")]
    m = pipeline.moderate(comments(spark, text), {"lexicon": CHEAP}, with_behavior=False)
    assert m.results.first().status == "pending" and m.suppressed.isEmpty()
    assert [(r.source, r.evidence) for r in m.signals.collect()] == [("lexicon", "低价出售")]


def test_actionable_intent_overrides_a_benign_wrapper(spark):
    p = {"semantic_rules": {"contexts": {"unambiguous_benign_markers": ["违规样例"], "actionable_patterns": ["确实可以找我"]}}}
    m = pipeline.moderate(comments(spark, "这条低价账号广告只是违规样例。", "下面是违规样例，低价账号确实可以找我。"), p, with_behavior=False)
    assert {r.comment_id: r.benign for r in m.clauses.collect()} == {1: True, 2: False}


def test_promotion_is_not_suppressed(spark):
    rule = {"id": "commercial_spam", "category": "spam_fraud", "subjects": ["账号"], "predicates": ["出售"], "level": "review"}
    texts = "先说这是“安全测试”：低价出售账号的看我头像，我这里长期有。", "免费领，真的不要米，懂的来"
    m = pipeline.moderate(comments(spark, *texts), {"lexicon": CHEAP, "combination_rules": [rule]}, with_behavior=False)
    assert m.suppressed.isEmpty() and {r.status for r in m.results.collect()} == {"pending"}
    assert {(r.comment_id, r.source, r.evidence) for r in m.signals.where("source in ('lexicon', 'context')").collect()} == {(1, "lexicon", "低价出售"), (1, "context", "账号+出售"), (2, "lexicon", "免费领")}


def test_behavior_and_history(spark):
    rows = [(k, 7, 3, "9.9.9.9", "同样的一段评论内容在这里重复", 100 + k) for k in range(1, 7)]
    df = spark.createDataFrame(rows, "comment_id long, user_id long, article_id long, ip string, content string, ts_s long")
    new, old = df.where("comment_id > 3"), df.where("comment_id <= 3")
    got = {r.comment_id: r.status for r in pipeline.moderate(new, {}, history=old).results.collect()}
    assert got == {4: "rejected", 5: "rejected", 6: "rejected"}
    assert {r.status for r in pipeline.moderate(df.where("comment_id = 1"), {}).results.collect()} == {"approved"}


@pytest.mark.parametrize(
    "bad",
    [
        {"lexicon": {"fuzzy": {"max_distance": 3, "candidate_words": {"a": ["abcdef"]}}}},
        {"lexicon": {"fuzzy": {"candidate_words": {"a": ["ab"]}}}},
        {"behavior_rules": {"near_duplicate": {"max_hamming_distance": 17}}},
        {"behavior_rules": {"near_duplicate": {"max_length_difference_percent": 51}}},
        {"combination_rules": [{"subjects": ["a"], "predicates": ["b"]}]},
        {"combination_rules": [RULE, RULE]},
        {"combination_rules": [RULE | {"subjects": []}]},
        {"combination_rules": [RULE | {"level": "huge"}]},
        {"structure_patterns": {"risk_patterns": ["("]}},
        {"structure_patterns": {"risk_patterns": [" "]}},
    ],
)
def test_policy_errors(bad):
    with pytest.raises(ValueError):
        policy.validate_policy(bad)


def test_structure_patterns(spark):
    cases = {"电话13812345678吧": True, "a213812345678": False, "加微信abc": True, "me at mail dot com": True, "普通": False, "☎️：abcd12": True}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert df.where(structure.is_contact(F.col("t")) != F.col("want")).collect() == []
    urls = {"看www.x": True, "hxxp://a": True, "例子.com": True, "ab.community": False}
    df = spark.createDataFrame(list(urls.items()), "t string, want boolean")
    assert df.where(structure.is_url(F.col("t")) != F.col("want")).collect() == []


def test_handles(spark):
    cases = [(" ", ""), ("1", "00001"), ("00001", "00001"), ("99999", "99999"), ("100000", "100000"), ("github-user", "github-user")]
    df = spark.createDataFrame(cases, "v string, want string")
    assert df.where(C.normalize_handle(F.col("v")) != F.col("want")).collect() == []


def test_corpus_reader(spark, tmp_path):
    good = tmp_path / "gray.tsv"
    good.write_text("id\ttext\texpected\tcategory\ttags\tnote\n# a remark\nG1\tx\tpending\tabuse\tmanual_edge,b\t\nG2\ty\tapproved\tn\t\tz\n")
    rows = tables.read_corpus(spark, str(good)).collect()
    assert [(r.id, r.corpus, r.tags) for r in rows] == [("G1", "gray", "manual_edge,b"), ("G2", "gray", "")]
    bad = tmp_path / "bad.tsv"
    bad.write_text("id\ttext\texpected\tcategory\ttags\tnote\nG1\t\tpending\tabuse\t\t\n")
    with pytest.raises(ValueError):
        tables.read_corpus(spark, str(bad))
    report = decision.evaluate_corpus(tables.read_corpus(spark, str(good)).withColumn("actual", F.lit("approved")))
    tables.write_eval_report(decision.judged_cases(tables.read_corpus(spark, str(good)).withColumn("actual", F.lit("approved"))), report, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "summary")).first().mismatch == 1


def test_logs_and_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"scene":"view-log","score":3,"server_ts":1704067200000}\n')
    assert str(tables.read_risk_audit(spark, str(tmp_path / "a.json")).first().ts) == "2024-01-01 00:00:00"
    (tmp_path / "b.json").write_text('{"path":"/x","user-agent":"u","cost":0.5}\n')
    assert tables.read_access_log(spark, str(tmp_path / "b.json")).first().user_agent == "u"
    one = tables.write_snapshot(spark.range(3).toDF("id"), str(tmp_path / "s"))
    two = tables.write_snapshot(spark.read.parquet(one), str(tmp_path / "s"))
    assert one != two and spark.read.parquet(two).count() == 3


def test_html_images_and_assets(spark):
    from inkwell.operators import images

    df = spark.createDataFrame([(1, '<img src="a.png" srcset="b.png 1x, c.png 2x"><IMG SRC=data:x> ![m](d.png)')], "article_id long, content string")
    assert sorted((r.url, r.ref_type) for r in images.extract_image_refs(df).collect()) == [("a.png", "html"), ("b.png", "html"), ("c.png", "html"), ("d.png", "markdown")]
    files = [("x.png", b"\x89PNG\r\n\x1a\n"), ("y.svg", b"<svg onload=x>"), ("z.svg", b"<svg/>"), ("w.txt", b"hi"), ("v.gif", b"GIF89a" + b"0" * (1 << 20))]
    got = {r.path: (r.mime, r.reason) for r in images.image_asset_audit(spark.createDataFrame([(p, bytearray(b)) for p, b in files], "path string, content binary")).collect()}
    assert got == {"x.png": ("image/png", ""), "y.svg": ("image/svg+xml", "unsafe_svg"), "z.svg": ("image/svg+xml", ""), "w.txt": (None, "unsupported"), "v.gif": ("image/gif", "too_large")}


def test_preview_errors(spark):
    with pytest.raises(ValueError):
        pipeline.moderation_preview(spark.createDataFrame([(1, " ")], "line long, content string"), {})
    with pytest.raises(ValueError):
        pipeline.moderation_preview(spark.createDataFrame([(1, "x" * 1001)], "line long, content string"), {})

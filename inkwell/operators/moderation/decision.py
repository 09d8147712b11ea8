"""Context suppression, scores, decision, reasons, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.functions.columns import normalize_level
from inkwell.operators.moderation.structure import clause_flags

PENDING, REJECT = 40, 80
STAGES = ("lexicon", "similarity", "structure", "context", "behavior", "semantic")


def format_reason(source: Column, category: Column, level: Column, evidence: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(":", source, blank(category), blank(level), blank(evidence))


def signal_scores(signals: DataFrame, rule_scores: DataFrame | None = None, pending: int = PENDING, reject: int = REJECT) -> DataFrame:
    """Add ``score``: the first positive one along nine coarser keys (``rule_scores(key, score)``, dots between parts),
    else the level's own."""
    level = normalize_level(F.col("level"))
    default = F.when(level == "block", reject).when(level == "review", pending).otherwise(0).cast("long")
    if rule_scores is None:
        return signals.withColumn("score", default)
    part = {n: F.nullif(F.lower(F.trim(c)), F.lit("")) for n, c in (("s", F.col("source")), ("c", F.col("category")), ("r", F.col("rule_id")), ("l", level))}
    keys = F.array(*[_dotted([part[x] for x in k]) for k in ("scrl", "scr", "scl", "sc", "srl", "sr", "sl", "s", "l")])
    table = rule_scores.where("score > 0").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("score").cast("long"))))).scalar()
    out = signals.withColumn("__table", table).withColumn("__keys", F.array_compact(keys))
    best = F.get(F.array_compact(F.transform("__keys", lambda k: F.try_element_at(F.col("__table"), k))), F.lit(0))
    return out.withColumn("score", F.coalesce(best, default)).drop("__table", "__keys")


def _dotted(parts: list[Column]) -> Column:
    """The parts between dots, null if any is null."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws(".", *parts))


def evidence_terms(evidence: Column) -> Column:
    """The compact parts of an evidence text, without the names of structure rules."""
    parts = F.transform(F.split(F.lower(evidence), r"[+,:\s]"), lambda p: F.regexp_replace(p, r"[\s\p{P}\p{S}]", ""))
    return F.filter(parts, lambda p: (p != "") & ~p.isin("url", "contact", "riskphrase"))


SIGNAL_FIELDS = ("stage", "seq", "source", "category", "level", "evidence", "rule_id", "clause", "score", "reason")


def _signal(**given) -> Column:
    return F.struct(*[given[f].alias(f) for f in SIGNAL_FIELDS])


def listed_signals(signals: DataFrame) -> DataFrame:
    """``(comment_id, signals)``: the signals of a comment in order, as an array."""
    value = lambda c: F.col(c) if c in signals.columns else F.lit(None).cast("long" if c == "score" else "string")
    item = _signal(**{c: value(c) for c in SIGNAL_FIELDS})
    return signals.groupBy("comment_id").agg(F.array_sort(F.collect_list(item)).alias("signals"))


def judged_in_context(listed: DataFrame, clauses: DataFrame, severe: list[str], risk_phrases: list[str] = (), risk_patterns: list[str] = ()) -> DataFrame:
    """``(comment_id, kept, suppressed)``, arrays; where something is suppressed, ``kept`` ends with one allow signal.

    ``listed(comment_id, signals)``; ``clauses(comment_id, clause, normalized, compact, skeleton, pinyin, benign)``. Behaviour, hidden
    addresses, scripts and text quality are never suppressed. Abuse stays iff a relevant clause has a severe mark; anything
    else goes iff every relevant clause is benign. With no relevant clause a signal stays. A comment's signals and clauses
    meet in one row, so nothing is dealt again where both lie by comment.
    """
    hard, phrase = F.lit(False), F.lit(False)
    for m in severe:
        hard = hard | F.contains(F.col("compact"), F.lit(m)) | F.contains(F.col("pinyin"), F.lit(m)) | F.contains(F.col("skeleton"), F.lit(m))
    for m in risk_phrases:
        phrase = phrase | F.contains(F.col("compact"), F.lit(m))
    for m in risk_patterns:
        phrase = phrase | F.col("normalized").rlike(m)
    rows = clause_flags(clauses).select("comment_id", F.struct("clause", "compact", "pinyin", "benign", hard.alias("hard"), F.col("has_url").alias("url"), F.col("has_account").alias("contact"), phrase.alias("phrase")).alias("c"))
    j = listed.join(rows.groupBy("comment_id").agg(F.collect_list("c").alias("__clauses")).hint("merge"), "comment_id", "left")

    def relevant(s: Column, terms: Column) -> Column:
        """The clauses that a signal is about."""
        rule = lambda name, flag: (s["rule_id"] == name) & flag
        by_rule = lambda c: (s["source"] == "structure") & (rule("url", c["url"]) | rule("contact", c["contact"]) | rule("risk_phrase", c["phrase"]))
        by_words = lambda c: s["source"].isin("lexicon", "context") & F.forall(terms, lambda t: F.contains(c["compact"], t) | F.contains(c["pinyin"], t))
        own = F.coalesce(s["clause"], F.lit(0)) > 0
        return F.filter("__clauses", lambda c: F.when(own, s["clause"] == c["clause"]).otherwise(by_words(c) | by_rule(c)))

    def gone(s: Column) -> Column:
        fixed = (s["source"] == "behavior") | ((s["source"] == "structure") & s["rule_id"].isin("decoded_url", "script_injection", "text_quality"))
        about = relevant(s, evidence_terms(s["evidence"]))
        verdict = F.transform(F.array(about), lambda cs: F.when(F.size(cs) <= 0, False).when((s["category"] == "abuse") & F.lit(bool(severe)), ~F.exists(cs, lambda c: c["hard"])).otherwise(F.forall(cs, lambda c: c["benign"])))
        return ~fixed & F.coalesce(verdict[0], F.lit(False))

    j = j.withColumn("__marked", F.transform("signals", lambda s: F.struct(s.alias("s"), gone(s).alias("gone"))))
    pick = lambda flag: F.transform(F.filter("__marked", lambda x: x["gone"] == flag), lambda x: x["s"])
    j = j.withColumn("suppressed", pick(True)).withColumn("__kept", pick(False))
    words = F.array_distinct(F.filter(F.transform("suppressed", lambda x: F.trim(x["evidence"])), lambda x: x != ""))
    text = {"source": "semantic", "category": "benign_context", "level": "allow", "rule_id": "benign_context"}
    allow = _signal(stage=F.lit(STAGES.index("semantic")), seq=F.lit(0).cast("long"), evidence=F.array_join(words, ","), clause=F.lit(0), score=F.lit(0).cast("long"), reason=F.lit(None).cast("string"), **{k: F.lit(v) for k, v in text.items()})
    return j.select("comment_id", F.when(F.size("suppressed") > 0, F.concat("__kept", F.array(allow))).otherwise(F.col("__kept")).alias("kept"), "suppressed")


def unlisted(listed: DataFrame, name: str) -> DataFrame:
    """The signals of an array column as rows."""
    return listed.select("comment_id", F.explode(name).alias("s")).select("comment_id", *[F.col(f"s.{c}").alias(c) for c in SIGNAL_FIELDS])


def suppress_by_context(signals: DataFrame, clauses: DataFrame, severe: list[str], risk_phrases: list[str] = (), risk_patterns: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(kept signals with one allow signal per touched comment, suppressed signals)``, as :func:`judged_in_context` decides.

    ``signals(comment_id, stage, seq, source, category, level, evidence, rule_id, clause)``, with ``score`` and ``reason`` if there are.
    """
    judged = judged_in_context(listed_signals(signals), clauses, severe, risk_phrases, risk_patterns)
    return unlisted(judged, "kept"), unlisted(judged, "suppressed")


def decide(signals: DataFrame, pending: int = PENDING, reject: int = REJECT, order: tuple[str, ...] = ("stage", "seq")) -> DataFrame:
    """``(comment_id, status, score, decision, reasons)`` of comments with signals.

    In order: the first block signal rejects, with at least the reject score and the reasons up to it; else any review
    signal holds the comment, its sum kept between pending and reject; else it is approved with the sum.
    """
    item = F.struct(*order, F.col("level").alias("__level"), F.col("score").cast("long").alias("score"), F.col("reason").alias("reason"))
    return decided(signals.groupBy("comment_id").agg(F.array_sort(F.collect_list(item)).alias("a")), pending, reject, "__level")


def decided(listed: DataFrame, pending: int = PENDING, reject: int = REJECT, level: str = "level") -> DataFrame:
    """:func:`decide` on ``(comment_id, a)``, a comment's signals in order."""
    a = listed.select("comment_id", F.transform("a", lambda x: F.struct(normalize_level(x[level]).alias("lv"), F.coalesce(x["score"], F.lit(0).cast("long")).alias("score"), x["reason"].alias("reason"))).alias("a"))
    at = F.array_position(F.transform("a", lambda x: F.coalesce(x["lv"], F.lit(""))), "block")
    total = F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + x["score"])
    review = F.exists("a", lambda x: x["lv"] == "review")
    used = F.when(at > 0, F.slice("a", F.lit(1), at.cast("int"))).otherwise(F.col("a"))
    status = F.when(at > 0, "rejected").when(review, "pending").otherwise("approved")
    block = F.greatest(F.get("a", (at - 1).cast("int"))["score"], F.lit(reject).cast("long"))
    score = F.when(at > 0, block).when(review, F.least(F.greatest(total, F.lit(pending)), F.lit(reject - 1))).otherwise(total)
    decision = F.when(at > 0, "block_signal").when(review, "review_signal").otherwise("no_risk_signal")
    reasons = F.filter(F.transform(used, lambda x: x["reason"]), lambda r: F.coalesce(r, F.lit("")) != "")
    return a.select("comment_id", status.alias("status"), score.cast("long").alias("score"), decision.alias("decision"), reasons.alias("reasons"))


def on_disabled(comments: DataFrame) -> DataFrame:
    return comments.select("comment_id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("score"), F.lit("disabled").alias("decision"), F.array(F.lit("moderation_disabled")).alias("reasons"))


def on_error(failed: DataFrame, default_on_error: str = "pending", pending: int = PENDING) -> DataFrame:
    """Results of comments whose detectors failed, ``failed(comment_id, error)``."""
    status = "rejected" if default_on_error.strip().lower() == "rejected" else "pending"
    return failed.select("comment_id", F.lit(status).alias("status"), F.lit(pending).cast("long").alias("score"), F.lit("error").alias("decision"), F.array(F.concat(F.lit("moderation_error:"), "error")).alias("reasons"))


def encode_reasons(reasons: Column) -> Column:
    """JSON text of the non-blank reasons, blank if there are none."""
    kept = F.filter(F.transform(reasons, lambda r: F.trim(r)), lambda r: r != "")
    return F.when(F.size(kept) > 0, F.to_json(kept)).otherwise("")


def decode_reasons(text: Column) -> Column:
    """The reasons of a JSON text; any other text is one reason, a blank one none."""
    t = F.trim(text)
    parsed = F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<string>")
    kept = F.filter(F.transform(F.coalesce(parsed, F.array(t)), lambda r: F.trim(r)), lambda r: r != "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(kept)


# Labels of reason parts.
SOURCE_LABELS = {"lexicon": "敏感词库命中", "structure": "结构规则命中", "context": "上下文规则命中", "behavior": "行为风险命中"}
CATEGORY_LABELS = {
    "sensitive": "敏感内容", "political": "涉政风险", "minor": "未成年人风险", "sexual": "色情低俗", "gore": "血腥暴力", "insult": "辱骂攻击", "harmful_value": "不良价值观",
    "spam_fraud": "营销/诈骗", "gambling": "赌博风险", "drugs": "毒品风险", "illegal_privacy": "违法/隐私风险", "contact": "联系方式", "url": "链接", "risk_phrase": "风险话术",
    "text_quality": "文本质量异常", "user_frequency": "用户频率异常", "ip_frequency": "IP 频率异常", "duplicate_content": "重复内容",
}
LEVEL_LABELS = {"review": "待人工复核", "block": "建议拒绝"}
EVIDENCE_LABELS = {
    "contact": "联系方式特征", "url": "链接特征", "risk_phrase": "风险话术", "number_like": "疑似联系方式数字串", "user_frequency": "同一用户短时间评论过多",
    "ip_frequency": "同一 IP 短时间评论过多", "duplicate_content": "重复提交相同内容",
}


def _label(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key)


def label_reason(reason: Column) -> Column:
    """A reason of at least four parts in words; any other unchanged."""
    p = F.split(reason, ":")
    source, category, level = (F.get(p, F.lit(k)) for k in range(3))
    last = F.element_at(p, -1)
    evidence = _label(EVIDENCE_LABELS, last)
    evidence = F.when((evidence == last) & (source == "context"), F.replace(last, F.lit("+"), F.lit(" + "))).otherwise(evidence)
    inner = F.when(category == "", _label(LEVEL_LABELS, level)).otherwise(F.concat(_label(CATEGORY_LABELS, category), F.lit("，"), _label(LEVEL_LABELS, level)))
    return F.when(F.size(p) < 4, reason).otherwise(F.concat(_label(SOURCE_LABELS, source), F.lit("："), evidence, F.lit("（"), inner, F.lit("）")))


def moderation_reason_stats(signals: DataFrame, day: Column | None = None) -> DataFrame:
    """Signals by source, category and level (and day), with roll-up rows: null stands for all values."""
    dims = ["source", "category", "level"]
    if day is not None:
        signals, dims = signals.withColumn("day", day), ["day", *dims]
    return signals.rollup(*dims).agg(F.count("*").alias("n"), F.sum(F.col("score").cast("long")).alias("score"))


def evaluate_corpus(cases: DataFrame) -> DataFrame:
    """Per corpus: totals, statuses, false positives of normal rows, false negatives of violations, mismatches.

    ``cases(corpus, expected, actual)`` and ``tags``, if there, for the hand-picked edge cases.
    """
    c = judged_cases(cases)
    edge = F.exists(F.split("tags", ","), lambda t: F.trim(t) == "manual_edge") if "tags" in cases.columns else F.lit(False)
    return c.groupBy("corpus").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("actual") == s).alias(s) for s in ("approved", "pending", "rejected")],
        F.count_if((F.col("corpus") == "normal") & F.col("false_positive")).alias("false_positive"),
        F.count_if((F.col("corpus") == "violation") & F.col("false_negative")).alias("false_negative"),
        F.count_if("wrong").alias("mismatch"),
        F.count_if(edge).alias("manual_edge"),
    )


def judged_cases(cases: DataFrame) -> DataFrame:
    """Add ``wrong``, ``false_positive`` and ``false_negative`` to every case."""
    e, a = F.lower(F.trim("expected")), F.col("actual")
    known = e.isin("approved", "risk", "pending", "rejected")
    wrong = F.when(e == "approved", a != "approved").when(e == "risk", a == "approved").when(known, a != e).otherwise(True)
    return cases.withColumn("wrong", wrong).withColumn("false_positive", F.col("wrong") & (e == "approved")).withColumn("false_negative", F.col("wrong") & known & (e != "approved") & (a == "approved"))


def wrong_by_category(cases: DataFrame) -> DataFrame:
    return judged_cases(cases).where("wrong").groupBy("category").agg(F.count("*").alias("wrong"))

"""Benign clauses, structure rules, text quality, rule combinations."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.operators.moderation.lexicon import contains_any, term_hits

# Patterns that results depend on, each whole. ``\b`` stands for an ASCII word border.
SCRIPT = r"(?i)(<\s*script\b|javascript\s*:)"
PHONE = r"\b1[3-9]\d{9}\b"
DOMAIN = r"(?i)(https?\s*:\s*/\s*/|www\s*\.|[\p{Han}a-z0-9][\p{Han}a-z0-9._-]*\s*\.\s*(com|cn|net|org|top|xyz|shop|vip|cc|io|me)\b)"
HIDDEN_DOMAIN = r"(?i)(hxxps?\s*:\s*/\s*/|[a-z0-9-]+\s*(点|\[\s*\.\s*\])\s*(com|cn|net|org|top|xyz|shop|vip|cc|io|me)\b)"
ACCOUNT = r"(?i)(加|群|qq|vx|v信|微信|筘|扣|抠|薇|威|扫码|二维码|企鹅群)[^\n]{0,12}\d[\d\s]{4,}|(\b(v|vx|qq)\b|微信|微信号|v信)\s*[:：]\s*[a-z0-9_-]{4,}|(\b(v|vx|qq)\b|微信|微信号|v信)\s*[:：]\s*(?:[a-z0-9][\s_-]*){4,}"
INTENT = r"(?i)(加\s*(微信|vx|v信|qq|群|好友|筘|扣|抠|薇|威)|v我|联系\s*我|私信|进群|扫码|二维码|绿泡泡|绿信|微信号|账号写图片|联系方式)"
HIDDEN_MAIL = r"(?i)\b[a-z0-9._%+-]+\s+at\s+[a-z0-9.-]+\s+dot\s+[a-z]{2,}\b"
SYMBOL_ACCOUNT = r"\p{So}[\x{FE0F}\x{200D}]*[\s\x{85}\x{A0}\p{Z}]*[:：][\s\x{85}\x{A0}\p{Z}]*[a-z0-9_-]{4,}"
_NUMBER_LIKE = r"[\p{N}零〇一二三四五六七八九壹贰叁肆伍陆柒捌玖两]"

# Phrases of contacts that are negated or only spoken of. A clause is exempt if it holds a phrase of every
# list of a row; INTENT stands for a match of that pattern.
EXEMPT_CONTACTS = [
    [["不包含联系方式", "没有联系方式", "不留联系方式", "无需联系方式"]],
    [["不需要", "无需", "不要", "不应", "禁止", "别把"], INTENT],
    [["联系方式识别测试", "联系方式测试"]],
    [["不要把"], ["当成违规"]],
    [["别把"], ["判违规"]],
    [["正常讨论"], ["误杀"]],
    [["测试数据", "测试号码", "示例账号", "正则", "反垃圾样本"], ["微信", "账号", "手机号", "号码", "邮件", " at "]],
]

# ---- Helpers. ----


def matches(col: Column, pattern: str) -> Column:
    """Whether a fixed pattern is found: Java's name of the script, and its word borders for ASCII words only."""
    word = "[0-9A-Za-z_]"
    border = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return col.rlike(pattern.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\b", border))


def _any(col: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(col, F.lit(p))
    return out


def _with(col: Column, parts: list[str], pattern: str) -> Column:
    """:func:`matches`, tried only on texts that hold one of the parts, as every match does."""
    return _any(F.lower(col), parts) & matches(col, pattern)


def is_url(col: Column) -> Column:
    return _with(col, [".", "http"], DOMAIN) | _with(col, ["hxxp", "点", "["], HIDDEN_DOMAIN)


def is_contact(col: Column, symbols: bool = True) -> Column:
    account = _with(col, ["v", "qq", "加", "群", "微信", "筘", "扣", "抠", "薇", "威", "扫码", "二维码"], ACCOUNT)
    intent = _with(col, ["加", "v我", "联系", "私信", "进群", "扫码", "二维码", "绿泡泡", "绿信", "微信号", "账号写图片"], INTENT)
    out = matches(col, PHONE) | account | intent | _with(col, ["dot"], HIDDEN_MAIL)
    return out | is_symbol_account(col) if symbols else out


def is_symbol_account(col: Column) -> Column:
    return _with(col, [":", "："], SYMBOL_ACCOUNT)


def exempt_contact(col: Column) -> Column:
    """Contacts that are negated, or only spoken of as test data: some row of ``EXEMPT_CONTACTS`` holds."""
    rows = [reduce(and_, [matches(col, x) if isinstance(x, str) else _any(col, x) for x in row]) for row in EXEMPT_CONTACTS]
    return reduce(or_, rows)


def clause_benign(clauses: DataFrame, terms: DataFrame | None, patterns: list[str], found: DataFrame | None = None) -> DataFrame:
    """Add ``benign`` to clauses: empty; else no actionable pattern and an unambiguous mark; else no actionable mark and a
    reporting, rejection or technical one. Marks are found by join, one row per clause and kind: ``found(comment_id, clause,
    kind)``, looked up here unless it is given."""
    if found is None:
        found = contains_any(clauses, terms, ["comment_id", "clause"], "compact")
    kinds = found.groupBy("comment_id", "clause").agg(F.collect_set("kind").alias("__kinds"))
    j = clauses.join(kinds.hint("merge"), ["comment_id", "clause"], "left").withColumn("__kinds", F.coalesce("__kinds", F.array().cast("array<string>")))
    has = lambda k: F.array_contains("__kinds", k)
    act = F.lit(False)
    for p in patterns:
        act = act | F.col("normalized").rlike(p)
    benign = F.when(F.col("compact") == "", True).when(act, False).when(has("unambiguous_benign"), True).when(has("actionable"), False).otherwise(has("reporting") | has("rejection") | has("technical"))
    return j.withColumn("benign", benign).drop("__kinds")


def clause_flags(clauses: DataFrame) -> DataFrame:
    """Add what the structure rules and the suppression ask of a clause, so that each pattern is tried once: ``has_script``,
    ``has_url``, ``has_contact`` (symbols included, exempt ones not) and ``has_account`` (without symbols, exempt or not)."""
    if "has_url" in clauses.columns:
        return clauses
    n = F.col("normalized")
    plain = is_contact(n, False)
    rows = clauses.withColumn("has_script", matches(n, SCRIPT)).withColumn("has_url", is_url(n)).withColumn("has_account", plain)
    return rows.withColumn("has_contact", (F.col("has_account") | is_symbol_account(n)) & ~exempt_contact(n))


def text_quality(compact: Column) -> Column:
    """``no_words``, ``numeric``, ``number_like``, ``repeated``, or null; in whole numbers, JVM only."""
    n = F.length(compact)
    like = n - F.length(F.regexp_replace(compact, _NUMBER_LIKE, ""))
    chars = F.split(compact, "")
    kinds = F.array_distinct(chars)
    top = F.aggregate(kinds, F.lit(0), lambda a, c: F.greatest(a, n - F.length(F.replace(compact, c, F.lit("")))))
    few = (F.size(kinds) - 1) * 4 <= n  # else no one character can be three quarters
    return F.when(n == 0, "no_words").when((n >= 5) & compact.rlike(r"^\p{N}+$"), "numeric").when((n >= 5) & (like * 10 >= n * 6), "number_like").when((n >= 6) & few & (top * 4 >= n * 3), "repeated")


def structure_signals(comments: DataFrame, clauses: DataFrame, risk_phrases: DataFrame | None, risk_patterns: list[str], levels: dict[str, str], found: DataFrame | None = None) -> DataFrame:
    """Signals ``(comment_id, seq, category, level, evidence, rule_id)`` in fixed rule order.

    ``comments(comment_id, normalized, compact, decoded)``; ``clauses(comment_id, clause, normalized, compact, benign)``.
    A rule on the whole text counts unless every clause is benign; on a clause, unless that clause is. ``found(comment_id)``:
    comments with a risk phrase, looked up here unless they are given.
    """
    live = lambda name: F.bool_or(F.col(name) & ~F.col("benign"))
    flags = clause_flags(clauses).groupBy("comment_id").agg(F.bool_and("benign").alias("all_benign"), live("has_script").alias("script"), live("has_url").alias("url"), live("has_contact").alias("contact"))
    if found is None:
        found = contains_any(comments, risk_phrases, ["comment_id"], "compact")
    phrases = found.select("comment_id", F.lit(True).alias("phrase")).distinct()
    j = comments.join(flags.hint("merge"), "comment_id", "left").join(phrases.hint("merge"), "comment_id", "left")
    norm, live = F.col("normalized"), ~F.coalesce("all_benign", F.lit(False))
    risky = F.coalesce("phrase", F.lit(False))
    for p in risk_patterns:
        risky = risky | norm.rlike(p)
    quality = text_quality(F.col("compact"))
    rules = [
        (F.coalesce("script", F.lit(False)), "script_injection", F.lit("script")),
        (F.coalesce("url", F.lit(False)) | (is_url(norm) & live), "url", F.lit("url")),
        (F.coalesce("contact", F.lit(False)) | (is_contact(norm) & live), "contact", F.lit("contact")),
        (risky, "risk_phrase", F.lit("risk_phrase")),
        (quality.isNotNull(), "text_quality", quality),
    ]
    made = [F.when(cond, F.struct(F.lit(k * 1000 if name != "text_quality" else 1_000_000).cast("long").alias("seq"), F.lit(name).alias("rule_id"), e.alias("evidence"))) for k, (cond, name, e) in enumerate(rules)]
    decoded = F.transform("decoded", lambda x, i: F.struct((F.lit(500_000) + i).cast("long").alias("seq"), F.lit("decoded_url").alias("rule_id"), x.alias("evidence")))
    rows = j.select("comment_id", F.explode(F.concat(F.array_compact(F.array(*made)), decoded)).alias("s"))
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    default = F.when(F.col("s.rule_id") == "script_injection", "block").otherwise("review")
    return rows.select("comment_id", "s.seq", F.col("s.rule_id").alias("category"), F.coalesce(level[F.col("s.rule_id")], default).alias("level"), "s.evidence", "s.rule_id")


def combination_signals(clauses: DataFrame, rules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``(comment_id, seq, category, level, evidence, rule_id, clause)``: a subject and another predicate of one rule in one
    clause that is not benign, each pair once, at its first clause. Both word lists are found by join, in one pass:
    ``found(comment_id, clause, side, rule_no, word_no, term)``, looked up here unless it is given."""
    live = clauses.where(~F.col("benign"))
    if found is None:
        views = live.select("comment_id", "clause", F.explode(F.array_distinct(F.array("compact", "pinyin"))).alias("text")).where("text <> ''")
        found = term_hits(views, rule_words(rules), ["comment_id", "clause"])
    else:
        found = found.join(live.select("comment_id", "clause").hint("merge"), ["comment_id", "clause"], "left_semi")

    def side(column: str, name: str) -> DataFrame:
        return found.where(F.col("side") == column).groupBy("comment_id", "clause", "rule_no", F.col("term").alias(name)).agg(F.min("word_no").alias(f"{name}_no"))

    pairs = side("subjects", "subject").join(side("predicates", "predicate").hint("merge"), ["comment_id", "clause", "rule_no"]).where("subject <> predicate")
    first = pairs.groupBy("comment_id", "rule_no", "subject", "predicate").agg(F.min(F.struct("clause", "subject_no", "predicate_no")).alias("f"))
    named = first.join(F.broadcast(rules.select("rule_no", F.col("id").alias("rule_id"), "category", "level")), "rule_no")
    seq = F.col("rule_no") * 1_000_000_000_000 + F.col("f.clause").cast("long") * 100_000_000 + F.col("f.subject_no").cast("long") * 10_000 + F.col("f.predicate_no")
    return named.select("comment_id", seq.alias("seq"), "category", "level", F.concat_ws("+", "subject", "predicate").alias("evidence"), "rule_id", F.col("f.clause").alias("clause"))


def rule_words(rules: DataFrame) -> DataFrame:
    """``(side, rule_no, word_no, term)`` of the combination rules."""
    one = lambda column: rules.select(F.lit(column).alias("side"), "rule_no", F.posexplode(column).alias("word_no", "term"))
    return one("subjects").unionByName(one("predicates"))

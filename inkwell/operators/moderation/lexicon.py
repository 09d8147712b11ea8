"""Dictionary matching as joins, levels of hits, fuzzy matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.functions.text import CONFUSABLES

_SAME = str.maketrans(CONFUSABLES)


MAX_BROADCAST_TERMS = 200_000


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pairs(last: str) -> str:
    """SQL of the pair of code points at place ``p`` of ``__chars``, the last one alone."""
    return f"concat(get(__chars, p - 1), coalesce(get(__chars, p), {last}))"


def rarest_pairs(texts: DataFrame, words: list[str], text: str = "text", share: int = 16) -> dict[str, tuple[str, int]]:
    """Of every word the pair of neighbouring code points that is rarest in the texts, and how many stand before it; a single
    code point for itself. Pairs are counted in one of ``share`` texts by their hash: what is chosen decides speed only."""
    pairs = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
    seen: dict[str, int] = {}
    if any(len(w) > 2 for w in words):
        some = texts.where((F.length(text) > 0) & (F.pmod(F.xxhash64(text), F.lit(share)) == 0)).select(F.split(F.col(text), "").alias("__chars"))
        spread = some.where("size(__chars) > 0").select("__chars", F.expr("explode(sequence(1, size(__chars))) as p")).select(F.expr(_pairs(_quoted(""))).alias("pair"))
        seen = dict(spread.where(F.col("pair").isin(sorted(pairs))).groupBy("pair").count().collect())  # a row a pair at most
    return {w: (w, 0) if len(w) == 1 else min((seen.get(w[i : i + 2], 0), i, w[i : i + 2]) for i in range(len(w) - 1))[:0:-1] for w in words}


def anchored_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> tuple[DataFrame, list[str] | None, int, int]:
    """Terms with ``__key`` and ``__off``, the keys themselves, how far a term reaches before its key, and the longest term.

    Up to ``MAX_BROADCAST_TERMS`` different terms are brought to the driver and anchored at their rarest pair; beyond that, a
    term's key is its first pair and the keys are not listed.
    """
    t = terms.where(F.length(term) > 0)
    found = t.select(term).distinct().limit(MAX_BROADCAST_TERMS + 1).collect()
    if len(found) > MAX_BROADCAST_TERMS:
        return t.withColumn("__key", F.substring(term, 1, 2)).withColumn("__off", F.lit(0)), None, 0, t.agg(F.max(F.length(term))).first()[0]
    words = [r[0] for r in found]
    anchors = rarest_pairs(texts, words, text)
    rows = t.sparkSession.createDataFrame([(w, key, off) for w, (key, off) in anchors.items()], f"{term} string, __key string, __off int")
    return t.join(F.broadcast(rows), term), sorted({k for k, _ in anchors.values()}), max([0, *(o for _, o in anchors.values())]), max(map(len, words), default=1)


def anchor_places(texts: DataFrame, keys: list[str], anchors: list[str] | None, reach: int, width: int, text: str = "text", context: bool = False) -> DataFrame:
    """The places of the texts where an anchor stands: ``keys``, ``pos``, ``__key``, and ``__piece``, the code points around it from
    ``__from`` on. Places without an anchor become no rows, and texts are not copied."""
    cut = texts.where(F.length(text) > 0).select(*keys, F.split(F.col(text), "").alias("__chars"))
    pair, one = _pairs(_quoted("")), "get(__chars, p - 1)"
    listed = lambda keys: ", ".join(map(_quoted, keys)) or "''"
    if anchors is None:
        wanted, found = "true", f"explode(array_distinct(array({pair}, {one})))"
    else:
        double, single = f"{pair} in ({listed([k for k in anchors if len(k) == 2])})", f"{one} in ({listed([k for k in anchors if len(k) == 1])})"
        wanted, found = double, pair
        if any(len(k) == 1 for k in anchors):
            wanted, found = f"({double} or {single})", f"explode(array(case when {double} then {pair} end, case when {single} then {one} end))"
    begin = f"greatest(p - {reach + 1}, 1)"
    before = "array_join(slice(__chars, greatest(p - {n}, 1), least(p - 2, {n} - 1)), '')"
    close, far = before.format(n=10), "array_join(slice(__chars, 1, p - 2), '')"
    colon = lambda t: f"rlike({t}, '[:：][ \\\\t\\\\n\\\\x0B\\\\f\\\\r]*$')"
    # a quote that follows a colon and perhaps white space; only if white space fills what stands close, the rest is looked at
    keyed = f"""case when p > 2 and get(__chars, p - 2) = '"' then case when {colon(close)} then true when p > 11 and trim({close}) = '' then {colon(far)} else false end else false end as keyed"""
    fields = ["p as pos", f"{begin} as __from", f"array_join(slice(__chars, {begin}, p - {begin} + {width + 2}), '') as __piece", *([keyed] if context else [])]
    # the place is generated and tested in one compiled stage, so a place without an anchor is never a row in memory
    places = cut.select(*keys, "__chars", F.expr("explode(sequence(1, size(__chars))) as p")).where(wanted)
    rows = places.select(*keys, *map(F.expr, fields), F.expr(found).alias("__key")).where("__key is not null")
    return rows.select(*keys, "pos", "__key", "__from", "__piece", *(["keyed"] if context else []))


def term_hits(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", term: str = "term", context: bool = False) -> DataFrame:
    """Every occurrence of every term: ``keys``, the columns of ``terms``, and ``pos`` from 1; with ``context`` also the
    code point ``before``, the two ``after``, and for terms of one or two code points whether a quote that follows a colon stands
    before it (``keyed``).

    A term is looked up by its rarest pair of code points, its anchor: only places with some term's anchor become rows, which
    meet the terms in a broadcast join and are checked around the anchor. Beyond ``MAX_BROADCAST_TERMS`` terms every place
    becomes a row and the join shuffles. Blank and null terms match nothing.
    """
    t, anchors, reach, width = anchored_terms(texts, terms, text, term)
    places = anchor_places(texts, keys, anchors, reach, width, text, context)
    t = F.broadcast(t) if anchors is not None else t.hint("merge")
    begin, at = F.col("pos") - F.col("__off"), F.col("pos") - F.col("__off") - F.col("__from") + 1
    hits = places.join(t, "__key").where((begin >= 1) & (F.substring(F.col("__piece"), at, F.length(term)) == F.col(term)))
    extra = []
    if context:
        extra = [F.when(at > 1, F.substring(F.col("__piece"), at - 1, F.lit(1))).otherwise("").alias("before"), F.substring(F.col("__piece"), at + F.length(term), F.lit(2)).alias("after"), (F.col("keyed") & (F.length(term) <= 2)).alias("keyed")]
    return hits.select(*keys, begin.alias("pos"), *terms.columns, *extra)


def contains_any(texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` of the texts that hold a term, per ``kind`` of term."""
    return term_hits(texts, terms.select("kind", "term"), keys, text).select(*keys, "kind").distinct()


#: Category names and aliases, and marks that give a generic hit its category.
CATEGORIES = {
    "sexual": "sexual", "pornography": "sexual", "涉黄": "sexual", "political": "political", "涉政": "political", "violence": "violence", "暴力": "violence",
    "gambling": "gambling", "赌博": "gambling", "drugs": "drugs", "毒品": "drugs", "abuse": "abuse", "profanity": "abuse", "脏话": "abuse",
    "hate": "hate", "discrimination": "hate", "歧视": "hate", "spam_fraud": "spam_fraud", "scam": "spam_fraud", "诈骗": "spam_fraud", "sensitive": "sensitive",
}
GENERIC = [
    ("gambling", ("赌", "博彩", "下注", "娱乐城")),
    ("drugs", ("毒品", "制毒", "贩毒", "吸毒")),
    ("political", ("法轮功", "涉政", "政权", "推翻政府")),
    ("sexual", ("色情", "成人", "裸聊", "约炮", "淫")),
    ("violence", ("暴力", "杀人", "砍人", "打人")),
    ("spam_fraud", ("诈骗", "刷单", "贷款")),
]


def category_name(col: Column) -> Column:
    """The category an alias stands for; unknown names are ``custom``."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.lower(F.trim(col))], F.lit("custom"))


def generic_category(word: Column) -> Column:
    out = F
    for name, marks in GENERIC:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(F.lower(word), F.lit(m))
        out = out.when(hit, name)
    return out.otherwise("sensitive")


def lexicon_level(hits: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Category and level of dictionary hits: the word's own level, else its category's override ``(category, override)``,
    else block for the three hard categories and review for the rest."""
    c = category_name(F.col("category"))
    out = hits.withColumn("category", F.when(c == "sensitive", generic_category(F.col("term"))).otherwise(c))
    out = out.join(F.broadcast(overrides), "category", "left") if overrides is not None else out.withColumn("override", F.lit(None).cast("string"))
    hard = F.when(F.col("category").isin("sexual", "gambling", "drugs"), "block").otherwise("review")
    return out.withColumn("level", F.coalesce(F.nullif("level", F.lit("")), F.nullif("override", F.lit("")), hard)).drop("override")


def skipped_hit(before: Column, after: Column, keyed: Column, term: Column) -> Column:
    """Hits that do not count: a technical compound, and one or two ASCII word characters that are part of a longer word
    or stand as a quoted JSON value."""
    after1 = F.substring(after, 1, 1)
    short = F.lower(term).rlike("^[a-z0-9_]{1,2}$")
    glued = before.rlike("^[A-Za-z0-9_]$") | after1.rlike("^[A-Za-z0-9_]$")
    return ((term == "垃圾") & after.isin("回收", "收集")) | (short & (glued | (keyed & (after1 == '"'))))


def lexicon_signals(views: DataFrame, terms: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Signals of dictionary terms in any view: ``(comment_id, seq, category, level, evidence)``, each triple once.

    ``views(comment_id, view_no, text)``; ``terms(term, category, level)``. ``seq`` follows view, position and word.
    """
    tagged = views.select("comment_id", "view_no", F.trim("text").alias("text"))
    return hit_signals(term_hits(tagged, terms.select("term", "category", "level"), ["comment_id", "view_no"], context=True), overrides)


def hit_signals(raw: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The signals of dictionary hits ``raw(comment_id, view_no, pos, term, category, level, before, after, keyed)``."""
    kept = raw.where(~skipped_hit(F.col("before"), F.col("after"), F.col("keyed"), F.col("term")))
    named = lexicon_level(kept, overrides)
    first = named.groupBy("comment_id", "category", "level", "term").agg(F.min(F.struct("view_no", "pos", "term")).alias("first"))
    seq = F.row_number().over(W.partitionBy("comment_id").orderBy("first", "category", "level")).cast("long")
    return first.select("comment_id", seq.alias("seq"), "category", "level", F.col("term").alias("evidence"))


def weighted_distance(left: str, right: str) -> int:
    """Edit distance: 2 for a substitution, insertion or deletion, 1 for a look-alike."""
    row = [2 * k for k in range(len(right) + 1)]
    for i, a in enumerate(left, 1):
        new = [2 * i]
        for j, b in enumerate(right, 1):
            swap = 0 if a == b else 1 if CONFUSABLES.get(a, a) == CONFUSABLES.get(b, b) else 2
            new.append(min(row[j] + 2, new[j - 1] + 2, row[j - 1] + swap))
        row = new
    return row[-1]


def closest_window(views: list[str], word: str, distance: int) -> tuple[str, int] | None:
    """The first window of least cost within ``2 * distance``; a view that holds the word itself is passed over."""
    best, found = 2 * distance + 1, None
    sizes = range(max(1, len(word) - distance), len(word) + distance + 1)
    need = len(word) - distance
    for v in views:
        if word in v:
            continue
        held = {CONFUSABLES.get(c, c) for c in v}
        if sum(CONFUSABLES.get(c, c) in held for c in word) < need:
            continue  # every window misses more of the word than the distance allows
        for start in range(len(v)):
            for size in sizes:
                if start + size > len(v):
                    break
                cost = weighted_distance(v[start : start + size], word)
                if cost < best:
                    best, found = cost, v[start : start + size]
    return None if found is None else (found, (best + 1) // 2)


def closest_windows(texts: list[str], word: str, distance: int) -> list[tuple[int, str] | None]:
    """Per text its first window of least cost within ``2 * distance`` and that cost, or None; as :func:`closest_window`
    finds it in one view, for all texts at once, a row of the distance tables at a time."""
    out: list[tuple[int, str] | None] = [None] * len(texts)
    sizes = range(max(1, len(word) - distance), len(word) + distance + 1)
    plain = word.translate(_SAME)
    folded = [t.translate(_SAME) for t in texts]
    live = [k for k, t in enumerate(texts) if word not in t and sum(c in folded[k] for c in plain) >= len(word) - distance and len(t) >= sizes[0]]
    if not live:
        return out
    code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    exact, alike = (code("".join(x[k] for k in live)) for x in (texts, folded))
    lens = np.array([len(texts[k]) for k in live])
    ends = np.repeat(np.cumsum(lens), lens)
    cost = np.full((len(exact), len(sizes)), 2 * distance + 1)
    row = [np.full(len(exact), 2 * j) for j in range(len(word) + 1)]
    for i in range(sizes[-1]):
        at = np.minimum(np.arange(len(exact)) + i, len(exact) - 1)
        a, b = exact[at], alike[at]
        new = [np.full(len(exact), 2 * (i + 1))]
        for j, (c, d) in enumerate(zip(code(word), code(plain), strict=True)):
            swap = np.where(a == c, 0, np.where(b == d, 1, 2))
            new.append(np.minimum(np.minimum(row[j + 1] + 2, new[j] + 2), row[j] + swap))
        row = new
        if i + 1 in sizes:
            inside = np.arange(len(exact)) + i < ends
            cost[inside, sizes.index(i + 1)] = row[-1][inside]
    first = np.cumsum(lens) - lens
    for k, begin, n in zip(live, first.tolist(), lens.tolist(), strict=True):
        best = int(cost[begin : begin + n].argmin())  # the first place, then the shortest window
        start, size = divmod(best, len(sizes))
        if cost[begin + start, size] <= 2 * distance:
            out[k] = int(cost[begin + start, size]), texts[k][start : start + sizes[size]]
    return out


def seeds(words: list[str], max_distance: int) -> list[tuple[str, int]]:
    """Each word in one piece more than its distance, of nearly equal length, with the word's number. A window within the
    distance leaves one piece as it is, look-alikes aside."""
    out = []
    for k, w in enumerate(words):
        plain, n = w.translate(_SAME), max_distance + 1
        cuts = [len(w) * i // n for i in range(n + 1)]
        out += [(plain[a:b], k) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return sorted(set(out))


def fuzzy_signals(clauses: DataFrame, candidates: list[tuple[str, str]], max_distance: int = 1, min_runes: int = 4, found: DataFrame | None = None) -> DataFrame:
    """``(comment_id, clause, category, word, evidence)``: near misses of candidate words, the first clause of each word.

    ``candidates`` are (category, word) of a validated policy and travel with the function. Only clauses whose skeleton holds a
    piece of a word are compared with it: ``found(comment_id, clause, word_no)``, looked up here unless it is given.
    """
    kind = "array<struct<seq: int, category: string, word: string, evidence: string>>"
    fit = [k for k, (_, w) in enumerate(candidates) if len(w) >= min_runes]
    if found is None:
        pieces = [(p, fit[k]) for p, k in seeds([candidates[k][1] for k in fit], max_distance)]
        table = clauses.sparkSession.createDataFrame(pieces, "term string, word_no int")
        found = term_hits(clauses, table, ["comment_id", "clause"], "skeleton").select("comment_id", "clause", "word_no")

    def scan(compact: pd.Series, skeleton: pd.Series, numbers: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in compact]
        rows: dict[int, list[int]] = {}
        for i, ks in enumerate(numbers):
            for k in ks:
                rows.setdefault(int(k), []).append(i)
        views = compact.tolist(), ["" if s == c else s for c, s in zip(compact, skeleton, strict=True)]
        for k in sorted(rows):
            category, w = candidates[k]
            for i, x, y in zip(rows[k], *(closest_windows([v[i] for i in rows[k]], w, max_distance) for v in views), strict=True):
                if m := y if x is None or (y is not None and y[0] < x[0]) else x:
                    out[i].append({"seq": k, "category": category, "word": w, "evidence": f"{m[1]}~{w}(d={(m[0] + 1) // 2})"})
        return pd.Series(out)

    numbers = found.groupBy("comment_id", "clause").agg(F.collect_set("word_no").alias("__words"))
    met = clauses.join(numbers.hint("merge"), ["comment_id", "clause"])  # a side of the texts' size is never sent to the driver
    hits = met.select("comment_id", "clause", F.explode(F.pandas_udf(scan, kind)("compact", "skeleton", "__words")).alias("m"))
    first = hits.groupBy("comment_id", F.col("m.category").alias("category"), F.col("m.word").alias("word")).agg(F.min(F.struct("clause", F.col("m.seq").alias("seq"), F.col("m.evidence").alias("evidence"))).alias("f"))
    return first.select("comment_id", F.col("f.clause").alias("clause"), F.col("f.seq").alias("seq"), "category", "word", F.col("f.evidence").alias("evidence"))

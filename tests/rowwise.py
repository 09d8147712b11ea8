"""Moderation a second time: one comment after the other in plain Python, to hold the Spark pipeline against.

The views of a text come from the text helpers, which have golden rows of their own; everything after them is written anew.
"""

from __future__ import annotations

import re
from collections import defaultdict

import regex

from inkwell.functions import text as T
from inkwell.operators.moderation import structure as S
from inkwell.sources.policy import compile_policy

STAGE = {"lexicon": 0, "similarity": 1, "structure": 2, "context": 3, "behavior": 4, "semantic": 5}
GENERIC = {"赌 博彩 下注 娱乐城": "gambling", "毒品 制毒 贩毒 吸毒": "drugs", "法轮功 涉政 政权 推翻政府": "political", "色情 成人 裸聊 约炮 淫": "sexual", "暴力 杀人 砍人 打人": "violence", "诈骗 刷单 贷款": "spam_fraud"}
ALIASES = "sexual:sexual pornography:sexual 涉黄:sexual political:political 涉政:political violence:violence 暴力:violence gambling:gambling 赌博:gambling drugs:drugs 毒品:drugs abuse:abuse profanity:abuse 脏话:abuse hate:hate discrimination:hate 歧视:hate spam_fraud:spam_fraud scam:spam_fraud 诈骗:spam_fraud sensitive:sensitive"
ALIASES = dict(x.split(":") for x in ALIASES.split())
LEVELS = {"block": "block", "reject": "block", "rejected": "block", "review": "review", "pending": "review", "notice": "notice", "allow": "allow", "approved": "allow"}


def java(pattern: str):
    """A fixed pattern as Java reads it: ASCII classes and borders, code points by number."""
    p = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), pattern)
    flags = 0
    if p.startswith("(?i)"):
        p, flags = p[4:], regex.IGNORECASE
    out, inside = "", False
    for token in re.findall(r"\\.|.", p, re.DOTALL):
        inside = (inside or token == "[") and token != "]"
        known = {r"\s": " \\t\\n\\x0b\\f\\r", r"\d": "0-9"}.get(token)
        if known:
            token = known if inside else f"[{known}]"
        out += r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))" if token == r"\b" else token
    return regex.compile(out, flags)


SCRIPT, PHONE, DOMAIN, HIDDEN, ACCOUNT, INTENT, MAIL, SYMBOL = map(java, (S.SCRIPT, S.PHONE, S.DOMAIN, S.HIDDEN_DOMAIN, S.ACCOUNT, S.INTENT, S.HIDDEN_MAIL, S.SYMBOL_ACCOUNT))
EXEMPT = S.EXEMPT_CONTACTS


def url(t):
    return bool(DOMAIN.search(t) or HIDDEN.search(t))


def contact(t, symbols=True):
    return any(p.search(t) for p in (PHONE, ACCOUNT, INTENT, MAIL, *([SYMBOL] if symbols else [])))


def exempt(t):
    return any(all(bool(INTENT.search(t)) if isinstance(x, str) else any(w in t for w in x) for x in row) for row in EXEMPT)


def places(text, term):
    at = text.find(term)
    while at >= 0:
        yield at
        at = text.find(term, at + 1)


def lexicon(a, words, overrides):
    views = [a["normalized"], a["compact"], *(a[v] for v in ("skeleton", "pinyin") if a[v] and a[v] != a["compact"]), *a["decoded"]]
    first = {}
    for no, view in enumerate(views):
        view = view.strip(" ")
        for term, category, level in words:
            for at in places(view, term) if term else ():
                before, after = view[at - 1 : at] if at else "", view[at + len(term) : at + len(term) + 2]
                if term == "垃圾" and after in ("回收", "收集"):
                    continue
                if re.fullmatch("[a-z0-9_]{1,2}", term.lower()):
                    glued = re.fullmatch("[A-Za-z0-9_]", before or " ") or re.match("[A-Za-z0-9_]", after)
                    keyed = before == '"' and re.search("[:：][ \t\n\x0b\f\r]*$", view[: max(at - 1, 0)]) and after[:1] == '"'
                    if glued or keyed:
                        continue
                c = ALIASES.get(category.strip(" ").lower(), "custom")
                if c == "sensitive":
                    c = next((name for marks, name in GENERIC.items() if any(m in term.lower() for m in marks.split())), "sensitive")
                lv = level or overrides.get(c) or ("block" if c in ("sexual", "gambling", "drugs") else "review")
                key = (c, lv, term)
                first[key] = min(first.get(key, (no, at, term)), (no, at, term))
    order = sorted(first, key=lambda k: (first[k], k[0], k[1]))
    return [dict(source="lexicon", seq=n, category=c, level=lv, evidence=t) for n, (c, lv, t) in enumerate(order, 1)]


def distance(a, b):
    row = list(range(0, 2 * len(b) + 1, 2))
    for i, x in enumerate(a, 1):
        new = [2 * i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 2, new[-1] + 2, row[j - 1] + (0 if x == y else 1 if T.CONFUSABLES.get(x, x) == T.CONFUSABLES.get(y, y) else 2)))
        row = new
    return row[-1]


def nearest(view, word, d):
    best = None
    if view and word not in view:
        for at in range(len(view)):
            for size in range(max(1, len(word) - d), len(word) + d + 1):
                if at + size <= len(view):
                    cost = distance(view[at : at + size], word)
                    if cost <= 2 * d and (best is None or cost < best[0]):
                        best = cost, view[at : at + size]
    return best


def fuzzy(clauses, candidates, d, least):
    first = {}
    for c in clauses:
        for k, (category, word) in enumerate(candidates):
            if len(word) < least:
                continue
            x, y = nearest(c["compact"], word, d), nearest(c["skeleton"] if c["skeleton"] != c["compact"] else "", word, d)
            m = y if x is None or (y is not None and y[0] < x[0]) else x
            if m is not None:
                found = (c["clause"], k, f"{m[1]}~{word}(d={(m[0] + 1) // 2})")
                first[category, word] = min(first.get((category, word), found), found)
    return [dict(source="similarity", seq=cl * 1_000_000 + k, category=c, level="review", evidence=e, rule_id="fuzzy_lexicon", clause=cl) for (c, _), (cl, k, e) in first.items()]


def quality(compact):
    n = len(compact)
    if not n:
        return "no_words"
    if n >= 5 and regex.fullmatch(r"\p{N}+", compact):
        return "numeric"
    if n >= 5 and 10 * len(regex.findall(r"[\p{N}零〇一二三四五六七八九壹贰叁肆伍陆柒捌玖两]", compact)) >= 6 * n:
        return "number_like"
    return "repeated" if n >= 6 and 4 * max(map(compact.count, set(compact))) >= 3 * n else None


def structure(a, clauses, p):
    live, n, out = [c for c in clauses if not c["benign"]], a["normalized"], []
    levels = p["structure_rules"]

    def add(seq, rule, evidence):
        out.append(dict(source="structure", seq=seq, category=rule, level=levels.get(rule, {}).get("level") or ("block" if rule == "script_injection" else "review"), evidence=evidence, rule_id=rule))

    if any(SCRIPT.search(c["normalized"]) for c in live):
        add(0, "script_injection", "script")
    if any(url(c["normalized"]) for c in live) or (url(n) and live):
        add(1000, "url", "url")
    if any(contact(c["normalized"]) and not exempt(c["normalized"]) for c in live) or (contact(n) and live):
        add(2000, "contact", "contact")
    if risky(n, a["compact"], p):
        add(3000, "risk_phrase", "risk_phrase")
    if q := quality(a["compact"]):
        add(1_000_000, "text_quality", q)
    for i, x in enumerate(a["decoded"]):
        add(500_000 + i, "decoded_url", x)
    return out


def risky(normalized, compact, p):
    return any(w in compact for w in p["structure_patterns"]["risk_phrases"]) or any(java(x).search(normalized) for x in p["structure_patterns"]["risk_patterns"])


def combinations(clauses, rules):
    first = {}
    for c in clauses:
        if not c["benign"]:
            texts = [t for t in (c["compact"], c["pinyin"]) if t]
            for no, r in enumerate(rules):
                for i, s in enumerate(r["subjects"]):
                    for j, o in enumerate(r["predicates"]):
                        if s != o and any(s in t for t in texts) and any(o in t for t in texts):
                            found = (c["clause"], i, j)
                            first[no, s, o] = min(first.get((no, s, o), found), found)
    return [dict(source="context", seq=no * 10**12 + cl * 10**8 + i * 10**4 + j, category=rules[no]["category"], level=rules[no]["level"], evidence=f"{s}+{o}", rule_id=rules[no]["id"], clause=cl) for (no, s, o), (cl, i, j) in first.items()]


def behavior(rows, rules):
    """comment id -> signals, over ``rows`` of dicts with their compact text."""
    out = defaultdict(list)
    rows = sorted(rows, key=lambda r: (r["ts_s"], r["comment_id"]))
    user, ip, dup, near = (rules[k] for k in ("user_frequency", "ip_frequency", "duplicate_content", "near_duplicate"))

    def add(r, seq, category, level, evidence):
        out[r["comment_id"]].append(dict(source="behavior", seq=seq, category=category, level=level, evidence=evidence, rule_id=category))

    for seq, key, rule, name in ((0, "user_id", user, "user_frequency"), (1, "ip", ip, "ip_frequency")):
        seen = defaultdict(list)
        for r in rows:
            if r[key] and str(r[key]).strip(" "):
                before = seen[r[key]]
                if sum(t >= r["ts_s"] - rule["window_seconds"] for t in before) + 1 >= rule["review_threshold"]:
                    add(r, seq, name, "review", name)
                before.append(r["ts_s"])
    sessions, samples = {}, defaultdict(list)
    for r in rows:
        if not (r["user_id"] and r["article_id"]):
            continue
        key = r["user_id"], r["article_id"], r["compact"]
        last, n = sessions.get(key, (None, 0))
        n = n + 1 if last is not None and r["ts_s"] - last <= dup["window_seconds"] else 1
        sessions[key] = r["ts_s"], n
        if n >= dup["review_threshold"]:
            block = n >= dup["block_threshold"]
            add(r, 2, "duplicate_content", "block" if block else "review", "duplicate_block" if block else "duplicate_review")
        size = len(r["compact"])
        if not near["disabled"] and size >= near["min_content_runes"]:
            h, held = T.simhash_of(r["compact"]), samples[key[:2]]
            recent = [x for x in held if x[0] >= r["ts_s"] - near["window_seconds"]][-near["max_samples"] :]
            alike = sum(100 * abs(size - m) <= near["max_length_difference_percent"] * max(size, m) and bin((h ^ o) & (2**64 - 1)).count("1") <= near["max_hamming_distance"] for _, m, o in recent)
            if alike + 1 >= near["review_threshold"]:
                add(r, 3, "near_duplicate", "review", "simhash_review")
            held.append((r["ts_s"], size, h))
    return out


def score(s, table, pending, reject):
    level = LEVELS.get(s["level"].strip(" ").lower(), "")
    part = {"s": s["source"], "c": s["category"], "r": s["rule_id"], "l": level}
    part = {k: v.strip(" ").lower() for k, v in part.items()}
    for k in "scrl scr scl sc srl sr sl s l".split():
        if all(part[x] for x in k) and table.get(".".join(part[x] for x in k), 0) > 0:
            return table[".".join(part[x] for x in k)]
    return {"block": reject, "review": pending}.get(level, 0)


def suppressed(s, clauses, severe, p):
    if s["source"] == "behavior" or (s["source"] == "structure" and s["rule_id"] in ("decoded_url", "script_injection", "text_quality")):
        return False
    if s["clause"] > 0:
        relevant = [c for c in clauses if c["clause"] == s["clause"]]
    elif s["source"] in ("lexicon", "context"):
        terms = [regex.sub(r"[\s\p{P}\p{S}]", "", t, flags=regex.ASCII) for t in re.split(r"[+,:\s]", s["evidence"].lower(), flags=re.ASCII)]
        terms = [t for t in terms if t and t not in ("url", "contact", "riskphrase")]
        relevant = [c for c in clauses if all(t in c["compact"] or t in c["pinyin"] for t in terms)]
    else:
        test = {"url": lambda c: url(c["normalized"]), "contact": lambda c: contact(c["normalized"], False), "risk_phrase": lambda c: risky(c["normalized"], c["compact"], p)}.get(s["rule_id"], lambda c: False)
        relevant = [c for c in clauses if test(c)] if s["source"] == "structure" else []
    if not relevant:
        return False
    if s["category"] == "abuse" and severe:
        return not any(m in c[v] for c in relevant for m in severe for v in ("compact", "pinyin", "skeleton"))
    return all(c["benign"] for c in relevant)


def moderate(comments, policy, words=(), history=(), with_behavior=True):
    """comment id -> dict(status, score, decision, reasons, signals, suppressed, clauses)."""
    p = compile_policy(policy)
    sem, contexts, scores = p["semantic_rules"], p["semantic_rules"]["contexts"], p["decision"]["score"]
    own = [(w.strip(), c, lv) for lv in ("block", "review") for c, ws in p["lexicon"]["custom_words"][lv].items() for w in ws if w.strip()]
    words = own + [w for w in words if w[0] not in {x[0] for x in own}]
    overrides = {k: (v["level"] if isinstance(v, dict) else v) for k, v in p["decision"]["category_overrides"].items()}
    candidates = [(c, w) for c, ws in p["lexicon"]["fuzzy"]["candidate_words"].items() for w in ws]
    table = {k.strip().lower().replace(":", "."): int(v) for k, v in p["decision"]["rule_scores"].items() if int(v) > 0}
    severe = [] if sem["abuse_policy"]["disabled"] else sem["abuse_policy"]["severe_markers"]
    acted = defaultdict(list)
    analysed = {r["comment_id"]: T.analyse(r["content"]) for r in comments}
    if with_behavior:
        old = [r | {"compact": T.analyse(r["content"])["compact"]} for r in history]
        acted = behavior([r | {"compact": analysed[r["comment_id"]]["compact"]} for r in comments] + old, p["behavior_rules"])
    out = {}
    for r in comments:
        a = analysed[r["comment_id"]]
        clauses = [dict(c) for c in a["clauses"]]
        for c in clauses:
            has = lambda k: any(m in c["compact"] for m in contexts[f"{k}_markers"])  # noqa: B023, E731
            c["benign"] = c["compact"] == "" or (
                not any(java(x).search(c["normalized"]) for x in contexts["actionable_patterns"])
                and (has("unambiguous_benign") or (not has("actionable") and (has("reporting") or has("rejection") or has("technical"))))
            )
        found = lexicon(a, words, overrides)
        if candidates and not p["lexicon"]["fuzzy"]["disabled"]:
            found += fuzzy(clauses, candidates, p["lexicon"]["fuzzy"]["max_distance"], p["lexicon"]["fuzzy"]["min_word_runes"])
        found += structure(a, clauses, p) + combinations(clauses, p["combination_rules"]) + acted[r["comment_id"]]
        for s in found:
            s |= {"stage": STAGE[s["source"]], "clause": s.get("clause", 0), "rule_id": s.get("rule_id", "")}
            s["score"] = score(s, table, scores["pending"], scores["reject"])
            what = f"{s['rule_id']}:{s['evidence']}" if s["source"] == "context" else s["evidence"]
            s["reason"] = ":".join([s["source"], *(x for x in (s["category"], s["level"], what) if x)])
        found.sort(key=lambda s: (s["stage"], s["seq"]))
        gone = [] if sem["disabled"] else [s for s in found if suppressed(s, clauses, severe, p)]
        kept = [s for s in found if not any(s is g for g in gone)]
        if gone:
            said = list(dict.fromkeys(t for s in gone if (t := s["evidence"].strip(" "))))
            kept.append(dict(source="semantic", seq=0, category="benign_context", level="allow", evidence=",".join(said), rule_id="benign_context", clause=0, stage=5, score=0, reason=None))
        status, total, why, reasons = "approved", sum(s["score"] for s in kept), "no_risk_signal", kept
        block = next((k for k, s in enumerate(kept) if LEVELS.get(s["level"].lower()) == "block"), None)
        if block is not None:
            status, total, why, reasons = "rejected", max(kept[block]["score"], scores["reject"]), "block_signal", kept[: block + 1]
        elif any(LEVELS.get(s["level"].lower()) == "review" for s in kept):
            status, total, why = "pending", min(max(total, scores["pending"]), scores["reject"] - 1), "review_signal"
        out[r["comment_id"]] = dict(status=status, score=total, decision=why, reasons=[s["reason"] for s in reasons if s["reason"]], signals=kept, suppressed=gone, clauses=clauses)
    return out

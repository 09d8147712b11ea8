"""Moderation policy: validation, compilation to normalised terms, and dimension tables.

A policy is a nested dictionary (as read from YAML): ``lexicon.custom_words.{block,review}``, ``lexicon.fuzzy``,
``structure_patterns``, ``structure_rules``, ``combination_rules``, ``semantic_rules``, ``behavior_rules``, ``decision``.
"""

from __future__ import annotations

import copy
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.functions.columns import LEVELS
from inkwell.functions.text import compact, normalize, skeleton

#: What an absent setting means.
DEFAULTS = {
    "behavior_rules": {
        "user_frequency": {"window_seconds": 600, "review_threshold": 6},
        "ip_frequency": {"window_seconds": 600, "review_threshold": 12},
        "duplicate_content": {"window_seconds": 86400, "review_threshold": 2, "block_threshold": 4},
        "near_duplicate": {"disabled": False, "window_seconds": 86400, "review_threshold": 2, "max_hamming_distance": 10, "min_content_runes": 12, "max_samples": 100, "max_length_difference_percent": 30},
    },
    "lexicon": {"custom_words": {"block": {}, "review": {}}, "fuzzy": {"disabled": False, "max_distance": 1, "min_word_runes": 4, "candidate_words": {}}},
    "structure_patterns": {"risk_phrases": [], "risk_patterns": []},
    "structure_rules": {"url": {"level": "review"}, "decoded_url": {"level": "review"}, "contact": {"level": "review"}, "script_injection": {"level": "block"}, "text_quality": {"level": "review"}, "risk_phrase": {"level": "review"}},
    "combination_rules": [],
    "semantic_rules": {
        "disabled": False,
        "contexts": {k: [] for k in ("reporting_markers", "rejection_markers", "technical_markers", "unambiguous_benign_markers", "actionable_markers", "actionable_patterns")},
        "abuse_policy": {"disabled": False, "severe_markers": []},
    },
    "decision": {
        "default_on_error": "pending",
        "score": {"pending": 40, "reject": 80},
        "rule_scores": {},
        "category_overrides": {"sexual": "block", "gambling": "block", "drugs": "block", "political": "review", "violence": "review", "abuse": "review", "hate": "review", "spam_fraud": "review", "sensitive": "review", "custom": "review"},
    },
}


def filled(policy: dict, defaults: dict | None = None) -> dict:
    """The policy with absent, null and non-positive numeric settings taken from the defaults."""
    out = copy.deepcopy(defaults if defaults is not None else DEFAULTS)
    for k, v in policy.items():
        have = out.get(k)
        if isinstance(have, dict) and isinstance(v, dict):
            out[k] = filled(v, have)
        elif v is not None and not (isinstance(have, int) and not isinstance(have, bool) and isinstance(v, int) and v <= 0):
            out[k] = copy.deepcopy(v)
    return out


def terms(values: list[str]) -> list[str]:
    """Normalised, compact, blank ones dropped."""
    return [t for t in (compact(normalize(v)) for v in values) if t]


def _level(value: str | None) -> str:
    return LEVELS.get((value or "").strip().lower(), "")


def validate_policy(policy: dict) -> dict:
    """Raise ``ValueError`` for settings that would silently switch a detector off; returns the filled policy."""
    p = filled(policy)
    fuzzy = p["lexicon"]["fuzzy"]
    if not fuzzy["disabled"] and fuzzy["candidate_words"]:
        if fuzzy["max_distance"] > 2:
            raise ValueError("lexicon.fuzzy.max_distance must be at most 2")
        for category, words in fuzzy["candidate_words"].items():
            for w in words:
                if len(compact(normalize(w))) < fuzzy["min_word_runes"]:
                    raise ValueError(f"lexicon.fuzzy.candidate_words[{category}]: {w!r} is too short")
    near = p["behavior_rules"]["near_duplicate"]
    if not near["disabled"] and near["max_hamming_distance"] > 16:
        raise ValueError("behavior_rules.near_duplicate.max_hamming_distance must be at most 16")
    if not near["disabled"] and near["max_length_difference_percent"] > 50:
        raise ValueError("behavior_rules.near_duplicate.max_length_difference_percent must be at most 50")
    seen = set()
    for k, rule in enumerate(p["combination_rules"]):
        name = (rule.get("id") or "").strip()
        if not name:
            raise ValueError(f"combination_rules[{k}]: id is required")
        if name in seen:
            raise ValueError(f"combination_rules: duplicate id {name!r}")
        seen.add(name)
        for part in ("subjects", "predicates"):
            if not terms(rule.get(part) or []):
                raise ValueError(f"combination_rules[{name}]: {part} are required")
        if (rule.get("level") or "").strip() and not _level(rule["level"]):
            raise ValueError(f"combination_rules[{name}]: invalid level {rule['level']!r}")
    for path, patterns in (("structure_patterns.risk_patterns", p["structure_patterns"]["risk_patterns"]), ("semantic_rules.contexts.actionable_patterns", p["semantic_rules"]["contexts"]["actionable_patterns"])):
        for k, pattern in enumerate(patterns):
            if not pattern.strip():
                raise ValueError(f"{path}[{k}]: pattern is empty")
            try:
                re.compile(pattern)
            except re.error as e:
                raise ValueError(f"{path}[{k}]: {e}") from e
    return p


def policy_error(body: Column) -> Column:
    """What is wrong with each policy of a column of JSON texts: the error of :func:`validate_policy`, blank if it is valid,
    and ``policy is not an object`` for anything but a JSON object."""

    def check(body: str | None) -> str:
        try:
            given = json.loads(body or "")
        except json.JSONDecodeError:
            given = None
        if not isinstance(given, dict):
            return "policy is not an object"
        try:
            validate_policy(given)
        except ValueError as e:
            return str(e)
        return ""

    return F.pandas_udf(lambda s: s.map(check), "string")(body)


def compile_policy(policy: dict) -> dict:
    """The validated policy with every term normalised and compact, fuzzy candidates also as skeletons."""
    p = validate_policy(policy)
    p["structure_patterns"]["risk_phrases"] = terms(p["structure_patterns"]["risk_phrases"])
    words = p["lexicon"]["fuzzy"]["candidate_words"]
    p["lexicon"]["fuzzy"]["candidate_words"] = {c: [skeleton(t) for t in terms(w)] for c, w in words.items()}
    for rule in p["combination_rules"]:
        rule["id"] = rule["id"].strip()
        rule["category"] = (rule.get("category") or "").strip() or rule["id"]
        rule["level"] = _level(rule.get("level")) or "review"
        rule["subjects"], rule["predicates"] = terms(rule["subjects"]), terms(rule["predicates"])
    contexts = p["semantic_rules"]["contexts"]
    for k in contexts:
        if k.endswith("_markers"):
            contexts[k] = terms(contexts[k])
    abuse = p["semantic_rules"]["abuse_policy"]
    abuse["severe_markers"] = terms(abuse["severe_markers"])
    return p


def policy_tables(spark: SparkSession, policy: dict) -> dict[str, DataFrame]:
    """Dimension tables of a policy: ``term(kind, category, level, term, seq)``, ``rule``, ``pattern``, ``threshold``, ``rule_score``."""
    p = compile_policy(policy)
    term = [(f"lexicon_{lv}", c, lv, w.strip()) for lv in ("block", "review") for c, ws in p["lexicon"]["custom_words"][lv].items() for w in ws if w.strip()]
    term += [("fuzzy", c, "review", w) for c, ws in p["lexicon"]["fuzzy"]["candidate_words"].items() for w in ws]
    term += [("risk_phrase", "", "", w) for w in p["structure_patterns"]["risk_phrases"]]
    term += [(k.removesuffix("_markers"), "", "", w) for k, ws in p["semantic_rules"]["contexts"].items() if k.endswith("_markers") for w in ws]
    term += [("severe", "abuse", "", w) for w in p["semantic_rules"]["abuse_policy"]["severe_markers"]]
    rule = [(k, r["id"], r["category"], r["level"], r["subjects"], r["predicates"]) for k, r in enumerate(p["combination_rules"])]
    pattern = [("risk", x) for x in p["structure_patterns"]["risk_patterns"]] + [("actionable", x) for x in p["semantic_rules"]["contexts"]["actionable_patterns"]]
    threshold = [(d, k, int(v)) for d, r in p["behavior_rules"].items() for k, v in r.items()]
    score = [(k.strip().lower().replace(":", "."), int(v)) for k, v in p["decision"]["rule_scores"].items() if int(v) > 0]
    make = spark.createDataFrame
    return {
        "term": make([(*t, k) for k, t in enumerate(term)], "kind string, category string, level string, term string, seq long"),
        "rule": make(rule, "rule_no long, id string, category string, level string, subjects array<string>, predicates array<string>"),
        "pattern": make(pattern, "kind string, pattern string"),
        "threshold": make(threshold, "detector string, name string, value long"),
        "rule_score": make(score, "key string, score long"),
    }

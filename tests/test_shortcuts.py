"""Short ways of text analysis and structure rules give what the long ways give."""

import random

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators.moderation import structure

ASCII = st.text(st.characters(max_codepoint=127), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ASCII)
def test_ascii_texts(t):
    """A letter outside ASCII behind the text takes it the long way."""
    assert text.normalize(f"{t}x é") == text.normalize(f"{t}x") + " é"
    assert text.compact(t + "é") == text.compact(t) + "é"
    assert text.skeleton(t + "é") == text.skeleton(t) + "é"


def _plain_simhash(t: str) -> int:
    grams = [t] if len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)]
    votes = [0] * 64
    for g in grams:
        h = 14695981039346656037
        for byte in g.encode("utf-8", "surrogatepass"):
            h = (h ^ byte) * 1099511628211 % 2**64
        votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
    value = sum(1 << k for k, v in enumerate(votes) if v >= 0) if t else 0
    return value - 2**64 if value >> 63 else value


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8), st.integers(1, 9))
def test_simhashes(texts, step):
    assert text.simhashes(texts, step).tolist() == [_plain_simhash(t) for t in texts]


def test_patterns_behind_parts(spark):
    """The parts that a text must hold before a pattern is tried are parts of all its matches."""
    rng = random.Random(3)
    words = "www . com . http:// HTTPS : / / hxxp hxxps:// 点 [.] [ a.io x-1 cn me@ at dot a at b dot com V : VX ：ab12 qq:1234 QQ 加 群 12345 1 3 扫码123456 二维码 联系 我 私信 微信号 绿信 加 好友 v我 😀：abcd ☎ : a_b-c 13812345678 账号写图片 K".split(" ")
    rows = [("".join(w + rng.choice(["", " ", ""]) for w in rng.choices(words, k=rng.randrange(1, 7))),) for _ in range(6000)]
    n = F.col("t")
    url = structure.matches(n, structure.DOMAIN) | structure.matches(n, structure.HIDDEN_DOMAIN)
    symbol = structure.matches(n, structure.SYMBOL_ACCOUNT)
    contact = structure.matches(n, structure.PHONE) | structure.matches(n, structure.ACCOUNT) | structure.matches(n, structure.INTENT) | structure.matches(n, structure.HIDDEN_MAIL)
    pairs = [(structure.is_url(n), url), (structure.is_contact(n), contact | symbol), (structure.is_contact(n, False), contact), (structure.is_symbol_account(n), symbol)]
    found = spark.createDataFrame(rows, "t string").agg(*[F.count_if(a != b).alias(f"d{k}") for k, (a, b) in enumerate(pairs)], *[F.count_if(b).alias(f"n{k}") for k, (_, b) in enumerate(pairs)]).first()
    assert list(found)[:4] == [0] * 4 and min(list(found)[4:]) > 100


def test_repeated_characters(spark):
    """At least three quarters of six or more characters are one and the same."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab好😀", weights=[12, 1, 1, 1], k=rng.randrange(6, 13))) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(structure.text_quality(F.col("t"))).collect()]
    assert got == ["repeated" if max(map(t.count, t)) * 4 >= 3 * len(t) else None for t in texts]


def test_long_texts_leave_in_portions():
    """A batch of many long texts is never analysed as one frame, and every text comes out once, in order."""
    texts = ["a. " * 60_000, None, "", "b: c", *["long text. " * 40_000] * 8, "end"]
    frames = list(text._analyse_series(iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["x"])])))
    assert max(f["normalized"].str.len().sum() for f in frames) <= text.ANALYSED and len(frames) > 4
    assert [d for f in frames for d in f["normalized"]] == [text.analyse(t)["normalized"] for t in [*texts, "x"]]
    assert [len(c) for f in frames for c in f["clauses"]] == [len(text.analyse(t)["clauses"]) for t in [*texts, "x"]]

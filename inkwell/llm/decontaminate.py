"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters. Items are dealt to blocks of bounded
size, one automaton and one pass each; every document streams through each automaton once, carrying the length of the longest
suffix that occurs in an item. A suffix reaching the window length (or a whole shorter item) marks its words as hit.
A benchmark of one block takes one Arrow pass over the documents: no shuffle, no join, no grouping.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import checkpointed, map_text, worker_cache

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised automaton of word sequences, annotated with the windows that end in each state."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.trans: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, seq in seqs:
            last = 0
            for t in seq:
                last = self._extend(last, t)
        n = len(self.trans)
        self.window_items: list[set[int] | None] = [None] * n
        self.short_items: list[dict[int, set[int]] | None] = [None] * n
        for item, seq in seqs:
            size = min(window, len(seq))
            v = length = 0
            for t in seq:
                v, length = self.step(v, length, t)
                if length >= window:
                    u = v
                    while self.length[self.link[u]] >= window:
                        u = self.link[u]
                    self.window_items[u] = self.window_items[u] or set()
                    self.window_items[u].add(item)
            if size < window:
                self.short_items[v] = self.short_items[v] or {}
                self.short_items[v].setdefault(size, set()).add(item)
        # What ends in a state: the state standing for its window-length suffix, and the short items along its suffixes.
        self.ends_window = [-1] * n
        self.ends_short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * n
        self.least = [1 << 60] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.ends_window[v] = v if self.length[up] < window else self.ends_window[up]
            own = tuple((m, frozenset(s)) for m, s in sorted((self.short_items[v] or {}).items()))
            self.ends_short[v] = self.ends_short[up] + own
            self.least[v] = min([m for m, _ in self.ends_short[v]] + [window] * (self.ends_window[v] >= 0), default=1 << 60)
        self.min_run = min((min(window, len(s)) for _, s in seqs), default=1 << 60)

    def _extend(self, last: int, t: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        if t in trans[last]:
            q = trans[last][t]
            return q if length[q] == length[last] + 1 else self._clone(last, q, t)
        cur = len(trans)
        trans.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p != -1 and t not in trans[p]:
            trans[p][t] = cur
            p = link[p]
        if p != -1:
            q = trans[p][t]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, t)
        return cur

    def _clone(self, p: int, q: int, t: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        c = len(trans)
        trans.append(dict(trans[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = c
        while p != -1 and trans[p].get(t) == q:
            trans[p][t] = c
            p = link[p]
        return c

    def step(self, v: int, length: int, t: int) -> tuple[int, int]:
        nxt = self.trans[v].get(t)
        while nxt is None and v:
            v = self.link[v]
            length = self.length[v]
            nxt = self.trans[v].get(t)
        return (nxt, length + 1) if nxt is not None else (0, 0)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word spans (end exclusive, by end), items found, longest match. Runs of unknown words are skipped."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        longest = 0
        if len(words) < self.min_run:
            return spans, items, longest
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(np.concatenate(([-1], ids, [-1])) < 0)
        long = np.flatnonzero(np.diff(gaps) > self.min_run)
        trans, link, lens, least = self.trans, self.link, self.length, self.least
        states: set[int] = set()
        for g in long.tolist():
            start, v, n = int(gaps[g]), 0, 0
            for pos, t in enumerate(ids[start : int(gaps[g + 1]) - 1].tolist(), start):
                nxt = trans[v].get(t)
                while nxt is None and v:
                    v = link[v]
                    n = lens[v]
                    nxt = trans[v].get(t)
                if nxt is None:
                    v = n = 0
                    continue
                v = nxt
                n += 1
                if n < least[v]:
                    continue
                longest = max(longest, n)
                if n >= self.window and self.ends_window[v] >= 0:
                    spans.append((pos - self.window + 1, pos + 1))
                    states.add(self.ends_window[v])
                for m, found in self.ends_short[v]:
                    if m <= n:
                        spans.append((pos - m + 1, pos + 1))
                        items |= found
        for u in states:
            items |= self.window_items[u]
        return spans, items, longest


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; the rest is untouched."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, text[done:]])


def item_blocks(benchmark: DataFrame, item_id: str, text_col: str, max_block_words: int) -> tuple[DataFrame, int]:
    """The items ``(i, t, block)`` and the number of blocks, dealt by a hash so that a block has about ``max_block_words``
    words. Words are counted on Spark. Null ids or texts have no items."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    counted = map_text(items, "t", [], [T.StructField("n", T.LongType())], lambda texts: {"n": [len(normal_words(t)) for t in texts]})
    blocks = max(1, -(-(counted.agg(F.sum("n")).first()[0] or 0) // max_block_words))
    return items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), blocks


def block_words(items: DataFrame, block: int) -> list[tuple[int, list[bytes]]]:
    rows = items.where(F.col("block") == block).select("i", F.col("t").cast("binary").alias("t")).collect()
    found = [(r["i"], normal_words(bytes(r["t"]))) for r in sorted(rows, key=lambda r: (r["i"], bytes(r["t"])))]
    return [(i, words) for i, words in found if words]


def _scanned(docs: DataFrame, text_col: str, carry: list[str], items: list[tuple[int, list[bytes]]], window: int, fields: list[T.StructField], result) -> DataFrame:
    """One pass over the documents with the automaton of one block; ``result(text, words, spans, items, longest)`` gives a
    row of ``fields``."""
    key = "automaton " + hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def run(texts):
        automaton = worker_cache(key, lambda: SuffixAutomaton(items, window)) if items else None
        rows = []
        for text in texts:
            words = normal_words(text)
            spans, found, longest = automaton.scan(words) if automaton else ([], set(), 0)
            rows.append(result(text, words, spans, found, longest))
        return {f.name: [r[k] for r in rows] for k, f in enumerate(fields)}

    return map_text(docs, text_col, carry, fields, run)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_coverage: float = 0.05,
    carry: list[str] | None = None,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    with_text: bool = False,
    max_block_words: int = 2_000_000,
) -> DataFrame:
    """Per document: n_words, n_hit, item_ids, longest_match, contaminated and, if asked, clean_text.

    A window is ``window`` consecutive item words, or a whole shorter item. ``contaminated`` says that hit words are at
    least ``min_coverage`` of all words. ``clean_text`` is the text without its hit spans (null for a null text). A null
    or empty text has no words; repeated rows are judged alike; an empty benchmark hits nothing. Columns named in
    ``carry`` pass through, and an output column replaces one of its name. A benchmark over ``max_block_words`` words is
    taken in several blocks, one pass over the documents for each, so that neither the driver nor a task ever holds more
    than about one block; the passes' spans meet by a row number.
    """
    items, blocks = item_blocks(benchmark, item_id, item_text, max_block_words)
    share = round(min_coverage * 10_000)
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("longest_match", T.LongType()),
        T.StructField("contaminated", T.BooleanType()),
    ] + [T.StructField("clean_text", T.StringType())] * with_text

    def result(text, words, spans, found, longest):
        spans = merge_spans(spans)
        hit = sum(b - a for a, b in spans)
        row = (len(words), hit, sorted(found), longest, hit > 0 and 10_000 * hit >= share * len(words))
        return (*row, None if text is None else (cut_words(text, spans) if spans else text).decode("utf-8", "replace"))

    carry = carry if carry is not None else docs.columns
    if blocks == 1:
        return _scanned(docs, text_col, carry, block_words(items, 0), window, fields, result)

    items = checkpointed(items)
    rows = checkpointed(docs.select(*dict.fromkeys([*carry, text_col])).withColumn("__row", F.monotonically_increasing_id()))
    spans = T.ArrayType(T.ArrayType(T.LongType()))
    found = [T.StructField("__spans", spans), T.StructField("__items", T.ArrayType(T.LongType())), T.StructField("__longest", T.LongType())]
    passes = []
    for k in range(blocks):
        made = _scanned(rows, text_col, ["__row"], block_words(items, k), window, found, lambda _, __, s, i, n: ([list(x) for x in s], sorted(i), n))
        passes.append(checkpointed(made.where("__longest > 0")))
    both = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = reduce(DataFrame.unionByName, passes).groupBy("__row").agg(both("__spans"), both("__items"), F.max("__longest").alias("__longest"))
    met = rows.join(whole, "__row", "left")
    hits = F.struct("__spans", "__items", "__longest")

    def settle(batch):
        texts, given = batch
        made = [result(t, normal_words(t), [tuple(s) for s in g["__spans"] or []], set(g["__items"] or []), g["__longest"] or 0) for t, g in zip(texts, given, strict=True)]
        return {f.name: [r[k] for r in made] for k, f in enumerate(fields)}

    return map_text(met.withColumn("__hits", hits), text_col, carry, fields, settle, beside="__hits")

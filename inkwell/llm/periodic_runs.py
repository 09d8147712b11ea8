"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two the factors of that many words get names; a name of 2^(k+1) words is the pair of the names of its two
halves. Occurrences of one factor inside a window of twice its length form an arithmetic progression whose difference is a
period there. So on level k the distances to the next occurrence of the same name, where they are at most 2^k (and over
2^(k-1), as lower levels have proposed the shorter ones), propose periods, and neighbouring places with one distance form
one run. A run of at least three periods q has such a place on the level with 2^(k-1) < q <= 2^k, and there the distance is
exactly q, its smallest period: a shorter one would make the repeated part a power.

Places whose name occurs once in their text cannot repeat on any higher level and are left out from there on, which is exact
and leaves little of ordinary prose after three levels. Many texts are named in one pass, each word together with its text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import map_text

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("__collapsed", T.BinaryType())]


def find_runs(words: np.ndarray, sizes: Sequence[int], min_words: int = 24, min_exponent: int = 3) -> np.ndarray:
    """Rows (text, start, length, period) of all maximal runs, by text, start and period.

    ``words`` holds the word numbers of all texts one after another, ``sizes`` how many each has.
    """
    if min_exponent < 3:
        raise ValueError("the levels find every run of three periods or more only")
    sizes = np.asarray(sizes, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    name, n = np.full(len(words), -1, np.int64), len(words)
    places, keys = np.arange(n), words.astype(np.int64) * max(len(sizes), 1) + text  # a word of another text is another word
    found, width = [], 1
    while len(places):
        order = np.argsort(keys, kind="stable")  # by name, then place
        keys, places = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        gap = places[1:] - places[:-1]
        hit = same & (gap <= width) & (2 * gap > width)
        if hit.any():
            found.append(_progressions(places[:-1][hit], gap[hit], width))
        again = np.zeros(len(places), bool)
        again[1:] |= same
        again[:-1] |= same
        rank = np.cumsum(np.concatenate(([0], ~same)))
        places, rank = places[again], rank[again]
        name[places] = rank
        here = places[places + width < n]
        here = here[(name[here + width] >= 0) & (text[here] == text[here + width])]
        keys = name[here] << 32 | name[here + width]
        name[places] = -1
        here_order = np.argsort(here)
        places, keys, width = here[here_order], keys[here_order], 2 * width
    if not found:
        return np.zeros((0, 4), np.int64)
    start, stop, period = np.concatenate(found, axis=1)
    start, stop = _extended(words, text, start, stop, period)
    of = text[start]
    rows = np.unique(np.stack([of, start - first[of], stop - start, period], axis=1), axis=0)
    length, period = rows[:, 2], rows[:, 3]
    rows = rows[(length >= min_words) & (length >= min_exponent * period)]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _progressions(place: np.ndarray, gap: np.ndarray, width: int) -> np.ndarray:
    """Stretches of neighbouring places with one distance: rows of starts, ends and periods."""
    order = np.lexsort((place, gap))
    place, gap = place[order], gap[order]
    new = np.concatenate(([True], (gap[1:] != gap[:-1]) | (place[1:] != place[:-1] + 1)))
    last = np.concatenate((new[1:], [True]))
    return np.stack([place[new], place[last] + gap[last] + width, gap[new]])


def _extended(words: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grow each stretch word by word while its period goes on inside its text."""
    start, stop, n = start.copy(), stop.copy(), len(words)
    for end, step in ((start, -1), (stop, 1)):
        grow = np.arange(len(end))
        while len(grow):
            at = end[grow] - (step < 0)
            back = at - step * period[grow]
            ok = (at >= 0) & (at < n)
            at, back = np.clip(at, 0, n - 1), np.clip(back, 0, n - 1)
            ok &= (text[at] == text[back]) & (words[at] == words[back])
            grow = grow[ok]
            end[grow] += step
    return start, stop


def _passes(counts: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for k, c in enumerate(counts):
        if held and held + c > most:
            yield begin, k
            begin, held = k, 0
        held += c
    if begin < len(counts):
        yield begin, len(counts)


def detect_runs(df: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), min_words: int = 24, min_exponent: int = 3, pass_words: int = 1 << 18) -> DataFrame:
    """``carry`` columns, ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``, the
    text of the words that no run repeats (a run keeps its first period), joined by one space; no shuffle.

    Words are maximal stretches without space, tab, line feed, vertical tab, form feed and carriage return. A null, empty or
    blank text has no words, no runs and an empty ``collapsed``. Rows are judged each by itself, so repeated rows give
    repeated results. A run is maximal, its period is its smallest and it has at least ``min_words`` words and
    ``min_exponent`` periods (three or more). A carried column named like a result is replaced. A task holds one Arrow
    batch and about 100 bytes a word of ``pass_words`` words, or of one longer text.
    """

    def run(texts: list[bytes | None]) -> dict[str, object]:
        split = [(t or b"").split() for t in texts]
        counts = [len(w) for w in split]
        runs: list[list[dict]] = [[] for _ in texts]
        joined = [b" ".join(w) for w in split]
        for a, b in _passes(counts, pass_words):
            known: dict[bytes, int] = {}
            ids = np.fromiter((known.setdefault(w, len(known)) for words in split[a:b] for w in words), np.int64, sum(counts[a:b]))
            rows = find_runs(ids, counts[a:b], min_words, min_exponent)
            for k in np.unique(rows[:, 0]).tolist():
                own = rows[rows[:, 0] == k, 1:].tolist()
                drop = np.zeros(counts[a + k], bool)
                for start, length, period in own:
                    drop[start + period : start + length] = True
                runs[a + k] = [dict(zip(RUN.names, r, strict=True)) for r in own]
                words = split[a + k]
                joined[a + k] = b" ".join(words[i] for i in np.flatnonzero(~drop).tolist())
        return {"n_words": counts, "runs": runs, "__collapsed": joined}

    made = map_text(df.withColumn("__text", F.col(f"`{text_col}`")), "__text", [c for c in carry if c != "collapsed"], FIELDS, run)
    return made.withColumn("collapsed", F.col("__collapsed").cast("string")).drop("__collapsed")


def best_run(runs):
    """The run of greatest length / period, compared exactly; of equal ones the first of the list. Null for an empty list."""
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, x: F.when(better(a, x), x).otherwise(a))

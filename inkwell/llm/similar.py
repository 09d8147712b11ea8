"""What the similarity operators share: shingle sets, posting groups by leader, and exact linking inside a group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from inkwell.llm.common import checkpointed

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_x64 = xxhash.xxh3_64_intdigest
SHINGLE = 5
SALTS = 64  # keys over which a large group is dealt to meet its count


def rolled(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """63-bit hashes of all windows of ``size`` word hashes, in order."""
    s = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        s = (s ^ h[i : i + len(s)]) * _MIX[0]
        s ^= s >> np.uint64(29)
    s *= _MIX[1]
    return (s ^ (s >> np.uint64(32))) >> np.uint64(1)


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; fewer words than ``size`` are one shingle, none are none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    s = rolled(np.array(list(map(_x64, words)), np.uint64), min(size, n))
    s.sort()
    s = s.view(np.int64)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(s: np.ndarray) -> int:
    return _x64(s.tobytes()) >> 1


def linked(a: int, b: int, both: int | np.ndarray, percent: int):
    """Jaccard of sets of a and b elements sharing ``both`` is at least ``percent`` hundredths, in integers."""
    return 100 * both >= percent * (a + b - both)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that hold the stretches of ``values`` between the cuts."""
    offsets = np.append(cuts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind) if len(col) else np.zeros(0, kind), np.diff(at) // size


def flood(sets: list[np.ndarray], percent: int, size: np.ndarray | None = None, fits=None, index_from: int = 48) -> np.ndarray:
    """Component root (the smallest index) of every set, by exact links.

    Linking spreads from a set to those not reached yet, so members of a tight group are not compared with each other.
    Larger groups count overlaps through an index over their elements. Where ``sets`` are parts of sets, ``size`` gives
    the whole sizes and ``fits(i, rest, both)`` says which of ``rest`` set i links with, given the elements they share;
    elements repeated in a part may count more than once.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64) if size is None else size
    fits = fits or (lambda i, rest, both: linked(size[i], size[rest], both, percent))
    root = np.full(m, -1)
    if m > index_from:
        tok, doc = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
        order = np.argsort(tok, kind="stable")
        doc = doc[order]
        ids = np.empty(len(tok), np.int64)
        sorted_tok = tok[order]
        new = np.concatenate(([True], sorted_tok[1:] != sorted_tok[:-1])) if len(tok) else np.zeros(0, bool)
        ids[order] = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(tok))
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for r in range(m):
        if root[r] >= 0:
            continue
        root[r] = r
        todo = [r]
        while todo:
            i = todo.pop()
            rest = np.flatnonzero(root < 0)
            if not len(rest):
                return root
            rest = rest[(100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])) & (size[rest] > 0)]
            if not len(rest) or not size[i]:
                continue
            if m > index_from:
                own = ids[at[i] : at[i + 1]]
                lens = first[own + 1] - first[own]
                where = np.repeat(first[own] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
                both = np.bincount(doc[where], minlength=m)[rest]
            else:
                both = np.array([shared(sets[i], sets[j]) for j in rest])
            found = rest[fits(i, rest, both)]
            root[found] = r
            todo.extend(found.tolist())
    return root


def leader_groups(postings: DataFrame) -> DataFrame:
    """``(leader, member)`` of postings ``(token, member)``: every token's members meet under the token's smallest member.

    Any two members of one token share a group, and a group of near copies, whose tokens mostly have the same smallest
    member, becomes one group of its members rather than one for each token. Tokens of a single member are left out.
    """
    token = W.partitionBy("token")
    led = postings.withColumn("leader", F.min("member").over(token)).withColumn("last", F.max("member").over(token))
    return uncovered(checkpointed(led.where("leader <> last").select("leader", "member").distinct()))


def uncovered(groups: DataFrame) -> DataFrame:
    """The checkpointed ``groups(leader, member, ...)`` without those all of whose members also meet in the group that their
    leader belongs to under a smaller leader."""
    above = groups.groupBy("member").agg(F.min("leader").alias("above")).where("above < member").withColumnRenamed("member", "leader")
    there = groups.select(F.col("leader").alias("above"), "member", F.lit(1).alias("hit"))
    met = groups.select("leader", "member").join(above, "leader").join(there, ["above", "member"], "left")
    covered = met.groupBy("leader").agg(F.count("*").alias("n"), F.count("hit").alias("k")).where("n = k").select("leader")
    return groups.join(covered, "leader", "left_anti")


def blocked(groups: DataFrame, block: int = 512) -> DataFrame:
    """Split groups of over ``block`` members into pairs of blocks: ``(leader, i, j, member)``, where every two members of
    a group meet in one of its block pairs. No task holds more than about two blocks of a group: counts are combined before
    they move, and members meet the count of a large group under a salted key."""
    large = groups.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    h = F.xxhash64("member")
    g = groups.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(large, ["leader", "salt"], "left")
    g = g.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(h, F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("b")) | (F.col("blocks") == 1))
    g = g.withColumn("o", F.explode(others))
    return g.select("leader", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "member")


def size_class(n: Column, percent: int) -> Column:
    """Sizes within the ratio lie in the same or in neighbouring classes."""
    return F.floor(F.log(n) / F.lit(math.log(100 / (percent - 0.1))))


def compatible(groups: DataFrame, percent: int) -> DataFrame:
    """Of ``groups(leader, member, n)`` the members that another member of their group may fit in size. Members are counted
    per leader and size class with map-side combining, so a group of any size is spread over its members."""
    g = groups.where("n > 0").withColumn("slot", size_class(F.col("n"), percent))
    g = g.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1)))
    several = g.groupBy("leader", "slot").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return g.join(several, ["leader", "slot"]).select("leader", "member").distinct()


def link_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning edges ``(a, b)`` of the exact links inside every block pair of ``rows(leader, i, j, node, tokens)``."""

    def run(t: pa.Table) -> pa.Table:
        node, sets = members(t, np.int64)
        root = flood(sets, percent)
        keep = root != np.arange(len(root))
        return pa.table({"a": pa.array(node[root[keep]], pa.int64()), "b": pa.array(node[keep], pa.int64())})

    return rows.groupBy("leader", "i", "j").applyInArrow(run, "a long, b long")


def members(t: pa.Table, kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nodes of a block pair, smallest first, and their packed tokens."""
    node = t.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    held = t.column("tokens").to_pylist()
    return node[order], [np.frombuffer(held[k], kind) for k in order]


def attach(src: DataFrame, wanted: DataFrame, key: str, max_words: int = 1 << 20) -> DataFrame:
    """``src`` joined with the checkpointed ``wanted`` on a long key, moving little of ``src`` but the rows wanted.

    The wanted keys set bits in at most ``max_words`` words of 64, which are broadcast (16 MB at most, whatever the size of
    ``wanted``); rows whose bit is not set stay where they are, all others meet their key in a shuffle join. With more
    keys than bits, more rows move and none is lost.
    """
    words = min(max_words, max(1 << 10, 1 << wanted.count().bit_length()))
    h = F.xxhash64(F.col(key))
    word, bit = F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    ones = wanted.where(F.col(key).isNotNull()).select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__one"))
    bits = ones.groupBy("__word").agg(F.bit_or("__one").alias("__bits"))
    held = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1)) == 1
    near = src.withColumn("__word", word).join(F.broadcast(bits), "__word").where(held).select(*src.columns)
    return near.join(wanted, key)

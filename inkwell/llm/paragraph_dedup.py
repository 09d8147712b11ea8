"""Substring deduplication of paragraphs by MinHash banding with exact verification.

Paragraphs (lines of enough words) are hashed to a MinHash signature whose bands are tuned so that a pair at the
similarity limit collides with the wanted recall. Colliding paragraphs meet under the smallest member of a band,
their exact shingle Jaccard (or word edit distance) is verified, and connected components are the repeat classes:
the first occurrence stays, the others are removals. Exact copies post once per task and link without verification.

Passages are found wherever they stand, inside longer lines or across short ones: every run of ``RUN`` words that another
document has word for word (case and white space aside). A run's least inner window is its fingerprint; runs whose
fingerprint is in one document only are not looked at again, all others are compared by the hash of the whole run.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from inkwell.llm.common import checkpointed, components
from inkwell.llm.similar import SHINGLE, attach, blocked, compatible, leader_groups, link_groups, packed, rolled, unpacked


def tune_bands(percent: int, recall: float, max_rows: int = 6) -> tuple[int, int]:
    """(bands, rows) with the longest bands, then fewest of them, that give ``recall`` at the limit within 64 hashes."""
    t = percent / 100
    for rows in range(max_rows, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - t**rows)))
        if bands * rows <= 64:
            return bands, rows
    raise ValueError("no banding gives that recall")


_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(s: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """63-bit band keys, one row for each set; the sets' shingle hashes stand one after the other from the places ``first``.
    The hashes are random already, so each odd factor puts them in another order."""
    s, keys = s.view(np.uint64), []
    for b in range(bands):
        key = np.full(len(first), np.uint64(b + 1) * _A[1])
        for r in range(rows):
            key = (key ^ np.minimum.reduceat(s * _A[b * rows + r], first)) * _A[2]
            key ^= key >> np.uint64(29)
        keys.append((key >> np.uint64(1)).view(np.int64))
    return np.stack(keys, 1)


def _by(own: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by ``own`` (small numbers), then ``value``."""
    order = np.argsort(value)
    own = own[order]
    return order[np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")]


class Paragraphs:
    """The paragraphs of some texts: for each its text's number, line number, start and end (bytes), words, signature and
    sorted distinct shingles. All texts are worked on together."""

    def __init__(self, texts: list[bytes | None], min_words: int):
        if min_words < SHINGLE:
            raise ValueError("paragraphs need at least as many words as a shingle")
        at, words = [], []
        for d, text in enumerate(texts):
            for k, start, end, w in paragraphs(text, min_words):
                at.append((d, k, start, end, len(w)))
                words += w
        self.text, self.line, self.start, self.end, self.n_words = np.array(at, np.int64).reshape(-1, 5).T
        count = self.n_words - SHINGLE + 1
        s = np.zeros(0, np.uint64)
        if at:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            own = np.repeat(np.arange(len(at)), count)
            s = rolled(h)[np.arange(len(own)) + (SHINGLE - 1) * own]
            order = _by(own, s)
            s, own = s[order], own[order]
            fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (own[1:] != own[:-1])))
            s, own = s[fresh], own[fresh]
            count = np.bincount(own, minlength=len(at))
        self.shingles, self.size = s.view(np.int64), count
        self.first = np.cumsum(count) - count
        mixed = (s ^ (s >> np.uint64(31))) * _A[3]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * _A[4]
        total = np.add.reduceat(mixed, self.first) if at else mixed
        total = (total ^ count.astype(np.uint64)) * _A[5]
        self.sig = ((total ^ (total >> np.uint64(32))) >> np.uint64(1)).view(np.int64)

    def of(self, k: int) -> np.ndarray:
        return self.shingles[self.first[k] : self.first[k] + self.size[k]]


def paragraphs(text: bytes | None, min_words: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(number, start, end, lower-cased words) of the lines with enough words; bytes, end exclusive, whole text."""
    at = 0
    for k, line in enumerate((text or b"").split(b"\n")):
        if len(line) >= 2 * min_words - 1:
            words = line.lower().split()
            if len(words) >= min_words:
                yield k, at, at + len(line), words
        at += len(line) + 1


def _parts(batches: Iterator[pa.RecordBatch], column: str, rows: int = 500) -> Iterator[tuple]:
    """Some rows at a time: a column (numbers as an array) and the texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            x = part.column(column)
            yield x.to_numpy() if pa.types.is_integer(x.type) else x.to_pylist(), part.column("text").to_pylist()


RUN, INNER = 50, 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """63-bit hashes of all windows of ``size`` word hashes, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power = np.full(len(h), _ODD)
    power[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(power))))
    back = np.full(n, _INVERSE)
    back[0] = 1
    w = (sums[size:] - sums[:n]) * np.cumprod(back)
    w ^= w >> np.uint64(31)
    w *= _A[0]
    return ((w ^ (w >> np.uint64(32))) >> np.uint64(1)).view(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    """The fingerprint of every run of ``RUN`` words: the least hash of its windows of ``INNER`` words."""
    low, span = windows(h, INNER), RUN - INNER + 1
    if len(h) < RUN:
        return low[:0]
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :])


def word_hashes(text: bytes | None) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, (text or b"").lower().split())), np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line) of the words: code points, end exclusive, and line numbers from 0."""
    b = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    point = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    line = np.concatenate(([0], np.cumsum(b == 10)))
    return point[start], point[end], line[start]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_places: int = 5000) -> DataFrame:
    """One row per stretch of text whose every run of ``RUN`` words other rows have too; columns as in repeated_paragraphs.

    A run's class is the rows of the table that have it; a stretch is cut where its runs first occur in another
    document or elsewhere in it. ``paragraph`` is the line in which it begins, ``class_doc`` and ``class_paragraph`` say
    where it begins in its first occurrence, ``class_size`` is that of its most frequent run. Null ids and texts of fewer
    words give no rows; a run that only its own document repeats is none. Runs meet by fingerprint in buckets; those of
    fingerprints in over ``max_places`` rows are added up run by run instead, with the same result.
    """
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def post(batches):
        for ids, texts in _parts(batches, "id"):
            words = [t.lower().split() if t is not None and len(t) >= 2 * RUN - 1 else [] for t in texts]
            length = np.array([len(w) for w in words])
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, length.sum())
            low, own = fingerprints(h), np.repeat(np.arange(len(words)), length)
            whole = own[: len(low)] == own[RUN - 1 :] if len(low) else np.zeros(0, bool)  # runs inside one text
            low, own = low[whole], own[: len(whole)][whole]
            fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]))) if len(low) else whole
            low, own = low[fresh], own[fresh]
            order = _by(own, low)
            low, own = low[order], own[order]
            fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (own[1:] != own[:-1]))) if len(low) else whole
            low, n = low[fresh], np.bincount(own[fresh], minlength=len(words))
            ends = np.concatenate(([0], np.cumsum(n[n > 0]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.ListArray.from_arrays(pa.array(ends), pa.array(low))], names=["id", "lows"])

    posted = checkpointed(src.mapInArrow(post, "id long, lows array<long>")).select("id", F.explode("lows").alias("low"))
    several = posted.groupBy("low").agg(F.count("*").alias("n")).where("n > 1")
    often = F.col("n") > max_places
    wanted = posted.join(several, "low").groupBy("id").agg(F.collect_set(F.when(~often, F.col("low"))).alias("want"), F.collect_set(F.when(often, F.col("low"))).alias("hot"))
    wanted = checkpointed(wanted)
    shared, hot = wanted.agg(F.sum(F.size("want")), F.sum(F.size("hot"))).first()
    buckets = max(64, (shared or 0) // 100_000)

    def places(column: str):
        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    want = np.sort(b.column(column)[k].values.to_numpy(zero_copy_only=False))
                    text = b.column("text")[k].as_py()
                    if len(want) and len(h := word_hashes(text)) >= RUN:
                        made = run_blocks(h, want, text, b.column("id")[k].as_py(), buckets)
                        if made is not None:
                            yield made

        return run

    found = attach(src, wanted, "id").select("id", "text", "want", "hot")
    met = found.mapInArrow(places("want"), BLOCKS).groupBy("bucket").applyInArrow(meet_runs, STRETCHES)
    if hot:  # runs of fingerprints that very many rows share meet one by one, added up before they move
        each = checkpointed(found.where(F.size("hot") > 0).mapInArrow(places("hot"), BLOCKS).mapInArrow(single_places, PLACES))
        first = each.groupBy("run").agg(F.sum("fresh").alias("n"), F.min(F.struct("id", "at", "line")).alias("first")).where("n > 1")
        alone = each.join(first, "run").select(
            "id", F.col("first.id").alias("class_doc"), (F.col("at") - F.col("first.at")).alias("shift"), "at", F.col("at").alias("z"), "start", "end", "line", F.col("first.line").alias("origin"), "n"
        )
        met = met.unionByName(alone)
    whole = W.partitionBy("id", "class_doc", "shift").orderBy("at")
    gap = F.coalesce(F.col("at") > F.max("z").over(whole.rowsBetween(W.unboundedPreceding, -1)) + 1, F.lit(False))
    met = met.withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(whole))
    out = met.groupBy("id", "class_doc", "shift", "stretch").agg(F.min(F.struct("at", "line", "start", "origin")).alias("p"), F.max("z").alias("z"), F.max("end").alias("end"), F.max("n").alias("class_size"))
    return out.select(
        F.col("id").alias(id_col), F.col("p.line").alias("paragraph"), F.col("p.start").alias("start"), "end",
        (F.col("z") - F.col("p.at") + RUN).alias("n_words"), "class_doc", F.col("p.origin").alias("class_paragraph"), "class_size", ((F.col("id") != F.col("class_doc")) | (F.col("shift") != 0)).alias("removed"),
    )


#: A stretch of places with one fingerprint: the hash of each place's run (and a last bit: the text's first place of that
#: run), and the start, end and line of each. What a bucket finds: stretches of places that share runs with one document.
BLOCKS = "bucket int, id long, at long, runs binary, spans binary"
STRETCHES = "id long, class_doc long, shift long, at long, z long, start long, end long, line long, origin long, n long"
PLACES = "run long, fresh long, id long, at long, start long, end long, line long"


def run_blocks(h: np.ndarray, want: np.ndarray, text: bytes, id: int, buckets: int) -> pa.RecordBatch | None:
    """The ``BLOCKS`` of a text at the wanted fingerprints."""
    low = fingerprints(h)
    at = np.searchsorted(want, low)
    at[at == len(want)] = 0
    at = np.flatnonzero(want[at] == low)
    if not len(at):
        return None
    run, low = windows(h, RUN)[at], low[at]
    fresh = np.zeros(len(at), np.int64)
    fresh[np.unique(run, return_index=True)[1]] = 1  # a text counts once
    start, end, line = word_places(text)
    cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]))))
    spans = planes(np.stack([start[at], end[at + RUN - 1], line[at]]), cuts)
    bucket = (low[cuts].view(np.uint64) * _A[2] >> np.uint64(33)).astype(np.int64) % buckets
    cols = pa.array(bucket, pa.int32()), pa.array(np.full(len(cuts), id)), pa.array(at[cuts]), packed(run << 1 | fresh, cuts), packed(spans, cuts * 12)
    return pa.RecordBatch.from_arrays(list(cols), names=["bucket", "id", "at", "runs", "spans"])


def planes(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bytes of three rising 32-bit numbers for each place, as differences within its block and by order of the byte, so that
    the many zeros stand together."""
    step = np.diff(rows, axis=1, prepend=0)
    step[:, cuts] = rows[:, cuts]
    return np.concatenate([x.astype("<u4").view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1).ravel() for x in np.split(step, cuts[1:], axis=1)])


def unplanes(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.arange(lens.sum()) - np.repeat(begin, lens)
    base, width = np.repeat(begin * 12, lens) + place, np.repeat(lens, lens)
    out = []
    for row in range(3):
        step = sum(data[base + (row * 4 + k) * width].astype(np.int64) << (8 * k) for k in range(4))
        total = np.cumsum(step)
        out.append(total - np.repeat(total[begin] - step[begin], lens) if len(begin) else total)
    return tuple(out)


def _unpack(t) -> dict[str, np.ndarray]:
    one = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
    runs, lens = unpacked(one("runs"), np.int64)
    begin = np.cumsum(lens) - lens
    start, end, line = unplanes(unpacked(one("spans"), np.uint8)[0], begin, lens)
    at = np.repeat(t.column("at").to_numpy() - begin, lens) + np.arange(len(runs))
    return {"run": (runs.view(np.uint64) >> np.uint64(1)).view(np.int64), "fresh": runs & 1, "id": np.repeat(t.column("id").to_numpy(), lens), "at": at, "start": start, "end": end, "line": line}


def single_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _unpack(b)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in x.values()], names=list(x))


def meet_runs(t: pa.Table) -> pa.Table:
    """Of a bucket's blocks, the ``STRETCHES`` of places whose runs several texts have."""
    x = _unpack(t)
    order = np.lexsort((x["line"], x["at"], x["id"], x["run"]))
    x = {k: v[order] for k, v in x.items()}
    new = np.concatenate(([True], x["run"][1:] != x["run"][:-1])) if len(order) else np.zeros(0, bool)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.add.reduceat(x["fresh"], first)[group] if len(first) else group
    first = first[group] if len(first) else group
    x |= {"n": n, "class_doc": x["id"][first], "shift": x["at"] - x["at"][first], "origin": x["line"][first]}
    x = {k: v[n > 1] for k, v in x.items()}
    order = np.lexsort((x["at"], x["shift"], x["class_doc"], x["id"]))
    x = {k: v[order] for k, v in x.items()}
    part = np.zeros(len(order), bool)
    part[:1] = True
    for k in ("id", "class_doc", "shift"):
        part[1:] |= x[k][1:] != x[k][:-1]
    part[1:] |= x["at"][1:] > x["at"][:-1] + 1
    begin = np.flatnonzero(part)
    last = np.append(begin[1:], len(order)) - 1 if len(begin) else begin
    most = lambda v: np.maximum.reduceat(v, begin) if len(begin) else v
    cols = [x["id"][begin], x["class_doc"][begin], x["shift"][begin], x["at"][begin], x["at"][last], x["start"][begin], most(x["end"]), x["line"][begin], x["origin"][begin], most(x["n"])]
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in STRETCHES.split(", ")])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Repeated paragraphs (``limits`` as there) and repeated passages; the rows of both may overlap."""
    return repeated_paragraphs(docs, id_col, text_col, **limits).unionByName(repeated_passages(docs, id_col, text_col))


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    min_words: int = 20,
    recall: float = 0.995,
    max_edit_percent: int | None = None,
) -> DataFrame:
    """One row per occurrence of a repeated paragraph, its class and whether it is removed.

    Columns: id, ``paragraph`` (line number from 0), ``start`` and ``end`` (code points in the whole text), ``n_words``,
    ``class_doc`` and ``class_paragraph`` (the class's first occurrence), ``class_size`` (occurrences) and ``removed``
    (false for the first one). With ``max_edit_percent``, paragraphs also link when their word edit distance is at most
    that share of the longer. Null, empty and shorter texts give no rows, nor do null ids and paragraphs without a
    partner; a paragraph that its own document repeats is a repeat. Other input columns are ignored.
    """
    bands, per = tune_bands(percent, recall)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    names = ["id", "paragraph", "start", "end", "n_words", "sig", "size"]

    def occurrences(batches):
        for ids, texts in _parts(batches, "id"):
            p = Paragraphs(texts, min_words)
            points = np.zeros((2, len(p.text)), np.int64)  # code points
            done = point = last = -1
            for j, (d, start, end) in enumerate(zip(p.text.tolist(), p.start.tolist(), p.end.tolist(), strict=True)):
                if d != last:
                    done, point, last = 0, 0, d
                points[0, j] = point = point + len(texts[d][done:start].decode("utf-8", "replace"))
                points[1, j] = point = point + len(texts[d][start:end].decode("utf-8", "replace"))
                done = end
            cols = ids[p.text], p.line, points[0], points[1], p.n_words, p.sig, p.size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    seen = checkpointed(src.mapInArrow(occurrences, ", ".join(f"`{n}` long" for n in names)))
    place = F.struct("id", "paragraph")
    classes = seen.groupBy("sig").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("size").alias("size"))

    def post(batches):
        done: set[int] = set()
        for _, texts in _parts(batches, "id"):
            p = Paragraphs(texts, min_words)
            sig, at = np.unique(p.sig, return_index=True)
            at = at[[x not in done for x in sig.tolist()]] if done else at
            if len(done) >= 1_000_000:
                done.clear()
            done.update(sig.tolist())
            if len(at):
                s = np.concatenate([p.of(k) for k in at])
                tok = band_keys(s, np.cumsum(p.size[at]) - p.size[at], bands, per)
                yield pa.RecordBatch.from_arrays([pa.array(tok.ravel()), pa.array(np.repeat(p.sig[at], bands))], names=["token", "member"])

    token = W.partitionBy("token")
    posted = src.mapInArrow(post, "token long, member long")
    posted = posted.withColumn("lo", F.min("member").over(token)).withColumn("hi", F.max("member").over(token)).where("lo <> hi")
    groups = leader_groups(posted.select("token", "member").distinct())
    if max_edit_percent is None:
        blocks = blocked(compatible(groups.join(classes.select(F.col("sig").alias("member"), F.col("size").alias("n")), "member"), percent))
    else:  # the size ratio of Jaccard says nothing about edits
        blocks = checkpointed(blocked(groups))
    places = blocks.groupBy(F.col("member").alias("sig")).agg(F.collect_list(F.struct("leader", "i", "j")).alias("places"))
    held = classes.join(places, "sig").select(F.col("first.id").alias("id"), F.struct("sig", "places").alias("w"))
    wanted = checkpointed(held.groupBy("id").agg(F.collect_list("w").alias("want")))
    kind = "array<struct<leader long, i int, j int>>"

    def load(batches):
        for want, texts in _parts(batches, "want"):
            left = [{w["sig"]: w["places"] for w in x} for x in want]
            p = Paragraphs(texts, min_words)
            member, at, tokens = [], [], []
            for k, (d, sig) in enumerate(zip(p.text.tolist(), p.sig.tolist(), strict=True)):
                if (where := left[d].pop(sig, None)) is not None:
                    member.append(sig)
                    at.append(where)
                    tokens.append(p.of(k).tobytes())
            places_type = pa.list_(pa.struct([("leader", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), pa.array(at, places_type), pa.array(tokens, pa.binary())], names=["node", "places", "tokens"])

    sets = attach(src, wanted, "id").select("text", "want").mapInArrow(load, f"node long, places {kind}, tokens binary")
    edges = link_groups(sets.select(F.explode("places").alias("p"), "node", "tokens").select("p.leader", "p.i", "p.j", "node", "tokens"), percent)
    if max_edit_percent is not None:
        edges = edges.unionByName(_edit_edges(src, blocks, wanted.select("id", F.col("want.sig").alias("want")), min_words, max_edit_percent))
    found = components(edges).withColumnRenamed("node", "sig")
    named = classes.join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    whole = named.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("class_size")).where("class_size > 1")
    member = named.select("sig", "component").join(whole, "component")
    out = seen.join(member, "sig")
    return out.select(
        F.col("id").alias(id_col), "paragraph", "start", "end", "n_words", F.col("first.id").alias("class_doc"), F.col("first.paragraph").alias("class_paragraph"), "class_size", (place != F.col("first")).alias("removed")
    )


def _edit_edges(src: DataFrame, blocks: DataFrame, wanted: DataFrame, min_words: int, max_edit_percent: int) -> DataFrame:
    """Links by word edit distance among colliding paragraphs: all pairs of a block."""

    def load(batches):
        for b in batches:
            member, body = [], []
            for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                want = set(want)
                for (_, _, _, words), sig in zip(paragraphs(text, min_words), Paragraphs([text], min_words).sig.tolist(), strict=True):
                    if sig in want:
                        want.discard(sig)
                        member.append(sig)
                        body.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), pa.array(body, pa.binary())], names=["member", "body"])

    bodies = src.join(wanted, "id").select("text", "want").mapInArrow(load, "member long, body binary").dropDuplicates(["member"])
    block = ["leader", "i", "j"]
    pairs = blocks.join(blocks.withColumnRenamed("member", "to"), block).where("member < to").select("member", "to").distinct()
    pairs = pairs.join(bodies, "member").join(bodies.select(F.col("member").alias("to"), F.col("body").alias("other")), "to")

    def near(batches):
        for b in batches:
            keep = [edit_distance(x.split(), y.split(), max_edit_percent) for x, y in zip(b.column("body").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([v.as_py() for v, k in zip(b.column(c), keep, strict=True) if k], pa.int64()) for c in ("to", "member")], names=["a", "b"])

    return pairs.select("to", "member", "body", "other").mapInArrow(near, "a long, b long")


def edit_distance(a: list[bytes], b: list[bytes], percent: int) -> bool:
    """Whether the word edit distance is at most ``percent`` hundredths of the longer, within a band of that width."""
    n, m = len(a), len(b)
    limit = percent * max(n, m) // 100
    if abs(n - m) > limit:
        return False
    row = list(range(m + 1))
    for i in range(1, n + 1):
        lo, hi = max(1, i - limit), min(m, i + limit)
        new = [limit + 1] * (m + 1)
        if i <= limit:
            new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return row[m] <= limit


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their removed paragraphs and passages cut out of the text, whole lines with their break."""
    cuts = repeats.where("removed").groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    t, n = F.col(text_col), F.length(text_col)
    piece = lambda a, b: t.substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def cut(done, c):
        line = ((c["start"] == 0) | (piece(c["start"] - 1, c["start"]) == "\n")) & ((c["end"] >= n) | (piece(c["end"], c["end"] + 1) == "\n"))
        to = F.when(line, c["end"] + 1).otherwise(c["end"])
        return F.struct(F.concat(done["out"], piece(done["at"], c["start"])).alias("out"), F.greatest(done["at"], to).alias("at"))

    def rest(done):  # the last line goes with the break before it
        return F.when(done["at"] > n, F.regexp_replace(done["out"], r"\n\z", "")).otherwise(F.concat(done["out"], piece(done["at"], n)))

    text = F.when(F.col("__cut").isNull(), t).otherwise(F.aggregate("__cut", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), cut, rest))
    return docs.join(cuts, id_col, "left").withColumn(text_col, text).drop("__cut").select(*docs.columns)

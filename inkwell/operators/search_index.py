"""An inverted index of trigrams, so that a search reads the posting lists of its word instead of every text.

    <path>/of-<parts>/part=<p>/    (field, gram, segment, n, ids)    posting lists, by the hash of field and gram
    <path>/of-<parts>/part=-1/     (segment, ids)                    which article stands at which place of a segment

A task turns its articles into segments of bounded size (so many articles or characters) and sends one row a segment and
trigram: the places, as gaps of a byte each. A posting list of a very common trigram is therefore many rows, and the files of a
part are split by segment, too. A search reads the parts of its word's trigrams, intersects the lists segment by segment, rarest
first, and checks the articles that are left by the plain search; so results are those of the plain search exactly.

Titles are compared without case and accents. Their trigrams are taken of a folded form, for characters whose folding is certain
to agree with that comparison; titles with any other character are checked in every search. Changed articles are added as
new segments; old lists of theirs only make candidates that the check refuses.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkwell.operators.catalog import search_articles

CONTENT, TITLE = 0, 1
#: The list of articles whose title has characters without a certain folding.
UNFOLDED = -1
POSTINGS = "part int, field int, gram long, segment long, n int, ids binary"
SEED = 0x9E3779B97F4A7C15


#: White space with a place of its own in the collation.
_PLAIN = frozenset("\t\n\r")


def fold(text: str) -> str | None:
    """``text`` without case and accents, character by character; None if that is not certain to agree with the collation:
    for all but printable ASCII, tabs and line ends, letters that are an ASCII letter with accents (and ß, which is ss), and unified ideographs."""
    out = []
    for c in text:
        if " " <= c <= "~" or "一" <= c <= "鿿" or c in _PLAIN:
            out.append(c.lower())
            continue
        plain = "ss" if c == "ß" else unicodedata.normalize("NFD", c) if "À" <= c <= "ž" else ""
        if not ("a" <= plain[:1].lower() <= "z"):
            return None
        out.append("ss" if c == "ß" else plain[0].lower())
    return "".join(out)


def grams(text: str) -> np.ndarray:
    """The different trigrams of code points, as numbers."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(a[:-2] << 42 | a[1:-1] << 21 | a[2:]) if len(a) >= 3 else np.zeros(0, np.int64)


def part_of(field: int, gram: np.ndarray, parts: int) -> np.ndarray:
    mixed = (gram.astype(np.uint64) * np.uint64(2) + np.uint64(field)) * np.uint64(SEED)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def pack_gaps(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of rising places, ``starts`` where each begins, as bytes: a gap is as many 255 as it has, then its rest. Returns the
    bytes and where each list's bytes begin (and, last, end)."""
    first = np.zeros(len(places), bool)
    first[starts] = True
    gap = np.where(first, places + 1, places - np.roll(places, 1))
    size = gap // 255 + 1
    ends = np.cumsum(size)
    data = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    data[ends - 1] = gap % 255
    return data, np.concatenate((ends[starts] - size[starts], ends[-1:]))


def unpack_gaps(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.cumsum(a, dtype=np.int64)[a != 255] - 1


class _Segment:
    def __init__(self, number: int, parts: int):
        self.number, self.parts, self.ids, self.chars = number, parts, [], 0
        self.found: dict[int, list[tuple[int, np.ndarray]]] = {CONTENT: [], TITLE: []}

    def add(self, key: int, title: str | None, content: str | None) -> None:
        place = len(self.ids)
        self.ids.append(key)
        self.chars += len(content or "") + len(title or "") + 1
        folded = fold(title or "")
        self.found[TITLE].append((place, grams(folded) if folded is not None else np.array([UNFOLDED])))
        self.found[CONTENT].append((place, grams(content or "")))

    def rows(self) -> Iterator[pa.RecordBatch]:
        none = pa.array([None], pa.int32())
        at = lambda v, kind: pa.array([v], kind)
        yield pa.RecordBatch.from_arrays([at(-1, pa.int32()), none, at(None, pa.int64()), at(self.number, pa.int64()), at(len(self.ids), pa.int32()), at(np.array(self.ids, ">i8").tobytes(), pa.binary())], names=_NAMES)
        for field, found in self.found.items():
            gram = np.concatenate([g for _, g in found]) if found else np.zeros(0, np.int64)
            if not len(gram):
                continue
            place = np.repeat(np.array([p for p, _ in found]), [len(g) for _, g in found])
            order = np.argsort(gram, kind="stable")
            gram, place = gram[order], place[order]
            starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            data, cuts = pack_gaps(place, starts)
            lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            n = np.diff(np.concatenate((starts, [len(gram)]))).astype(np.int32)
            k, gram = len(starts), gram[starts]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(field, gram, self.parts)), pa.array(np.full(k, field, np.int32)), pa.array(gram), pa.array(np.full(k, self.number)), pa.array(n), lists], names=_NAMES)


_NAMES = [c.split()[0] for c in POSTINGS.split(", ")]


def add_to_index(articles: DataFrame, path: str, parts: int = 64, spread: int = 4, segment_rows: int = 4096, segment_chars: int = 4 << 20) -> None:
    """Index (id, title, content) of all rows, beside what ``path`` already has with the same ``parts``. Null texts have no
    trigrams. ``spread``: how many tasks write one part. A task holds one segment: its texts' trigrams, about 60 bytes each."""
    generation = F.unix_micros(F.current_timestamp())
    src = articles.select(F.col("id").cast("long").alias("id"), F.col("title").cast("string").alias("title"), F.col("content").cast("string").alias("content"))
    base = articles.sparkSession.range(1).select(generation).first()[0] << 11  # segments of a later call have other numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = base + (TaskContext.get().partitionId() << 32)
        held = _Segment(number, parts)
        for b in batches:
            for key, title, content in zip(*(b.column(c).to_pylist() for c in ("id", "title", "content")), strict=True):
                held.add(key, title, content)
                if len(held.ids) >= segment_rows or held.chars >= segment_chars:
                    yield from held.rows()
                    number += 1
                    held = _Segment(number, parts)
        if held.ids:
            yield from held.rows()

    rows = src.where("id is not null").mapInArrow(run, POSTINGS)
    dealt = rows.repartition(parts, F.col("part"), F.pmod("segment", F.lit(spread).cast("long"))).sortWithinPartitions("part", "field", "gram", "segment")
    dealt.write.mode("append").partitionBy("part").parquet(f"{path}/of-{parts}")


def _candidates(lists: DataFrame) -> DataFrame:
    """(segment, place) that are in all ``wanted`` lists of a kind. A group holds one segment's lists of one word."""

    def meet(table: pa.Table) -> pa.Table:
        segment, n, ids = (table.column(c).to_pylist() for c in ("segment", "n", "ids"))
        left = np.zeros(0, np.int64)
        if len(ids) == table.column("wanted")[0].as_py():
            order = sorted(range(len(ids)), key=n.__getitem__)  # the rarest first
            left = unpack_gaps(ids[order[0]])
            for k in order[1:]:
                if not len(left):
                    break
                left = np.intersect1d(left, unpack_gaps(ids[k]), assume_unique=True)
        return pa.table({"segment": pa.array([segment[0]] * len(left), pa.int64()), "place": pa.array(left, pa.int64())})

    return lists.groupBy("kind", "segment").applyInArrow(meet, "segment long, place long")


@dataclass(frozen=True)
class Index:
    """An index as it stood when it was opened: its files are listed once, whatever is searched."""

    rows: DataFrame
    parts: int


def open_index(spark: SparkSession, path: str, parts: int = 64) -> Index:
    return Index(spark.read.schema(POSTINGS.replace("part int, ", "") + ", part int").parquet(f"{path}/of-{parts}"), parts)


def postings(index: Index, field: int, gram: np.ndarray) -> DataFrame:
    """The posting lists of some trigrams: reads their parts, and in these the pages that hold them."""
    where = sorted(set(part_of(field, gram, index.parts).tolist()))
    return index.rows.where(F.col("part").isin(*where) & (F.col("field") == field) & F.col("gram").isin(*gram.tolist())).select("gram", "segment", "n", "ids")


def candidates(index: Index, word: str) -> DataFrame | None:
    """(segment, place) of the articles that may hold ``word``; None if the index cannot tell (a word under three characters,
    or one whose title form is not certain)."""
    folded = fold(word)
    if len(word) < 3 or folded is None:
        return None
    kinds = [(CONTENT, grams(word)), (TITLE, grams(folded)), (TITLE, np.array([UNFOLDED]))]
    lists = [postings(index, field, gram).select(F.lit(k).alias("kind"), F.lit(len(gram)).alias("wanted"), "segment", "n", "ids") for k, (field, gram) in enumerate(kinds)]
    return _candidates(lists[0].unionByName(lists[1]).unionByName(lists[2])).distinct()


def ids_of(index: Index, found: DataFrame, max_pushed: int = 5_000) -> tuple[DataFrame, list[int] | None]:
    """The articles at (segment, place), and their ids as a list if they are at most ``max_pushed``: a bounded list is pushed into
    the scans as a filter, more are joined."""
    segments = index.rows.where("part = -1").select("segment", "ids")
    few = found.limit(max_pushed + 1).collect()
    pushed = len(few) <= max_pushed
    if pushed:
        found = found.sparkSession.createDataFrame([tuple(r) for r in few], "segment long, place long")
        segments = segments.where(_one_of("segment", {r["segment"] for r in few}))
    number = F.conv(F.hex(F.substring("ids", (F.col("place") * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")  # big-endian
    ids = found.join(segments, "segment").select(number.alias("id")).distinct()
    return ids, (sorted(r[0] for r in ids.collect()) if few else []) if pushed else None


def _one_of(column: str, numbers) -> Column:
    """As one expression: thousands of single literals take seconds to pass."""
    return F.expr(f"{column} in ({', '.join(f'{n}L' for n in numbers)})") if numbers else F.lit(False)


def indexed_search(articles: DataFrame, tags: DataFrame, index: Index, word: str, page: int = 1, page_size: int = 10, max_pushed: int = 5_000) -> DataFrame:
    """The rows of :func:`inkwell.operators.catalog.search_articles`, found by an index that holds all articles."""
    word = word.strip()
    found = candidates(index, word) if word else None
    if found is not None:
        ids, few = ids_of(index, found, max_pushed)
        if few is not None:
            articles = articles.where(_one_of("id", few))
        else:
            articles = articles.join(ids, "id", "left_semi")
    return search_articles(articles, tags, word, page, page_size)

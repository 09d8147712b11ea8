"""Cost-balanced sequence packing of tokenised documents.

One Arrow pass: a task tokenises its documents, emits every full sequence a long document fills alone, and holds the
remainders until a bounded pool is full. A pool is packed greedily: pieces by descending attention cost, each into the
sequence of lowest cost that still has room; what fits nowhere is cut to fill the cheapest open sequences. The last
tokens of a pool go to sequences whose lengths are powers of two, which need no padding. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from inkwell.llm.common import worker_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file, through a bounded cache of words.

    It is for vocabularies whose pre-tokens never cross white space and keep letters and punctuation apart, with a mark
    on the last piece of each pre-token. Words between spaces and line breaks are encoded once, letters-only words many
    at a time, and looked up after that; the ids equal those of ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str, max_words: int = 400_000, end_mark: str = "</w>"):
        from tokenizers import Tokenizer

        self.tok, self.max_words = Tokenizer.from_file(path), max_words
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(end_mark)]] = True
        self.known: dict[str, bytes] = {"": b""}
        letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c).islower()] + ["ª", "º"]
        self.forms = {ord(c): "".join(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in letters}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _letters(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token each. Those of Latin-1 letters go to the vocabulary's model at once, in the
        form that the pre-tokenizer gives each letter; among others, a word ends where a piece is marked as last."""
        ids, ends, rest, tokenize = [], [], [], self.tok.model.tokenize
        for w in words:
            if w.isascii() or max(w) < "\u0100":
                ids += [t.id for t in tokenize(w.translate(self.forms))]
                ends.append(len(ids))
            else:
                rest.append(w)
        self._keep([w for w in words if w.isascii() or max(w) < "\u0100"] if rest else words, np.array(ids, "<u4"), np.array(ends, np.int64))
        for at in range(0, len(rest), 64):
            part = rest[at : at + 64]
            ids = self._encode(" ".join(part))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and len(ids) == ends[-1]:
                self._keep(part, ids, ends)
            else:
                self.known.update((w, self._encode(w).tobytes()) for w in part)

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, cuts = ids.tobytes(), (ends * 4).tolist()
        self.known.update(zip(words, (data[i:j] for i, j in zip([0, *cuts], cuts)), strict=True))

    def learn(self, words: list[str]) -> None:
        known, plain, made = self.known, set(), []
        for w in words:
            core = w.rstrip(_PUNCTUATION)
            if not core.isalpha():
                if core or w not in known:
                    known[w] = self._encode(w).tobytes()
                continue
            key = core.lower() if max(core) < "\u0100" else core
            if key not in known:
                plain.add(key)
            if key != w:
                made.append((w, key, w[len(core) :]))
        self._letters(list(plain))
        for w, key, tail in made:
            if tail not in known:
                known[tail] = self._encode(tail).tobytes()
            known[w] = known[key] + known[tail]

    def batch(self, texts: pa.Array, group_bytes: int = 6 << 20) -> Iterator[np.ndarray]:
        """The ids of every text. Texts are split and their words numbered by Arrow, about ``group_bytes`` at a time; each
        different word is looked up once and its ids are then copied to all its places."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // group_bytes
        for at, end in zip(*_stretches(group), strict=True):
            part = pc.split_pattern(pc.replace_substring(texts.slice(at, end - at), "\n", " "), " ")
            coded = part.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = [w for w in words if w not in self.known]
            if len(fresh) > self.max_words // 2:  # texts of very many different words, one at a time
                for t in texts.slice(at, end - at):
                    yield self._encode(t.as_py())
                continue
            if len(self.known) + len(fresh) > self.max_words:  # the cache begins anew
                self.known, fresh = {"": b""}, words
            self.learn(fresh)
            made = list(map(self.known.__getitem__, words))
            lens = np.fromiter(map(len, made), np.int64, len(made)) // 4
            ids, first = np.frombuffer(b"".join(made), "<u4"), np.cumsum(lens) - lens
            word = coded.indices.to_numpy()
            n = lens[word]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = ids[np.repeat(first[word] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[part.offsets.to_numpy() - part.offsets[0].as_py()].tolist()
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield ids[i:j]


def _stretches(group: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each run of equal numbers begins and ends."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))).tolist() if len(group) else []
    return at, [*at[1:], len(group)] if at else []


def piece_cost(length: np.ndarray | int, linear: float, quadratic: float):
    """Attention cost of a piece: linear in its tokens plus quadratic, as attention stays inside the piece."""
    return linear * length + quadratic * length * length


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then the rest as descending powers of two."""
    full, rest = divmod(total, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Rows (item, start, length, sequence, offset) that place every token of every item exactly once."""
    room = np.array(capacities(sum(lengths), size), np.int64)
    used, cost, rows = np.zeros(len(room), np.int64), np.zeros(len(room)), []
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))

    def place(item: int, start: int, n: int, s: int) -> None:
        rows.append((item, start, n, s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += piece_cost(n, linear, quadratic)

    for item in order:
        start, left = 0, lengths[item]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:  # nowhere whole: fill the sequence with most room and go on with the rest
                s = int(room.argmax())
                place(item, start, n := int(room[s]), s)
            else:
                place(item, start, n := left, s)
            start, left = start + n, left - n
    return rows


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    pool_tokens: int = 1 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece (see ``PIECES``), with the piece's ids if ``with_ids``.

    A null or empty text is the end id alone. Rows with the same id are separate documents. Ids may be null. Sequence
    ids are unique: the task's partition number and a count within it. ``pool_tokens`` bounds what a task holds.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = PIECES + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_cache(f"tokenizer {tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        next_seq = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        pool: list[tuple] = []  # (doc_id, ids, first token, doc_tokens)
        held = 0

        def row(doc, ids, start, length, total, seq, offset):
            part = ids[start : start + length]
            return (doc, start, length, zlib.crc32(part.tobytes()), total, seq, offset) + ((part.astype(np.int64),) if with_ids else ())

        def flush():
            nonlocal pool, held, next_seq
            top = 0
            for item, start, length, seq, offset in pack([len(p[1]) - p[2] for p in pool], size):
                doc, ids, first, total = pool[item]
                out.append(row(doc, ids, first + start, length, total, next_seq + seq, offset))
                top = max(top, seq + 1)
            next_seq += top
            pool, held = [], 0

        def batch():
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return made

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), tok.batch(b.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total, full = len(ids), len(ids) // size * size
                for start in range(0, full, size):
                    out.append(row(doc, ids, start, size, total, next_seq, 0))
                    next_seq += 1
                if full < total:
                    pool.append((doc, ids, full, total))
                    held += total - full
                if held >= pool_tokens:
                    flush()
                if len(out) >= 20_000:
                    yield batch()
        flush()
        yield batch()

    return src.mapInArrow(run, schema)

"""Token counts of whole texts, with huge texts encoded in overlapping chunks that are resynchronised.

A text of at most ``chunk`` characters is encoded whole. A longer one is cut into chunks that overlap by ``overlap``
characters on both sides of every cut. A chunk that does not begin where the tokenizer would stand in the whole text may
begin wrongly; it is right from the first place where it and its left neighbour both end a pre-token. That is a proof, not a
guess, for tokenizers that :func:`resynchronises` accepts: their splitting pattern looks ahead by a few characters and never
back, and merges stay inside a pre-token, so what follows a boundary depends on the boundary alone. Boundaries within
``margin`` characters of a chunk's end are not trusted, as text beyond it could still change them. Where two neighbours have
no boundary in common, their overlap is doubled, and once it reaches a chunk's length the two become one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import map_text, worker_cache

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]


def resynchronises(spec: dict) -> bool:
    """Whether common pre-token boundaries are stable: byte-level splitting without a normaliser, no space put in front, and
    special strings that neither swallow spaces nor ask for word borders."""
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain


class ChunkCounter:
    """Counts tokens by a ``tokenizers`` file, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, chunk: int, overlap: int, group_chars: int = 1 << 19):
        if not 0 < overlap < chunk:
            raise ValueError("an overlap has to be positive and shorter than a chunk")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tok, self.chunk, self.overlap, self.group = Tokenizer.from_file(path), chunk, overlap, group_chars
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        self.resync = resynchronises(spec)
        # a special string begun before the end of a chunk, and what the pattern looks ahead ('re, a run of spaces)
        self.margin = max([0, *(len(t["content"]) for t in spec.get("added_tokens", []))]) + 4
        self.widened = 0

    def encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def count(self, texts: Sequence[str]) -> list[int]:
        out = [0] * len(texts)
        small = [k for k, t in enumerate(texts) if t and (len(t) <= self.chunk or not self.resync)]
        for part in _groups(small, [len(texts[k]) for k in small], self.group):
            for k, e in zip(part, self.tok.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = len(e)
        done = set(small)
        for k, t in enumerate(texts):
            if t and k not in done:
                out[k] = self.count_long(t)
        return out

    def count_long(self, text: str) -> int:
        """Splices chunk after chunk; holds the encodings of a few chunks."""
        cuts = list(range(self.chunk, len(text), self.chunk))
        starts, stops = [0, *(c - self.overlap for c in cuts)], [*(min(len(text), c + self.overlap) for c in cuts), len(text)]
        encoded = self._encoded(text, starts, stops)
        total, skip, start, stop, left = 0, 0, starts[0], stops[0], next(encoded)  # skip: tokens of the left chunk before its splice
        for cut, a, b in zip(cuts, starts[1:], stops[1:], strict=True):
            right, width = next(encoded), self.overlap
            while (at := self._common(left, start, stop, skip, right, a, len(text))) is None:
                self.widened += 1
                width *= 2
                if width >= self.chunk:  # one chunk instead of two
                    left, stop = self.encode(text[start:b]), b
                    break
                stop, a = min(len(text), cut + width), cut - width
                left, right = self.encode(text[start:stop]), self.encode(text[a:b])
            if at is not None:
                total += at[0] - skip
                left, start, stop, skip = right, a, b, at[1]
        return total + len(left) - skip

    def _encoded(self, text: str, starts: list[int], stops: list[int]) -> Iterator:
        step = max(1, self.group // (self.chunk + 2 * self.overlap))
        for k in range(0, len(starts), step):
            yield from self.tok.encode_batch([text[a:b] for a, b in zip(starts[k : k + step], stops[k : k + step], strict=True)], add_special_tokens=False)

    def _common(self, left, start: int, stop: int, skip: int, right, a: int, n: int) -> tuple[int, int] | None:
        """The first stable boundary of both, as numbers of their tokens in front of it. ``skip``: tokens before the splice at
        which the left chunk begins to be right."""
        trusted = stop if stop == n else stop - self.margin
        there: dict[int, int] = {}
        words, offsets = left.word_ids, left.offsets
        for i in range(len(words) - 1, skip, -1):
            if start + offsets[i][0] < a:
                break
            if words[i] != words[i - 1] and start + offsets[i][0] <= trusted:
                there[start + offsets[i][0]] = i
        words, offsets = right.word_ids, right.offsets
        for j in range(len(words)):
            at = a + offsets[j][0]
            if at > trusted:
                return None
            if (j == 0 or words[j] != words[j - 1]) and at in there:
                return there[at], j
        return None


def _groups(keys: list[int], sizes: list[int], most: int) -> Iterator[list[int]]:
    held: list[int] = []
    size = 0
    for k, n in zip(keys, sizes, strict=True):
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(k)
        size += n
    if held:
        yield held


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",), limit: int = 1024, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """``carry`` columns and ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) per row, without a shuffle.

    A null or empty text has no bytes and no tokens. Rows are counted each by itself, so repeated rows and ids give repeated
    results; a carried column named like a result is replaced by it. No text is cut or padded. Special strings inside texts
    count as their special token, the library's default. With a tokenizer of which :func:`resynchronises` is not true,
    texts are encoded whole. A task holds one Arrow batch and the encodings of about half a million characters.
    """

    def run(texts: list[bytes | None]) -> dict[str, object]:
        counter = worker_cache(f"counter {tokenizer_path} {chunk} {overlap}", lambda: ChunkCounter(tokenizer_path, chunk, overlap))
        n = counter.count([(t or b"").decode("utf-8", "replace") for t in texts])
        return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    return map_text(df.withColumn("__text", F.col(f"`{text_col}`")), "__text", carry, FIELDS, run)

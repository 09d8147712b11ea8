"""Secret scans: exact base patterns plus a linear-chain conditional random field over tokens, decoded by Viterbi.

Tokens are tagged begin, inside or outside of a secret from their shape, their neighbours' shapes and file features.
The field is trained here, on a bounded sample labelled by the base patterns. Decoding prunes exactly: a token whose
outside score leads by more than any transition could win back is outside in every best path, so Viterbi runs only
over the short stretches between such tokens; the result equals decoding the whole text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import checkpointed, map_text, worker_cache

_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX_TABLE = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
KINDS = ("assign", "access", "hex", "crf")

_DELIMITERS = b" \t\n\x0b\x0c\r\"'=:,;()<>|[]{}"
_SPLIT = bytes(32 if bytes([c]) in [bytes([d]) for d in _DELIMITERS] else c for c in range(256))
_TOKEN = re.compile(rb"[^\s\"'=:,;()<>|\[\]{}]+")
_WORDLIKE = re.compile(rb"pass|pwd|secret|token|key|auth|cred")
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes; leftmost, non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(0, *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(1, *m.span(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    marks = text.translate(_HEX_TABLE)
    at = marks.find(b"h" * 24)
    while at >= 0:
        end = marks.find(b" ", at)
        end = len(text) if end < 0 else end
        out.append((2, at, end, at, end))
        at = marks.find(b"h" * 24, end)
    return sorted(out, key=lambda s: (s[1], s[0]))


#: Each byte's kind: digit, upper, lower, special, beyond ASCII or other mark, rest.
_KINDS = bytes(
    ord("d") if 48 <= c <= 57 else ord("U") if 65 <= c <= 90 else ord("l") if 97 <= c <= 122 else ord("s") if c in b"+/_.-" else ord("o") if c > 127 or 33 <= c <= 42 or c in b"?@\\^`~" else ord("r")
    for c in range(256)
)
_SIZES = bytes(0 if n < 6 else 1 if n < 10 else 2 if n < 16 else 3 if n < 20 else 4 if n < 24 else 5 if n < 32 else 6 for n in range(64))


def shape(token: bytes) -> int:
    """Eleven-bit shape of a token: length class, character kinds, hexadecimal only, key-like word."""
    n = len(token)
    kinds = token.translate(_KINDS)
    out = (_SIZES[n] if n < 64 else 7) | (b"U" in kinds[1:]) << 4 | (b"l" in kinds) << 5 | (b"s" in kinds[:-1]) << 6 | (b"o" in kinds) << 7
    if b"d" in kinds:
        out |= 1 << 3
        if n >= 8 and not token.translate(None, b"0123456789abcdef"):
            out |= 1 << 8
    if n < 20 and _WORDLIKE.search(token.lower()):
        out |= 1 << 9
    return out | (token[:4] == b"AKIA") << 10


def shapes_of(tokens: list[bytes]) -> np.ndarray:
    """The shapes of all tokens, through a bounded cache of this worker."""
    known = worker_cache("token shapes")
    try:
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    except KeyError:
        if len(known) > 200_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = shape(t)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


N_SHAPES = 1 << 11


def _shape_features() -> np.ndarray:
    """Binary features of every shape: length classes, flags, and each flag with long or mixed tokens."""
    s = np.arange(N_SHAPES)
    size = np.eye(8)[s & 7]
    flags = np.stack([s >> b & 1 for b in range(3, 11)], 1)
    digit, upper, lower = flags[:, 0], flags[:, 1], flags[:, 2]
    long = (s & 7) >= 3
    mixed = np.stack([digit & upper, digit & lower, digit & upper & lower, long & digit, long & upper & digit, long & (1 - digit)], 1)
    return np.concatenate([size, flags, mixed], 1).astype(np.float64)


PHI = _shape_features()
N_FILE = 4


def file_features(n_tokens: int, n_digit: int, n_word: int) -> np.ndarray:
    """Of the whole text: always on, short, many tokens with digits, key-like words present."""
    return np.array([1.0, n_tokens < 100, 20 * n_digit > n_tokens, n_word > 0], np.float64)


class Field:
    """Weights of the chain: per-shape score tables of the token, its left and its right neighbour, and transitions."""

    def __init__(self, own, left, right, file, trans, start):
        self.own, self.left, self.right, self.file, self.trans, self.start = own, left, right, file, trans, start
        # The most that a transition pair through B or I can beat the same place outside, where a following I becomes B.
        later = max(0.0, (trans[I] - trans[B]).max())  # a token after it that turns from inside to begin
        pairs = [(x, b, O, B, later) if b == I else (x, b, O, b, 0.0) for x in (B, I) for b in (B, I, O)]
        before = [(trans[a], x) for a in (B, I, O) for x in (B, I)] + [(start, B)]
        gains = [row[x] + trans[x, b] - row[o] - trans[o, c] + more for row, y in before for x, b, o, c, more in pairs if x == y and np.isfinite(row[x])]
        ends = [row[x] - row[O] for row, x in before if np.isfinite(row[x])]
        self.bound = max(gains + ends + [0.0]) + 1e-6

    def scores(self, shapes: np.ndarray, file: np.ndarray) -> np.ndarray:
        e = self.own[shapes] + file @ self.file
        e[1:] += self.left[shapes[:-1]]
        e[:-1] += self.right[shapes[1:]]
        return e

    def viterbi(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        """Best labels of a stretch; an outside token stands before it unless ``first`` and after it unless ``last``."""
        begin = self.start if first else self.trans[O]
        rows, trans = e.tolist(), self.trans.tolist()
        best, back = [rows[0][y] + begin[y] for y in range(3)], []
        for r in rows[1:]:
            nxt, from_ = [], []
            for y in range(3):
                x = max(range(3), key=lambda x: best[x] + trans[x][y])
                from_.append(x)
                nxt.append(best[x] + trans[x][y] + r[y])
            best = nxt
            back.append(from_)
        if not last:
            best = [best[y] + trans[y][O] for y in range(3)]
        y = max(range(3), key=best.__getitem__)
        path = [y]
        for from_ in reversed(back):
            y = from_[y]
            path.append(y)
        return path[::-1]

    def decode(self, shapes: np.ndarray, file: np.ndarray) -> list[tuple[int, int]]:
        """Token spans (end exclusive) of the secrets in the best labelling of the whole sequence."""
        n = len(shapes)
        e = self.scores(shapes, file)
        shift = np.zeros(n)
        shift[:-1] = np.maximum(0, e[1:, I] - e[1:, B])
        open_ = e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.bound + shift
        if not open_.any():
            return []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
        out = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            begin = None
            for at, y in enumerate([*self.viterbi(e[a:b], a == 0, b == n), O], a):
                if begin is not None and y != I:
                    out.append((begin, at))
                    begin = None
                if y == B:
                    begin = at
        return out


def token_windows(text: bytes, context: int = 8, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool] | None:
    """Shapes (-1 past the end) and labels of at most ``most`` token windows, the file features, and whether the text has
    base matches: windows around those, else elsewhere; in either case spread over the whole text. None without tokens."""
    sh = shapes_of(text.translate(_SPLIT).split())
    if not len(sh):
        return None
    y = np.full(len(sh), O)
    if spans := base_spans(text):
        at = np.array([m.span() for m in _TOKEN.finditer(text)])
        for _, _, _, a, b in spans:
            i, j = np.searchsorted(at[:, 1], a, "right"), np.searchsorted(at[:, 0], b)
            y[i : i + 1], y[i + 1 : j] = B, I
    width = 2 * context + 1
    centres = np.flatnonzero(y == B) if spans else np.arange(0, len(sh), width)
    centres = centres[np.unique(np.linspace(0, len(centres) - 1, min(most, len(centres))).astype(int))]
    place = np.clip(centres - context, 0, max(len(sh) - width, 0))[:, None] + np.arange(width)
    live, place = place < len(sh), np.minimum(place, len(sh) - 1)
    f = file_features(len(sh), int((sh >> 3 & 1).sum()), int((sh >> 9 & 1).sum()))
    return np.where(live, sh[place], -1).astype(np.int16), np.where(live, y[place], O).astype(np.int8), f, bool(spans)


def train_field(texts: list[bytes], context: int = 8, **settings: float) -> Field:
    """Fit the field to the token windows of these texts."""
    found = [w for t in texts if (w := token_windows(t, context)) is not None]
    return fit_field([(s, y, f) for s, y, f, _ in found], 2 * context + 1, **settings)


def fit_field(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, steps: int = 150, rate: float = 0.15, ridge: float = 2e-4) -> Field:
    """Gradient ascent on the label likelihood of token windows ``(shapes, labels, file features)``. Scores and gradients go
    through one table row per shape, so a step's cost does not depend on the number of features."""
    d = PHI.shape[1]
    theta = np.zeros((3 * d + N_FILE, 3))
    trans, start = np.zeros((3, 3)), np.zeros(3)
    forbid = np.zeros((3, 3))
    forbid[O, I] = -1e4
    if windows:
        s, y = np.concatenate([w[0] for w in windows]).astype(np.int64), np.concatenate([w[1] for w in windows]).astype(np.int64)
        f = np.repeat(np.array([w[2] for w in windows]), [len(w[0]) for w in windows], 0)
        live = s >= 0
        shapes = [s, np.pad(s[:, :-1], ((0, 0), (1, 0)), constant_values=-1), np.pad(s[:, 1:], ((0, 0), (0, 1)), constant_values=-1)]
        seen = [np.flatnonzero((x >= 0) & live) for x in shapes]  # the token itself, its left and its right neighbour
        gold = np.eye(3)[y] * live[..., None]
        pair = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        m = np.zeros_like(theta), np.zeros_like(theta), np.zeros((3, 3)), np.zeros((3, 3))
        for k in range(1, steps + 1):
            e = np.repeat((f @ theta[3 * d :])[:, None], width, 1).reshape(-1, 3)
            for j, (x, at) in enumerate(zip(shapes, seen, strict=True)):
                e[at] += (PHI @ theta[j * d : (j + 1) * d])[x.ravel()[at]]
            e = e.reshape(*s.shape, 3) * live[..., None]
            t = trans + forbid
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + start + np.array([0, -1e4, 0])
            for i in range(1, width):
                step = _lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i]
                alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
            for i in range(width - 2, -1, -1):
                step = _lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(live[:, i + 1, None], step, 0)
            z = _lse(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
            q = np.zeros((3, 3))
            for i in range(1, width):
                joint = np.exp(alpha[:, i - 1, :, None] + t + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
                q += (joint * live[:, i, None, None]).sum(0)
            rest, g = (gold - p).reshape(-1, 3), np.zeros_like(theta)
            for j, (x, at) in enumerate(zip(shapes, seen, strict=True)):
                by = np.stack([np.bincount(x.ravel()[at], rest[at, c], N_SHAPES) for c in range(3)], 1)
                g[j * d : (j + 1) * d] = PHI.T @ by
            g[3 * d :] = f.T @ rest.reshape(*s.shape, 3).sum(1)
            for j, (grad, w) in enumerate(((g / len(s) - ridge * theta, theta), ((pair - q) / len(s) - ridge * trans, trans))):
                m[2 * j][...] = 0.9 * m[2 * j] + 0.1 * grad
                m[2 * j + 1][...] = 0.99 * m[2 * j + 1] + 0.01 * grad * grad
                w += rate * (m[2 * j] / (1 - 0.9**k)) / (np.sqrt(m[2 * j + 1] / (1 - 0.99**k)) + 1e-8)
    else:
        theta[3 * d, O] = 1e3
    return Field(PHI @ theta[:d], PHI @ theta[d : 2 * d], PHI @ theta[2 * d : 3 * d], theta[3 * d :], np.where(forbid < 0, -np.inf, trans), np.array([0, -np.inf, 0.0]))


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


WINDOWS = [T.StructField("likely", T.BooleanType()), *(T.StructField(c, T.BinaryType()) for c in ("shapes", "labels", "file"))]


def training_windows(docs: DataFrame, id_col: str, text_col: str, max_rows: int, max_bytes: int, sample_rows: int, context: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token windows of at most ``max_rows`` texts with base matches and half as many others of at most ``max_bytes``: the
    first in order of a hash of the id among the ``sample_rows`` documents that come first in that order. Only ids are
    read to draw them, and only windows reach the driver."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def run(texts):
        found = [token_windows(t, context) if t else None for t in texts]
        out = {"likely": [w and w[3] for w in found]}
        return out | {c: [w and w[k].tobytes() for w in found] for k, c in enumerate(("shapes", "labels", "file"))}

    made = map_text(rows.where((F.col("h") <= last) & (F.octet_length("t") <= max_bytes)), "t", ["h"], WINDOWS, run).where("likely is not null")
    made = checkpointed(made)
    some = [made.where(c).orderBy("h", "shapes", "labels").limit(n).collect() for c, n in (("likely", max_rows), ("not likely", max_rows // 2))]
    shaped = lambda x, kind: np.frombuffer(x, kind).reshape(-1, 2 * context + 1)
    return [(shaped(bytes(r["shapes"]), np.int16), shaped(bytes(r["labels"]), np.int8), np.frombuffer(bytes(r["file"]))) for rs in some for r in rs]


def scan_secrets(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = 2000, max_train_bytes: int = 100_000, sample_rows: int = 40_000) -> DataFrame:
    """Per document: ``spans``, an array of (kind, start, end) in code points by start then kind, end exclusive.

    Base spans are kept as they are; a span of the field is added, as kind ``crf``, where it overlaps no base span. Null
    and empty texts have none. The field is fitted to windows of at most ``max_train_rows`` texts with base matches and half
    as many others, of the first ``sample_rows`` documents by a hash of the id (bounds on training alone; every text is
    scanned whole). Columns in ``carry`` pass through.
    """
    field = fit_field(training_windows(docs, id_col, text_col, max_train_rows, max_train_bytes, sample_rows), 17)

    def run(texts):
        out = []
        for text in texts:
            if not text:
                out.append([])
                continue
            sh = shapes_of(text.translate(_SPLIT).split())
            base = base_spans(text)
            spans = fixed = [(k, a, b) for k, a, b, _, _ in base]
            if len(sh):
                found = field.decode(sh, file_features(len(sh), int((sh >> 3 & 1).sum()), int((sh >> 9 & 1).sum())))
                if found:
                    at = [m.span() for m in _TOKEN.finditer(text)]
                    for i, j in found:
                        a, b = at[i][0], at[j - 1][1]
                        if all(b <= u or a >= v for _, u, v in fixed):
                            spans = [*spans, (3, a, b)]
            if spans:
                points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                at_point = lambda o: int(points[o - 1]) if o else 0
                spans = [(KINDS[k], at_point(a), at_point(b)) for k, a, b in sorted(spans, key=lambda s: (s[1], s[0]))]
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        return {"spans": out}

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return map_text(docs, text_col, carry if carry is not None else docs.columns, [T.StructField("spans", T.ArrayType(span))], run)


def mask_secrets(text_col: str, spans_col: str = "spans", mask: str = "[SECRET]"):
    """The text with every span replaced by ``mask``; overlapping spans are masked once."""

    def step(acc, s):
        start = F.greatest(acc["at"], s["start"])
        piece = F.substring(F.col(text_col), acc["at"] + 1, start - acc["at"])
        fresh = s["end"] > acc["at"]
        out = F.when(fresh, F.concat(acc["out"], piece, F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit("")))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col(spans_col), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.lit(2**31 - 1).cast("long"))))
    return F.when(F.size(spans_col) > 0, done).otherwise(F.col(text_col))

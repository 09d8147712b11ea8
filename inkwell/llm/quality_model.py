"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words' shapes, how much it repeats itself, and a
hashed bag of words; a hidden layer and a gated attention, learnt from document labels alone, weigh the passages, and
the weighted representation is scored. Training runs on a bounded sample; scoring is one Arrow pass over all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from inkwell.llm.common import map_text, worker_cache

PASSAGE = 64  # words in a passage; the last may be shorter
BUCKETS = 32
_SYMBOLS = b"#*$%&|<>!"
_WORD_BITS = 24
N_STATS = 12
N_FEATURES = N_STATS + 3 + BUCKETS


def word_code(w: bytes) -> int:
    """Low bits: a hash of the word; above them its length class and shape flags."""
    n = len(w)
    plain = w.isalpha()
    size = 0 if n < 3 else 1 if n < 6 else 2 if n < 10 else 3 if n < 16 else 4 if n < 30 else 5
    caps = n > 1 and w.isupper()
    title = not caps and 65 <= w[0] <= 90
    digit = not plain and any(48 <= c <= 57 for c in w)
    symbol = not plain and len(w.translate(None, _SYMBOLS)) < n
    ends = w[-1:] in b".?;:" and n > 1
    other = not w.isascii()
    flags = size | caps << 3 | title << 4 | digit << 5 | symbol << 6 | ends << 7 | other << 8
    return flags << _WORD_BITS | xxhash.xxh3_64_intdigest(w) & ((1 << _WORD_BITS) - 1)


def _codes(words: list[bytes]) -> np.ndarray:
    known = worker_cache("word codes")
    try:
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    except KeyError:
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = word_code(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all texts, and the first passage of each text. A text without words is one empty passage."""
    codes, first, starts, at = [], [], [], 0
    for text in texts:
        c = _codes((text or b"").split())
        first.append(len(starts))
        starts.extend(range(at, at + max(len(c), 1), PASSAGE))
        if not len(c):  # one placeholder, so that every passage has a word; its features are zeroed below
            c = np.array([-1])
        codes.append(c)
        at += len(c)
    first, starts = np.array(first), np.array(starts)
    c = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    if not len(c):
        return np.zeros((0, N_FEATURES), np.float32), first
    real = c >= 0
    c = np.where(real, c, 0)
    size = np.diff(np.append(starts, len(c)))
    passage = np.repeat(np.arange(len(starts)), size)
    doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(starts))))
    flags = c >> _WORD_BITS
    x = np.zeros((len(starts), N_FEATURES), np.float32)
    counts = np.maximum(np.add.reduceat(real, starts), 1)
    for k in range(6):
        x[:, k] = np.add.reduceat(((flags & 7) == k) & real, starts) / counts
    for k in range(6):
        x[:, 6 + k] = np.add.reduceat((flags >> (3 + k) & 1) * real, starts) / counts
    word = c & ((1 << _WORD_BITS) - 1)
    x[:, N_STATS] = _distinct(passage, word, len(starts)) / counts
    by_doc = np.repeat(doc, size)
    n_doc = np.bincount(by_doc, real, len(first))
    # Distinct words against what prose of that length has, by Heaps' law with a fixed exponent.
    x[:, N_STATS + 1] = (_distinct(by_doc, word, len(first)) / np.maximum(n_doc, 1) ** 0.8)[doc]
    x[:, N_STATS + 2] = (np.log1p(n_doc) / 10)[doc]
    bag = np.bincount(passage * BUCKETS + (word % BUCKETS), real, len(starts) * BUCKETS).reshape(-1, BUCKETS)
    x[:, N_STATS + 3 :] = bag / counts[:, None]
    x[n_doc[doc] == 0] = 0
    return x, first


def chunks(texts: list[bytes | None], size: int = 4 << 20):
    """Runs of whole texts of about ``size`` bytes, so that what encoding holds does not depend on the batch."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or b"")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _distinct(group: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    key = np.sort(group.astype(np.int64) << _WORD_BITS | word)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(key[new] >> _WORD_BITS, minlength=n)


@dataclass
class Model:
    """x -> tanh(x W + b) = h; attention exp(w . (tanh(h V) * sigmoid(h U))); score sigmoid(c . sum(a h) + c0)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "sizes": sizes, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -60, 60)))}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 200, rate: float = 0.03, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of bags. With fewer than two classes the model scores the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    init = lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
    p = {"W": init(N_FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "c0": np.zeros(1, np.float32)}
    model = Model(mean.astype(np.float32), (1 / np.maximum(std, 1e-3)).astype(np.float32), p)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        p["c"][:] = 0
        p["c0"][:] = np.log(share / (1 - share))
        return model
    m, q = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    for t in range(1, steps + 1):
        f = model.forward(x, first)
        d = ((f["score"] - y) / len(y)).astype(np.float32)
        spread = np.repeat(d, f["sizes"])
        g = {"c": f["z"].T @ d + ridge * p["c"], "c0": np.array([d.sum()])}
        hc = f["h"] @ p["c"]
        ds = spread * f["a"] * (hc - np.repeat(f["z"] @ p["c"], f["sizes"]))
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (spread * f["a"])[:, None] * p["c"] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dx + ridge * p["W"], dx.sum(0)
        for k, w in p.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            q[k] = 0.999 * q[k] + 0.001 * g[k] ** 2
            w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(id_col: str):
    """True where crc32 of the id's text leaves 1 on division by 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 4000, max_train_bytes: int = 30_000) -> Model:
    """Fit on at most ``max_train`` labelled rows that are not held out, of at most ``max_train_bytes`` of text each.

    Rows are drawn in order of a hash of the id, so the sample does not depend on the layout. Only texts and labels are
    used; ids, languages and sources never become inputs. Ids labelled both ways take the smaller label.
    """
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__y"))
    chosen = named.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).where(F.octet_length("__t") <= max_train_bytes)
    rows = texts.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id", "__t"), "__t").limit(max_train)
    fields = [T.StructField("passages", T.BinaryType())]

    def run(batch):
        x, first = encode(batch)
        return {"passages": [p.astype("<f4").tobytes() for p in np.split(x, first[1:])] if len(first) else []}

    got = [(r["__y"], bytes(r["passages"])) for r in map_text(rows, "__t", ["__y"], fields, run).collect()]
    got.sort()
    x = np.frombuffer(b"".join(p for _, p in got), "<f4").reshape(-1, N_FEATURES)
    first = np.cumsum([0] + [len(p) // (4 * N_FEATURES) for _, p in got])[:-1]
    return train(x, first, np.array([y for y, _ in got], np.float32))


def score(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Add ``score`` in [0, 1] to every row, higher where label 1 is likelier. Null and empty texts are one empty passage."""

    def run(texts):
        out = []
        for part in chunks(texts):
            x, first = encode(part)
            out.append(model.forward(x, first)["score"].astype(np.float64))
        return {"score": np.concatenate(out)}

    return map_text(docs, text_col, carry if carry is not None else docs.columns, [T.StructField("score", T.DoubleType())], run)

"""Token counts, periodic runs and whitening against the library, brute force and plain linear algebra."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import periodic_runs, queries, token_counts, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_tokens string, runs string, collapsed string"
AWKWARD = [None, "", " \n\t ", "one", "Ünï cödé 🐮 text", "a b a b a b", "word " * 3000, "x" * 50_000, "\x00\x01", "<|endoftext|> hi <|endoftext|>", "one", "a   b  \n c"]


def docs(spark, texts):
    return spark.createDataFrame([(k if k % 7 else None, t, "x", "y", "z") for k, t in enumerate(texts)], DOCS)


# -- token counts --

PATH = queries.tokenizer_path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def hostile(rng, n):
    """Texts of what makes boundaries move: runs of spaces, contractions, digits, marks, special strings and halves of them."""
    parts = ["'s", "'re", "'", "don't", " ", "  ", "   ", "\n", "\n\n", "\t", "123", "4567", "word", "Wörter", "🐮", "é", "!!", "<|endoftext|>", "<|endof", "text|>", " ", "　", "internationalisation", "x" * 40]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (100, 60), (400, 40)])
def test_chunks_give_the_counts_of_whole_texts(chunk, overlap):
    rng, tok = random.Random(chunk), library()
    counter = token_counts.ChunkCounter(PATH, chunk, overlap)
    texts = [hostile(rng, rng.randrange(0, 400)) for _ in range(150)] + ["x" * 3000, "a" + " " * 2000 + "b", "", "<|endoftext|>" * 50]
    assert counter.count(texts) == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.widened  # overlaps without a common boundary have occurred


def test_a_common_token_boundary_alone_is_not_enough():
    """Chunks of one long word share token boundaries without a pre-token boundary: they must be joined, not spliced."""
    counter, text = token_counts.ChunkCounter(PATH, 50, 20), "nationalisationinter" * 40
    assert counter.count([text]) == [len(library().encode(text, add_special_tokens=False))]
    assert counter.widened


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    counter, text = token_counts.ChunkCounter(path, 64, 16), "Some  Words, and More. " * 50
    assert not counter.resync
    assert counter.count([text]) == [len(Tokenizer.from_file(path).encode(text, add_special_tokens=False))]
    with pytest.raises(ValueError, match="overlap"):
        token_counts.ChunkCounter(path, 64, 64)


def test_count_tokens_rows(spark):
    tok = library()
    for chunk in (16_384, 200):
        rows = token_counts.count_tokens(docs(spark, AWKWARD), PATH, carry=["doc_id", "text", "n_tokens"], chunk=chunk, overlap=64).collect()
        want = [(t, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for t in AWKWARD]
        assert sorted(((r["text"], r["n_bytes"], r["n_tokens"]) for r in rows), key=repr) == sorted(want, key=repr)
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts.count_tokens(docs(spark, ["x"]).where("false"), PATH).count() == 0


def test_token_count_query(spark):
    tok = library()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False))
        assert got[r["doc_id"]] == (len((r["text"] or "").encode()), n, n > 1024)


# -- periodic runs --


def brute_runs(words, least=24, times=3):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                stretch = words[i : i + length]
                if all(any(stretch[k] != stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    """Stretches that repeat, nested and side by side, on a small or a large alphabet."""
    words = []
    while len(words) < rng.randrange(1, 160):
        root = [rng.choice("abcd" if rng.random() < 0.5 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.4:
            root = root * 2 + root[:1]
        words += (root * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return words


@pytest.mark.parametrize("least", [3, 24])
def test_runs_match_brute_force(least):
    rng = random.Random(least)
    texts = [periodic(rng) for _ in range(300)] + [[], ["a"], ["a"] * 100, list("ab" * 50), list("aab" * 9 + "aabaab"), list("abcabcabd" * 12)]
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t])
    got = periodic_runs.find_runs(ids, [len(t) for t in texts], min_words=least).tolist()
    assert got == [[k, *r] for k, t in enumerate(texts) for r in brute_runs(t, least)]
    with pytest.raises(ValueError, match="three"):
        periodic_runs.find_runs(ids, [len(t) for t in texts], min_exponent=2)


def brute_op12(doc_id, text):
    data = (text or "").encode()
    words, h = data.split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha(text.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_periodic_query(spark):
    rows = [tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()]
    have = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"] for r in have if len((r["text"] or "").split()) <= 700}  # brute force is cubic
    assert len(short) > 100
    assert sorted(r for r in rows if r[0] in short) == sorted(brute_op12(*r) for r in have if r["doc_id"] in short)
    assert sum(r[1] > 0 for r in rows) > 10


def test_detect_runs_rows(spark):
    texts = [*AWKWARD, " ".join("ab" * 20), "x " * 30 + "y " * 30]
    rows = periodic_runs.detect_runs(docs(spark, texts), carry=["doc_id", "text", "runs", "collapsed"], pass_words=50).collect()
    for r in rows:
        words = (r["text"] or "").encode().split()
        runs = brute_runs([w.decode() for w in words]) if len(words) < 700 else [(0, len(words), 1)]
        assert [tuple(x) for x in r["runs"]] == runs
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in drop)
    assert len(rows) == len(texts)
    assert periodic_runs.detect_runs(docs(spark, ["x"]).where("false")).count() == 0


# -- whitening --


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 20):
        for _ in range(20):
            a = rng.integers(-3, 4, (n, n)).astype(float)  # small whole numbers: zero pivots and equal eigenvalues occur
            a = a + a.T
            values = np.linalg.eigvalsh(a)
            for s in (-2.5, -0.3, 0.137, 1.9):
                if np.abs(values - s).min() > 1e-9:
                    assert whitening.count_above(a, s) == (values > s).sum()


@pytest.mark.parametrize("case", ["plain", "equal", "close", "low", "zero", "one"])
def test_leading_eigenvalues(case):
    rng = np.random.default_rng(2)
    n = 1 if case == "one" else 24
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"plain": np.linspace(30, 1, n), "equal": np.repeat([9.0, 4.0, 1.0], 8), "close": np.repeat([9.0, 4.0, 1.0], 8) + np.arange(n)[::-1] * 1e-9, "low": np.r_[5.0, 3.0, np.zeros(22)], "zero": np.zeros(n), "one": np.ones(1)}[case]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    k = min(8, n)
    got, vectors = whitening.leading(a, k)
    np.testing.assert_allclose(got, np.sort(values)[::-1][:k], atol=1e-12 * 30)
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(a @ vectors.T, vectors.T * got, atol=1e-10)


def check_whitened(rows, vectors, n_components=8):
    ids, m = zip(*[(i, np.floor(1024 * np.array(v, float)) + 100_000) for i, v in vectors], strict=True)
    x = np.array(m)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    want = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for i, r in zip(ids, x, strict=True)}
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == n * n_components
    for k in range(n_components):
        here = np.array([got[i, k + 1]["whitened"] for i in ids])
        there = centred @ basis[:, k] / np.sqrt(values[k])
        assert min(np.abs(here - there).max(), np.abs(here + there).max()) < 1e-6
    for r in rows:
        assert r["deviation"] == want[r["vec_id"]] and r["n"] == n
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-9
        assert r["identity_error"] < 1e-8


def test_whitening_query(spark):
    rows = queries.op13_whitening(spark, SF).collect()
    check_whitened(rows, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(4)
    good = [(k, [rng.gauss(0, 1 + j) for j in range(3)]) for k in range(40)] + [(99, [0.0, 0.0, 0.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<float>, deviation string, n int").repartition(5)
    rows, model = whitening.whiten(df, carry=["vec_id", "deviation", "n"])
    assert rows.columns == ["vec_id", "n", "deviation", "whitened"]
    assert (model.n, model.dim) == (41, 3)
    assert sorted(r["vec_id"] for r in rows.collect()) == sorted(i for i, _ in good)
    none, empty = whitening.whiten(df.where("false"))
    assert empty is None and none.count() == 0
    same, model = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>"))
    assert model.identity_error is None and model.explained == [0.0, 0.0]
    assert [(r["vec_id"], int(r["deviation"]), r["whitened"]) for r in same.collect()] == [(None, 0, [None, None])] * 3


def test_large_deviations_are_exact(spark):
    df = spark.createDataFrame([(0, [3.0e11, 1.0]), (1, [-3.0e11, 2.0])], "vec_id long, embedding array<double>")
    rows, model = whitening.whiten(df)
    x = [[np.floor(1024 * c) + 100_000 for c in v] for v in ([3.0e11, 1.0], [-3.0e11, 2.0])]
    s = [int(a) + int(b) for a, b in zip(*x, strict=True)]
    for r in rows.collect():
        assert int(r["deviation"]) == sum((2 * int(a) - b) ** 2 for a, b in zip(x[r["vec_id"]], s, strict=True))
    assert rows.select(F.col("deviation").try_cast("long")).first()[0] is None

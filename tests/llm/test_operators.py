"""Corpus operators against brute force, on empty tables, and on awkward rows."""

import collections
import gzip
import hashlib
import itertools
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat, common, decontaminate, html_extract, ngram_join, packing, paragraph_dedup, quality_model, quality_rules, queries, secrets, similar, warc

DOCS = "doc_id long, text string, source string, n_words string, kept string"  # two extra columns with clashing names
random.seed(11)
VOCAB = [f"w{k}" for k in range(60)]


def prose(n, rng=random):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, texts, ids=None):
    rows = [(i, t, f"s{k % 3}" if k % 5 else None, "x", "y") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \n\t ", "one", "Ünï cödé 🐮 text", "a b c d e", "A B C D E", "a b c d e", "word " * 30_000, "x" * 200_000, "\x00\x01", "<|endoftext|> hi <|im_end|>"]


# -- decontamination --


def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in word.findall(t or "")]
    d, hit, found = low(text), set(), set()
    for i, t in items:
        w = low(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if k else ():
            for b in range(len(d) - k + 1):
                if d[b : b + k] == w[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(i)
    return len(d), len(hit), sorted(found)


def test_decontaminate_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for k in range(12)] + [(50, None), (51, prose(20, rng)), (52, "é É;x")]
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(40)] + AWKWARD + [f"{prose(40, rng)}, {items[-2][1].upper()} {prose(9, rng)}", "z é É x"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (2_000_000, 25):
        got = decontaminate.decontaminate(docs(spark, texts), bench, carry=["doc_id"], max_block_words=block).collect()
        for r in got:
            if len(texts[r.doc_id] or "") < 2000:
                assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(texts[r.doc_id], items)
                assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_decontaminate_cuts_spans(spark):
    item = " ".join(f"q{k}" for k in range(14))
    d = docs(spark, [f"before, {item.replace(' ', ', ')}! after", None])
    got = decontaminate.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert got[0].clean_text == "before, ! after" and got[1].clean_text is None and got[0].kept == "y"
    none = decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string"), carry=["doc_id"]).collect()
    assert [r.n_hit for r in none] == [0, 0]


# -- quality rules --


def test_repeat_words_matches_brute_force():
    rng = random.Random(2)
    for n in (0, 4, 5, 9, 40, 200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        c = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
        want = {p for i in range(n - 4) if c[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        assert quality_rules.repeat_words(words) == len(want)
    many = [str(k).encode() for k in range(20_000)]
    assert quality_rules.repeat_words(many + many[:7]) == 14


def test_host_quality(spark):
    texts = AWKWARD + [prose(60) for _ in range(30)]
    got = quality_rules.host_quality(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and not by[0].kept and by[8].base_failed and by[4].word_chars == len("Ünïcödé🐮text")
    assert quality_rules.host_quality(docs(spark, [])).collect() == []
    bad = docs(spark, ["too short"] * 60 + [prose(60)] * 3).withColumn("source", F.lit("bad"))
    good = docs(spark, [prose(60) for _ in range(60)]).withColumn("source", F.concat(F.lit("g"), (F.col("doc_id") % 4).cast("string")))
    verdict = quality_rules.host_quality(bad.unionByName(good)).groupBy("source").agg(F.bool_or("host_ok").alias("ok")).collect()
    assert {r.source: r.ok for r in verdict} == {"bad": False, "g0": True, "g1": True, "g2": True, "g3": True}


# -- secrets --


def test_base_spans():
    text = 'PassWord: "abc123" password=abc AKIA' + "Z" * 16 + " AKIAshort " + "0af" * 8 + "g " + "a" * 23
    found = secrets.base_spans(text.encode())
    assert [(k, text[a:b]) for k, a, b, _, _ in found] == [(0, 'PassWord: "abc123'), (1, "AKIA" + "Z" * 16), (2, "0af" * 8)]


def brute_spans(text):
    """The rules as plain patterns over code points, one kind after the other."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(21)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "\u017fecret", "\u212aey", "é🐮", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0af", "x", ":", "=", " ", "  ", '"', "'", "\n", "\t", "-", "/", "hunter2", "Z"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + AWKWARD
    for r in secrets.scan_secrets(docs(spark, texts)).collect():
        assert [tuple(s) for s in r.spans if s.kind != "crf"] == brute_spans(texts[r.doc_id] or "")


def test_field_gradient_and_decoding():
    texts = [f"{prose(9)} password={'abcdefgh'[k % 8] * 4}12345{k} {prose(9)}".encode() for k in range(40)] + [prose(60).encode() for _ in range(40)]
    f = secrets.train_field(texts)
    hidden = f"{prose(9)} passwd hhhh1234507 {prose(9)}".encode()  # no base rule names this
    assert secrets.base_spans(hidden) == []
    tokens = [m.span() for m in secrets._TOKEN.finditer(hidden)]
    sh = np.array([secrets.shape(hidden[a:b]) for a, b in tokens])
    file = secrets.file_features(len(sh), int((sh >> 3 & 1).sum()), int((sh >> 9 & 1).sum()))
    assert {hidden[tokens[i][0] : tokens[j - 1][1]] for i, j in f.decode(sh, file)} == {b"hhhh1234507"}
    e = f.scores(sh[6:13], file)
    total = lambda path: sum(e[k, y] for k, y in enumerate(path)) + f.start[path[0]] + sum(f.trans[a, b] for a, b in itertools.pairwise(path))
    best = max(itertools.product(range(3), repeat=7), key=total)
    assert abs(total(best) - total(f.viterbi(e, True, True))) < 1e-9


def test_pruned_viterbi_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(30):
        trans = rng.normal(0, 2, (3, 3))
        trans[secrets.O, secrets.I] = -np.inf
        own = rng.normal(0, 3, (secrets.N_SHAPES, 3))
        f = secrets.Field(own, own * 0.3, own * 0.2, np.zeros((secrets.N_FILE, 3)), trans, np.array([0, -np.inf, 0.5]))
        shapes = rng.integers(0, secrets.N_SHAPES, 80)
        e = f.scores(shapes, np.zeros(secrets.N_FILE))
        full, out, begin = f.viterbi(e, True, True), [], None
        for at, y in enumerate([*full, secrets.O]):
            if begin is not None and y != secrets.I:
                out.append((begin, at))
                begin = None
            if y == secrets.B:
                begin = at
        assert f.decode(shapes, np.zeros(secrets.N_FILE)) == out


def test_scan_and_mask(spark):
    texts = AWKWARD + [f"{prose(8)} password=s3cr3tvalue{k} {prose(8)} 🐮 token: deadbeefdeadbeefdeadbeef{k:02d}" for k in range(20)]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, texts)).withColumn("masked", secrets.mask_secrets("text")).collect()}
    assert got[0].spans == [] and got[1].spans == []
    for k in range(len(AWKWARD), len(texts)):
        r = got[k]
        assert [s.kind for s in r.spans if s.kind != "crf"] == ["assign", "assign", "hex"]
        assert texts[k][r.spans[0].start : r.spans[0].end].startswith("password=s3cr3t")
        assert "s3cr3t" not in r.masked and "deadbeef" not in r.masked and "🐮" in r.masked
    assert secrets.scan_secrets(docs(spark, [])).collect() == []


# -- packing --


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = str(queries.tokenizer_path())
    tok = Tokenizer.from_file(path)
    texts = AWKWARD + [prose(700) + " don't I'LL 12.5 — “q” ﬁ naïve ΟΔΟΣ it's,** ...!?" for _ in range(9)]
    rows = packing.pack_documents(docs(spark, texts), path, with_ids=True, pool_tokens=5000).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert list(itertools.chain.from_iterable(r.ids for r in pieces)) == want
        assert {r.doc_tokens for r in pieces} == {len(want)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        total = sum(r.length for r in pieces)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(docs(spark, []), path).collect() == []


def test_word_cache_may_be_small():
    tok = packing.WordTokenizer(str(queries.tokenizer_path()), max_words=40)
    texts = [prose(50) + f" new{k} Écolé\u0301 ΟΔΟΣ ǅ İstanbul ßÿµª" for k in range(20)] + [""]
    for t, ids in zip(texts, tok.batch(pa.array(texts), 300), strict=True):
        assert ids.tolist() == tok.tok.encode(t, add_special_tokens=False).ids


# -- quality model --


def test_quality_model(spark):
    rng = random.Random(5)
    good = [prose(rng.randrange(20, 200), rng) for _ in range(150)]
    junk = [" ".join([rng.choice(VOCAB)] * 80) if k % 2 else prose(60, rng).upper() + " ###" * 30 for k in range(150)]
    d = docs(spark, good + junk + AWKWARD)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(d, labels)
    got = quality_model.score(d, model, carry=["doc_id"]).withColumn("held", quality_model.held_out("doc_id")).collect()
    held = [r for r in got if r.held and r.doc_id < 300]
    assert np.mean([(r.score >= 0.5) == (r.doc_id < 150) for r in held]) > 0.95
    assert len(got) == 300 + len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.held for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1} == {True}
    blind = quality_model.fit(d, labels.where("quality = 1"))
    assert quality_model.score(d, blind, carry=["doc_id"]).agg(F.countDistinct("score")).first()[0] == 1
    assert quality_model.score(docs(spark, []), blind).collect() == []


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(12, quality_model.N_FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    m = quality_model.train(x, first, y, hidden=6, gate=4, steps=300)
    assert np.abs(m.forward(x, first)["score"] - y).max() < 0.2
    f = m.forward(x, first)
    assert np.allclose(np.add.reduceat(f["a"], first), 1)


# -- paragraphs and n-gram join --


def near(text, rng, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(VOCAB)
    return " ".join(words)


def components_of(sets, percent=75):
    par = list(range(len(sets)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            par[b] = a
    return [find(i) for i in range(len(sets))]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_ngram_join_matches_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng.randrange(6, 120), rng) for _ in range(40)]
    texts = AWKWARD + base + [near(rng.choice(base), rng, rng.randrange(0, 5)) for _ in range(120)] + [base[0]] * 40 + [near(base[1], rng, 1) for _ in range(60)]
    want = components_of([shingle_set(t) for t in texts])
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]


def test_ngram_join_ids_and_empty(spark):
    got = ngram_join.ngram_join(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [None, 5, 5, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (7, 7)]
    assert ngram_join.ngram_join(docs(spark, [])).collect() == []


def test_prefixes_lose_no_link():
    rng = random.Random(17)
    base = [prose(rng.randrange(40, 90), rng) for _ in range(6)]
    sets = [similar.shingles(near(rng.choice(base), rng, rng.randrange(0, 4)).encode().split()) for _ in range(80)]
    seen = np.sort(np.concatenate(sets))
    often = np.unique(seen)[::3]
    count = np.searchsorted(seen, often, "right") - np.searchsorted(seen, often)
    frequent = ngram_join.Frequent(often, count, np.zeros(len(often), np.int64))
    for part in (sets, sets[:40]):  # through the index, and one by one
        tokens = pa.array([ngram_join.prefix_row(s, frequent, 75).tobytes() for s in part], pa.binary())
        met = ngram_join.near_members(pa.table({"node": pa.array(range(len(part)), pa.int64()), "tokens": tokens}), 75)
        leader = dict(zip(met.column("member").to_pylist(), met.column("leader").to_pylist(), strict=True))
        exact = components_of([set(s.tolist()) for s in part])
        assert len(set(exact)) < len(part)
        assert all(leader[i] == leader[r] for i, r in enumerate(exact) if r != i)
        assert all(x <= m for m, x in leader.items())


def test_flood_and_blocks(spark):
    rng = random.Random(7)
    base = prose(60, rng)
    sets = [similar.shingles(near(base, rng, rng.randrange(0, 9)).encode().split()) for _ in range(90)]
    want = components_of([set(s.tolist()) for s in sets])
    for limit in (5, 200):
        root = similar.flood(sets, 75, index_from=limit)
        assert [min(j for j in range(90) if root[j] == root[i]) for i in range(90)] == want
    groups = spark.range(1100).selectExpr("1L as leader", "id as member")
    met = similar.blocked(groups, 400).groupBy("i", "j").agg(F.count("*").alias("n")).collect()
    assert len(met) == 3 and max(r.n for r in met) < 1000
    small = spark.range(7).selectExpr("2L as leader", "id as member")
    met = similar.blocked(groups.union(small), 400).where("leader = 2").collect()
    assert sorted((r.i, r.j, r.member) for r in met) == [(0, 0, k) for k in range(7)]


def test_paragraphs_match_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng.randrange(20, 60), rng) for _ in range(12)]
    texts = ["\n".join(near(rng.choice(base), rng, rng.randrange(0, 3)) if rng.random() < 0.5 else prose(rng.randrange(5, 40), rng) for _ in range(4)) for _ in range(50)] + AWKWARD
    occ = [(i, k, t[a:b]) for i, x in enumerate(texts) for t in [(x or "").encode()] for k, a, b, _ in paragraph_dedup.paragraphs(t, 20)]
    root = components_of([shingle_set(t.decode()) for _, _, t in occ])
    size = collections.Counter(root)
    want = {(i, k): occ[r][:2] for (i, k, _), r in zip(occ, root, strict=True) if size[r] > 1}
    rows = paragraph_dedup.repeated_paragraphs(docs(spark, texts), recall=0.9999).collect()
    assert {(r.doc_id, r.paragraph): (r.class_doc, r.class_paragraph) for r in rows} == want
    assert all(len(texts[r.doc_id][r.start : r.end].split()) == r.n_words for r in rows)
    d = docs(spark, texts)
    left = paragraph_dedup.remove_repeats(d, paragraph_dedup.repeated_paragraphs(d, recall=0.9999)).collect()
    assert len(left) == len(texts) and sum(len((r.text or "").split("\n")) for r in left) == sum(len((t or "").split("\n")) for t in texts) - sum(r.removed for r in rows)
    assert paragraph_dedup.repeated_paragraphs(docs(spark, [])).collect() == []


def test_bands_and_edit_distance(spark):
    for percent, recall in ((75, 0.995), (90, 0.9), (50, 0.99)):
        b, r = paragraph_dedup.tune_bands(percent, recall)
        assert 1 - (1 - (percent / 100) ** r) ** b >= recall
    assert paragraph_dedup.edit_distance(b"a b c d".split(), b"a x c d e".split(), 40) and not paragraph_dedup.edit_distance(b"a b".split(), b"c d".split(), 40)
    text = prose(40)
    d = docs(spark, [text, near(text, random.Random(9), 3)])
    assert len(paragraph_dedup.repeated_paragraphs(d, percent=75, recall=0.99999, max_edit_percent=20).collect()) in (0, 2)


def test_passages_inside_lines_and_across_them(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))
    passage, short = fresh(60), fresh(49)
    words = passage.split()
    texts = [f"{fresh(150)} {passage} {fresh(80)}", f"{fresh(30)}\n{fresh(90)} é {passage.upper()} {fresh(200)}", "\n".join([fresh(3), *(" ".join(words[k : k + 12]) for k in range(0, 60, 12)), fresh(4)])]
    texts += [f"{fresh(40)} {short} {fresh(40)}", f"{fresh(70)} {short} {fresh(10)}", fresh(300), "word " * 500, None, ""]
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in paragraph_dedup.repeats(d).collect()}
    assert {i: (r.paragraph, r.n_words, r.class_doc, r.class_paragraph, r.class_size, r.removed) for i, r in rows.items()} == {0: (0, 60, 0, 0, 3, False), 1: (1, 60, 0, 0, 3, True), 2: (1, 60, 0, 0, 3, True)}
    assert all(texts[i][r.start : r.end].lower().split() == words for i, r in rows.items())
    left = {r.doc_id: r.text for r in paragraph_dedup.remove_repeats(d, paragraph_dedup.repeats(d)).collect()}
    assert [k for k in left if left[k] != texts[k]] == [k for k in left if k in (1, 2)]
    assert passage.upper() not in left[1] and left[1].startswith(texts[1].split(" é ")[0] + " é") and len(left[2].split()) == 7


def test_passages_match_brute_force(spark):
    rng = random.Random(13)
    base = [prose(rng.randrange(30, 140), rng) for _ in range(10)]
    texts = [" ".join(near(rng.choice(base), rng, rng.randrange(0, 2)) + rng.choice("\n ") for _ in range(3)) for _ in range(40)] + [prose(300, rng) for _ in range(5)] + AWKWARD
    texts += [f"{base[0]} {base[0]}"]  # both places count
    runs = [[tuple(w[i : i + 50]) for i in range(len(w) - 49)] for w in ((t or "").lower().split() for t in texts)]
    seen = collections.Counter(r for s in runs for r in set(s))
    want = {(k, i + j) for k, s in enumerate(runs) for i, r in enumerate(s) if seen[r] > 1 for j in range(50)}
    every = []
    for most in (5000, 3):  # with runs of common fingerprints apart, and most of them so
        got = set()
        every.append(sorted(paragraph_dedup.repeated_passages(docs(spark, texts), max_places=most).collect()))
        for r in every[-1]:
            at = len(texts[r.doc_id][: r.start].split())
            assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words
            got |= {(r.doc_id, at + j) for j in range(r.n_words)}
        assert got == want
    assert every[0] == every[1] and paragraph_dedup.repeated_passages(docs(spark, [])).collect() == []


def test_edit_links_need_not_pass_the_smallest_member(spark):
    rng = random.Random(14)
    linked = 0
    for _ in range(3):  # b is one edit from a and from c; a and c are too far apart
        a = prose(40, rng).split()
        b, c = list(a), list(a)
        for k in range(0, 40, 10):
            b[k] = c[k] = f"b{k}"
        for k in range(5, 40, 10):
            c[k] = f"c{k}"
        rows = paragraph_dedup.repeated_paragraphs(docs(spark, [" ".join(x) for x in (a, b, c)]), percent=30, recall=0.99999, max_edit_percent=10).collect()
        linked += len(rows) == 3 and {r.class_size for r in rows} == {3}
    assert linked == 3


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)] + [(200, x) for x in range(201, 230)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 230)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- archives --


def test_warc(spark, tmp_path):
    big = "é" * 300
    rows = [(5, "http://a/", big), (2, None, big), (2, "u\r\n", big), (None, "n", big), (9, "x", None), (7, "y", "short"), (8, "y", "short"), (1 << 60, "z", "q" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    for k in range(2):
        warc.write_archives(df, f"{tmp_path}/w{k}", shard_bytes=700, roll_bytes=400)
    got = warc.read_archives(spark, f"{tmp_path}/w0").collect()
    assert len(got) == len(rows)
    kinds = sorted((r.record_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(5, 600, "revisit", 2), (2, 600, "response", None), (2, 600, "response", None), (-1, 600, "revisit", 2), (9, 0, "response", None), (7, 5, "response", None), (8, 5, "response", None), (1 << 60, 5000, "response", None)], key=lambda r: (r[0], r[1], r[2], r[3] or 0))
    names = [sorted((p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / f"w{k}").glob("*.warc.gz")) for k in range(2)]
    assert names[0] == names[1] and len(names[0]) > 1
    by_shard = {}
    for p in sorted((tmp_path / "w0").glob("*.warc.gz")):
        keys = [int(k) for k in re.findall(rb"X-Record-Key: (\d+)", gzip.decompress(p.read_bytes()))]
        by_shard.setdefault(p.name[:12], []).extend(keys)
    spans = [(k[0], k[-1]) for k in by_shard.values() if k]
    assert all(k == sorted(k) for k in by_shard.values()) and spans == sorted(spans)  # one far id leaves the others sorted by range
    assert {9, 7, 8} & set(by_shard[min(by_shard)]) == set() or len(by_shard) > 2
    for p in (tmp_path / "w0").glob("*.warc.gz"):
        assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n")
    empty = f"{tmp_path}/e-{uuid.uuid4().hex}"
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


# -- html --

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li>More</ul></nav><div id="cookie-notice">We use cookies</div><main><article class="post"><h1>Big &amp; bold</h1>
<p>One <b>two</b>
 three&nbsp;four<p>five<br>six<ul><li>a<li>b</ul><form>f<input></form><div class="share-bar">S</div><aside>x</aside><p>%s</article>
<section id="comments"><article class="comment">c</article></section></main><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE % "end &lt;", set()) == "Big & bold\n\nOne two three four\n\nfive six\n\na\n\nb\n\nend <"
    for odd in ("", "plain", "<", "<p", "<p>a</", "<!-- x", "<script>x", "<article>a</div>b</article>", "<p>a<p>b</b></i>"):
        html_extract.main_text(odd, set())
    assert html_extract.main_text("<body><p>a<p>b", set()) == "a\n\nb"


def test_wrapper_alignment():
    w = html_extract.stream("<body><div class=x>Menu</div><p>one</p><p>two</p></body>")
    for other in ("<body><div class=x>Menu</div><p>three</p></body>", "<body><div class=x>Menu</div><h2>h</h2><p>q</p></body>"):
        w = html_extract.align(w, html_extract.stream(other))
    assert html_extract.expression(w) == "<body><div.x>#text</div>(<h2>#text</h2>)?(<p>#PCDATA</p>)+</body>"
    assert html_extract.literals(w) == {html_extract.text_key("Menu")}


def test_common_subsequence():
    rng = random.Random(15)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row

    for k in range(60):
        a, b = ([rng.choice("abcdefghijkl"[: rng.randrange(1, 12)]) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert html_extract.prefix_lengths(a, b).tolist() == length(a, b)
        for cells in (10_000, 6):
            pairs = html_extract.common(a, b, cells)
            assert all(a[i] == b[j] for i, j in pairs) and all(p < q and u < v for (p, u), (q, v) in itertools.pairwise(pairs))
            assert len(pairs) == length(a, b)[-1]


def test_wide_and_deep_pages():
    wide = ["".join(f"<div class=c{rng.randrange(10**9)}>x</div><p>y</p>" for _ in range(6000)) for rng in (random.Random(1), random.Random(2))]
    w = html_extract.align(html_extract.stream(wide[0]), html_extract.stream(wide[1]))
    assert w and html_extract.main_text(wide[0], set()).startswith("x\n\ny")
    deep = "<div>" * 3000 + "end" + "</div>" * 3000
    html_extract.align(html_extract.stream(deep), html_extract.stream(deep + "<p>z</p>"))
    assert html_extract.main_text(deep, set()) == "end"


def test_many_layouts_of_a_host(spark):
    page = "<body><div class=nav>Menu of us</div>" + "%s" + "<p>own %d</p></body>"
    rows = [(k, "http://h.example/x", page % ("".join(f"<i class=l{k}{j}></i>" for j in range(k % 7)), k)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    found = html_extract.infer_wrappers(df, F.lit("h"), fan=3).collect()
    assert len(found) == 1 and found[0].n_pages == 40
    for most in (32 << 20, 0):
        got = {r.page_id: r.text for r in html_extract.extract(df, max_broadcast_bytes=most).collect()}
        assert got == {k: f"own {k}" for k in range(40)}


def test_extract(spark):
    site = "<body><div class=top>Always here</div><p>%s</p></body>"
    rows = [(k, "http://h.example/x", site % f"own text {k}") for k in range(9)] + [(20, None, None), (21, "http://h.example/x", PAGE % "z"), (22, "bad", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(df, carry=["page_id", "url", "text"]).collect()}
    assert got[20] == "" and got[22] == "" and got[21].startswith("Big & bold")
    same = [r for r in rows if r[0] < 9]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert got == {k: f"own text {k}" for k in range(9)}
    assert html_extract.extract(df.limit(0)).collect() == []


def test_wrapper_decides_inside_articles(spark):
    notice = "All rights of this house are kept. " * 12  # over 300 characters
    page = "<body><div class=nav><a href=/>Home</a></div><article><h1>Title %d</h1><div class=zz>Tell <b>a friend</b></div><p>own %d</p><p>Home</p><div class=yy>" + notice + "</div></article></body>"
    rows = [(k, "http://h.example/x", page % (k, k)) for k in range(9)]
    rows += [(20 + k, "http://copies.example/x", "<article><p>same</p></article>") for k in range(9)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\n\nown {k}\n\nHome" for k in range(9)} | {20 + k: "same" for k in range(9)}


# -- chat --


def test_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "hi<|im_end|>"), ("t", 2, 1, 0.2, "assistant", "a"), ("t", 3, 1, 0.9, "assistant", "b"), ("t", 4, 3, 0.5, "user", None), ("t", 5, 4, 0.1, "assistant", "<||x"), ("t", 5, 4, 0.1, "assistant", "<||x"), ("s", 9, 77, None, "a\nb<|", "lone")]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = {(r.tree, r.leaf): r for r in chat.format_trees(nodes).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("turns"))).collect()}
    assert set(got) == {("t", 2), ("t", 5), ("s", 9)}
    assert [tuple(t) for t in got["t", 5].turns] == [("user", "hi<|im_end|>"), ("assistant", "b"), ("user", ""), ("assistant", "<||x")]
    assert got["t", 5].loss == "b<||x" and got["t", 5].rank == 1 and got["t", 2].rank == 2
    assert [tuple(t) for t in got["s", 9].turns] == [("a\nb<|", "lone")]
    assert [r.leaf for r in chat.format_trees(nodes, top=1).where("tree = 't'").collect()] == [5]
    assert chat.format_trees(nodes.limit(0)).collect() == []


def test_null_tree(spark):
    rows = [(None, 1, None, 0.0, "user", "a"), (None, 2, 1, 0.0, "assistant", "b"), ("t", 1, None, 0.0, "user", "c")]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    assert {(r.tree, r.leaf, r.n_turns) for r in chat.format_trees(nodes).collect()} == {(None, 2, 2), ("t", 1, 1)}
    assert {(r.tree, r.leaf, r.node, r.up) for r in chat.leaf_paths(nodes).collect()} == {(None, 2, 2, 0), (None, 2, 1, 1), ("t", 1, 1, 0)}


def test_reply_loops(spark):
    rows = [(1, 2), (2, 1), (3, 2), (4, None), (5, 4), (6, 6), (7, 3)]
    nodes = spark.createDataFrame([("t", n, p, 0.0, "user", str(n)) for n, p in rows], "tree string, node long, parent long, score double, role string, text string")
    assert {(r.leaf, r.node, r.up) for r in chat.leaf_paths(nodes).collect()} == {(5, 5, 0), (5, 4, 1), (6, 6, 0)}


def test_long_chain(spark):
    nodes = spark.range(1, 301).selectExpr("0L as tree", "id as node", "case when id > 1 then id - 1 end as parent", "0.0D as score", "'user' as role", "cast(id as string) as text")
    r = chat.format_trees(nodes).first()
    assert r.n_turns == 300 and r.formatted.count("<|im_start|>") == 300


@pytest.mark.parametrize("text", ["", "<", "<|", "<||", "<|||<|", "|<|im_start|>|", "a<|n|>b\n"])
def test_escape(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("b"), chat.escape(F.col("t")).alias("c")).first()
    assert r.a == text == r.b and "<|i" not in r.c


def test_large_groups_keep_their_members(spark):
    star = [(1, k) for k in range(1, 1500)]
    inner = [(2, k) for k in range(2, 1400)]  # all of it meets under 1 too
    other = [(3, k) for k in range(3, 1000)] + [(3, 5000)]  # 5000 meets no one under 1
    groups = common.checkpointed(spark.createDataFrame(star + inner + other, "leader long, member long"))
    got = {(r.leader, r.member) for r in similar.uncovered(groups).collect()}
    assert got == set(star) | set(other)
    sized = groups.withColumn("n", F.when(F.col("member") == 5000, 9000).otherwise(100))
    got = {(r.leader, r.member) for r in similar.compatible(sized, 75).collect()}
    assert got == set(star) | set(inner) | set(other) - {(3, 5000)}


def test_components_of_a_large_star(spark):
    edges = [(0, k) for k in range(1, 1200)] + [(5000 + k, 5001 + k) for k in range(5)] + [(1199, 5003)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 1206 and set(got.values()) == {0}

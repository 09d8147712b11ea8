"""The pipeline on a small table: each stage's rows against a plain version over what the previous stage kept."""

import collections
import random
import zlib

import numpy as np

import corpus_pipeline as pipe
from inkwell.llm import queries, secrets
from tests.llm.test_operators import brute_hits, components_of, near, prose, shingle_set


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    item = " ".join(f"bench{k}" for k in range(15))
    good = [prose(rng.randrange(30, 120), rng) for _ in range(60)]
    texts = good + [near(good[k], rng, 1) for k in range(0, 20, 2)] + [good[3]] * 3 + [" ".join([w] * 90) for w in "abcdefghij" * 3]
    texts += [f"{prose(20, rng)} {item}", f"{prose(700, rng)} {item} end", f"{prose(40, rng)} password=hunter22secret {prose(40, rng)}", None]
    ids = list(range(len(texts))) + [4]
    texts.append(texts[4])
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(not (73 <= i < 103)), 0) for i in range(103)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipe.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == pipe.COLUMNS
    graded = {r.doc_id for r in kept[0]}
    assert set(range(60)) <= graded and not any(73 <= i < 103 for i in graded)

    first = sorted((r.doc_id, r.text) for r in kept[0])
    root = components_of([shingle_set(t) for _, t in first])
    want = {}
    for (i, t), c in zip(first, root, strict=True):
        if first[c][0] == i:
            want[i] = t
    assert {r.doc_id: r.text for r in kept[1]} == want and len(kept[1]) == len(want)

    hits = {i: brute_hits(t, [(1, item)]) for i, t in want.items()}
    clean = {i: t for i, t in want.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
    assert {r.doc_id for r in kept[2]} == set(clean)
    for r in kept[2]:
        assert (r.text == clean[r.doc_id]) == (hits[r.doc_id][1] == 0) and (r.text is None or "bench3" not in r.text)
        assert r.text is None or r.n_chars == len(r.text)

    assert {r.doc_id for r in kept[3]} == set(clean)
    for r in kept[3]:
        assert r.text is None or secrets.base_spans(r.text.encode()) == []
    assert any("[SECRET]" in (r.text or "") for r in kept[3])

    tok = Tokenizer.from_file(str(queries.tokenizer_path()))
    pieces = collections.defaultdict(list)
    for r in kept[4]:
        pieces[r.doc_id].append(r)
    for r in kept[3]:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)

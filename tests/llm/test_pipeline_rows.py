"""Pipeline stages on repeated ids, null columns and empty tables."""

import random

import corpus_pipeline as pipe
from tests.llm.test_operators import near, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def test_near_duplicates_judges_rows_by_their_text(spark):
    rng = random.Random(3)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (9, near(b, rng, 1)), (7, c), (7, c), (8, None), (8, None), (8, ""), (None, a), (None, None)]
    kept = pipe.near_duplicates(spark, rows_of(spark, rows), "").collect()
    assert sorted(((r.doc_id or -1, r.text or "") for r in kept)) == sorted([(3, a), (5, b), (7, c), (8, ""), (8, ""), (8, ""), (-1, a), (-1, "")])


def test_stages_on_empty_and_null_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    empty = rows_of(spark, [])
    for _, stage in pipe.STAGES:
        assert stage(spark, empty, sf).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0)], SCHEMA)
    for name, stage in pipe.STAGES[1:4]:
        assert {r.doc_id for r in stage(spark, nulls, sf).collect()} == {None, 1, 2}, name
    assert sorted(r.doc_id or -1 for r in pipe.pack(spark, nulls, sf).collect()) == [-1, 1, 2]

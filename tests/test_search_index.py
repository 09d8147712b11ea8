"""The trigram index against the plain search, and what it reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import search_index as S
from inkwell.operators.catalog import search_articles

ARTICLES = "id long, title string, summary string, content string, view_num long, status string, tag_id long, create_time timestamp"
PARTS = "Über uber STRASSE straße ñandú Ångström 例え 世界 naïve ＦＵＬＬ it's œuvre øre ﬁne don't a b the then other ﷺ ́ x ab" .split() + ["‍", "İstanbul", "ısı", "ΑΒΓ", "のノ", "a\tb", "line\nend", "“quoted”", "l’été", "¿qué?", "–", "groß"]


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(PARTS) + rng.choice(["", "", "s", "é"])
    rows = [(i * 7 - 300, " ".join(word() for _ in range(4)) if i % 9 else None, "s", " ".join(word() for _ in range(30)) if i % 11 else None, i % 13, "draft" if i % 10 == 0 else "published", i % 3, None) for i in range(400)]
    rows.append((9_000_000_000_000_000_000, "needle in a title", "s", "x" * 70_000 + "haystack", 5, "published", 1, None))
    return spark.createDataFrame(rows, ARTICLES).repartition(5), spark.createDataFrame([(0, "en"), (1, "de")], "id long, name string")


@pytest.fixture(scope="module")
def index(spark, library, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    S.add_to_index(library[0], path, parts=16, segment_rows=40)
    return S.open_index(spark, path, 16)


def test_gaps_round_trip():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, m, n)) for m, n in ((5, 3), (300, 10), (5000, 4), (100_000, 30))] + [np.array([0]), np.array([254]), np.array([255, 510, 511])]
    data, cuts = S.pack_gaps(np.concatenate(lists), np.cumsum([0, *(len(x) for x in lists[:-1])]))
    for k, x in enumerate(lists):
        assert S.unpack_gaps(data[cuts[k] : cuts[k + 1]].tobytes()).tolist() == x.tolist()


def test_folding_loses_nothing_that_the_collation_finds(spark):
    """Of characters that have a folding: those that the collation takes for equal fold alike, one by one and before a letter."""
    chars = [c for c in map(chr, [*range(1, 0x180), 0x4E00, 0x4E8C, 0x9FA5]) if S.fold(c) is not None]
    assert len(chars) > 200
    df = spark.createDataFrame([(c, S.fold(c)) for c in chars], "c string, f string")
    title, word = (lambda n: F.concat(F.lit("x"), F.col(n), F.lit("eb"))), (lambda n: F.concat(F.col(n), F.lit("eb")))
    pairs = df.join(df.toDF("c2", "f2"), F.contains(F.collate(title("c"), "UNICODE_CI_AI"), F.collate(word("c2"), "UNICODE_CI_AI")))
    lost = [tuple(r) for r in pairs.where(~F.contains(title("f"), word("f2"))).collect()]
    assert not lost
    assert pairs.count() > len(chars)


WORDS = ["then", " the ", "uber", "ÜBER", "strasse", "straße", "nandu", "angstrom", "例え 世", "世界", "naive", "full", "it's", "oeuvre", "øre", "fine", "needle", "haystack", "xxxx", "absent-word", "ab", "", "istanbul", "other the", "s a", "のの", "them'", "grosss", "groß", "’ete", "a\tb", "e\ne", "“q", "?quo", "\"quoted"]


@pytest.mark.parametrize("pushed", [5_000, 3])
def test_same_rows_as_the_plain_search(spark, library, index, pushed):
    articles, tags = library
    for word in WORDS if pushed > 3 else WORDS[:4]:
        got = S.indexed_search(articles, tags, index, word, 1, 1000, pushed).collect()
        assert got == search_articles(articles, tags, word, 1, 1000).collect(), word


def test_reads_only_the_parts_of_the_word(spark, index):
    grams = S.grams("then")
    lists = S.postings(index, S.CONTENT, grams)
    where = set(S.part_of(S.CONTENT, grams, 16).tolist())
    assert 1 <= len(where) <= 2
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [" in plan and "In(gram" in plan
    partitions = {f.split("part=")[1].split("/")[0] for f in lists.select("ids").inputFiles()}
    read = {r[0] for r in lists.select(F.regexp_extract(F.input_file_name(), "part=([-0-9]+)", 1)).distinct().collect()}
    assert read <= {str(w) for w in where}
    assert partitions  # the files of the whole index are known; those of other parts are pruned
    assert {r.gram for r in lists.collect()} == set(grams.tolist())


def test_changed_articles_are_added(spark, library, tmp_path):
    articles, tags = library
    path = str(tmp_path / "i")
    S.add_to_index(articles, path, parts=4)
    changed = articles.where("id between 0 and 50").withColumn("content", F.lit("quite new wording"))
    S.add_to_index(changed, path, parts=4)
    now = articles.where("id not between 0 and 50").unionByName(changed)
    for word in ("quite new", "then"):
        assert S.indexed_search(now, tags, S.open_index(spark, path, 4), word, 1, 1000).collect() == search_articles(now, tags, word, 1, 1000).collect()


def test_empty_table(spark, library, tmp_path):
    articles, tags = library
    S.add_to_index(articles.where("false"), str(tmp_path / "e"), parts=4)
    assert S.indexed_search(articles.where("false"), tags, S.open_index(spark, str(tmp_path / "e"), 4), "word").collect() == []


def test_segments_of_huge_texts(spark, tmp_path):
    rows = [(i, f"title {i}", "s", f"{i} " * 3000, 0, "published", 0, None) for i in range(20)]
    df = spark.createDataFrame(rows, ARTICLES)
    S.add_to_index(df, str(tmp_path / "h"), parts=4, segment_chars=20_000)
    assert S.indexed_search(df, spark.createDataFrame([(0, "en")], "id long, name string"), S.open_index(spark, str(tmp_path / "h"), 4), "17 17 17").count() == 1

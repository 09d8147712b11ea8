"""Versioned tables against whole-table merges, and what they write and read."""

import random
from datetime import datetime

import pytest

from inkwell.functions.checkpoint import settings
from inkwell.operators import maintenance as M, versioned as V
from inkwell.sources.versions import Conflict, VersionedTable

T = "id long, status string, view_num long, content string, user_id long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def base(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, "draft" if i % 2 else "published", rng.randrange(100), f"text {i} " + "".join(rng.choices("abcdefghij", k=2000)), i % 7) for i in range(2000)], T)


def make(base, tmp_path, keys=("id",), buckets=8):
    return VersionedTable.create(base, str(tmp_path / "t"), list(keys), buckets)


def size(table):
    return sum(d["bytes"] for d in table.manifest()["deltas"])


def test_written_bytes_follow_the_change(spark, base, tmp_path):
    table = make(base, tmp_path)
    whole = table.files.size(f"{table.path}/base")
    small = spark.createDataFrame([(i, 10_000 + i) for i in range(5)], "article_id long, views long")
    V.write_back_views(table, small)
    assert size(table) < whole / 200
    one = size(table)
    V.write_back_views(table, spark.range(100, 600).selectExpr("id as article_id", "id as views"))
    assert size(table) - one < whole / 100  # no content, although 500 rows changed
    V.delete_comments(table, spark.range(700, 720))
    assert table.files.size(f"{table.path}/base") == whole
    assert table.files.size(table.path) < whole * 1.05
    want = M.write_back_views(base, small.union(spark.range(100, 600).selectExpr("id", "id"))).where("id not between 700 and 719")
    assert rows(table.read()) == rows(want)


def test_unchanged_rows_are_not_written(spark, base, tmp_path):
    table = make(base, tmp_path)
    same = base.selectExpr("id as article_id", "view_num as views")
    assert V.write_back_views(table, same) == 0
    assert table.version() == 0 and table.manifest()["deltas"] == []


def test_upserts_patch_old_rows_and_put_new_ones(spark, tmp_path):
    images = spark.createDataFrame([(i, f"k{i}", f"u{i}", "used", i) for i in range(300)], "id long, object_key string, url string, status string, size long")
    changes = spark.createDataFrame([(1000 + i, f"k{i}", f"v{i}", "unused", None) for i in range(290, 310)], images.schema)
    table = make(images, tmp_path, ["object_key"])
    V.upsert_images(table, changes)
    assert sorted(d["kind"] for d in table.manifest()["deltas"]) == ["patch", "put"]
    assert rows(table.read()) == rows(M.upsert_images(images, changes))  # a null is a value of a patch, too
    before = table.read()
    V.insert_ignore_images(table, changes.union(changes.selectExpr("id + 5", "concat(object_key, '-')", "url", "status", "size")))
    assert rows(table.read()) == rows(M.insert_ignore_images(M.upsert_images(images, changes), changes.union(changes.selectExpr("id + 5", "concat(object_key, '-')", "url", "status", "size"))))
    assert before.count() == 310


@pytest.mark.parametrize("few", [True, False])
def test_random_histories(spark, tmp_path, few, monkeypatch):
    """Puts, patches of two columns and drops of the same keys in any order, with compactions, against a dictionary."""
    if not few:
        monkeypatch.setattr(VersionedTable, "BROADCAST", (0, 0))
    rng = random.Random(few)
    now = {i: [i, "a", i, "c", 0] for i in range(30)}
    table = make(spark.createDataFrame(list(now.values()), T), tmp_path, buckets=3)
    versions = {0: {k: list(v) for k, v in now.items()}}
    for step in range(6):
        keys, m = rng.sample(range(45), 12), table.manifest()
        put = [[k, "p", step, None, step] for k in keys[:4]]
        patch = [(k, step * 10) for k in keys[4:8]]
        status = [(k, None if step % 2 else "s") for k in keys[6:10] if k not in keys[4:8]]
        drop = keys[10:]
        parts = [("put", spark.createDataFrame(put, T), m_names), ("patch", spark.createDataFrame(patch, "id long, view_num long"), ["id", "view_num"]), ("drop", spark.createDataFrame([(k,) for k in drop], "id long"), ["id"])] if (m_names := table.columns()) else []
        if status:
            parts.append(("patch", spark.createDataFrame(status, "id long, status string"), ["id", "status"]))
        v = table.append_deltas(m, parts)
        for r in put:
            now[r[0]] = list(r)
        for k, n in patch:
            if k in now:
                now[k][2] = n
        for k, s in status:
            if k in now:
                now[k][1] = s
        for k in drop:
            now.pop(k, None)
        versions[v] = {k: list(r) for k, r in now.items()}
        if step % 3 == 2:
            table.compact(rng.choice([0.0, 0.5, 2.0]))
    for v, state in versions.items():
        assert rows(table.read(v)) == sorted((tuple(r) for r in state.values()), key=repr)
    some = spark.createDataFrame([(k,) for k in (1, 2, 3, 44, 99)], "id int")
    assert rows(table.lookup(some)) == sorted((tuple(now[k]) for k in (1, 2, 3, 44, 99) if k in now), key=repr)
    assert table.compact(0.0) >= max(versions)
    assert table.manifest()["deltas"] == []
    assert rows(table.read()) == sorted((tuple(r) for r in now.values()), key=repr)


def test_compaction_touches_due_buckets_only(spark, base, tmp_path):
    table = make(base, tmp_path)
    first = table.manifest()["base"]
    one = table.spark.range(2000).select("id", table._bucket(table.manifest()).alias("b")).where("b = 3").select("id")
    V.delete_comments(table, one.limit(100))
    V.write_back_views(table, spark.createDataFrame([(7, 1_000_000)], "article_id long, views long"))
    table.compact(0.1)
    after = table.manifest()["base"]
    assert {b for b in first if first[b] != after[b]} == {"3"}
    assert rows(table.read(0)) == rows(base)
    left = sum(n for d in table.manifest()["deltas"] for n in d["buckets"].values())
    assert left <= 1


def test_lookup_reads_the_buckets_of_the_keys(spark, base, tmp_path):
    table = make(base, tmp_path, buckets=64)
    files = {f.split("__bucket=")[1].split("/")[0] for f in table.lookup(spark.createDataFrame([(5,), (6,)], "id long")).inputFiles() if "__bucket=" in f}
    assert 1 <= len(files) <= 2


def test_conflicts_are_noticed_and_retried(spark, base, tmp_path):
    table, other = make(base, tmp_path), VersionedTable(spark, str(tmp_path / "t"))
    m, counts = table.manifest(), spark.createDataFrame([(4, 77)], "article_id long, views long")
    V.delete_comments(other, spark.range(3, 4))
    with pytest.raises(Conflict):
        table.append_deltas(m, [("drop", spark.range(9, 10), ["id"])])
    assert rows(table.read().where("id in (3, 9)")) == rows(base.where("id = 9"))
    seen = []

    def slow(part):
        if not seen:  # another writer is faster
            V.delete_comments(other, spark.range(5, 6))
        seen.append(1)
        return M.write_back_views(part, counts)

    assert table.apply(slow, counts.selectExpr("article_id as id"), ["view_num"]) == 3
    assert len(seen) == 2
    assert rows(table.read().where("id in (3, 4, 5)").select("id")) == [(4,)]
    with pytest.raises(Conflict):
        table._commit(m)
    assert not [n for n in table.files.names(f"{table.path}/manifests") if not n.startswith("v-") and not n.endswith(".crc")]


def test_vacuum(spark, base, tmp_path):
    table = make(base, tmp_path)
    V.delete_comments(table, spark.range(0, 900))
    table.compact(0.0)
    want = rows(table.read())
    assert table.vacuum(keep=1, min_age_s=3600) == []  # young folders may belong to a writer
    assert len(table.vacuum(keep=1, min_age_s=-1)) >= 1
    assert rows(table.read()) == want
    assert table.version() == 2


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(2000)], "id long, v string")
    df.write.parquet(str(tmp_path / "src"))
    src = spark.read.parquet(str(tmp_path / "src"))
    assert VersionedTable.create(src, str(tmp_path / "one"), ["id"]).manifest()["buckets"] == 16
    monkeypatch.setattr(VersionedTable, "BUCKET_BYTES", 500)
    table = VersionedTable.create(src, str(tmp_path / "two"), ["id"])
    assert table.manifest()["buckets"] > 16 and table.read().count() == 2000


def test_what_a_task_writes_stays_bounded(spark, base, tmp_path):
    """Of large buckets, too, and of several that meet in one partition."""

    def largest(table):
        tasks: dict[str, int] = {}
        for f in (tmp_path / table).glob("base/*/*/part-*.parquet"):
            at = f"{f.parts[-3]} {f.name.split('-')[1]}"  # a task's files of all buckets have its number
            tasks[at] = tasks.get(at, 0) + f.stat().st_size
        return max(tasks.values())

    small = {"spark__sql__adaptive__advisoryPartitionSizeInBytes": "256k", "spark__sql__adaptive__coalescePartitions__minPartitionSize": "64k", "spark__sql__files__maxPartitionBytes": "256k"}
    with settings(spark, **small):
        for name, buckets in (("many", 16), ("few", 2), ("one", 1)):
            table = VersionedTable.create(base.repartition(16), str(tmp_path / name), ["id"], buckets)
            assert len(table.manifest()["base"]) == buckets
            assert largest(name) < 400_000
            assert rows(table.read()) == rows(base)
        V.write_back_views(table, spark.range(0, 2000).selectExpr("id as article_id", "id as views"))
        want = rows(table.read())
        table.compact(0.0)
        assert largest("one") < 400_000
        assert rows(table.read()) == want


def test_few_keys_move_no_rows_of_the_table(spark, base, tmp_path, monkeypatch):
    table = make(base, tmp_path)
    wanted = spark.createDataFrame([(5,), (6,), (6,), (None,), (9999,)], "id long")
    want = rows(base.where("id in (5, 6)"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = table.lookup(wanted)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == want
        for most in ((2, 8 << 20), (200_000, 5)):  # keys that are too many, or too long
            monkeypatch.setattr(VersionedTable, "BROADCAST", most)
            found = table.lookup(wanted)
            assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
            assert rows(found) == want


def test_keys_are_checked(spark, tmp_path):
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="unique"):
            VersionedTable.create(spark.createDataFrame(bad, "id long, v string"), str(tmp_path / "bad"), ["id"], 2)
    empty = VersionedTable.create(spark.createDataFrame([], "id long, v string"), str(tmp_path / "empty"), ["id"], 2)
    assert empty.read().collect() == [] and empty.read().columns == ["id", "v"]
    empty.append_deltas(empty.manifest(), [("put", spark.createDataFrame([(1, "x")], "id long, v string"), ["id", "v"])])
    assert rows(empty.read()) == [(1, "x")]
    assert empty.compact() == 2 and rows(empty.read()) == [(1, "x")]


def test_multi_table_changes(spark, tmp_path):
    at = datetime(2024, 1, 1)
    articles = spark.createDataFrame([(1, "published", None, 1), (2, "published", None, None), (3, "draft", 1, 1), (4, "published", None, 2)], "id long, status string, published_id long, tag_id long")
    refs = spark.createDataFrame([(9, 1, "markdown", 1), (9, 4, "html", 1)], "image_id long, article_id long, ref_type string, ref_count int")
    comments = spark.createDataFrame([(1, 1, "approved", at), (2, 2, "approved", at), (3, 4, "approved", at)], "id long, article_id long, status string, update_time timestamp")
    tables = [VersionedTable.create(df, str(tmp_path / n), k, 4) for n, df, k in (("a", articles, ["id"]), ("r", refs, ["image_id", "article_id", "ref_type"]), ("c", comments, ["id"]))]
    ids = spark.createDataFrame([(1,), (2,), (77,)], "id long")
    V.delete_articles(*tables, ids)
    for t, want in zip(tables, M.delete_articles(articles, refs, comments, ids), strict=True):
        assert rows(t.read()) == rows(want)
    reports = spark.createDataFrame([(i, 2 + i % 2, i, "pending") for i in range(8)], "id long, comment_id long, reporter_id long, status string")
    table = VersionedTable.create(reports, str(tmp_path / "p"), ["comment_id", "reporter_id"], 4)
    left, actions = tables[2].read(), spark.createDataFrame([(2, True), (3, False)], "comment_id long, accept boolean")
    want = M.resolve_reports(reports, left, actions)
    want = [rows(w) for w in want]
    V.resolve_reports(table, tables[2], actions)
    assert [rows(table.read()), rows(tables[2].read())] == want
    new = spark.createDataFrame([(50, 2, 0, None), (51, 2, 99, None), (52, 2, 99, None)], reports.schema)
    before = table.read()
    want = rows(M.append_reports(before, new))
    V.append_reports(table, new)
    assert rows(table.read()) == want
    with pytest.raises(ValueError, match="unknown"):
        V.delete_comments(tables[2], spark.range(1000, 1001))
    V.delete_images(VersionedTable.create(spark.createDataFrame([(9, "k")], "id long, object_key string"), str(tmp_path / "i"), ["object_key"], 2), tables[1], spark.range(9, 10))
    assert tables[1].read().collect() == []

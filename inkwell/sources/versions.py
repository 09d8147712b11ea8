"""Versioned tables with merge on read: a bucketed base, small deltas beside it, and a manifest that names both.

    <path>/base/<id>/bucket=<b>/    rows by bucket of the key, in one or more files, each sorted by key
    <path>/delta/<id>/              put (whole rows), patch (key and a few columns) or drop (keys: tombstones)
    <path>/manifests/v-<n>.json     the state of version n

A change writes what it changes: rows that it inserts, columns that it sets, keys that it removes. A reader collapses the
deltas to one row a key and joins it to the base; the manifest says how many rows they have, so the reader knows whether
that side may be broadcast. Compaction rewrites only buckets whose deltas have grown. Data folders have names of their own
and never change; the manifest appears under its number by a rename that does not replace, so of two writers one starts
again on the other's version, readers see whole versions, and a lost writer leaves nothing but an unnamed folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = T.StructField("__bucket", T.IntegerType())


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class _Files:
    """The few file operations that the driver does itself, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        where = self.at(path)
        return [f.getPath().getName() for f in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def age(self, path: str) -> float:
        return self.jvm.System.currentTimeMillis() / 1000 - self.fs.getFileStatus(self.at(path)).getModificationTime() / 1000

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.at(path)).getLength()

    def read(self, path: str) -> str:
        source = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, path: str, text: str) -> None:
        """Write beside, then rename without replacing."""
        folder, _, name = path.rpartition("/")
        beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        out = self.fs.create(self.at(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        plain = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(self.at(beside), self.at(path), plain)
        except Py4JJavaError as error:
            self.fs.delete(self.at(beside), False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
                raise Conflict(path) from None
            raise

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


class VersionedTable:
    """One table under ``path`` with a unique, non-null key."""

    #: What may be broadcast of the deltas: rows and bytes on disk, as the manifest counts them.
    BROADCAST = (200_000, 8 << 20)
    BUCKET_BYTES = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), _Files(spark, path)

    # -- versions --

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> VersionedTable:
        """Version 0 from all rows of ``df``. A null or repeated key is an error. Without ``buckets``, as many as the plan's size
        estimate has stretches of ``BUCKET_BYTES``, 16 at least and 65,536 at most."""
        table = cls(df.sparkSession, path)
        if buckets is None:
            size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
            buckets = min(1 << 16, max(16, -(-size // cls.BUCKET_BYTES)))
        bad = df.groupBy(*keys).count().where(" or ".join(["count > 1", *(f"`{k}` is null" for k in keys)]))
        if not bad.isEmpty():
            raise ValueError(f"{', '.join(keys)} has to be unique and not null")
        fixed = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        first = {"version": 0, "keys": list(keys), "buckets": buckets, "schema": fixed.jsonValue(), "base": {}, "deltas": []}
        first["base"] = table._write_base(first, df)
        table._commit(first)
        return table

    def version(self) -> int:
        """The newest one; -1 if there is none."""
        return max((int(n[2:-5]) for n in self.files.names(f"{self.path}/manifests") if n.startswith("v-")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.files.read(self._manifest_path(self.version() if version is None else version)))

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/v-{version:012d}.json"

    def _commit(self, manifest: dict) -> None:
        self.files.create(self._manifest_path(manifest["version"]), json.dumps(manifest))

    # -- reading --

    def columns(self) -> list[str]:
        return self._names(self.manifest())

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest unless one is named."""
        m = self.manifest(version)
        return self._merged(m, None).select(*self._names(m))

    def lookup(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """The table's rows whose key is in ``rows``; reads the buckets of those keys only."""
        m = self.manifest(version)
        wanted = rows.select(*m["keys"]).distinct()
        buckets, few = self._buckets_of(m, wanted)
        return self._merged(m, buckets).join(F.broadcast(wanted) if few else wanted, m["keys"], "left_semi").select(*self._names(m))

    @staticmethod
    def _names(m: dict) -> list[str]:
        return [f["name"] for f in m["schema"]["fields"]]

    @staticmethod
    def _bucket(m: dict) -> Column:
        """By the key's text, so that an int and a long of one value share a bucket."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in m["keys"]]), F.lit(m["buckets"]).cast("long")).cast("int")

    def _buckets_of(self, m: dict, wanted: DataFrame) -> tuple[set[int], bool]:
        """At most as many numbers as there are buckets, and whether the keys are few enough to be broadcast."""
        size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in m["keys"]), F.lit(0))
        found = wanted.groupBy(self._bucket(m).alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
        return {r["b"] for r in found}, sum(r["n"] for r in found) <= self.BROADCAST[0] and sum(r["bytes"] for r in found) <= self.BROADCAST[1]

    def _base(self, m: dict, buckets: set[int] | None) -> DataFrame:
        schema = T.StructType(T.StructType.fromJson(m["schema"]).fields + [BUCKET])
        roots: dict[str, list[str]] = {}
        for b, (root, _) in m["base"].items():
            if buckets is None or int(b) in buckets:
                roots.setdefault(root, []).append(b)
        out = self.spark.createDataFrame([], schema)
        for root, own in roots.items():
            at = f"{self.path}/base/{root}"
            part = self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/__bucket={b}" for b in own])
            out = part if len(roots) == 1 else out.unionByName(part)
        return out

    def _collapsed(self, m: dict, buckets: set[int] | None) -> tuple[DataFrame | None, list[str], bool]:
        """The deltas as one row a key: ``__full`` (number of the last put or drop), ``__row`` (that row, null for a drop), and for
        each column that any patch sets, its last number and value. Then those columns, and whether the rows are few."""
        key, names, parts, rows, size = m["keys"], self._names(m), [], 0, 0
        set_by = [c for c in names if any(c in d["columns"] and d["kind"] == "patch" for d in m["deltas"])]
        for d in m["deltas"]:
            live = {int(b) for b in d["buckets"]} & (buckets if buckets is not None else {int(b) for b in d["buckets"]})
            if not live:
                continue
            fields = [T.StructField.fromJson(f) for f in m["schema"]["fields"] if f["name"] in d["columns"]]
            df = self.spark.read.schema(T.StructType([*fields, BUCKET])).parquet(f"{self.path}/delta/{d['id']}")
            if len(live) < d["written"]:
                df = df.where(F.col("__bucket").isin(*live))
            marks = [F.lit(d["kind"] == "patch" and c in d["columns"]).alias(f"__p_{c}") for c in set_by]
            parts.append(df.select("*", F.lit(d["seq"]).alias("__seq"), F.lit(d["kind"]).alias("__kind"), *marks))
            rows, size = rows + sum(d["buckets"].values()), size + d["bytes"]
        if not parts:
            return None, set_by, True
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p, allowMissingColumns=True)
        for c in names:
            if c not in union.columns:
                union = union.withColumn(c, F.lit(None).cast(T.StructType.fromJson(m["schema"])[c].dataType))
        full = F.when(F.col("__kind") != "patch", F.col("__seq"))
        row = F.when(F.col("__kind") == "put", F.struct(*[c for c in names if c not in key], F.lit(True).alias("__put")))
        found = [F.max(full).alias("__full"), F.max_by(F.struct(row.alias("r")), full)["r"].alias("__row")]
        for c in set_by:
            at = F.when(F.col(f"__p_{c}"), F.col("__seq"))
            found += [F.max(at).alias(f"__s_{c}"), F.max_by(F.struct(F.col(c).alias("v")), at)["v"].alias(f"__v_{c}")]
        few = rows <= self.BROADCAST[0] and size <= self.BROADCAST[1]
        return union.groupBy(*key).agg(*found), set_by, few

    def _merged(self, m: dict, buckets: set[int] | None) -> DataFrame:
        base, names = self._base(m, buckets).drop(BUCKET.name), self._names(m)
        deltas, set_by, few = self._collapsed(m, buckets)
        if deltas is None:
            return base
        last = F.coalesce("__full", F.lit(-1))
        fresh = lambda c, old: F.when(F.col(f"__s_{c}") > last, F.col(f"__v_{c}")).otherwise(old).alias(c) if c in set_by else old.alias(c)
        slim = deltas.select(*m["keys"], "__full", *[x for c in set_by for x in (f"__s_{c}", f"__v_{c}")])
        kept = base.join(F.broadcast(slim) if few else slim, m["keys"], "left").where("__full is null")
        put = deltas.where("__row is not null")
        return kept.select(*[fresh(c, F.col(c)) for c in names]).unionByName(put.select(*[fresh(c, F.col(c) if c in m["keys"] else F.col("__row")[c]) for c in names]))

    # -- writing --

    def _write_base(self, m: dict, rows: DataFrame) -> dict[str, list]:
        root = uuid.uuid4().hex
        at = f"{self.path}/base/{root}"
        typed = rows.select(*[F.col(c) for c in self._names(m)]).withColumn(BUCKET.name, self._bucket(m))
        # tasks of about the advisory partition size, however large buckets are; several of them may write files of one bucket
        typed.hint("rebalance", 4 * m["buckets"], BUCKET.name).sortWithinPartitions(BUCKET.name, *m["keys"]).write.partitionBy(BUCKET.name).parquet(at)
        there = self.spark.read.schema(T.StructType(T.StructType.fromJson(m["schema"]).fields + [BUCKET])).parquet(at)
        return {str(r[0]): [root, r[1]] for r in there.groupBy(BUCKET.name).count().collect()}  # a row a bucket

    def _write_delta(self, m: dict, kind: str, rows: DataFrame, columns: list[str]) -> dict | None:
        name = uuid.uuid4().hex
        at = f"{self.path}/delta/{name}"
        schema = T.StructType.fromJson(m["schema"])
        typed = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns]).withColumn(BUCKET.name, self._bucket(m))
        typed.hint("rebalance").write.parquet(at)
        there = self.spark.read.schema(T.StructType([*(schema[c] for c in columns), BUCKET])).parquet(at)
        counts = {str(r[0]): r[1] for r in there.groupBy(BUCKET.name).count().collect()}  # a row a bucket
        if not counts:
            self.files.drop(at)
            return None
        return {"id": name, "kind": kind, "columns": columns, "buckets": counts, "written": len(counts), "bytes": self.files.size(at)}

    def append_deltas(self, m: dict, parts: Sequence[tuple[str, DataFrame, list[str]]], note: tuple[str, int] | None = None) -> int:
        """Commit (kind, rows, columns) on top of version ``m`` as one version; parts without rows leave no trace. A ``note`` (a
        writer's name and its number, as of a stream's batch) is kept in the manifest with the change."""
        made = [d for d in (self._write_delta(m, *p) for p in parts) if d is not None]
        if not made and note is None:
            return m["version"]
        version = m["version"] + 1
        notes = m.get("notes", {}) | ({note[0]: note[1]} if note else {})
        self._commit(m | {"version": version, "deltas": m["deltas"] + [d | {"seq": version} for d in made], "notes": notes})
        return version

    def apply(self, change: Callable[[DataFrame], DataFrame], touched: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] | None = None, attempts: int = 5, note: tuple[str, int] | None = None) -> int:
        """Commit ``change(rows)`` for the rows that ``touched`` names, and return the version.

        ``change`` gets these rows and returns what they become, with new rows if there are any; every row of its result
        may depend on the rows it got and on what it joins, not on the rest of the table. Rows are named by the key, or by the
        columns ``by``, which makes the lookup read those columns of all buckets. With ``columns``, rows that stay are written as
        patches of these columns; without, whole. Rows that come out as they were are not written. After a conflict the
        change is made again on the newer version. With a ``note``, a number that this writer has already committed, or an
        earlier one, changes nothing: a batch that is run again after a failure counts once.
        """
        for _ in range(attempts):
            m = self.manifest()
            if note is not None and m.get("notes", {}).get(note[0], -1) >= note[1]:
                return m["version"]
            key, names = m["keys"], self._names(m)
            if by is None:
                rows = self.lookup(touched, m["version"])
            else:
                rows = self.read(m["version"]).join(touched.select(*by).distinct(), list(by), "left_semi").select(*names)
            new = change(rows).select(*names)
            values = [c for c in (columns or names) if c not in key]
            old = rows.select(*key, F.struct(*values).alias("__old"))
            same = new.join(old, key).where(~F.struct(*values).eqNullSafe(F.col("__old")))
            parts = [
                ("drop", rows.select(*key).join(new.select(*key), key, "left_anti"), list(key)),
                ("put", new.join(rows.select(*key), key, "left_anti"), names),
                ("patch", same, [*key, *values]) if columns else ("put", same, names),
            ]
            try:
                return self.append_deltas(m, parts, note)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {attempts} attempts")

    # -- upkeep --

    def compact(self, share: float = 0.1) -> int:
        """Fold the deltas of each bucket whose delta rows are more than ``share`` of its base rows into a new base of that bucket.
        Other buckets are neither read nor written. Returns the version; raises :class:`Conflict` if another writer was first."""
        m = self.manifest()
        rows: dict[str, int] = {}
        for d in m["deltas"]:
            for b, n in d["buckets"].items():
                rows[b] = rows.get(b, 0) + n
        due = {b for b, n in rows.items() if n > share * (m["base"].get(b, [None, 0])[1])}
        if not due:
            return m["version"]
        made = self._write_base(m, self._merged(m, {int(b) for b in due}))
        base = {b: v for b, v in m["base"].items() if b not in due} | made
        deltas = [d | {"buckets": left} for d in m["deltas"] if (left := {b: n for b, n in d["buckets"].items() if b not in due})]
        self._commit(m | {"version": m["version"] + 1, "base": base, "deltas": deltas})
        return m["version"] + 1

    def vacuum(self, keep: int = 2, min_age_s: float = 86_400) -> list[str]:
        """Drop manifests before the newest ``keep``, and data folders older than ``min_age_s`` that no remaining manifest names
        (a younger one may belong to a writer at work). Returns the folders."""
        newest, gone = self.version(), []
        kept = [v for v in range(max(0, newest - keep + 1), newest + 1)]
        used: set[str] = set()
        for v in kept:
            m = self.manifest(v)
            used |= {f"base/{root}" for root, _ in m["base"].values()} | {f"delta/{d['id']}" for d in m["deltas"]}
        for n in self.files.names(f"{self.path}/manifests"):
            if n.startswith("v-") and int(n[2:-5]) not in kept:
                self.files.drop(f"{self.path}/manifests/{n}")
        for kind in ("base", "delta"):
            for n in self.files.names(f"{self.path}/{kind}"):
                if f"{kind}/{n}" not in used and self.files.age(f"{self.path}/{kind}/{n}") >= min_age_s:
                    self.files.drop(f"{self.path}/{kind}/{n}")
                    gone.append(f"{kind}/{n}")
        return gone

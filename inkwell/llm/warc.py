"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, shards are cut at byte-weighted boundaries that depend on the data alone, and within a
shard files roll by compressed size. Writers use temporary names; a manifest of what succeeded is checkpointed, the
files are renamed by it, and the manifest itself, written last, is the commit. Every record is its own gzip member.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkwell.llm.common import checkpointed

MANIFEST = "shard long, roll long, temp string, final string, records long, bytes long, sha256 string"
RECORD = "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"
_BINS = 4096


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store that a Hadoop-style URI names, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = 100) -> DataFrame:
    """Record rows (turn 1) and, for records that revisit, a narrow mark (turn 0) to be sorted in front of them.

    Of equal payloads of ``min_revisit`` bytes the smallest id responds and the others revisit it, as their marks say.
    Payloads thus meet no join and move once, to their shard.

    Sizes and digests are of the whole payload; a null one counts as empty. Rows that repeat the smallest id and payload
    all respond; a null id revisits the smallest id, and payloads under null ids alone all respond. The digest side is
    aggregated with map-side combining and holds repeated payloads only. Other input columns are not carried.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = pages.select(F.col(id_col).cast("long").alias("record_id"), payload.alias("p")).where(F.octet_length("p") >= min_revisit)
    narrow = narrow.select("record_id", F.sha2("p", 256).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("record_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    marks = narrow.join(first.drop("n"), "digest").where("record_id is null or record_id <> refers_to").distinct()
    rows = rows.select("record_id", "digest", F.lit(1).alias("turn"), F.lit(None).cast("long").alias("refers_to"), "url", "payload")
    return rows.unionByName(marks.select("record_id", "digest", F.lit(0).alias("turn"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")))


def assign_shards(records: DataFrame, sizes: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Add ``shard``: ranges of record_id of about ``shard_bytes`` payload, the same on every run over the same rows; also
    the number of shards.

    ``sizes(record_id, size)`` are the same rows, narrow. Boundaries come from exact histograms of 4096 bins: one over all
    ids, then one inside each bin heavier than a shard, until a bin is a single id. So ids far from all others leave the
    rest sorted by range, and the driver sees no more than some thousand sums for each heavy bin. A single id heavier than
    a shard is split by digest. Null ids form the first bin.
    """
    session = records.sparkSession
    lo, hi = sizes.agg(F.min("record_id"), F.max("record_id")).first()
    lo, hi = lo or 0, hi or 0
    nodes = {0: (lo, (hi - lo) // _BINS + 1)}  # first id and width of a bin
    leaves: list[tuple[int, int, int, int]] = []  # first id, node, bin, bytes
    made, key = 1, F.col("record_id")
    records, sizes = (x.withColumn("node", F.lit(0).cast("long")).withColumn("lo", F.lit(lo)).withColumn("width", F.lit(nodes[0][1])) for x in (records, sizes))
    split = True
    while split:
        bin_of = F.coalesce(F.expr("(record_id - lo) div width"), F.lit(-1)).cast("long")
        records, sizes = (x.withColumn("bin", F.when(F.col("width") > 0, bin_of).otherwise(F.col("bin")) if "bin" in x.columns else bin_of) for x in (records, sizes))
        split = []
        for node, b, w in sizes.where("width > 0").groupBy("node", "bin").agg(F.sum("size").alias("w")).collect():
            first, width = nodes[node]
            if w > shard_bytes and width > 1 and b >= 0:
                nodes[made] = (first + b * width, (width - 1) // _BINS + 1)
                split.append((node, b, made, *nodes[made]))
                made += 1
            else:
                leaves.append((first + b * width if b >= 0 else lo - 1, node, b, w))
        if split:
            finer = F.broadcast(session.createDataFrame(split, "node long, bin long, __node long, __lo long, __width long"))
            records, sizes = (
                x.join(finer, ["node", "bin"], "left").withColumns(
                    {"node": F.coalesce("__node", "node"), "lo": F.coalesce("__lo", "lo"), "width": F.coalesce("__width", F.lit(0).cast("long"))}
                ).drop("__node", "__lo", "__width")
                for x in (records, sizes)
            )
    starts, shard, held = [], 0, 0
    for _, node, b, w in sorted(leaves):
        if held and held + w > shard_bytes:
            shard, held = shard + 1, 0
        parts = max(1, -(-w // shard_bytes))
        starts.append((node, b, shard, parts))
        held += w
        if parts > 1:
            shard, held = shard + parts, 0
    dims = F.broadcast(session.createDataFrame(starts, "node long, bin long, first long, parts long"))
    shards = max((s + p for _, _, s, p in starts), default=1)
    return records.join(dims, ["node", "bin"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("digest"), F.col("parts"))).drop("node", "bin", "lo", "width", "first", "parts"), shards


def _record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; block digest, lengths and the HTTP head are made anew from the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    rid = "null" if record_id is None else str(record_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid} {digest}')}>",
        f"WARC-Date: {date}",
        f"X-Record-Key: {rid}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>",
            f"X-Refers-To-Key: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(
    pages: DataFrame,
    out: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    roll_bytes: int = 256 << 20,
    shard_bytes: int = 32 << 20,
    min_revisit: int = 100,
    date: str = DATE,
) -> DataFrame:
    """Write one record per row of ``pages`` under ``out`` (a folder that does not exist); returns the committed manifest.

    A task attempt writes to names of its own, so a lost executor or a speculative twin leaves garbage beside the data,
    never in it. File names and contents depend on the records alone. Renames are idempotent and run on the executors.
    """
    records = plan_records(pages, id_col, url_col, payload_col, min_revisit)
    sizes = pages.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.octet_length(F.col(payload_col).cast("string")), F.lit(0)).cast("long").alias("size"))
    sharded, shards = assign_shards(records, sizes, shard_bytes)
    sharded = sharded.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "record_id", "digest", "turn")  # a task for each shard

    order = ("shard", "record_id", "digest", "turn", "refers_to", "url", "payload")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(out)
        task = TaskContext.get()
        attempt = f"{task.stageId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        fs.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
        sink, done, key = None, [], (None, 0)

        def close():
            nonlocal sink
            sink.close()
            done.append((key[0], key[1], temp, f"shard-{key[0]:06d}-{key[1]:04d}.warc.gz", count, size, whole.hexdigest()))
            sink = None

        mark = None
        for b in batches:
            for shard, record_id, digest, turn, refers_to, url, payload in zip(*(b.column(c).to_pylist() for c in order), strict=True):
                if not turn:
                    mark = (record_id, digest, refers_to)
                    continue
                if sink is not None and (shard != key[0] or size >= roll_bytes):
                    close()
                if sink is None:
                    key = (shard, key[1] + 1 if shard == key[0] else 0)
                    temp, count, size, whole = f"_temporary/{attempt}/{key[0]}-{key[1]}", 0, 0, hashlib.sha256()
                    sink = fs.open_output_stream(f"{base}/{temp}", compression=None)
                first = mark[2] if mark and mark[:2] == (record_id, digest) else None
                data = _member(_record(record_id, url, payload, digest, first, date))
                sink.write(data)
                whole.update(data)
                count, size = count + 1, size + len(data)
        if sink is not None:
            close()
        cols = zip(*done, strict=True) if done else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    manifest = checkpointed(sharded.mapInArrow(write, MANIFEST))

    def publish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(out)
        for frame in frames:
            for r in frame.itertuples():
                if fs.get_file_info(f"{base}/{r.final}").type == pafs.FileType.NotFound:
                    fs.move(f"{base}/{r.temp}", f"{base}/{r.final}")
            yield frame

    committed = checkpointed(manifest.mapInPandas(publish, MANIFEST))
    committed.drop("temp").write.parquet(f"{out}/_manifest")
    return committed


def _stream(source) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=source) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not at a record")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8").partition(": ")
                head[name] = value
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("record without its end")
            yield head, block


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """One row per record of a committed archive, digests checked against the bytes read; one file at a time per task."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(out)
        for frame in frames:
            for name in frame["final"]:
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as source:
                    for head, block in _stream(source):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(head["X-Payload-Length"])
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: block digest differs")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                            if digest != head["WARC-Payload-Digest"].removeprefix("sha256:"):
                                raise ValueError(f"{name}: payload digest differs")
                        key, first = head["X-Record-Key"], head.get("X-Refers-To-Key")
                        rows.append((None if key == "null" else int(key), head.get("WARC-Target-URI"), size, digest, kind, int(first) if first else None))
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    files = spark.read.parquet(f"{out}/_manifest").select("shard", "final")
    shards = (files.agg(F.max("shard")).first()[0] or 0) + 1
    return files.repartitionById(shards, F.col("shard").cast("int")).select("final").mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")], dtype=object)
    for c in ("record_id", "refers_to", "payload_bytes"):
        frame[c] = frame[c].astype("Int64")
    return frame

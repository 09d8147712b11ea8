"""Readers and writers: tables, labelled corpora, logs, snapshots, evaluation reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkwell.schemas import SCHEMAS

CORPUS = ("id", "text", "expected", "category", "tags", "note")
AUDIT = "event string, scene string, target_id string, fingerprint_id string, ip string, user_agent string, decision int, reject_reason string, score int, client_ts long, server_ts long"
ACCESS = "path string, status int, method string, query string, ip string, `user-agent` string, cost double, time string"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the ten tables under ``path``, with its fixed schema; zone-less times are cast once, here."""
    schema = SCHEMAS[name]
    df = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
    lost = [f.name for f in schema if f.name not in df.columns]
    if lost:
        raise ValueError(f"{name} lacks {lost}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


Pieces = list[tuple[int, int, int]]


def balanced_ranges(low: int, high: int, rows: int, partitions: int, histogram: Callable[[int, int, int], dict[int, int]], bins: int = 1024) -> list[tuple[int, int]]:
    """Ranges [start, end) that cover ``low`` to ``high`` and hold about ``rows / partitions`` rows each.

    ``histogram(start, end, width)`` counts the rows by (value - start) div width. The whole range is counted in bins first; a bin
    that alone holds more than a partition should is counted in bins again, so ids may lie as unevenly as they like. A value
    that more rows share than that stays one range. At most ``partitions`` questions a level, of ``bins`` rows each.
    """
    most = max(1, -(-rows // partitions))
    pieces: Pieces = [(low, high + 1, rows)]
    while any(n > most and end - start > 1 for start, end, n in pieces):
        finer: Pieces = []
        for start, end, n in pieces:
            if n <= most or end - start <= 1:
                finer.append((start, end, n))
                continue
            width = -(-(end - start) // bins)
            finer += [(start + b * width, min(end, start + (b + 1) * width), k) for b, k in sorted(histogram(start, end, width).items())]
        pieces = finer
    out: list[tuple[int, int]] = []
    begin, held = low, 0
    for start, _, n in pieces:
        if held and held + n > most:
            out.append((begin, start))
            begin, held = start, 0
        held += n
    return [*out, (begin, high + 1)]


def read_jdbc(spark: SparkSession, url: str, name: str, column: str = "id", partitions: int = 64, table: str | None = None, bins: int = 1024, **options: str) -> DataFrame:
    """The table ``name`` over JDBC, read in parallel by ranges of a whole-number column that hold equally many rows.
    ``column`` and ``table`` are written as the source's SQL wants them, quoted if need be.

    The bounds come from counts that the source makes itself; rows without a value are read with the first range. Rows that
    change value meanwhile may be missed or seen twice, as with any read in several statements.
    """
    source = table or name

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()

    low, high, rows = ask(f"select min({column}) as lo, max({column}) as hi, count({column}) as n from {source}")[0]

    def histogram(start: int, end: int, width: int) -> dict[int, int]:
        bin_of = f"floor(cast({column} - {start} as double precision) / {width})"
        found = ask(f"select b, count(*) as n from (select {bin_of} as b from {source} where {column} >= {start} and {column} < {end}) t group by b")
        last = (end - start - 1) // width
        out: dict[int, int] = {}
        for b, n in found:  # doubles may put the last values of a bin into the next one, which unbalances nothing
            out[min(int(b), last)] = out.get(min(int(b), last), 0) + int(n)
        return out

    none = f"{column} is null"
    ranges = balanced_ranges(int(low), int(high), int(rows), partitions, histogram, bins) if low is not None else []
    predicates = [f"({column} >= {a} and {column} < {b})" for a, b in ranges] or [none]
    if ranges:
        predicates[0] = f"({predicates[0]} or {none})"
    df = spark.read.jdbc(url, source, predicates=predicates, properties=dict(options))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled TSV files: an exact header, ``#`` comment rows, no quoting; blank id, text or expected is an error.

    Adds ``corpus``, the file's name without its extension.
    """
    lines = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("corpus"))
    rows = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).withColumn("p", F.split("value", "\t", -1))
    header = F.col("p") == F.array(*[F.lit(c) for c in CORPUS])
    flat = rows.withColumn("h", header).select("corpus", "h", F.size("p").alias("n"), *[F.trim(F.get("p", F.lit(k))).alias(c) for k, c in enumerate(CORPUS)])
    heads = flat.groupBy("corpus").agg(F.count_if("h").alias("heads"))
    if not heads.where("heads <> 1").isEmpty():
        raise ValueError("a corpus file lacks its header")
    body = flat.where(~F.col("h"))
    if not body.where((F.col("n") != len(CORPUS)) | (F.col("id") == "") | (F.col("text") == "") | (F.col("expected") == "")).isEmpty():
        raise ValueError("a corpus row has a wrong number of columns or lacks its id, text or expectation")
    return body.select(*CORPUS, "corpus")


def read_risk_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines of risk events; the stream twin reads new files."""
    reader = (spark.readStream if stream else spark.read).schema(AUDIT)
    return reader.json(path).withColumn("ts", F.timestamp_millis("server_ts"))


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(ACCESS).json(path).withColumnRenamed("user-agent", "user_agent")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version beside the old ones and return its path; readers switch by that name, so none sees half a table."""
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return target


def write_eval_report(cases: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-case and per-group results of an evaluation as Parquet."""
    cases.write.mode("overwrite").parquet(f"{path.rstrip('/')}/cases")
    summary.write.mode("overwrite").parquet(f"{path.rstrip('/')}/summary")


def parse_schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)

"""Helpers shared by the corpus operators: table access, reliable checkpoints, Arrow row maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.functions.checkpoint import checkpointed, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_text(
    df: DataFrame,
    text_col: str,
    carry: Sequence[str],
    fields: Sequence[T.StructField],
    fn: Callable[[list[bytes | None]], dict[str, object]],
    beside: str | None = None,
) -> DataFrame:
    """Apply ``fn`` to whole texts (UTF-8 bytes, None for null), one Arrow batch at a time, without a shuffle.

    ``carry`` columns pass through; a carried column whose name is also an output field is replaced by the output. With
    ``beside``, ``fn`` gets a pair: the texts and that column's values.
    """
    names = {f.name for f in fields}
    carry = [c for c in carry if c not in names]
    kind = df.schema[text_col].dataType
    others = [c for c in carry if c != text_col]  # the text itself crosses once, as bytes
    more = [F.col(f"`{beside}`").alias("__beside")] if beside else []
    src = df.select(*[F.col(f"`{c}`") for c in others], *more, F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))
    passed = [*others, *(["__text"] if text_col in carry else [])]
    schema = T.StructType([src.schema[c] for c in passed] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000))  # what Python holds at once
        for batch in parts:
            texts = batch.column("__text").to_pylist()
            out = fn((texts, batch.column("__beside").to_pylist()) if beside else texts)
            cols = [batch.column(c) for c in passed]
            for f in fields:
                cols.append(pa.array(out[f.name], type=arrow.field(f.name).type))
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    made = src.mapInArrow(run, schema)
    text = F.col("__text").cast("string").cast(kind).alias(text_col)
    return made.select(*[text if c == text_col else F.col(f"`{c}`") for c in carry], *[F.col(f"`{f.name}`") for f in fields])


_CACHES: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object] = dict):
    """A cache of this Python worker that outlives a task. A worker keeps the one it used last, so that the operators of a
    pipeline do not fill it up between them."""
    if name not in _CACHES:
        _CACHES.clear()
        _CACHES[name] = make()
    return _CACHES[name]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node, component = smallest node.

    Alternates the two star contractions (every node points its larger neighbours at its smallest one, then its
    smaller-or-equal neighbours), which halves path lengths each round; each round is aggregated with map-side
    combining, and its result is checkpointed. Nulls and self loops are ignored; an empty input gives no rows.
    """
    nodes_of = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    cur = checkpointed(edges.where("a is not null and b is not null and a <> b").select(*nodes_of).distinct())
    last = None
    for _ in range(max_rounds):
        both = cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        big = big.where("lo <> hi").distinct()
        down = big.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("lo"), F.explode(F.array("u", "v")).alias("hi"))
        nxt = checkpointed(small.where("lo <> hi").distinct())
        n, s = nxt.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if (n, s) == last:
            break
        last, cur = (n, s), nxt
    else:
        raise RuntimeError("components did not converge")
    hi = cur.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return hi.union(hi.select(F.col("component").alias("node"), "component").distinct())

"""Materialising intermediate tables where every executor can read them."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Only a local session may do without, as it has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and cut the lineage there, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings, dots as double underscores, that hold inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def co_partitioned(df: DataFrame, key: str) -> DataFrame:
    """Materialise ``df`` dealt by ``key``, so that joins and groups by it, or by it and more, of what is made of several such
    tables need no exchange inside the next one.

    The partitioning of a checkpoint is known to later plans only if its own plan was fixed beforehand, so adaptive
    execution is off while it is written; and equal keys suffice for a join by more columns.
    """
    spark = df.sparkSession
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__requireAllClusterKeysForCoPartition="false"):
        return checkpointed(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))

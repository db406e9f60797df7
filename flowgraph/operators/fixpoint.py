"""Loops of joins to a fixpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _new_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names the folder in spark.checkpoint.dir. Where nothing is set, a session on this machine alone gets a
    temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written in the shared folder, without its lineage."""
    path = _new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared folder that grows by appended parts, so that reading it never has a longer plan."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema, self.path = like.sparkSession, like.schema, _new_path(like.sparkSession)
        self.add(like.limit(0))

    def add(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def merged(df: DataFrame) -> DataFrame:
    """df, not to be broadcast: ids that go up fit in few bytes of a file or a shuffle, and in many of the driver's memory."""
    return df.hint("merge")


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 100_000, merge: bool = False) -> DataFrame:
    """The least set of rows that holds seed and, for every part of it, step of that part.

    Semi-naive: each round steps from the last round's new rows only, so step must work row by row on its input. merge:
    known rows are never broadcast.
    """
    columns = seed.columns
    known = new = cut(seed.distinct())
    for number in range(max_rounds):
        new = cut(step(new).select(columns).distinct().join(merged(known) if merge else known, columns, "left_anti"))
        if new.isEmpty():
            return known
        known = known.union(new)
        if number % 10 == 9:
            known = cut(known)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def double_pointers(parents: DataFrame, key: list[str], up: str, max_rounds: int = 64) -> DataFrame:
    """(key, root, depth): the last of the chain of `up` pointers, in rounds of the logarithm of its length.

    parents: key (its last column is the node), up: the node above or null. The pointers must have no cycle.
    """
    *group, node = key
    now = cut(parents.select(*key, F.coalesce(up, node).alias("root"), F.when(F.col(up).isNull() | (F.col(up) == F.col(node)), 0).otherwise(1).alias("depth")))
    for _ in range(max_rounds):
        above = now.select(*group, F.col(node).alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        now = cut(now.join(above, [*group, "root"], "left").select(*key, F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce(F.col("more") > 0, F.lit(False)).alias("moved")))
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")
    raise RuntimeError("the pointers have a cycle")

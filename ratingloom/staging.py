"""Tables written between the steps of a long computation.

A written table cuts the lineage, survives the loss of an executor, keeps column pruning and
gives the planner true sizes for the next step. Written tables live in a folder that all executors
reach: the one given, else ``spark.checkpoint.dir``, else a folder beside the session's warehouse tables (an error on a
cluster whose warehouse is a local folder).
"""

from __future__ import annotations

import gc
import uuid

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(checkpoint: str | None, warehouse: str, master: str) -> str:
    """The checkpoint folder, else one in the warehouse, which on a cluster must not lie on one machine."""
    if checkpoint:
        return checkpoint.rstrip("/")
    if not master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
        raise RuntimeError(f"set spark.checkpoint.dir: executors do not see each other's files below {warehouse}")
    return warehouse.rstrip("/") + "/_staged"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; no setting is changed."""
    conf = spark.conf
    return shared_folder(conf.get("spark.checkpoint.dir", None), conf.get("spark.sql.warehouse.dir"), conf.get("spark.master"))


def fresh_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    return f"{folder or work_dir(spark)}/ratingloom/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """The written tables of one run. Its owner removes them once the results have been used."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.root = fresh_path(spark, "run", folder)
        self._count = 0

    def path(self, label: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{label}"

    def write(self, df: DataFrame, label: str, **how: str) -> str:
        path = self.path(label)
        df.write.parquet(path, **how)
        return path

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        return self.spark.read.schema(df.schema).parquet(self.write(df, label))

    def stage_observed(self, df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict[str, Any]]:
        """The same, with aggregates of all rows that are taken while they are written."""
        seen = Observation()
        observed = df.observe(seen, *[figure.alias(name) for name, figure in figures.items()])
        return self.stage(observed, label), seen.get

    def remove(self) -> None:
        remove_path(self.spark, self.root)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()


def stage(df: DataFrame, label: str, space: Workspace | None = None) -> DataFrame:
    """Write ``df`` once, into ``space`` or a run of its own, and return the written table."""
    return (space or Workspace(df.sparkSession)).stage(df, label)


def in_turn(key: Column, turn: int, turns: int) -> Column:
    """Whether the key belongs to that turn, by a hash of its own: others deal out blocks, slices and partitions."""
    return F.pmod(F.xxhash64(key, F.lit("turn")), F.lit(turns)) == turn if turns > 1 else F.lit(True)


def in_turns(turns: int, label: str, part: Callable[[int], DataFrame], space: Workspace | None = None) -> DataFrame:
    """The rows of ``part(0)`` to ``part(turns - 1)``: each is written and rid of its shuffle files before the next begins.

    So the disk holds the shuffles of one part at a time. A single part is not written.
    """
    if turns <= 1:
        return part(0)
    written = []
    for turn in range(turns):
        written.append(stage(part(turn), label, space))
        # Spark removes the files of a shuffle once the collectors of Python and of the JVM have seen that nobody refers to it.
        gc.collect()
        written[-1].sparkSession._jvm.System.gc()
    return reduce(DataFrame.unionByName, written)

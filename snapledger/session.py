"""Shared scratch folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("snapledger.scratch.dir", None)
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="snapledger-")
        spark.conf.set("snapledger.scratch.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/snapledger/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is read more than once and is dear to compute (content hashing, a join of
    two large tables): later steps scan only the columns they need, the planner sees true sizes,
    and a lost executor costs a re-read instead of a recomputation. ``by`` names columns, of few values,
    whose parts are to be read by themselves. Compressed closely, as the folder counts as scratch disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*(by or [])).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)

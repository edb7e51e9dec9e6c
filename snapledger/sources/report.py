"""File table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import time_text


def report_columns(table: DataFrame, names: list[str], zone: str = "UTC") -> DataFrame:
    return table.select(
        F.col("file_index").alias("file index"),
        *[F.col(f"`{n}`") for n in names],
        "size",
        time_text(F.col("mtime_ns"), zone).alias("time"),
        "hash",
        F.col("first_path").alias("first path"),
        F.col("first_source").alias("first source"),
    )


def write_file_table(table: DataFrame, names: list[str], path: str, zone: str = "UTC") -> None:
    """Write a file table (see ``operators.verify.file_table``) as CSV parts with a header.

    Quotes inside a value are doubled.
    """
    report = report_columns(table, names, zone)
    report.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_file_table(spark, names: list[str], path: str) -> DataFrame:
    counts = ", ".join(f"`{n}` bigint" for n in names)
    schema = (
        f"`file index` bigint, {counts}, size bigint, time string, hash string, "
        "`first path` string, `first source` string"
    )
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)

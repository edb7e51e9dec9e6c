"""Directories left empty after a deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import parent_chain, parent_path


def empty_directories(inventory: DataFrame, deleted: DataFrame) -> DataFrame:
    """Directories (snapshot, file) with no surviving entry anywhere below them.

    ``inventory`` has (snapshot, file, type), ``deleted`` (snapshot, file). Survivors are reduced
    to their distinct parent directories before the ancestors are listed.
    """
    place = ["snapshot", "file"]
    is_dir = F.col("type") == "directory"
    survivors = inventory.where(~is_dir).join(deleted.select(*place), place, "left_anti")
    parents = survivors.select("snapshot", parent_path(F.col("file")).alias("file")).distinct()
    chain = F.concat(parent_chain(F.col("file")), F.array("file"))
    in_use = parents.select("snapshot", F.explode(chain).alias("file")).distinct()
    return inventory.where(is_dir).select(*place).join(in_use, place, "left_anti")

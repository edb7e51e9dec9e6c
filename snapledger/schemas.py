"""Table schemas and fixed limits."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNATURE = ["source", "size", "mtime_ns"]
RECORD = ["source", "size", "mtime_ns", "hash", "file"]

MANIFEST = T.StructType(
    [
        T.StructField("snapshot", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("hash", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("blob_id", T.StringType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ns", T.LongType()),
        T.StructField("inode", T.LongType()),
        T.StructField("device", T.LongType()),
        T.StructField("nlink", T.LongType()),
    ]
)

SNAPSHOT_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("generation", T.LongType()),
        T.StructField("bases", T.ArrayType(T.LongType())),
        T.StructField("without", T.ArrayType(T.StringType())),
    ]
)

# Links one stored file can carry, the smallest size that is linked at all, and the
# path length from which a warning is due, per platform.
LINUX_MAX_LINKS = 65000
LINUX_MIN_BYTES = 0
LINUX_MAX_PATH = 4096
WINDOWS_MAX_LINKS = 1023
WINDOWS_MIN_BYTES = 513
WINDOWS_MAX_PATH = 260

# Row states of a run. The first three store a row, the others leave it out.
IMPORT = "import"
DUP_LINK = "dup_link"
DUP_COPY = "dup_copy"
SKIP = "skip"
CONFLICT = "conflict"
FAILED = "failed"
UNSTABLE = "unstable"
DELETE = "delete"
STORED = [IMPORT, DUP_LINK, DUP_COPY]

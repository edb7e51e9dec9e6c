"""Deciding, for each kept row, whether its content is imported, linked or copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import (
    DUP_COPY,
    DUP_LINK,
    FAILED,
    IMPORT,
    LINUX_MAX_LINKS,
    LINUX_MIN_BYTES,
)
from ..session import stage
from .lookup import BLOB_ORDER, blobs, content_capacity, hash_is_set
from .skew import BROADCAST_ROWS, HOT_ROWS, attach, bucket, count_rows, cut_to, running_before, running_total


def number_per_hash(
    files: DataFrame, held: DataFrame, any_hot: bool, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``files`` with ``nth`` within the hash and the columns of ``held`` but ``n_new``.

    ``held`` has a line for each hash with something to add, and for every hash with more than
    ``hot_rows`` new rows. Rows are numbered by (snapshot, bucket of the file, file); ``any_hot``
    only picks the plan: one shuffle of the rows, or numbering in parts.
    """
    by_hash = held.drop("n_new", "n_room")
    if not any_hot:
        order = Window.partitionBy("hash").orderBy("snapshot", bucket("file"), "file")
        numbered = files.withColumn("nth", F.row_number().over(order).cast("long"))
        return numbered.join(by_hash, "hash", "left")
    return _number_in_parts(files, held, hot_rows)


def _number_in_parts(files: DataFrame, held: DataFrame, hot_rows: int) -> DataFrame:
    """The same numbers when some hashes have more rows than one task should sort.

    Their rows are numbered inside (snapshot, bucket), thousands of independent parts, and shifted
    by the counts of the earlier parts: of earlier snapshots, of which a hash has one line each, and
    of the snapshot's earlier buckets. The limit rises with the number of rows, so the table of hot
    hashes stays below ``BROADCAST_ROWS`` lines. Per-hash values travel with the parts, so no join
    has a hot hash as its group either.
    """
    by_hash = held.drop("n_new", "n_room")
    total = held.agg(F.coalesce(F.sum(F.when(F.col("n_new") > hot_rows, F.col("n_new"))), F.lit(0))).first()[0]
    limit = max(hot_rows, total // BROADCAST_ROWS)
    hot = held.where(F.col("n_new") > limit)
    flags = F.broadcast(hot.select("hash", F.lit(True).alias("_hot")))
    rows = files.join(flags, "hash", "left").withColumn(
        "_part", F.when(F.col("_hot"), F.concat_ws("/", "snapshot", bucket("file"))).otherwise("")
    )
    sizes = count_rows(rows.where("_hot"), ["hash", "snapshot", "_part"], "_rows")
    per_snapshot = sizes.groupBy("hash", "snapshot").agg(F.sum("_rows").alias("_sum"))
    earlier = per_snapshot.withColumn("_earlier", running_before("_sum", ["hash"], ["snapshot"]))
    parts = (
        sizes.withColumn("_inside", running_before("_rows", ["hash", "snapshot"], ["_part"]))
        .join(earlier.drop("_sum"), ["hash", "snapshot"])
        .select("hash", "_part", (F.col("_earlier") + F.col("_inside")).alias("_before"))
        .join(F.broadcast(hot.select(*by_hash.columns)), "hash")
    )
    rest = held.where(F.col("n_new") <= limit).select(*by_hash.columns)
    places = parts.unionByName(rest.withColumn("_part", F.lit("")), allowMissingColumns=True)

    order = Window.partitionBy("hash", "_part").orderBy("snapshot", bucket("file"), "file")
    numbered = rows.withColumn("_local", F.row_number().over(order)).join(
        places, ["hash", "_part"], "left"
    )
    nth = F.coalesce("_before", F.lit(0)) + F.col("_local")
    carried = [c for c in by_hash.columns if c != "hash"]
    return numbered.select(*files.columns, nth.cast("long").alias("nth"), *carried)


def assign_blobs(
    files: DataFrame,
    manifest: DataFrame,
    run: str,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``action`` and ``blob_id`` to the kept rows of a run.

    New content is an ``import``; known content a ``dup_link`` to a blob with room, newest blob
    first; ``dup_copy`` where the file is below ``min_bytes`` or all blobs are at ``max_links``, and
    such a copy at the limit then takes the next links. ``run`` is a name no earlier run has used;
    it keeps new blob ids apart. With ``stored`` (see ``blobs``), rows whose only blobs are gone are
    ``failed``, as are rows without a hash. With a column ``prior_blob`` (see ``signature_lookup``)
    rows link to that blob first, as long as it has room (see ``follow_records``).

    What the manifest holds of the new hashes is written to the shared folder first (one line per
    hash), so the manifest is scanned once and the plan can follow what was found: numbering in
    parts only if a hash is hot, filling of older blobs only if one runs over.
    """
    # Counted, cut to, and numbered: computed once.
    files = stage(files, "files")
    has_hash = hash_is_set(F.col("hash"))
    decided = assign_hashed(
        files.where(has_hash), manifest, run, max_links, min_bytes, stored, hot_rows
    )
    unhashed = files.where(~has_hash).withColumn("action", F.lit(FAILED))
    unhashed = unhashed.withColumn("blob_id", F.lit(None).cast("string"))
    return decided.unionByName(unhashed.select(*decided.columns))


def assign_hashed(
    files: DataFrame,
    manifest: DataFrame,
    run: str,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    stored: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``assign_blobs`` for rows that all have a hash."""
    follow = "prior_blob" in files.columns
    if follow:
        files = files.drop("blob_id")
    manifest = cut_to(manifest, files, ["hash"])
    per_blob = blobs(manifest, max_links, min_bytes, stored)
    if not follow:
        return assign_by_hash(files, per_blob, run, max_links, min_bytes, hot_rows)
    # Read twice; blobs of other contents than the run's are not needed.
    per_blob = stage(per_blob.join(files.select("hash").distinct(), "hash", "left_semi"), "blobs")
    linked, rest, left = follow_records(files, per_blob, min_bytes)
    decided = assign_by_hash(rest, left, run, max_links, min_bytes, hot_rows)
    return decided.unionByName(linked.select(*decided.columns))


def follow_records(
    files: DataFrame, per_blob: DataFrame, min_bytes: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that link to the blob of the very record their signature was found in.

    Returns these rows with ``action`` and ``blob_id``, the rows that are left, and ``per_blob`` with
    the links taken off. Where more rows want a blob than it has room for, the first ones by
    (snapshot, bucket of the file, file) get it, and only those rows are numbered. Every row that
    wants a blob has a stored record in it, so a blob's group is never above its links.
    """
    wants = F.coalesce(F.col("prior_blob").isNotNull() & (F.col("size") >= min_bytes), F.lit(False))
    wanting = files.where(wants)
    wanting = wanting.withColumn("blob_id", F.col("prior_blob")).drop("prior_blob")
    place = ["hash", "blob_id"]
    room = per_blob.where("spare > 0").select(*place, "spare")
    demand = stage(count_rows(wanting, place, "n_want").join(room, place), "demand")
    enough = demand.where("n_want <= spare").select(*place)
    short = demand.where("n_want > spare").select(*place, "spare")

    order = Window.partitionBy(*place).orderBy("snapshot", bucket("file"), "file")
    in_line = wanting.join(short, place).withColumn("nth", F.row_number().over(order))
    linked = wanting.join(enough, place, "left_semi").unionByName(
        in_line.where("nth <= spare").drop("nth", "spare")
    )
    refused = in_line.where("nth > spare").drop("nth", "spare")
    roomless = wanting.join(demand.select(*place), place, "left_anti")
    rest = files.where(~wants).drop("prior_blob").unionByName(refused.unionByName(roomless).drop("blob_id"))

    taken = demand.select(*place, F.least("n_want", "spare").alias("taken"))
    left = per_blob.join(taken, place, "left").withColumn("spare", F.col("spare") - F.coalesce("taken", F.lit(0)))
    return linked.withColumn("action", F.lit(DUP_LINK)), rest, left.drop("taken")


def assign_by_hash(
    files: DataFrame,
    per_blob: DataFrame,
    run: str,
    max_links: int = LINUX_MAX_LINKS,
    min_bytes: int = LINUX_MIN_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows in order of their hash on its blobs with room, newest first."""
    counted = count_rows(files, ["hash"], "n_new").join(content_capacity(per_blob), "hash", "left")
    kept = F.col("present").isNotNull() | (F.col("n_new") > hot_rows)
    columns = ["hash", "n_new", "n_room", "spare", "present", "room"]
    held = stage(counted.where(kept).select(*columns), "held")
    # rows past the newest blob's room and within that of older blobs
    past_newest = (F.col("n_new") > F.col("room.spare")) & (F.col("spare") > F.col("room.spare"))
    found = held.agg(
        F.max(F.col("n_new") > hot_rows).alias("hot"), F.max(past_newest).alias("past_newest")
    ).first()
    numbered = number_per_hash(files, held, bool(found.hot), hot_rows)

    small = F.col("size") < min_bytes
    known = F.col("present").isNotNull()
    gone = known & ~F.col("present")
    over = F.col("nth") - F.coalesce("spare", F.lit(0)) - 1
    beyond = over >= 0
    action = (
        F.when(gone, FAILED)
        .when(~known & (F.col("nth") == 1), IMPORT)
        .when(small | (beyond & (over % max_links == 0)), DUP_COPY)
        .otherwise(DUP_LINK)
    )
    in_newest = F.coalesce(F.col("nth") <= F.col("room.spare"), F.lit(False))
    in_older = ~small & ~F.coalesce(gone, F.lit(False)) & ~beyond & ~in_newest
    new_id = F.concat_ws("#", F.lit(run), "hash", F.expr(f"(nth - coalesce(spare, 0) - 1) div {max_links}"))
    own_id = F.concat(F.lit(f"{run}#"), "hash", F.lit("@"), "snapshot", F.lit("/"), "file")
    blob = (
        F.when(gone, None)
        .when(small, own_id)
        .when(beyond, new_id)
        .when(in_newest, F.col("room.blob_id"))
    )
    columns = [*[c for c in files.columns if c != "blob_id"], "action", "blob_id"]
    decided = numbered.withColumn("action", action).withColumn("blob_id", blob)
    if not found.past_newest:
        return decided.select(*columns)
    need = held.where(past_newest).select("hash", "n_new", "n_room")
    slots = older_slots(per_blob.where("spare > 0"), need, hot_rows)
    waiting = decided.where(in_older).drop("blob_id").join(slots, ["hash", "nth"])
    direct = decided.where(~in_older).select(*columns)
    return direct.unionByName(waiting.select(*columns))


def older_slots(per_blob: DataFrame, need: DataFrame, hot_rows: int) -> DataFrame:
    """(hash, nth, blob_id) for numbers that fall to blobs after the newest one.

    One line per link that will be made, so there are never more of them than new rows.
    """
    wanted = attach(per_blob, need, ["hash"], ["blob_id"], "n_room", hot_rows)
    open_blobs = wanted.where("n_new is not null")
    before = running_total(open_blobs, ["hash"], BLOB_ORDER, "blob_id", "spare", "before")
    used = before.where((F.col("before") > 0) & (F.col("before") < F.col("n_new")))
    last = F.least(F.col("before") + F.col("spare"), F.col("n_new"))
    return used.select("hash", "blob_id", F.explode(F.sequence(F.col("before") + 1, last)).alias("nth"))

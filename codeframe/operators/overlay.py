"""Layered symbol store: base < branch < working < ai, with tombstones and file moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYERS = ("base", "branch", "working", "ai")


def last_writes(writes: DataFrame) -> DataFrame:
    """The last state of every (layer, hash); aggregated before the shuffle."""
    rest = [c for c in writes.columns if c not in ("layer", "hash")]
    ordered = F.struct("seq", *[c for c in rest if c != "seq"])
    return writes.groupBy("layer", "hash").agg(F.max(ordered).alias("x")).select("layer", "hash", *[F.col("x")[c].alias(c) for c in rest])


def resolve(writes: DataFrame) -> DataFrame:
    """The top layer's state per hash, tombstones included."""
    last = last_writes(writes)
    rest = [c for c in last.columns if c not in ("hash", "layer")]
    return last.groupBy("hash").agg(F.max(F.struct("layer", *rest)).alias("x")).select("hash", F.col("x.layer").alias("layer"), *[F.col("x")[c].alias(c) for c in rest])


def active(writes: DataFrame) -> DataFrame:
    return resolve(writes).where("state = 'active'")


def layer_stats(writes: DataFrame) -> DataFrame:
    return last_writes(writes).groupBy("layer").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "deleted").alias("deleted"))


def file_symbols(writes: DataFrame, file: str) -> DataFrame:
    return active(writes).where(F.col("file") == file)


def move_path(moves: Column, path: Column) -> Column:
    """Apply an ordered array of (from, to) to a path."""
    return F.aggregate(moves, path, lambda p, m: F.when(p == m["src"], m["dst"]).otherwise(p))


def resolve_paths(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths after all moves, layers from below, then in their order.  Moves are few: one row of all is made."""
    one = moves.agg(F.array_sort(F.collect_list(F.struct("layer", "seq", "src", "dst"))).alias("moves"))
    return files.join(one, F.lit(True)).select("file", move_path(F.coalesce("moves", F.array()), F.col("file")).alias("now"))


def rebase(overlay: DataFrame, base: DataFrame) -> DataFrame:
    """How each overlay symbol meets a new base: dropped (equal), conflict (changed) or preserved (only in the overlay)."""
    b = base.select("hash", F.col("content").alias("base_content"))
    verdict = F.when(F.col("base_content").isNull() & F.col("_in").isNull(), "preserved").when(F.col("content").eqNullSafe(F.col("base_content")), "dropped").otherwise("conflict")
    return overlay.join(b.withColumn("_in", F.lit(1)), "hash", "left").select("hash", verdict.alias("outcome"))


def mark_deleted(writes: DataFrame, files: DataFrame, layer: int) -> DataFrame:
    """Tombstones in a layer for every active symbol of the given files, with the next sequence numbers per hash."""
    gone = active(writes).join(files, "file", "left_semi")
    return gone.withColumn("layer", F.lit(layer).cast("long")).withColumn("state", F.lit("deleted")).withColumn("seq", F.col("seq") + 1)


def running_state(writes: DataFrame) -> DataFrame:
    """Each write with the number of writes of its hash up to it."""
    w = W.partitionBy("hash").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return writes.withColumn("version", F.count("*").over(w))

"""Captured git output as tables; nothing here runs git."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHANGE = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed"}


def name_status(lines: DataFrame) -> DataFrame:
    """Lines of ``--name-status -M``: path, old_path, change_type; renames and copies have both paths."""
    p = F.split("value", "\t")
    letter = F.substring(p[0], 1, 1)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in _CHANGE.items() for x in kv]), letter)
    two = F.size(p) >= 3
    rows = lines.where(F.contains("value", F.lit("\t"))).select(F.when(two, F.try_element_at(p, F.lit(3))).otherwise(p[1]).alias("path"), F.when(two, p[1]).alias("old_path"), kind.alias("change_type"))
    return rows.where("change_type is not null")


def log_lines(lines: DataFrame, separator: str = "\x1f") -> DataFrame:
    """Commits as sha, short sha, subject, author and date between a separator that no subject has."""
    p = F.split("value", separator, 5)
    names = ("sha", "short_sha", "subject", "author", "date")
    return lines.where(F.size(p) == 5).select(*[p[i].alias(n) for i, n in enumerate(names)])


def numstat(lines: DataFrame) -> DataFrame:
    """path, added and removed lines; binary files ('-') have none."""
    p = F.split("value", "\t", 3)
    n = lambda i: F.coalesce(p[i].try_cast("long"), F.lit(0).cast("long"))
    return lines.where(F.size(p) == 3).select(p[2].alias("path"), n(0).alias("added"), n(1).alias("removed"))


def staleness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row each side (sha, status_hash): stale if there is no index, or either differs; without git (null sha) modified times decide."""
    i, c = indexed.alias("i"), current.alias("c")
    state = F.when(F.col("i.sha").isNull() & F.col("c.sha").isNull(), "check_times").when(F.col("i.sha").eqNullSafe(F.col("c.sha")) & F.col("i.status_hash").eqNullSafe(F.col("c.status_hash")), "fresh").otherwise("stale")
    return c.join(i, F.lit(True), "left").select(state.alias("state"))

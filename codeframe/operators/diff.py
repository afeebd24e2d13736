"""Differences of two versions, drift, and change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.functions import rules
from codeframe.operators.search import page


def added_removed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Set difference both ways: the key columns and change = added or removed."""
    b, a = before.select(*key).distinct(), after.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("removed")))


def semantic_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer comparison by key: change, the changed columns, and the change of risk."""
    b = before.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.col("risk").alias("b_risk"), F.lit(1).alias("_b"))
    a = after.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.col("risk").alias("a_risk"), F.lit(1).alias("_a"))
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in columns])), ",")
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(changed != "", "modified").otherwise("same")
    risk = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), rules.risk_rank(F.col("a_risk")) - rules.risk_rank(F.col("b_risk"))).otherwise(0)
    return b.join(a, key, "full").select(key, state.alias("change"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), changed).otherwise("").alias("columns"), risk.cast("long").alias("risk_change"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("files"))


def by_language(changes: DataFrame, limit: int = 10) -> DataFrame:
    return page(changes.groupBy("language").agg(F.count("*").alias("files")), [F.desc("files"), "language"], limit)


def drift(changes: DataFrame, total: DataFrame) -> DataFrame:
    """changed, total, percent and the strategy to catch up; one row."""
    c = changes.agg(F.count_if(F.col("change_type") != "same").alias("changed"))
    t = total.agg(F.count("*").alias("total"))
    both = c.join(t, F.lit(True))
    return both.select("changed", "total", F.round(rules.drift_percent(F.col("changed"), F.col("total")), 6).alias("percent"), rules.update_strategy(F.lit(True), F.lit(False), F.col("changed"), F.col("total")).alias("strategy"))


def evolution(steps: DataFrame) -> DataFrame:
    """Per step: edges, and edges that the step before did not have."""
    prev = steps.select((F.col("step") + 1).alias("step"), "caller", "callee").distinct().withColumn("old", F.lit(1))
    e = steps.distinct().join(prev, ["step", "caller", "callee"], "left")
    return e.groupBy("step").agg(F.count("*").alias("edges"), F.count_if(F.col("old").isNull()).alias("new_edges"))

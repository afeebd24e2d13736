"""Comparing repositories by feature vectors and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.functions import hashing

LANGS = ("de", "en", "es", "fr")


def features(repos: DataFrame) -> DataFrame:
    """Each repository's size, mean file, largest file and language shares, each scaled to 0..1 over all repositories."""
    raw = repos.select("repo", F.col("files").cast("double").alias("f0"), (F.col("chars") / F.col("files")).alias("f1"), F.col("largest").cast("double").alias("f2"), *[(F.col(x) / F.col("files")).alias(f"f{3 + i}") for i, x in enumerate(LANGS)])
    names = [c for c in raw.columns if c != "repo"]
    ends = raw.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))])
    return raw.join(ends, F.lit(True)).select("repo", F.array(*[hashing.min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in names]).alias("v"))


def pairs(repos: DataFrame) -> DataFrame:
    """Every two repositories of a stated, small set: cosine of the features and chi-squared distance of languages."""
    v = features(repos).join(repos.select("repo", F.array(*[F.col(x) / F.col("files") for x in LANGS]).alias("share")), "repo")
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, F.col("a.repo") < F.col("b.repo"))
    return j.select(F.col("a.repo").alias("a"), F.col("b.repo").alias("b"), F.round(hashing.cosine(F.col("a.v"), F.col("b.v")), 6).alias("cosine"), F.round(hashing.chi_squared(F.col("a.share"), F.col("b.share")), 6).alias("chi_squared"))

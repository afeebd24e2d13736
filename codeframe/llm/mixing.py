"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised.  The exponent
is found by bisection (33 cuts a round, all in one aggregation) so that the mix
meets a target entropy or keeps the most repeated source within a limit.  The
weights are then realised: every pass over a source is a permutation by hash, whole
passes are drawn, and the last one is cut where the source's quota of tokens ends.
Draws go to blocks of a token budget, each with every source in its share.

Prefix sums run in two steps, over hash buckets of a source and inside a bucket, so
a source with a third of all rows is spread over tasks.  Texts are never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeframe.llm._common import write_shared

#: Rows of a hash bucket, about; and up to how many sources the table of quotas is broadcast.
BUCKET_ROWS, BROADCAST_SOURCES = 4096, 50_000


@dataclass(frozen=True)
class Target:
    """What the mix should meet.  Both may be set: the limit then wins over the entropy."""

    max_repeats: float | None = 1.25
    entropy: float | None = None  # nats
    budget: int | None = None  # tokens to draw; default: as many as the corpus has
    block_tokens: int = 1 << 22
    seed: int = 17


def words(text: Column) -> Column:
    """Tokens of a text: words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _hash(seed: int, turn: Column, doc_id: Column, kt: Column) -> Column:
    """63 bits that order a pass; rows of equal id and text share them."""
    return F.xxhash64(F.lit(seed), turn.cast("int"), doc_id, kt).bitwiseAND((1 << 63) - 1)


def _kt(text: Column) -> Column:
    """64 bits of the text; they only order rows of one id, so two texts that shared them would merely be drawn alike."""
    return F.xxhash64(F.lit(3), F.coalesce(text.cast("string"), F.lit("")))


def exponent(totals: DataFrame, target: Target, tokens: int, budget: int) -> float:
    """The exponent in [0, 1]; 1 keeps the natural shares, 0 makes all sources equal.

    With an entropy: the largest exponent whose mix has at least it.  With a limit: the
    smallest whose most repeated source is drawn at most so often.  Where no exponent
    can do it, the nearest end.
    """
    share = totals.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(float(tokens))).alias("lp"))

    def search(meets, falling: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(6):
            cuts = [lo + (hi - lo) * k / 32 for k in range(33)]
            x = F.col("x")
            got = (
                share.select("lp", F.explode(F.array(*map(F.lit, cuts))).alias("x"))
                .groupBy("x")
                .agg(F.sum(F.exp(x * F.col("lp"))).alias("z"), F.sum(F.exp(x * F.col("lp")) * F.col("lp")).alias("s"), F.max(F.exp((x - 1) * F.col("lp"))).alias("m"))
                .collect()
            )
            by = {r.x: meets(r) for r in got}
            good = [c for c in cuts if by.get(c, False)]
            if not good:
                return 0.0 if falling else 1.0
            best = max(good) if falling else min(good)
            step = (hi - lo) / 32
            lo, hi = (best, min(1.0, best + step)) if falling else (max(0.0, best - step), best)
        return lo if falling else hi

    out = 1.0
    if target.entropy is not None:
        out = search(lambda r: math.log(r.z) - r.x * r.s / r.z >= target.entropy, True)
    if target.max_repeats is not None:
        least = search(lambda r: budget / tokens * r.m / r.z <= target.max_repeats, False)
        out = max(out, least) if target.entropy is not None else least
    return out


def draws(docs: DataFrame, target: Target = Target(), source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """All draws of all rows, and the plan per source.

    Draws: doc_id, kt, source, n_tokens, pass, taken, block, order_key.  Plan: source, tokens,
    rows, weight, quota, whole (passes), cut (rows of a further pass whose hash is below).
    """
    rows = write_shared(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _kt(F.col("text")).alias("kt"), F.col(source_col).cast("string").alias("source"), words(F.col("text")).alias("n_tokens")),
        "mix-rows",
    )
    totals = write_shared(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-totals")
    all_ = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    tokens, budget = int(all_.t), int(target.budget if target.budget is not None else all_.t)
    x = exponent(totals, target, tokens, budget) if tokens else 1.0
    z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(max(tokens, 1))), F.lit(x)))).first()[0] or 1.0
    some = F.col("tokens") > 0
    weight = F.when(some, F.pow(F.col("tokens") / F.lit(float(max(tokens, 1))), F.lit(x)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = (
        totals.withColumn("weight", weight)
        .withColumn("quota", F.round(F.col("weight") * budget).cast("long"))
        # rows without any token cost nothing: drawn once
        .withColumn("whole", F.when(some, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("int"))
        .withColumn("rest", F.when(some, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(F.lit(-1)))
        .withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long"))
    )
    plan = write_shared(plan, "mix-plan")
    side = F.broadcast(plan.withColumnRenamed("source", "_s")) if all_.n <= BROADCAST_SOURCES else plan.withColumnRenamed("source", "_s")
    each = rows.join(side, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "kt", "source", "n_tokens", "tokens", "quota", "whole", "rest", "buckets", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("pass")
    )
    each = each.withColumn("h", _hash(target.seed, F.col("pass"), F.col("doc_id"), F.col("kt"))).withColumn("bucket", F.shiftright(F.shiftright("h", 32) * F.col("buckets"), 31))
    sums = each.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = sums.withColumn("before", F.sum("held").over(W.partitionBy("source", "pass").orderBy("bucket")) - F.col("held")).drop("held")
    inside = F.sum("n_tokens").over(W.partitionBy("source", "pass", "bucket").orderBy("h", "doc_id", "kt", "n_tokens").rowsBetween(W.unboundedPreceding, 0))
    e, b = each.withColumn("inside", inside).alias("e"), before.alias("b")
    placed = e.join(b, F.col("e.source").eqNullSafe(F.col("b.source")) & (F.col("e.pass") == F.col("b.pass")) & (F.col("e.bucket") == F.col("b.bucket"))).select("e.*", "b.before")
    upto = F.col("before") + F.col("inside")
    n_blocks = max(1, -(-budget // target.block_tokens))
    start = F.col("pass") * F.col("tokens") + upto - F.col("n_tokens")
    out = placed.select(
        "doc_id", "kt", "source", "n_tokens", F.col("pass").cast("int").alias("pass"), "h",
        ((F.col("pass") < F.col("whole")) | (upto <= F.col("rest"))).alias("taken"),
        F.when(F.col("quota") > 0, F.least(F.floor(start / F.col("quota") * n_blocks), F.lit(n_blocks - 1))).otherwise(0).cast("long").alias("block"),
        F.xxhash64(F.lit(target.seed + 1), "pass", "doc_id", "kt").alias("order_key"),
    )
    return out, plan


def mix(docs: DataFrame, target: Target = Target(), source_col: str = "source") -> DataFrame:
    """The drawn rows: doc_id, source, n_tokens, pass, block, order_key.

    A training run reads blocks in order, each sorted by ``order_key``.  A null source is
    a source of its own; null text has no tokens; rows of a source without tokens are
    drawn once; null ids and repeated rows are drawn like others; an empty table gives none.
    """
    out, _ = draws(docs, target, source_col)
    return out.where("taken").select("doc_id", "source", "n_tokens", "pass", "block", "order_key")


def drawn_rows(docs: DataFrame, target: Target = Target(), source_col: str = "source") -> DataFrame:
    """``docs`` as the mix draws them: a row for each draw, all columns as they were, texts not shuffled."""
    out, plan = draws(docs, target, source_col)
    # the last pass takes rows in the order of their hash: the first one left out is the cut
    cuts = out.where("not taken").groupBy("source").agg(F.min("h").alias("cut"))
    p, c = plan.alias("p"), cuts.alias("c")
    known = write_shared(p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(F.col("p.source").alias("__cf_s"), F.col("p.whole").alias("__cf_whole"), F.coalesce("c.cut", F.lit((1 << 63) - 1)).alias("__cf_cut"), F.col("p.tokens").alias("__cf_tokens")), "mix-cuts")
    side = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    last = _hash(target.seed, F.col("__cf_whole"), F.col("doc_id").cast("long"), _kt(F.col("text")))
    times = F.when(F.col("__cf_tokens") > 0, F.col("__cf_whole") + (last < F.col("__cf_cut")).cast("int")).otherwise(1)
    joined = docs.join(side, F.col(source_col).cast("string").eqNullSafe(F.col("__cf_s"))).withColumn("__cf_n", times).where("__cf_n > 0")
    return joined.withColumn("__cf_i", F.explode(F.sequence(F.lit(1), F.col("__cf_n")))).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Call-graph operators over edges (caller, callee)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.operators.search import page


def fan(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """fan_in and fan_out of every symbol; one pass over the edges before the join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("callee").alias("hash"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("caller").alias("hash"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    degrees = ends.groupBy("hash").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return symbols.join(degrees, "hash", "left").fillna(0, ["fan_in", "fan_out"])


def reverse(edges: DataFrame, externals: bool = False) -> DataFrame:
    out = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), *[c for c in edges.columns if c not in ("caller", "callee")])
    return out if externals else out.where(~F.col("caller").startswith("ext:"))


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(hash, depth): what callers lead to from the roots in 1..depth steps, with the least number of steps.

    A root that is reached again counts.  Each level joins a frontier without what was seen; from
    the third on levels are checkpointed, so that none is derived again from all before it.
    """
    from codeframe.operators.incremental import cut_lineage

    frontier, seen = roots.select("hash").distinct(), None
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["hash"] == edges["caller"]).select(F.col("callee").alias("hash")).distinct()
        if seen is not None:
            step = step.join(seen.select("hash"), "hash", "left_anti")
        step = step.withColumn("depth", F.lit(d).cast("long"))
        if d >= 2 and d < depth:
            step = cut_lineage(step)
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("hash")
    return seen


def callers(edges: DataFrame, target: str, depth: int = 3) -> DataFrame:
    """Transitive callers of one symbol with the least distance, up to three levels."""
    spark = edges.sparkSession
    return reach(reverse(edges), spark.createDataFrame([(target,)], "hash string"), min(depth, 3))


def trace(edges: DataFrame, target: str, depth: int, direction: str = "out") -> DataFrame:
    """Edges met from nodes at most ``depth`` steps away: caller, callee, level.

    Nodes at the last depth are expanded too, so their neighbours appear as ends.
    """
    spark, start = edges.sparkSession, [(target,)]
    out = []
    for way in ("out", "in") if direction == "both" else (direction,):
        g = edges if way == "out" else reverse(edges, True)
        root = spark.createDataFrame(start, "hash string")
        near = root.withColumn("depth", F.lit(0).cast("long"))
        if depth:
            near = near.unionByName(reach(g, root, depth).where(F.col("hash") != target))
        met = near.join(g, near["hash"] == g["caller"]).select("caller", "callee", F.col("depth").alias("level"))
        out.append(met if way == "out" else met.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"), "level"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1]).groupBy("caller", "callee").agg(F.min("level").alias("level"))


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """All simple cycles of 2..longest nodes, each once, from its least node on: path joined by '>' and its length.

    A cycle is cut in two at its least node and opposite it: as many steps lead from there as lead
    back.  In odd cycles an edge is between the two; the callees of where a path from the root ends
    go to the root as one list and are held against the nodes that lead back to it, so that paths
    of one step more are never written.  Nodes are numbered in the order of their names.
    """
    from codeframe.operators.incremental import cut_lineage

    named = edges.where("caller <> callee").select("caller", "callee")
    nodes = cut_lineage(named.select(F.col("caller").alias("name")).union(named.select("callee")).distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()))
    of = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    e = cut_lineage(named.join(of("caller"), "caller").join(of("callee"), "callee").select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee")))
    # forward: root and the nodes after it; back: nodes before the root; at is where both meet
    forward = {1: e.where("callee > caller").select(F.col("caller").alias("root"), F.array("callee").alias("path"), F.col("callee").alias("at"))}
    back = {1: e.where("caller > callee").select(F.col("callee").alias("root"), F.array("caller").alias("rest"), F.col("caller").alias("at"))}
    for k in range(2, longest // 2 + 1):
        more = forward[k - 1].join(e, F.col("at") == F.col("caller")).where((F.col("callee") > F.col("root")) & ~F.array_contains("path", F.col("callee")))
        forward[k] = more.select("root", F.concat("path", F.array("callee")).alias("path"), F.col("callee").alias("at"))
        more = back[k - 1].join(e, F.col("at") == F.col("callee")).where((F.col("caller") > F.col("root")) & ~F.array_contains("rest", F.col("caller")))
        back[k] = more.select("root", F.concat(F.array("caller"), "rest").alias("rest"), F.col("caller").alias("at"))
    callees, out = e.groupBy(F.col("caller").alias("at")).agg(F.collect_list("callee").alias("next")), None
    for n in range(2, longest + 1):
        k = n // 2
        if n % 2:
            near = forward[k].join(callees, "at").select("root", "path", F.filter("next", lambda x: x > F.col("root")).alias("next"))
            ends = back[k].select("root", "at").distinct().groupBy("root").agg(F.collect_list("at").alias("ends"))
            middle = near.join(ends, "root").select("root", "path", F.explode(F.array_intersect("next", "ends")).alias("at"))
            met = middle.join(back[k], ["root", "at"])
            rest = F.col("rest")
        else:
            met, rest = forward[k].join(back[k], ["root", "at"]), F.slice("rest", 2, max(k - 1, 1)) if k > 1 else F.array().cast("array<bigint>")
        found = met.where(~F.arrays_overlap("path", rest)).select(F.concat(F.array("root"), "path", rest).alias("ids"))
        out = found if out is None else out.unionByName(found)
    each = cut_lineage(out).select("ids", F.posexplode("ids").alias("at", "id")).join(nodes, "id")
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return each.groupBy("ids").agg(F.array_join(names, ">").alias("path")).select("path", F.size("ids").cast("long").alias("length"))


def module_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls between modules: (caller_module, callee_module, calls); ids of no symbol are external."""
    s = symbols.select("hash", "module")
    named = edges.join(s.withColumnsRenamed({"hash": "caller", "module": "caller_module"}), "caller").join(s.withColumnsRenamed({"hash": "callee", "module": "m"}), "callee", "left")
    ext = F.when(F.col("callee").startswith("ext:"), F.split_part("callee", F.lit(":"), F.lit(2))).otherwise("__external__")
    return named.withColumn("callee_module", F.coalesce("m", ext)).groupBy("caller_module", "callee_module").agg(F.count("*").alias("calls"))


def with_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callee names and risks; an unknown callee keeps its id and has risk unknown."""
    s = symbols.select(F.col("hash").alias("callee"), "symbol", "risk")
    return edges.join(s, "callee", "left").select("caller", "callee", F.coalesce("symbol", "callee").alias("callee_name"), F.coalesce("risk", F.lit("unknown")).alias("callee_risk"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (file, name) to hashes: the exact name, else what follows its last dot; of several symbols one in the same file first, else the least hash; else ``ext:name``.

    Candidates are reduced per (name, file) and per name before the joins, so a name with
    very many symbols sends one row.
    """
    by_file = symbols.groupBy(F.col("symbol").alias("known"), "file").agg(F.min("hash").alias("near"))
    by_name = symbols.groupBy(F.col("symbol").alias("known")).agg(F.min("hash").alias("any"))
    tries = F.array_distinct(F.array(F.col("name"), F.regexp_extract("name", r"([^.]*)$", 1)))
    each = calls.select("file", "name", F.posexplode(tries).alias("turn", "known"))
    found = each.join(by_file, ["known", "file"], "left").join(by_name, "known", "left").withColumn("hit", F.coalesce("near", "any"))
    best = found.groupBy("file", "name").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("turn", "hit")))["hit"].alias("hit"))
    return best.select("file", "name", F.coalesce("hit", F.concat(F.lit("ext:"), F.col("name"))).alias("callee"))


def stats(edges: DataFrame) -> DataFrame:
    """total_callers, total_edges and the mean number of callees."""
    per = edges.groupBy("caller").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("total_callers"), F.sum("n").alias("total_edges"), F.round(F.avg("n"), 6).alias("avg_callees"))


def top_callers(edges: DataFrame, over: int, limit: int) -> DataFrame:
    per = edges.groupBy("caller").agg(F.count("*").alias("callees")).where(F.col("callees") > over)
    return page(per, [F.desc("callees"), "caller"], limit)

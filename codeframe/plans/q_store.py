"""Layers, refreshes, duplicates, comparisons and sinks (O, D, K, X in batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeframe.functions import rules
from codeframe.operators import compare, diff, duplicates, incremental, overlay
from codeframe.operators.search import page
from codeframe.plans.registry import query
from codeframe.plans.views import Views

_FRESH = "select hash, symbol || case when start_line % 10 = 0 then '2' else '' end as content, file from symbols where start_line % 13 <> 0"


def _versions(v):
    s = v.symbols
    old = s.where("start_line % 17 <> 0").select("hash", F.col("symbol").alias("content"), "file")
    new = s.where("start_line % 13 <> 0").select("hash", F.concat("symbol", F.when(F.col("start_line") % 10 == 0, "2").otherwise("")).alias("content"), "file")
    return old, new


@query("O1_last_writes", "select layer, hash, seq, state, file, value from (select *, row_number() over (partition by layer, hash order by seq desc) as r from layers) where r = 1")
def o1(spark, d):
    return overlay.last_writes(Views(spark, d).layers)


@query("O2_resolve", "select hash, layer, seq, state from resolved where state = 'active'")
def o2(spark, d):
    return overlay.active(Views(spark, d).layers).select("hash", "layer", "seq", "state")


@query("O3_totals", "select count(*) as hashes, sum(case when state = 'active' then 1 else 0 end) as active from resolved")
def o3(spark, d):
    return overlay.resolve(Views(spark, d).layers).agg(F.count("*").alias("hashes"), F.count_if(F.col("state") == "active").alias("active"))


@query("O4_moves", "select file, case when file = 'src/u1.ts' then 'src/z.ts' when file = 'src/u2.ts' then 'src/q.ts' when file = 'src/u3.ts' then 'src/q.ts' else file end as now from (select distinct file from layers)")
def o4(spark, d):
    m = spark.createDataFrame([(0, 1, "src/u1.ts", "src/y.ts"), (1, 1, "src/y.ts", "src/z.ts"), (0, 2, "src/u3.ts", "src/u2.ts"), (1, 2, "src/u2.ts", "src/q.ts")], "layer int, seq int, src string, dst string")
    return overlay.resolve_paths(Views(spark, d).layers.select("file").distinct(), m)


@query("O5_file_symbols", "select hash, layer from resolved where state = 'active' and file = 'src/u3.ts'")
def o5(spark, d):
    return overlay.file_symbols(Views(spark, d).layers, "src/u3.ts").select("hash", "layer")


@query("O6_layered_search", "select hash, layer, value from resolved where state = 'active' and value > 20 order by cast(hash as bigint) limit 50")
def o6(spark, d):
    a = overlay.active(Views(spark, d).layers).where("value > 20")
    return page(a, [F.col("hash").cast("long")], 50).select("hash", "layer", "value")


@query("O7_update_counts", f"""with b as (select file, hash, symbol as content from symbols where start_line % 17 <> 0), a as ({_FRESH}) select coalesce(a.file, b.file) as file, sum(case when b.hash is null then 1 else 0 end) as added, sum(case when a.hash is null then 1 else 0 end) as removed,
    sum(case when a.hash is not null and b.hash is not null and a.content <> b.content then 1 else 0 end) as modified from a full join b on a.hash = b.hash and a.file = b.file group by 1""")
def o7(spark, d):
    old, new = _versions(Views(spark, d))
    return incremental.update_counts(old, new)


@query("O8_mark_deleted", "select hash, cast(2 as bigint) as layer, 'deleted' as state, seq + 1 as seq from resolved where state = 'active' and file in ('src/u3.ts', 'src/u4.ts')")
def o8(spark, d):
    files = spark.createDataFrame([("src/u3.ts",), ("src/u4.ts",)], "file string")
    return overlay.mark_deleted(Views(spark, d).layers, files, 2).select("hash", "layer", "state", "seq")


@query("O9_rebase", f"with b as (select hash, symbol as content from symbols where start_line % 17 <> 0), a as ({_FRESH}) select a.hash, case when b.hash is null then 'preserved' when a.content = b.content then 'dropped' else 'conflict' end as outcome from a left join b on a.hash = b.hash")
def o9(spark, d):
    old, new = _versions(Views(spark, d))
    return overlay.rebase(new, old)


@query("O11_strategy", "select p_partkey, case when p_partkey % 9 = 0 then 'full_rebuild' when p_partkey % 7 = 0 then 'rebase' when c = 0 then 'fresh' when c < 10 then 'incremental' when c < ceil(t * 0.3::double) then 'rebase' else 'full_rebuild' end as strategy from (select p_partkey, p_partkey % 50 as c, p_size + 40 as t from part)")
def o11(spark, d):
    k = F.col("p_partkey")
    return Views(spark, d).table("part").select("p_partkey", rules.update_strategy(k % 9 != 0, k % 7 == 0, k % 50, F.col("p_size") + 40).alias("strategy"))


@query("C42_drift", "select changed, total, round(changed / total * 100.0::double, 6) as percent, case when changed = 0 then 'fresh' when changed < 10 then 'incremental' when changed < ceil(total * 0.3::double) then 'rebase' else 'full_rebuild' end as strategy from (select (select count(*) from changes where o_orderkey % 4 = 0) as changed, (select count(*) from changes) as total)")
def c42(spark, d):
    v = Views(spark, d)
    return diff.drift(v.changes.where("o_orderkey % 4 = 0"), v.changes)


@query("O13_stale_sample", "select path from (select path, o_orderdate from changes join orders using (o_orderkey) order by path limit 200) where o_orderdate > timestamp '1996-01-01'")
def o13(spark, d):
    v = Views(spark, d)
    both = v.changes.join(v.table("orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("path", "o_orderdate")
    return page(both, ["path"], 200).where("o_orderdate > timestamp '1996-01-01'").select("path")


@query("O14_refresh_mode", "select p_partkey, case when p_partkey % 10 = 0 then 'full' when p_partkey % 3 = 0 then 'none' when p_partkey % 100 <= 50 then 'partial' else 'full' end as mode from part")
def o14(spark, d):
    k = F.col("p_partkey")
    return Views(spark, d).table("part").select("p_partkey", rules.refresh_mode(k % 10 != 0, k % 3 != 0, k % 100).alias("mode"))


@query("O15_partial_reindex", f"select hash, symbol as content, file from symbols where start_line % 17 <> 0 and not ends_with(file, '7.ts') union all select * from ({_FRESH}) where ends_with(file, '7.ts')")
def o15(spark, d):
    v = Views(spark, d)
    old, new = _versions(v)
    return incremental.replace_files(old, new, v.symbols.where(F.col("file").endswith("7.ts")).select("file"))


@query("G30_layer_stats", "select layer, sum(case when state = 'active' then 1 else 0 end) as active, sum(case when state = 'deleted' then 1 else 0 end) as deleted from (select *, row_number() over (partition by layer, hash order by seq desc) as r from layers) where r = 1 group by 1")
def g30(spark, d):
    return overlay.layer_stats(Views(spark, d).layers)


@query("X7_versions", "select seq, hash, row_number() over (partition by hash order by seq) as version from layers")
def x7(spark, d):
    return overlay.running_state(Views(spark, d).layers).select("seq", "hash", "version")


@query("X4_throttle_batch", """with recursive r as (select event_type, ts, row_number() over (partition by event_type order by ts, event_id) as n, event_id from events),
    w as (select event_type, ts, n, event_id, ts as last, true as emitted from r where n = 1 union all select r.event_type, r.ts, r.n, r.event_id, case when r.ts >= w.last + interval 1 hour then r.ts else w.last end, r.ts >= w.last + interval 1 hour from w join r on r.event_type = w.event_type and r.n = w.n + 1)
    select event_id, event_type from w where emitted""")
def x4(spark, d):
    from codeframe.streaming import events

    return events.throttle_batch(Views(spark, d).table("events"), "event_type", "ts", "event_id", 3600.0).select("event_id", "event_type")


@query("X5_debounce_windows", "select time_bucket(interval 1 hour, ts) as start, count(distinct user_id) as paths from events group by 1")
def x5(spark, d):
    from codeframe.streaming import events

    return events.debounce(Views(spark, d).table("events"), "ts", "user_id", "1 hour")


@query("X8_event_json", """select event_id, '{"type":"' || event_type || '","payload":{"user":' || user_id || '}}' as event from events""")
def x8(spark, d):
    return Views(spark, d).table("events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("payload"))).alias("event"))


_J = "case when len(a.{0}) + len(b.{0}) = 0 then 1.0::double else len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0}))) end"
_SIM = f"round({_J.format('calls')} * 0.45::double + {_J.format('names')} * 0.20::double + (1.0::double - bit_count(xor(a.params, b.params)) / 64.0::double) * 0.20::double + (1.0::double - bit_count(xor(a.state_fp, b.state_fp)) / 64.0::double) * 0.15::double, 6)"


@query("D1_signatures", "select doc_id, array_to_string(calls, ' ') as calls, array_to_string(names, ' ') as names, params from signatures")
def d1(spark, d):
    return Views(spark, d).signatures.select("doc_id", F.array_join("calls", " ").alias("calls"), F.array_join("names", " ").alias("names"), "params")


_REPS = "select calls, names, params, any_value(call_fp) as call_fp, any_value(state_fp) as state_fp, min(doc_id) as doc_id from sigfp group by 1, 2, 3"
_COARSE = "a.doc_id < b.doc_id and abs(a.params - b.params) <= 2 and abs(len(a.calls) - len(b.calls)) <= 3"
_ALL = f"select * from (select a.doc_id as a, b.doc_id as b, {_SIM} as similarity from ({_REPS}) a join ({_REPS}) b on {_COARSE} and {{0}}) where similarity >= {{1}}"
_PAIRS = _ALL.format("bit_count(xor(a.call_fp, b.call_fp)) <= 12", "0.8")


def _candidates(spark, d):
    return duplicates.candidate_pairs(duplicates.signatures(Views(spark, d).signatures))


@query("D2_candidates", _PAIRS)
def d2(spark, d):
    return _candidates(spark, d)


@query("D3_classes", "select s.doc_id, r.doc_id as class_id, copies from signatures s join (select calls, names, params, min(doc_id) as doc_id, count(*) as copies from signatures group by 1, 2, 3) r on r.calls = s.calls and r.names = s.names and r.params = s.params")
def d3(spark, d):
    return duplicates.classes(Views(spark, d).signatures)


@query("D4_near_pairs", f"select a, b, similarity, case when similarity >= 0.98 then 'exact' when similarity >= 0.90 then 'near' else 'divergent' end as kind from ({_PAIRS})")
def d4(spark, d):
    return duplicates.kinds(_candidates(spark, d), 0.90)


@query("D4_similar_at_any_distance", _ALL.format("true", "0.8"))
def d4a(spark, d):
    """Without the fingerprints, which are equal or differ by chance: what the similarity alone calls near."""
    return duplicates.candidate_pairs(duplicates.signatures(Views(spark, d).signatures), 64)


@query("D6_primaries", f"with p as ({_PAIRS}) select b as member, min(a) as primary from p where a not in (select b from p) group by 1")
def d6(spark, d):
    p = _candidates(spark, d)
    first = p.join(p.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    return first.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("primary"))


@query("D6_greedy_clusters")
def d6g(spark, d):
    """Over all pairs that are near, of any sizes; in order of ids, which SQL cannot follow: the tests compare with a loop."""
    return duplicates.greedy_clusters(duplicates.candidate_pairs(duplicates.signatures(Views(spark, d).signatures), 64, coarse=False))


@query("G25_rollup_by_module", f"select module, count(*) as pairs, min(similarity) as least, max(similarity) as most from ({_ALL.format('true', '0.8')}) join signatures s on s.doc_id = a group by 1 order by pairs desc, module limit 5")
def g25(spark, d):
    s = Views(spark, d).signatures
    return duplicates.rollup_by_module(duplicates.candidate_pairs(duplicates.signatures(s), 64), s)


@query("D10_severity", "select p_partkey, case when s >= 9 then 'critical' when s >= 7 then 'high' when s >= 4 then 'medium' when s > 0 then 'low' else 'none' end as severity from (select p_partkey, p_size / 5.0::double as s from part)")
def d10(spark, d):
    return Views(spark, d).table("part").select("p_partkey", rules.severity_of_cvss(F.col("p_size") / 5.0).alias("severity"))


@query("D13_validate", """select s.hash, case when cognitive > 15 then 'very high complexity' when cognitive > 10 then 'high complexity' else '' end as concern, fan_in > 10 as many_callers from symbols s join fan f on f.hash = s.hash""")
def d13(spark, d):
    from codeframe.operators import graph

    v = Views(spark, d)
    c = rules.concerns(F.col("cognitive"), F.lit(0))
    return graph.fan(v.pairs, v.symbols).select("hash", F.array_join(c, "").alias("concern"), (F.col("fan_in") > 10).alias("many_callers"))


@query("D14_semantic_diff", """with b as (select hash, symbol, cognitive, risk from symbols where start_line % 17 <> 0), a as (select hash, symbol, cognitive + case when start_line % 10 = 0 then 1 else 0 end as cognitive, case when start_line % 9 = 0 then 'high' else risk end as risk from symbols where start_line % 13 <> 0)
    select coalesce(a.hash, b.hash) as hash, case when b.hash is null then 'added' when a.hash is null then 'removed' when a.cognitive <> b.cognitive then 'modified' else 'same' end as change, case when a.hash is not null and b.hash is not null and a.cognitive <> b.cognitive then 'cognitive' else '' end as columns,
    cast(case when a.hash is not null and b.hash is not null then case a.risk when 'high' then 2 when 'medium' then 1 else 0 end - case b.risk when 'high' then 2 when 'medium' then 1 else 0 end else 0 end as bigint) as risk_change from a full join b on a.hash = b.hash""")
def d14(spark, d):
    s = Views(spark, d).symbols
    new = s.where("start_line % 13 <> 0").withColumn("cognitive", F.col("cognitive") + F.when(F.col("start_line") % 10 == 0, 1).otherwise(0)).withColumn("risk", F.when(F.col("start_line") % 9 == 0, "high").otherwise(F.col("risk")))
    return diff.semantic_diff(s.where("start_line % 17 <> 0"), new, "hash", ["symbol", "cognitive"])


_F = [("f0", "cast(files as double)"), ("f1", "chars / files"), ("f2", "cast(largest as double)"), ("f3", "de / files"), ("f4", "en / files"), ("f5", "es / files"), ("f6", "fr / files")]
_SCALED = "select repo, [" + ", ".join(f"case when min({e}) over () = max({e}) over () then 0.5::double else ({e} - min({e}) over ()) / (max({e}) over () - min({e}) over ()) end" for _, e in _F) + "] as v, [de / files, en / files, es / files, fr / files] as share from repos"


@query("D15_compare_repos", f"""with s as ({_SCALED}) select a.repo as a, b.repo as b, round(case when list_sum(list_transform(a.v, lambda x: x * x)) = 0 or list_sum(list_transform(b.v, lambda x: x * x)) = 0 then 0.0 else list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) end, 6) as cosine,
    round(list_sum(list_transform(list_zip(a.share, b.share), lambda z: case when z[1] + z[2] = 0 then 0.0 else (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2]) end)) / 2, 6) as chi_squared from s a join s b on a.repo < b.repo""")
def d15(spark, d):
    return compare.pairs(Views(spark, d).repos)


@query("D16_features", f"with s as ({_SCALED}) select repo, " + ", ".join(f"round(v[{i + 1}], 6) as f{i}" for i in range(7)) + " from s")
def d16(spark, d):
    f = compare.features(Views(spark, d).repos)
    return f.select("repo", *[F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(7)])


@query("E3_markup", r"select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, cast(len(regexp_extract_all(html, '<p>')) as bigint) as paragraphs, cast(len(regexp_extract_all(html, '<a href=')) as bigint) as links from pages")
def e3(spark, d):
    h = F.col("html")
    return Views(spark, d).table("pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count(h, F.lit("<a href=")).cast("long").alias("links"))

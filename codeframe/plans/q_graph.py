"""Joins, aggregates and graphs (J, G, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeframe.functions import rules
from codeframe.operators import graph, metrics
from codeframe.operators.search import page
from codeframe.plans.registry import query
from codeframe.plans.views import Views

LOC = "case when end_line > start_line then end_line - start_line + 1 else 1 end"


@query("G1_fan", "select hash, fan_in, fan_out from fan")
def g1(spark, d):
    v = Views(spark, d)
    return graph.fan(v.pairs, v.symbols).select("hash", "fan_in", "fan_out")


@query("G2_hotspots", "select hash, fan_in from fan order by fan_in desc, hash limit 10")
def g2(spark, d):
    v = Views(spark, d)
    return page(graph.fan(v.pairs, v.symbols).select("hash", "fan_in"), [F.desc("fan_in"), "hash"], 10)


@query("G3_high_coupling", "select f.hash, symbol, fan_out from fan f join symbols s on s.hash = f.hash where fan_out > 10")
def g3(spark, d):
    v = Views(spark, d)
    return graph.fan(v.pairs, v.symbols).where("fan_out > 10").select("hash", "symbol", "fan_out")


@query("G4_orphans", "select hash from symbols where hash not in (select caller from pairs) and hash not in (select callee from pairs)")
def g4(spark, d):
    v = Views(spark, d)
    e = v.pairs
    return v.symbols.select("hash").join(e.select(F.col("caller").alias("hash")).union(e.select("callee")).distinct(), "hash", "left_anti")


@query("G5_entry_points", "select s.hash from symbols s join (select callee, count(*) as n from pairs group by 1) i on i.callee = s.hash left join (select caller, count(*) as n from pairs group by 1) o on o.caller = s.hash where i.n >= 3 and coalesce(o.n, 0) <= 2")
def g5(spark, d):
    v = Views(spark, d)
    return graph.fan(v.pairs, v.symbols).where("fan_in >= 3 and fan_out <= 2").select("hash")


@query("G6_leaves", "select distinct s.hash from symbols s join pairs e on e.callee = s.hash where s.hash not in (select caller from pairs)")
def g6(spark, d):
    v = Views(spark, d)
    return graph.fan(v.pairs, v.symbols).where("fan_in > 0 and fan_out = 0").select("hash")


@query("G7_complexity", "select doc_id, sum(1 + line % 4) as cognitive, max(line % 4) as max_nesting, 1 + count(*) as cyclomatic from lines group by 1")
def g7(spark, d):
    v = Views(spark, d).files.select("doc_id", F.transform(F.sequence(F.lit(1), F.size(F.split("text", "\n"))), lambda i: (i % 4).cast("long")).alias("nest"))
    return v.select("doc_id", F.aggregate("nest", F.lit(0).cast("long"), lambda s, n: s + 1 + n).alias("cognitive"), F.array_max("nest").alias("max_nesting"), (F.size("nest") + 1).cast("long").alias("cyclomatic"))


@query("G8_rating", f"""select hash, score, case when score <= 5 then 'simple' when score <= 10 then 'moderate' when score <= 20 then 'complex' else 'very_complex' end as rating from
    (select s.hash, cognitive + case when fan_out > 10 then (fan_out - 10) // 2 else 0 end + case when {LOC} > 50 then ({LOC} - 50) // 25 else 0 end as score from symbols s join fan f on f.hash = s.hash)""")
def g8(spark, d):
    v = Views(spark, d)
    s = metrics.lines_of(graph.fan(v.pairs, v.symbols)).select("hash", rules.complexity_score(F.col("cognitive"), F.col("fan_out"), F.col("loc")).alias("score"))
    return s.withColumn("rating", rules.complexity_rating(F.col("score")))


@query("G9_module_metrics", f"""select module, count(distinct file) as files, count(*) as symbols, round(avg(cognitive), 6) as avg_complexity, max(cognitive) as max_complexity, (array_agg(symbol order by cognitive desc, hash))[1] as most_complex,
    sum({LOC}) as total_loc, sum(case when risk = 'high' then 1 else 0 end) as high_risk from symbols group by 1""")
def g9(spark, d):
    return metrics.module_metrics(Views(spark, d).symbols)


_MODULE_EDGES = "select a.module as caller_module, coalesce(b.module, case when starts_with(callee, 'ext:') then split_part(callee, ':', 2) else '__external__' end) as callee_module, count(*) as calls from pairs e join symbols a on a.hash = e.caller left join symbols b on b.hash = e.callee group by 1, 2"


@query("G10_instability", f"""with m as ({_MODULE_EDGES}), x as (select callee_module as module, caller_module as i, null as o from m where caller_module <> callee_module union all select caller_module, null, callee_module from m where caller_module <> callee_module)
    select module, count(distinct i) as ca, count(distinct o) as ce, round(case when count(distinct i) + count(distinct o) = 0 then 0.5 else count(distinct o) / (count(distinct i) + count(distinct o)) end, 6) as instability from x group by 1""")
def g10(spark, d):
    v = Views(spark, d)
    return metrics.coupling(graph.module_edges(v.pairs, v.symbols))


@query("G11_repo_totals", f"select count(*) as total_symbols, sum({LOC}) as total_lines, round(avg(cognitive), 6) as avg_complexity, round(sum(case when risk = 'high' then 1 else 0 end) / count(*) * 100, 6) as high_risk_percent from symbols")
def g11(spark, d):
    return metrics.repo_totals(Views(spark, d).symbols)


@query("G12_complex_symbols", f"select hash, symbol, cognitive, fan_out, loc, cognitive * 100 + fan_out * 10 + loc as weight from (select s.hash, symbol, cognitive, fan_out, {LOC} as loc from symbols s join fan f on f.hash = s.hash) where cognitive > 5 or fan_out > 10 or loc > 50 order by weight desc, hash limit 20")
def g12(spark, d):
    v = Views(spark, d)
    return metrics.complex_symbols(v.symbols, graph.fan(v.pairs, v.symbols))


@query("G13_fan_out_fallback", """with own as (select caller as hash, count(*) as n from pairs group by 1), named as (select symbol, max(n) as n from symbols s join own o on o.hash = s.hash group by 1),
    inside as (select a.hash, sum(o.n) as n from symbols a join symbols b on b.file = a.file and b.hash <> a.hash and b.start_line >= a.start_line and b.end_line <= a.end_line join own o on o.hash = b.hash group by 1),
    byfile as (select file, sum(n) as n from symbols s join own o on o.hash = s.hash group by 1)
    select s.hash, cast(coalesce(own.n, named.n, inside.n, case when kind = 'method' then byfile.n end, 0) as bigint) as fan_out from symbols s left join own on own.hash = s.hash left join named on named.symbol = s.symbol left join inside on inside.hash = s.hash left join byfile on byfile.file = s.file""")
def g13(spark, d):
    v = Views(spark, d)
    return metrics.fan_out_by_name(v.symbols, graph.fan(v.pairs, v.symbols))


@query("G15_module_edges", _MODULE_EDGES)
def g15(spark, d):
    v = Views(spark, d)
    return graph.module_edges(v.pairs, v.symbols)


@query("G16_module_graph", f"select caller_module as module, count(distinct callee_module) as outgoing, sum(calls) as weight from ({_MODULE_EDGES}) where caller_module <> callee_module group by 1")
def g16(spark, d):
    v = Views(spark, d)
    e = graph.module_edges(v.pairs, v.symbols).where("caller_module <> callee_module")
    return e.groupBy(F.col("caller_module").alias("module")).agg(F.count_distinct("callee_module").alias("outgoing"), F.sum("calls").alias("weight"))


@query("G17_modules", "select module, count(*) as symbol_count, sum(case when risk = 'high' then 1 else 0 end) as high_risk_count from symbols group by 1")
def g17(spark, d):
    return Views(spark, d).symbols.groupBy("module").agg(F.count("*").alias("symbol_count"), F.count_if(F.col("risk") == "high").alias("high_risk_count"))


@query("G18_node_counts", "select f.hash, fan_in as caller_count, fan_out as callee_count, p.caller is not null as self_recursive from fan f left join (select caller from pairs where caller = callee) p on p.caller = f.hash")
def g18(spark, d):
    v = Views(spark, d)
    loops = v.pairs.where("caller = callee").select(F.col("caller").alias("hash"), F.lit(True).alias("self_recursive"))
    return graph.fan(v.pairs, v.symbols).join(loops, "hash", "left").select("hash", F.col("fan_in").alias("caller_count"), F.col("fan_out").alias("callee_count"), F.coalesce("self_recursive", F.lit(False)).alias("self_recursive"))


@query("G19_edge_upsert", "select cast(l_partkey as varchar) as caller, l_returnflag as edge_kind, count(*) as call_count from lineitem group by 1, 2")
def g19(spark, d):
    return Views(spark, d).table("lineitem").groupBy(F.col("l_partkey").cast("string").alias("caller"), F.col("l_returnflag").alias("edge_kind")).agg(F.count("*").alias("call_count"))


@query("G20_graph_stats", "select count(*) as total_callers, cast(sum(n) as bigint) as total_edges, round(avg(n), 6) as avg_callees from (select caller, count(*) as n from pairs group by 1)")
def g20(spark, d):
    return graph.stats(Views(spark, d).pairs)


@query("L5_top_callers", "select caller, count(*) as callees from pairs group by 1 having count(*) > 5 order by callees desc, caller limit 15")
def l5(spark, d):
    return graph.top_callers(Views(spark, d).pairs, 5, 15)


@query("G21_overview", "select language, count(*) as files, sum(n_chars) as chars, sum(case when n_chars > 2000 then 1 else 0 end) as large from files group by 1")
def g21(spark, d):
    return Views(spark, d).files.groupBy("language").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 2000).alias("large"))


@query("G22_module_groups", """with f as (select module, file, max(case risk when 'high' then 2 when 'medium' then 1 else 0 end) as rank from symbols group by 1, 2), r as (select *, row_number() over (partition by module order by rank desc, file) as r from f)
    select module, count(*) as file_count, case max(rank) when 2 then 'high' when 1 then 'medium' else 'low' end as risk, coalesce(string_agg(file, ',' order by r) filter (where r <= 3 and rank = 2), '') as key_files from r group by 1""")
def g22(spark, d):
    return metrics.module_groups(Views(spark, d).symbols)


@query("G23_detect_patterns", "select bool_or(contains(text, 'password')) as has_secret, bool_or(contains(text, 'Apache License')) as has_license, cast(sum(case when contains(text, ' | ') then 1 else 0 end) as bigint) as tables, (array_agg(language order by doc_id))[1] as first_language from files")
def g23(spark, d):
    t = F.col("text")
    return Views(spark, d).files.agg(
        F.bool_or(F.contains(t, F.lit("password"))).alias("has_secret"), F.bool_or(F.contains(t, F.lit("Apache License"))).alias("has_license"), F.count_if(F.contains(t, F.lit(" | "))).alias("tables"), F.min_by("language", "doc_id").alias("first_language"),
    )


@query("G24_entry_files", "select distinct file from symbols where is_exported and regexp_matches(symbol, '^hot|ring$')")
def g24(spark, d):
    return Views(spark, d).symbols.where(F.col("is_exported") & F.col("symbol").rlike("^hot|ring$")).select("file").distinct()


@query("G26_change_counts", "select change_type, count(*) as files from changes group by 1")
def g26(spark, d):
    from codeframe.operators import diff

    return diff.change_counts(Views(spark, d).changes)


@query("L7_language_changes", "select language, count(*) as files from changes group by 1 order by files desc, language limit 10")
def l7(spark, d):
    from codeframe.operators import diff

    return diff.by_language(Views(spark, d).changes)


@query("G27_lint_rollup", "select sum(case when s = 3 then 1 else 0 end) as errors, sum(case when s = 2 then 1 else 0 end) as warnings, count(distinct l_partkey) as files from (select l_partkey, cast(l_linenumber % 4 as integer) as s from lineitem where l_linenumber % 4 >= 2 order by l_partkey, l_orderkey, l_linenumber, l_suppkey limit 500)")
def g27(spark, d):
    x = Views(spark, d).table("lineitem").where("l_linenumber % 4 >= 2")
    top = page(x, ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"], 500)
    s = F.col("l_linenumber") % 4
    return top.agg(F.count_if(s == 3).alias("errors"), F.count_if(s == 2).alias("warnings"), F.count_distinct("l_partkey").alias("files"))


@query("G29_token_metrics", "select file, source, strlen(text) as bytes, cast(ceil(strlen(text) / 3.8::double) as bigint) as tokens, cast(ceil(ceil(strlen(text) / 3.8::double) * 0.3::double) as bigint) as summary_tokens, cast(ceil(strlen(text) / 3.8::double) * 4 - ceil(ceil(strlen(text) / 3.8::double) * 0.3::double) as bigint) as saved from files")
def g29(spark, d):
    return metrics.token_metrics(Views(spark, d).files)


@query("G31_evolution", """with s as (select distinct p_size % 5 as step, caller, callee from pairs join part on cast(p_partkey as varchar) = caller) select a.step, count(*) as edges, sum(case when b.caller is null then 1 else 0 end) as new_edges
    from s a left join s b on b.step + 1 = a.step and b.caller = a.caller and b.callee = a.callee group by 1""")
def g31(spark, d):
    from codeframe.operators import diff

    v = Views(spark, d)
    size = v.table("part").select(F.col("p_partkey").cast("string").alias("caller"), (F.col("p_size") % 5).alias("step"))
    return diff.evolution(v.pairs.join(size, "caller").select("step", "caller", "callee"))


@query("G33_commit_prep", """select c.path, c.change_type, count(l_orderkey) as plus, coalesce(sum(case when l_returnflag = 'R' then 1 else 0 end), 0) as minus, case when c.change_type = 'deleted' then 'file was deleted' end as error
    from changes c left join lineitem on l_orderkey = c.o_orderkey group by 1, 2""")
def g33(spark, d):
    v = Views(spark, d)
    per = v.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("plus"), F.count_if(F.col("l_returnflag") == "R").alias("minus"))
    out = v.changes.join(per, "o_orderkey", "left").fillna(0, ["plus", "minus"])
    return out.select("path", "change_type", "plus", "minus", F.when(F.col("change_type") == "deleted", "file was deleted").alias("error"))


@query("G34_distinct_counts", "select count(distinct caller) as callers, count(distinct callee) as callees from edges")
def g34(spark, d):
    return Views(spark, d).edges.agg(F.count_distinct("caller").alias("callers"), F.count_distinct("callee").alias("callees"))


@query("G35_rollup", "select module, risk, count(*) as n from symbols group by rollup (module, risk)")
def g35(spark, d):
    return Views(spark, d).symbols.rollup("module", "risk").agg(F.count("*").alias("n"))


@query("J2_named_edges", "select caller, callee, coalesce(symbol, callee) as callee_name, coalesce(risk, 'unknown') as callee_risk from (select * from pairs union all select * from externals) e left join symbols s on s.hash = e.callee")
def j2(spark, d):
    v = Views(spark, d)
    return graph.with_names(v.pairs.unionByName(v.externals), v.symbols)


@query("J4_resolve_calls", """with near as (select symbol, file, min(hash) as hash from symbols group by 1, 2), anywhere as (select symbol, min(hash) as hash from symbols group by 1),
    calls as (select distinct file, case when cognitive % 3 = 0 then symbol else (case when cognitive % 3 = 1 then 'api.v2.red_bolt' else 'api.nowhere' end) end as name from symbols)
    select c.file, c.name, coalesce(n.hash, a.hash, n2.hash, a2.hash, 'ext:' || c.name) as callee from calls c left join near n on n.symbol = c.name and n.file = c.file left join anywhere a on a.symbol = c.name
    left join near n2 on n2.symbol = string_split(c.name, '.')[-1] and n2.file = c.file left join anywhere a2 on a2.symbol = string_split(c.name, '.')[-1]""")
def j4(spark, d):
    s = Views(spark, d).symbols
    name = F.when(F.col("cognitive") % 3 == 0, F.col("symbol")).when(F.col("cognitive") % 3 == 1, "api.v2.red_bolt").otherwise("api.nowhere")
    return graph.resolve_calls(s.select("file", name.alias("name")).distinct(), s)


@query("J8_contained", "select a.hash, count(*) as inner_symbols, cast(sum(b.cognitive) as bigint) as inner_complexity from symbols a join symbols b on b.file = a.file and b.hash <> a.hash and b.start_line >= a.start_line and b.end_line <= a.end_line group by 1")
def j8(spark, d):
    return metrics.contained(Views(spark, d).symbols)


@query("J11_inheritance", """with c as (select hash, unnest(string_split(case when cognitive % 4 = 0 then 'red_bolt,blue_ring' when cognitive % 4 = 1 then 'lost_base' else '' end, ',')) as base from symbols where kind in ('class', 'struct')),
    b as (select symbol, min(hash) as hash from symbols where kind in ('class', 'interface', 'struct') group by 1) select c.hash as child, coalesce(b.hash, 'unresolved:' || base) as parent from c left join b on b.symbol = base where base <> ''""")
def j11(spark, d):
    s = Views(spark, d).symbols
    bases = F.when(F.col("cognitive") % 4 == 0, "red_bolt,blue_ring").when(F.col("cognitive") % 4 == 1, "lost_base").otherwise("")
    c = s.where(F.col("kind").isin("class", "struct")).select("hash", F.explode(F.split(bases, ",")).alias("base")).where("base <> ''")
    b = s.where(F.col("kind").isin("class", "interface", "struct")).groupBy(F.col("symbol").alias("base")).agg(F.min("hash").alias("parent"))
    return c.join(b, "base", "left").select(F.col("hash").alias("child"), F.coalesce("parent", F.concat(F.lit("unresolved:"), F.col("base"))).alias("parent"))


@query("J13_module_deps", f"select distinct caller_module as module, callee_module as dep from ({_MODULE_EDGES}) where caller_module <> callee_module")
def j13(spark, d):
    v = Views(spark, d)
    return graph.module_edges(v.pairs, v.symbols).where("caller_module <> callee_module").select(F.col("caller_module").alias("module"), F.col("callee_module").alias("dep"))


@query("N4_reverse", "select callee as caller, caller as callee, edge_kind from edges")
def n4(spark, d):
    return graph.reverse(Views(spark, d).edges)


_WALK = "with recursive walk as (select {a} as hash, 1 as depth from pairs where {b} = '17' union select e.{a}, depth + 1 from walk join pairs e on e.{b} = walk.hash where depth < 3)"


@query("N5_callers", _WALK.format(a="caller", b="callee") + " select hash, cast(min(depth) as bigint) as depth from walk group by 1")
def n5(spark, d):
    return graph.callers(Views(spark, d).pairs, "17", 3)


@query("N6_direct_callers", "select e.caller as hash, s.symbol, s.risk = 'high' as high_risk from pairs e join symbols s on s.hash = e.caller where e.callee = '17' order by s.symbol, e.caller limit 20")
def n6(spark, d):
    v = Views(spark, d)
    c = v.pairs.where("callee = '17'").select(F.col("caller").alias("hash")).join(v.symbols, "hash")
    return page(c.select("hash", "symbol", (F.col("risk") == "high").alias("high_risk")), ["symbol", "hash"], 20)


@query("N7_trace", "with recursive walk as (select '17' as hash, 0 as depth union select e.callee, depth + 1 from walk join pairs e on e.caller = walk.hash where depth < 2), near as (select hash, min(depth) as depth from walk group by 1) select e.caller, e.callee, cast(depth as bigint) as level from near join pairs e on e.caller = near.hash")
def n7(spark, d):
    return graph.trace(Views(spark, d).pairs, "17", 2)


@query("N8_roots", "select hash from symbols where symbol = 'hot_gear' order by hash limit 200")
def n8(spark, d):
    return page(Views(spark, d).symbols.where("symbol = 'hot_gear'").select("hash"), ["hash"], 200)


@query("N9_callgraph", "select e.caller, e.callee, e.edge_kind from edges e join symbols s on s.hash = e.caller where s.module = 'Brand#12' order by e.caller, e.callee, e.edge_kind limit 500")
def n9(spark, d):
    v = Views(spark, d)
    s = v.symbols.where("module = 'Brand#12'").select(F.col("hash").alias("caller"))
    return page(v.edges.join(s, "caller"), ["caller", "callee", "edge_kind"], 500)


@query("N10_symbol_tree", _WALK.format(a="callee", b="caller") + " select hash, cast(min(depth) as bigint) as depth from walk group by 1")
def n10(spark, d):
    return graph.reach(Views(spark, d).pairs, spark.createDataFrame([("17",)], "hash string"), 3)


@query("N11_callees", "select callee from pairs where caller = '17'")
def n11(spark, d):
    return Views(spark, d).pairs.where("caller = '17'").select("callee")


_CYCLE = """with e as (select * from pairs where caller <> callee), b1 as (select caller as last, callee as root from e where caller > callee),
    b2 as (select e.caller as last, e.callee as before, b1.root from e join b1 on b1.last = e.callee where e.caller > b1.root),
    f2 as (select x.caller as root, x.callee as p, y.callee as q from e x join e y on y.caller = x.callee where x.callee > x.caller and y.callee > x.caller),
    f3 as (select f2.*, e.callee as r from f2 join e on e.caller = f2.q where e.callee > f2.root and e.callee <> f2.p)
    select e.caller || '>' || e.callee as path, cast(2 as bigint) as length from e join b1 on b1.root = e.caller and b1.last = e.callee
    union all select f2.root || '>' || p || '>' || q, 3 from f2 join b1 on b1.root = f2.root and b1.last = q
    union all select f2.root || '>' || p || '>' || q || '>' || before, 4 from f2 join b2 on b2.root = f2.root and b2.last = q where before <> p
    union all select f3.root || '>' || p || '>' || q || '>' || r || '>' || before, 5 from f3 join b2 on b2.root = f3.root and b2.last = r where before <> p and before <> q"""


@query("N12_cycles", _CYCLE)
def n12(spark, d):
    return graph.cycles(Views(spark, d).pairs, 5)


@query("N13_self_recursion", "select caller as hash from pairs where caller = callee")
def n13(spark, d):
    return Views(spark, d).pairs.where("caller = callee").select(F.col("caller").alias("hash"))


@query("N14_external_nodes", "select distinct callee as id, split_part(callee, ':', 2) as package, split_part(callee, ':', 3) as name from externals")
def n14(spark, d):
    c = F.col("callee")
    return Views(spark, d).externals.select(c.alias("id"), F.split_part(c, F.lit(":"), F.lit(2)).alias("package"), F.split_part(c, F.lit(":"), F.lit(3)).alias("name")).distinct()

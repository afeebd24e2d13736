"""Rows of the inventory that combine operators or need only a join, a set or a limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeframe.functions import hashing, paths, rules, text
from codeframe.operators import reports, search
from codeframe.plans.q_store import _ALL
from codeframe.plans.registry import query
from codeframe.plans.views import Views

LOC = "case when end_line > start_line then end_line - start_line + 1 else 1 end"


@query("G14_analyze_module", f"""select module, count(distinct file) as files, count(*) as symbols, round(avg(cognitive), 6) as avg_complexity, max(cognitive) as max_complexity, (array_agg(symbol order by cognitive desc, hash))[1] as most_complex,
    sum({LOC}) as total_loc, sum(case when risk = 'high' then 1 else 0 end) as high_risk from symbols where module = 'Brand#7' group by 1""")
def g14(spark, d):
    return reports.analyze_module(Views(spark, d).symbols, "Brand#7")


@query("F13_overview_modules", "select module, count(*) as symbols from symbols where module <> 'Brand#3' group by 1 order by symbols desc, module limit 10")
def f13(spark, d):
    return reports.overview(Views(spark, d).symbols, F.col("module") == "Brand#3", 10)


@query("F15_call_names", "select hash, case when nesting % 2 = 0 then 'api.' || symbol else symbol end as call from symbols")
def f15(spark, d):
    return Views(spark, d).symbols.select("hash", rules.call_name(F.col("symbol"), F.when(F.col("nesting") % 2 == 0, "api")).alias("call"))


@query("F17_skip_paths", "select hash, cognitive % 4 < 3 as skipped from symbols")
def f17(spark, d):
    p = F.element_at(F.array(*map(F.lit, ["a/node_modules/x.ts", ".git/config", "target/debug/y.rs", "src/ok.rs"])), (F.col("cognitive") % 4 + 1).cast("int"))
    return Views(spark, d).symbols.select("hash", paths.skip_path(p).alias("skipped"))


@query("L2_cluster_order", "select class_id, copies from (select min(doc_id) as class_id, count(*) as copies from signatures group by calls, names, params) where copies > 1 order by copies desc, class_id limit 20")
def l2(spark, d):
    from codeframe.operators import duplicates

    c = duplicates.class_sizes(Views(spark, d).signatures)
    return search.page(c.where("copies > 1"), [F.desc("copies"), "class_id"], 20)


@query("L3_findings", "select doc_id, cve_id, severity, similarity from (select o_orderkey as doc_id, 'c' || o_custkey % 7 as cve_id, case o_orderstatus when 'P' then 'critical' when 'F' then 'medium' else 'low' end as severity, round(o_custkey % 100 / 100.0::double, 2) as similarity from orders) where severity <> 'low' order by case severity when 'critical' then 0 else 1 end, similarity desc, doc_id, cve_id limit 40")
def l3(spark, d):
    s = F.col("o_orderstatus")
    m = Views(spark, d).table("orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("cve_id"), F.when(s == "P", "critical").when(s == "F", "medium").otherwise("low").alias("severity"), F.round((F.col("o_custkey") % 100) / 100.0, 2).alias("similarity")
    )
    return reports.findings(m, "medium", limit=40)


@query("O17_layer_staleness", "select layer, layer < 3 and max(ts) < timestamp '2024-01-25 00:00:00' - interval 1 hour as stale from (select ts, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end as layer from events where event_type <> 'error') group by 1")
def o17(spark, d):
    e = F.col("event_type")
    layer = F.when(e == "view", 0).when(e == "click", 1).when(e == "purchase", 2).otherwise(3)
    x = Views(spark, d).table("events").where(e != "error").select(F.col("ts").cast("timestamp").alias("at"), layer.alias("layer"))
    return reports.layer_staleness(x, F.lit("2024-01-25 00:00:00").cast("timestamp"), 3600)


@query("O18_duplicate_alerts", f"with p as ({_ALL.format('true', '0.9')}) select a as known_id, b as new_id, similarity from p where b % 7 = 0 and a % 7 <> 0 union all select b, a, similarity from p where a % 7 = 0 and b % 7 <> 0")
def o18(spark, d):
    """New signatures (ids divisible by 7) against the others."""
    s = Views(spark, d).signatures
    return reports.alerts(s.where("doc_id % 7 = 0"), s.where("doc_id % 7 <> 0")).select("known_id", "new_id", "similarity")


@query("D17_explanation", "select a, b, case when cosine >= 0.9 then 'very similar' when cosine >= 0.6 then 'similar' else 'different' end || case when chi <= 0.05 then ' with the same mix of languages' else ' with another mix of languages' end as explanation from (select p_partkey as a, p_size as b, p_size / 50.0::double as cosine, p_partkey % 10 / 100.0::double as chi from part)")
def d17(spark, d):
    p = Views(spark, d).table("part")
    return p.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("b"), reports.explain_similarity(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 100.0).alias("explanation"))


@query("C29_chi_squared", "select a.repo as a, b.repo as b, round((case when a.en + b.en = 0 then 0.0 else (a.en - b.en) * (a.en - b.en) / (a.en + b.en) end + case when a.de + b.de = 0 then 0.0 else (a.de - b.de) * (a.de - b.de) / (a.de + b.de) end) / 2, 6) as chi_squared from repos a join repos b on a.repo < b.repo")
def c29(spark, d):
    r = Views(spark, d).repos.select("repo", F.array("en", "de").alias("v"))
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.col("a.repo") < F.col("b.repo")).select(F.col("a.repo").alias("a"), F.col("b.repo").alias("b"), F.round(hashing.chi_squared(F.col("a.v"), F.col("b.v")), 6).alias("chi_squared"))


@query("C39_layer_names", "select distinct layer, case layer when 0 then 'base' when 1 then 'branch' when 2 then 'working' else 'ai' end as name from layers")
def c39(spark, d):
    from codeframe.operators.overlay import LAYERS

    return Views(spark, d).layers.select("layer").distinct().select("layer", F.element_at(F.array(*map(F.lit, LAYERS)), (F.col("layer") + 1).cast("int")).alias("name"))


@query("C44_map_lookup", "select hash, case cognitive % 3 when 0 then 'pkg:a' when 1 then 'pkg:root' else 'none' end as source from symbols")
def c44(spark, d):
    sources = F.create_map(F.lit("m0"), F.lit("pkg:a"), F.lit("root1"), F.lit("pkg:root"))
    k = (F.col("cognitive") % 3).cast("string")
    found = F.coalesce(F.try_element_at(sources, F.concat(F.lit("m"), k)), F.try_element_at(sources, F.concat(F.lit("root"), k)), F.lit("none"))
    return Views(spark, d).symbols.select("hash", found.alias("source"))


@query("J1_terms_documents", "select term, count(*) as n, sum(n_chars) as chars from terms join documents using (doc_id) where term in ('thanedble', 'attion', 'the') group by 1")
def j1(spark, d):
    v = Views(spark, d)
    some = F.array_intersect(text.lower_terms(F.col("text")), F.array(*map(F.lit, ["thanedble", "attion", "the"])))
    hit = v.files.select(F.col("doc_id").alias("id"), F.explode(some).alias("term"))
    return hit.join(v.table("documents").select(F.col("doc_id").alias("id"), "n_chars"), "id").groupBy("term").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("J3_file_module", "select s.hash, coalesce(m.module, split_part(s.file, '/', 2)) as module from symbols s left join (select distinct file, module from symbols where start_line % 2 = 0) m on m.file = s.file")
def j3(spark, d):
    s = Views(spark, d).symbols
    known = s.where("start_line % 2 = 0").select("file", "module").distinct()
    return s.select("hash", "file").join(known, "file", "left").select("hash", F.coalesce("module", paths.module_name(F.col("file"))).alias("module"))


@query("J9_not_deleted", "select distinct hash from layers where hash not in (select hash from layers where state = 'deleted' and layer = 3)")
def j9(spark, d):
    x = Views(spark, d).layers
    return x.select("hash").distinct().join(x.where("state = 'deleted' and layer = 3").select("hash").distinct(), "hash", "left_anti")


@query("J10_changed_symbols", "select hash from symbols where file in (select file from symbols where cognitive = 50)")
def j10(spark, d):
    s = Views(spark, d).symbols
    return s.select("hash", "file").join(s.where("cognitive = 50").select("file").distinct(), "file", "left_semi").select("hash")


@query("U4_rebase_sets", "select case when b.hash is null then 'overlay_only' else 'common' end as part, count(*) as n from (select hash from symbols where start_line % 13 <> 0) a left join (select hash from symbols where start_line % 17 <> 0) b on a.hash = b.hash group by 1")
def u4(spark, d):
    s = Views(spark, d).symbols
    a, b = s.where("start_line % 13 <> 0").select("hash"), s.where("start_line % 17 <> 0").select("hash")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.join(b, "hash", "left_semi"), "common").unionByName(n(a.join(b, "hash", "left_anti"), "overlay_only"))


@query("U9_ordered_distinct", "select p_partkey, case when p_name = p_brand then p_name else p_name || ',' || p_brand end as items from part")
def u9(spark, d):
    return Views(spark, d).table("part").select("p_partkey", F.array_join(F.array_distinct(F.array("p_name", "p_brand", "p_name")), ",").alias("items"))


@query("X6_scope_filter", "select event_id, 'working' as scope from events where starts_with(event_type, 'view')")
def x6(spark, d):
    e = Views(spark, d).table("events").withColumn("scope", F.when(F.col("event_type").startswith("view"), "working").otherwise("base"))
    return e.where("scope = 'working'").select("event_id", "scope")

"""Parsers of captured text, patterns and extraction, fed from the tables (S, D, E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeframe.functions import boilerplate, paths, registry, rules, text
from codeframe.operators import duplicates
from codeframe.plans.registry import query
from codeframe.plans.views import Views
from codeframe.sources import extract, files, git, patterns, tools


def _lines(spark, d, table: str, value):
    return Views(spark, d).table(table).select(value.alias("value"))


@query("S8_call_graph_text", "select caller, callee, edge_kind from edges")
def s8(spark, d):
    e = Views(spark, d).edges
    item = F.concat(F.lit('"'), paths.edge_encode(F.col("callee"), F.col("edge_kind")), F.lit('"'))
    text_ = e.groupBy("caller").agg(F.concat_ws(", ", F.collect_list(item)).alias("x")).select(F.concat("caller", F.lit(": ["), "x", F.lit("]")).alias("value"))
    return files.call_graph(text_)


@query("S10_toon_tables", "select p_partkey as doc, 'parts' as \"table\", cast(1 as bigint) as \"row\", p_name || ',x' as name, cast(p_size as varchar) as size from part")
def s10(spark, d):
    p = Views(spark, d).table("part")
    body = F.array(F.lit("parts[1]{name,size}:"), F.concat(F.lit('  "'), F.col("p_name"), F.lit(',x",'), F.col("p_size").cast("string")), F.lit("tail: 1"))
    rows = files.toon_rows(p.select(F.col("p_partkey").alias("doc"), F.posexplode(body)).select("doc", F.col("pos").cast("long").alias("line"), F.col("col").alias("value")))
    return rows.select("doc", "table", "row", F.col("fields")["name"].alias("name"), F.col("fields")["size"].alias("size"))


@query("S9_sections", "select p_partkey as doc, p_brand as name, p_type as kind, cast(p_size as varchar) as size from part")
def s9(spark, d):
    p = Views(spark, d).table("part")
    body = F.array(F.lit("junk"), F.concat(F.lit("--- "), F.col("p_brand"), F.lit(" ---")), F.concat(F.lit("kind: "), F.col("p_type")), F.concat(F.lit("size: "), F.col("p_size").cast("string")))
    out = files.sections(p.select(F.col("p_partkey").alias("doc"), F.posexplode(body)).select("doc", F.col("pos").alias("line"), F.col("col").alias("value")))
    return out.select("doc", "name", F.col("fields")["kind"].alias("kind"), F.col("fields")["size"].alias("size"))


@query("S12_module_registry", "select distinct module as full_path, lower(replace(module, '#', '')) as short_name from symbols where module in ('Brand#11', 'Brand#12')")
def s12(spark, d):
    m = Views(spark, d).symbols.select(F.col("module").alias("full_path"), F.lower(F.replace("module", F.lit("#"), F.lit(""))).alias("short_name")).distinct()
    return m.where(F.col("short_name").isin("brand11", "brand12"))


@query("S13_name_status", "select path, case when change_type = 'deleted' then 'src/old' || o_orderkey || '.ts' end as old_path, case when change_type = 'deleted' then 'renamed' else change_type end as change_type from changes")
def s13(spark, d):
    c = Views(spark, d).changes
    line = F.when(F.col("change_type") == "modified", F.concat_ws("\t", F.lit("M"), "path")).when(F.col("change_type") == "added", F.concat_ws("\t", F.lit("A"), "path"))
    return git.name_status(c.select(line.alias("v"), "*").select(F.coalesce("v", F.concat_ws("\t", F.lit("R087"), F.concat(F.lit("src/old"), F.col("o_orderkey").cast("string"), F.lit(".ts")), "path")).alias("value")))


@query("S14_commits", "select md5(cast(o_orderkey as varchar)) as sha, 'o | ' || o_orderpriority as subject from orders")
def s14(spark, d):
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    v = F.concat_ws("\x1f", sha, F.substring(sha, 1, 7), F.concat(F.lit("o | "), F.col("o_orderpriority")), F.lit("someone"), F.col("o_orderdate").cast("string"))
    return git.log_lines(_lines(spark, d, "orders", v)).select("sha", "subject")


@query("S15_numstat", "select 'f' || p_partkey as path, case when p_size % 5 = 0 then 0 else p_size end as added, case when p_size % 5 = 0 then 0 else p_partkey % 7 end as removed from part")
def s15(spark, d):
    binary = F.col("p_size") % 5 == 0
    v = F.concat_ws("\t", F.when(binary, "-").otherwise(F.col("p_size").cast("string")), F.when(binary, "-").otherwise((F.col("p_partkey") % 7).cast("string")), F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    return git.numstat(_lines(spark, d, "part", v))


_TSC = "select 'src/f' || p_partkey || '.ts' as file, cast(p_size as bigint) as line, p_partkey % 80 as \"column\", case when p_size % 3 = 0 then 'error' else 'warning' end as severity, 'TS' || (2000 + p_size) as rule, 'bad ' || p_name as message, 'tsc' as linter from part"


def _tsc(spark, d):
    c = lambda x: x.cast("string")
    v = F.concat(F.lit("src/f"), c(F.col("p_partkey")), F.lit(".ts("), c(F.col("p_size")), F.lit(","), c(F.col("p_partkey") % 80), F.lit("): "), F.when(F.col("p_size") % 3 == 0, "error").otherwise("warning"), F.lit(" TS"), c(F.col("p_size") + 2000), F.lit(": bad "), F.col("p_name"))
    return tools.lint_lines(_lines(spark, d, "part", v), "tsc")


@query("S17_lint_output", _TSC)
def s17(spark, d):
    return _tsc(spark, d)


@query("S17_lint_selected", f"select sum(case when severity = 'error' then 1 else 0 end) as errors, sum(case when severity = 'warning' then 1 else 0 end) as warnings, count(distinct file) as files from (select * from ({_TSC}) where severity = 'error' order by file, line limit 100)")
def s17b(spark, d):
    return tools.rollup(tools.select_issues(_tsc(spark, d), "error", limit=100))


@query("S18_test_output", "select p_partkey as run, cast(p_size as bigint) as passed, p_partkey % 4 as failed, cast(0 as bigint) as skipped, p_size + p_partkey % 4 as total from part")
def s18(spark, d):
    c = lambda x: x.cast("string")
    last = F.concat(F.lit("== "), c(F.col("p_partkey") % 4), F.lit(" failed, "), c(F.col("p_size")), F.lit(" passed in 1.2s =="))
    out = Views(spark, d).table("part").select(F.col("p_partkey").alias("run"), F.posexplode(F.array(F.lit("collected 9 items"), F.lit("3 passed so far"), last))).select("run", F.col("pos").alias("line"), F.col("col").alias("value"))
    return tools.test_results(out, "pytest")


@query("G32_languages", "select * from (values " + ", ".join(f"('{k}', '{', '.join(sorted(v.split()))}')" for k, v in paths.LANGUAGES.items()) + ") t(language, extensions)")
def g32(spark, d):
    return spark.createDataFrame([(k, ", ".join(sorted(v.split()))) for k, v in paths.LANGUAGES.items()], "language string, extensions string")


@query("D10_pattern_matches")
def d10p(spark, d):
    """Documents, read as source of a language by source number, against the catalogue; fingerprints have no cheap SQL."""
    langs = F.array(*[F.lit(x) for x in ("python", "java", "javascript", "go")])
    calls = F.array(F.lit("load(a); loads(y)"), F.lit("deserialize(a); readObject(b)"), F.lit("exec(a); spawn(b)"), F.lit("system(a)"))
    f = Views(spark, d).files.select("doc_id", F.element_at(langs, (F.col("doc_id") % 4 + 1).cast("int")).alias("language"), F.concat(F.lit("try: "), F.element_at(calls, (F.col("doc_id") % 4 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, "; other(z)").otherwise("")).alias("text"))
    return duplicates.match_patterns(patterns.fingerprints(f), patterns.catalogue(spark), 0.3)


@query("G28_pattern_summary")
def g28(spark, d):
    return d10p(spark, d).groupBy("severity").agg(F.count("*").alias("matches"))


@query("C5_line_terms", "select file, line, lower(regexp_extract(ltrim(line_text), '^(if|for|while|match|try)[^ ]*', 0)) as term from lines where regexp_matches(ltrim(line_text), '^(if|for|while|match|try)')")
def c5(spark, d):
    t = F.ltrim("line_text")
    return Views(spark, d).lines.where(t.rlike("^(if|for|while|match|try)")).select("file", "line", F.lower(F.regexp_extract(t, "^(if|for|while|match|try)[^ ]*", 0)).alias("term"))


@query("C4_path_terms", "select distinct file, regexp_extract(file, '([^/.]+)[.][^/]*$', 1) || ' ' || split_part(file, '/', 2) as terms from symbols where file like 'src/brand1/%'")
def c4(spark, d):
    f = Views(spark, d).symbols.where(F.col("file").startswith("src/brand1/")).select("file").distinct()
    return f.select("file", F.array_join(F.array_distinct(F.concat(text.bm25_terms(paths.stem(F.col("file"))), text.bm25_terms(paths.base_name(paths.parent_dir(F.col("file")))))), " ").alias("terms"))


@query("C11_token_breakdown", "select doc_id, cast(sum(length(line_text) - length(ltrim(line_text))) as bigint) as blank, cast(sum(len(regexp_extract_all(line_text, '[{}\\[\\]():,;]'))) as bigint) as structural from lines group by 1")
def c11(spark, d):
    v = F.col("line_text")
    return Views(spark, d).lines.groupBy("doc_id").agg(F.sum(F.length(v) - F.length(F.ltrim(v))).alias("blank"), F.sum(F.regexp_count(v, F.lit(r"[{}\[\]():,;]")).cast("long")).alias("structural"))


@query("C31_infer_type", "select p_partkey, (['string', 'number', 'array', 'boolean', null])[p_partkey % 5 + 1] as type from part")
def c31(spark, d):
    init = F.element_at(F.array(*map(F.lit, ["'x'", "42", "[1, 2]", "true", "f(x)"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return Views(spark, d).table("part").select("p_partkey", text.infer_type(init).alias("type"))


@query("C34_symbol_name", "select p_partkey, replace(p_name, ' ', '_') as name from part")
def c34(spark, d):
    k, n = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit("_"))
    line = F.when(k == 0, F.concat(F.lit("pub fn "), n, F.lit("(x)"))).when(k == 1, F.concat(F.lit("class "), n, F.lit(" {"))).when(k == 2, F.concat(F.lit("  const "), n, F.lit(" = 1"))).otherwise(F.concat(F.lit("* "), n))
    return Views(spark, d).table("part").select("p_partkey", rules.symbol_name_of_line(line).alias("name"))


@query("C38_insertion_order", "select p_partkey, case p_partkey % 2 when 0 then 'network call;' || p_name else p_name || ';plain' end as items from part")
def c38(spark, d):
    items = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_name"), F.lit("network call"))).otherwise(F.array(F.col("p_name"), F.lit("plain")))
    return Views(spark, d).table("part").select("p_partkey", F.array_join(rules.insertions_in_order(items), ";").alias("items"))


@query("V1_sql_functions", "select p_partkey, cast(ceil(strlen(p_name) / 3.8::double) as bigint) as tokens, case when p_size % 6 <= 1 then 'low' when p_size % 6 <= 3 then 'medium' else 'high' end as risk from part")
def v1(spark, d):
    registry.register(spark)
    return Views(spark, d).table("part").selectExpr("p_partkey", "cf_estimate_tokens(p_name) as tokens", "cf_risk_level(p_size % 6) as risk")


_RUST = "'pub fn ' || replace(p_name, ' ', '_') || '() {' || chr(10) || '    if x {' || chr(10) || '        go(1);' || chr(10) || '    }' || chr(10) || '}' || chr(10) || 'struct S' || p_partkey || ';'"


@query("E1_symbols", f"select 'src/m' || (p_partkey % 9) || '/f' || p_partkey || '.rs' as file, replace(p_name, ' ', '_') as symbol, 'function' as kind, cast(1 as bigint) as start_line, cast(5 as bigint) as end_line, true as is_exported, cast(1 as bigint) as cognitive from part union all select 'src/m' || (p_partkey % 9) || '/f' || p_partkey || '.rs', 'S' || p_partkey, 'struct', 6, 6, false, 0 from part where {_RUST} <> ''")
def e1(spark, d):
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("pub fn "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("() {\n    if x {\n        go(1);\n    }\n}\nstruct S"), k, F.lit(";"))
    f = Views(spark, d).table("part").select(F.concat(F.lit("src/m"), (F.col("p_partkey") % 9).cast("string"), F.lit("/f"), k, F.lit(".rs")).alias("file"), F.lit("rust").alias("language"), body.alias("text"))
    return extract.symbols(f).select("file", "symbol", "kind", "start_line", "end_line", "is_exported", "cognitive")


@query("N1_extracted_calls", "select 'src/f' || p_partkey || '.py' as file, 'helper' as name, 'src/g.py' as target from part")
def n1(spark, d):
    k = F.col("p_partkey").cast("string")
    f = Views(spark, d).table("part").select(F.concat(F.lit("src/f"), k, F.lit(".py")).alias("file"), F.lit("python").alias("language"), F.concat(F.lit("def run"), k, F.lit("(a):\n    return helper(a)\n")).alias("text"))
    g = spark.createDataFrame([("src/g.py", "python", "def helper(a):\n    pass\n")], "file string, language string, text string")
    from codeframe.operators import graph

    both = f.unionByName(g)
    syms = extract.symbols(both)
    found = graph.resolve_calls(extract.calls(both, syms).select("file", "name"), syms)
    return found.join(syms.select(F.col("hash").alias("callee"), F.col("file").alias("target")), "callee").select("file", "name", "target")


@query("N3_imports", "select 'src/f' || p_partkey || '.go' as file, 'pkg/' || p_brand[7:] as imported from part")
def n3(spark, d):
    f = Views(spark, d).table("part").select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("file"), F.lit("go").alias("language"), F.concat(F.lit('package x\nimport (\n  "pkg/'), F.substring("p_brand", 7, 9), F.lit('"\n)\n')).alias("text"))
    return extract.imports(f)


_NAMES = ["handleClick", "isUser", "set_size", "with_name", "new", "drop", "Awake", "Equals", "compute", "getStaticProps"]
_CLASSES = ["event_handler", "type_guard", "rust_setter", "rust_builder", "rust_constructor", "rust_drop", "unity_lifecycle", "equality_members", None, "nextjs_data_fetching"]


@query("D9_boilerplate", f"select p_partkey, case when p_size % 7 = 0 then 'mine' else ({'[' + ', '.join('null' if x is None else repr(x) for x in _CLASSES) + ']'})[p_partkey % 10 + 1] end as category from part")
def d9(spark, d):
    names = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 10 + 1).cast("int"))
    none = F.lit(None).cast("string")
    p = Views(spark, d).table("part").select("p_partkey", names.alias("name"), F.when(F.col("p_size") % 7 == 0, "src/gen/x.ts").otherwise("src/a.ts").alias("file"))
    s = boilerplate.Symbol(F.col("name"), F.array().cast("array<string>"), F.lit(""), F.col("file"), F.lit(0), none)
    return p.select("p_partkey", boilerplate.classify(s, [boilerplate.custom("mine", file_glob="src/gen/**")]).alias("category"))


@query("E2_entry_points", "select p_partkey, (['nextjs_page', 'nest_controller', 'react_component', 'main', 'none'])[p_partkey % 5 + 1] as entry_point from part")
def e2(spark, d):
    at = (F.col("p_partkey") % 5 + 1).cast("int")
    file = F.element_at(F.array(*map(F.lit, ["pages/a.tsx", "src/u.controller.ts", "src/V.tsx", "src/m.rs", "src/m.rs"])), at)
    name = F.element_at(F.array(*map(F.lit, ["Home", "UserCtl", "View", "main", "helper"])), at)
    return Views(spark, d).table("part").select("p_partkey", boilerplate.entry_point(file, name).alias("entry_point"))


@query("D7_cluster_summary", "select class_id, count(*) || ' copies, ' || case when count(*) > 3 then 'many' else 'few' end as summary from (select s.doc_id, r.doc_id as class_id from signatures s join (select calls, names, params, min(doc_id) as doc_id from signatures group by 1, 2, 3) r on r.calls = s.calls and r.names = s.names and r.params = s.params) group by 1 having count(*) > 1")
def d7(spark, d):
    c = duplicates.class_sizes(Views(spark, d).signatures).withColumnRenamed("copies", "n").where("n > 1")
    return c.select("class_id", F.concat(F.col("n").cast("string"), F.lit(" copies, "), F.when(F.col("n") > 3, "many").otherwise("few")).alias("summary"))

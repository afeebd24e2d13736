"""Scalar functions over rows of the tables (C, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeframe.functions import hashing, paths, rules, text
from codeframe.plans.registry import query
from codeframe.plans.views import Views

FNV = "printf('%016x', cast(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(regexp_replace(hex(encode({0})), '(..)', '\\1 ', 'g'), ' ')[1:strlen({0})], lambda x: cast(('0x' || x) as HUGEINT))), lambda h, y: (xor(h, y) * 1099511628211) % 18446744073709551616) as UHUGEINT))"


def _fnv_sql(expr: str) -> str:
    return FNV.format(expr)


STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("C1_fnv1a", f"""with h as (select p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: cast(ascii(p_name[i]) as HUGEINT))), lambda h, y: (xor(h, y) * 1099511628211) % 18446744073709551616) as v from part)
    select p_partkey, lower(lpad(hex(cast(v as UBIGINT)), 16, '0')) as fnv from h""")
def c1(spark, d):
    return Views(spark, d).table("part").select("p_partkey", hashing.fnv1a_hex(F.col("p_name")).alias("fnv"))


@query("C2_bm25_tokens", f"""select doc_id, array_to_string(list_distinct_ordered, ' ') as terms from (select doc_id, list_sort(list_distinct(ws)) as list_distinct_ordered from
    (select doc_id, list_filter(flatten(list_transform(list_filter(regexp_split_to_array(head, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_concat(list_transform(string_split(trim(regexp_replace(w, '(\\p{{Lu}})', ' \\1', 'g')), ' '), lambda x: x), [w]))), lambda x: strlen(x) >= 2 and lower(x) not in ({STOPS})) as raw, list_transform(raw, lambda x: lower(x)) as ws from (select doc_id, text as head from documents)))""")
def c2(spark, d):
    return Views(spark, d).table("documents").select("doc_id", F.array_join(F.array_sort(text.bm25_terms(F.col("text"))), " ").alias("terms"))


_CAMEL = "case p_partkey % 4 when 0 then 'handleUser' || upper(p_name[1]) || p_name[2:3] when 1 then replace(p_name, ' ', '_') when 2 then replace(p_name, ' ', '-Http') else 'parseXMLDoc_' || p_partkey end"


def _camel(k=None):
    n = F.col("p_name")
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("handleUser"), F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 2))).when(k == 1, F.replace(n, F.lit(" "), F.lit("_"))).when(k == 2, F.replace(n, F.lit(" "), F.lit("-Http"))).otherwise(F.concat(F.lit("parseXMLDoc_"), F.col("p_partkey").cast("string")))


@query("C6_camel_snake", f"select name, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(name, '([A-Z])', '_\\1', 'g'), '-', '_', 'g')), '_'), lambda x: x <> ''), ' ') as tokens from (select distinct {_CAMEL} as name from part)")
def c6(spark, d):
    return Views(spark, d).table("part").select(_camel().alias("name")).distinct().select("name", F.array_join(text.camel_snake(F.col("name")), " ").alias("tokens"))


@query("C7_symbol_tokens", f"select name, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[_.\\-\\s]+'), lambda x: length(x) > 1), ' ') as tokens from (select distinct {_CAMEL} as name from part)")
def c7(spark, d):
    return Views(spark, d).table("part").select(_camel().alias("name")).distinct().select("name", F.array_join(text.symbol_tokens(F.col("name")), " ").alias("tokens"))


KNOWN = ", ".join("'" + w.replace("'", "''") + "'" for w in text.ONE_TOKEN)
_PLAIN = "case when {w} in (" + KNOWN + ") or lower({w}) in (" + KNOWN + ") then 1 when regexp_matches({w}, '^[0-9]+$') then (strlen({w}) + 3) // 4 when strlen({w}) = 0 then 0 when strlen({w}) <= 4 then 1 when strlen({w}) <= 10 then 2 else (strlen({w}) + 3) // 4 end"
_PARTS = "list_filter(string_split(regexp_replace({w}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1_\\2', 'g'), '_'), lambda p: p <> '')"
_WORD = "case when {w} in (" + KNOWN + ") or lower({w}) in (" + KNOWN + ") or len(" + _PARTS + ") <= 1 then " + _PLAIN + " else list_sum(list_transform(" + _PARTS + ", lambda p: " + _PLAIN.replace("{w}", "p") + ")) end"


@query("C8_count_tokens", f"""select doc_id, cast(greatest(1, list_sum(list_transform(runs, lambda r: case when regexp_matches(r, '^[ \\t]') then (length(r) + 4) // 5 when regexp_matches(r, '^[\\n\\r{{}}\\[\\]():,;"'']') then 1 else {_WORD.format(w='r')} end))) as bigint) as tokens from
    (select doc_id, regexp_extract_all(text, '[ \\t]+|[\\n\\r{{}}\\[\\]():,;"'']|[^ \\t\\n\\r{{}}\\[\\]():,;"'']+') as runs from documents)""")
def c8(spark, d):
    return Views(spark, d).table("documents").select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


@query("C9_word_tokens", f"select name, cast({_WORD.format(w='name')} as bigint) as tokens from (select distinct {_CAMEL} as name from part union select distinct cast(p_partkey * 1237 as varchar) from part union select 'function')")
def c9(spark, d):
    p = Views(spark, d).table("part")
    names = p.select(_camel().alias("name")).union(p.select((F.col("p_partkey") * 1237).cast("string"))).union(spark.createDataFrame([("function",)], "name string")).distinct()
    return names.select("name", text.word_tokens(F.col("name")).cast("long").alias("tokens"))


@query("C10_split_identifier", f"select name, array_to_string({_PARTS.format(w='name')}, ' ') as parts from (select distinct {_CAMEL} as name from part)")
def c10(spark, d):
    return Views(spark, d).table("part").select(_camel().alias("name")).distinct().select("name", F.array_join(text.split_identifier(F.col("name")), " ").alias("parts"))


@query("C12_reduction", "select p_partkey, round(case when p_size = 0 then 0.0 else (p_size - p_partkey % 7) / p_size * 100.0 end, 6) as percent from part")
def c12(spark, d):
    return Views(spark, d).table("part").select("p_partkey", F.round(text.reduction_percent(F.col("p_size"), F.col("p_partkey") % 7), 6).alias("percent"))


@query("C13_estimate_tokens", "select doc_id, cast(ceil(strlen(text) / 3.8::double) as bigint) as tokens from documents")
def c13(spark, d):
    return Views(spark, d).table("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_NS = "list_filter(string_split(regexp_replace(file, '/?[^/]*$', ''), '/'), lambda p: p not in ('', 'src', 'lib', '.', '..', 'app', 'pages'))"


@query("C14_namespace", f"select distinct file, case when len({_NS}) > 0 then array_to_string({_NS}, '.') else split_part(file, '.', 1) end as namespace from symbols")
def c14(spark, d):
    return Views(spark, d).symbols.select("file", paths.namespace(F.col("file")).alias("namespace")).distinct()


_MOD = "list_filter(string_split(regexp_replace(file, '/?[^/]*$', ''), '/'), lambda p: p not in ('', '.', '..'))"


@query("C15_module_path", f"select file, case when len({_MOD}) > 0 then array_to_string({_MOD}, '.') when split_part(file, '.', 1) in ('index', 'mod', 'lib', 'main', '__init__') then 'root' else split_part(file, '.', 1) end as module from (select distinct file from symbols union all select 'main.rs' union all select 'tool.rs')")
def c15(spark, d):
    f = Views(spark, d).symbols.select("file").distinct().unionByName(spark.createDataFrame([("main.rs",), ("tool.rs",)], "file string"))
    return f.select("file", paths.module_path(F.col("file")).alias("module"))


@query("C16_module_name", "select file, replace(regexp_replace(regexp_extract(file, '^src/(.*)$', 1), '/?[^/]*$', ''), '/', '.') as module from files")
def c16(spark, d):
    return Views(spark, d).files.select("file", paths.module_name(F.col("file")).alias("module"))


@query("C17_optimal_names", """with m as (select distinct 'src.' || source || '.' || lang || case when doc_id % 2 = 0 then '.a' else '.b' || doc_id % 3 end as name from documents union select 'root'), p as (select name, string_split(name, '.') as parts from m), multi as (select * from p where len(parts) > 1),
    cut as (select name, d, array_to_string(parts[d + 1:], '.') as short from multi, (select unnest(range(1, (select min(len(parts)) from multi))) as d)), bad as (select min(d) as bad from (select d, short from cut group by 1, 2 having count(*) > 1 union all select d, short from cut where short in (select name from p where len(parts) = 1))),
    depth as (select coalesce(least(bad, (select min(len(parts)) from multi)) - 1, 0) as depth from bad)
    select p.name as "full", case when len(parts) > 1 then array_to_string(parts[depth + 1:], '.') else p.name end as short, cast(depth as bigint) as depth from p, depth""")
def c17(spark, d):
    from codeframe.operators.incremental import optimal_names

    k = F.col("doc_id")
    tail = F.when(k % 2 == 0, ".a").otherwise(F.concat(F.lit(".b"), (k % 3).cast("string")))
    names = Views(spark, d).table("documents").select(F.concat(F.lit("src."), F.col("source"), F.lit("."), F.col("lang"), tail).alias("full"))
    return optimal_names(names.unionByName(spark.createDataFrame([("root",)], "full string")))


_RANGE = "case p_partkey % 4 when 0 then p_size || '-' || (p_size + 9) when 1 then cast(p_size as varchar) when 2 then 'a-b' else '' end"


def _range():
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    return F.when(k == 0, F.concat_ws("-", n, n + 9)).when(k == 1, n.cast("string")).when(k == 2, "a-b").otherwise("")


@query("C18_parse_lines", f"select p_partkey, coalesce(try_cast(nullif(regexp_extract(s, '^([0-9]+)-([0-9]+)$', 1), '') as bigint), 0) as s0, coalesce(try_cast(nullif(regexp_extract(s, '^([0-9]+)-([0-9]+)$', 2), '') as bigint), 0) as s1 from (select p_partkey, {_RANGE} as s from part)")
def c18(spark, d):
    r = paths.parse_lines(F.col("s"))
    return Views(spark, d).table("part").select("p_partkey", _range().alias("s")).select("p_partkey", r["start"].alias("s0"), r["end"].alias("s1"))


@query("C19_line_range", f"select p_partkey, try_cast(nullif(regexp_extract(s, '^([0-9]+)(-[0-9]+)?$', 1), '') as bigint) as s0, try_cast(coalesce(nullif(regexp_extract(s, '^([0-9]+)-([0-9]+)$', 2), ''), nullif(regexp_extract(s, '^([0-9]+)$', 1), '')) as bigint) as s1 from (select p_partkey, {_RANGE} as s from part)")
def c19(spark, d):
    r = paths.parse_line_range(F.col("s"))
    return Views(spark, d).table("part").select("p_partkey", _range().alias("s")).select("p_partkey", r["start"].alias("s0"), r["end"].alias("s1"))


_INS = "case p_partkey % 5 when 0 then ['network call', 'Database write'] when 1 then ['fetch data'] when 2 then ['local storage'] when 3 then ['ui'] else cast([] as varchar[]) end"


@query("C20_file_risk", f"""select p_partkey, score, case when score <= 1 then 'low' when score <= 3 then 'medium' else 'high' end as risk from (select p_partkey, cast(least(p_partkey % 6, 3) + p_partkey % 3 + case when p_size > 0 then 1 else 0 end + case when p_size > 5 then 1 else 0 end + case when p_size > 15 then 1 else 0 end
    + 2 * len(list_filter({_INS}, lambda s: regexp_matches(lower(s), 'network|fetch|invoke|i/o|file'))) + case when p_partkey % 7 = 0 then 3 else 0 end + 3 * len(list_filter({_INS}, lambda s: regexp_matches(lower(s), 'storage|database|persist'))) as bigint) as score from part)""")
def c20(spark, d):
    k, lit = F.col("p_partkey"), lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    ins = F.when(k % 5 == 0, lit("network call", "Database write")).when(k % 5 == 1, lit("fetch data")).when(k % 5 == 2, lit("local storage")).when(k % 5 == 3, lit("ui")).otherwise(lit())
    s = rules.file_risk_score(k % 6, k % 3, F.col("p_size"), ins, k % 7 == 0).cast("long")
    return Views(spark, d).table("part").select("p_partkey", s.alias("score")).withColumn("risk", rules.risk_level(F.col("score")))


@query("C21_symbol_risk", "select p_partkey, case when s <= 1 then 'low' when s <= 3 then 'medium' else 'high' end as risk from (select p_partkey, least(p_size, 3) + 2 * (p_partkey % 2) + p_partkey % 3 as s from part)")
def c21(spark, d):
    k = F.col("p_partkey")
    return Views(spark, d).table("part").select("p_partkey", rules.risk_level(rules.symbol_risk_score(F.col("p_size"), k % 2, k % 3)).alias("risk"))


@query("C23_primary_symbol", "select file, hash from (select file, hash, row_number() over (partition by file order by case when is_exported then 50 else 0 end + case kind when 'class' then 30 when 'function' then 20 else 10 end desc, start_line, hash) as r from symbols) where r = 1")
def c23(spark, d):
    kind = F.col("kind")
    score = F.when(F.col("is_exported"), 50).otherwise(0) + F.when(kind == "class", 30).when(kind == "function", 20).otherwise(10)
    return Views(spark, d).symbols.groupBy("file").agg(F.min(F.struct(-score, F.col("start_line"), F.col("hash")))["hash"].alias("hash"))


@query("C25_fingerprint_similarity", "select p_partkey, 1.0::double - bit_count(xor(p_partkey, cast(p_size as bigint))) / 64.0::double as similarity from part")
def c25(spark, d):
    return Views(spark, d).table("part").select("p_partkey", hashing.fingerprint_similarity(F.col("p_partkey"), F.col("p_size").cast("long")).alias("similarity"))


@query("C26_jaccard", "select doc_id, round(case when len(list_distinct(list_concat(calls, names))) = 0 then 1.0 else len(list_intersect(list_distinct(calls), list_distinct(names))) / len(list_distinct(list_concat(calls, names))) end, 9) as jaccard from signatures")
def c26(spark, d):
    return Views(spark, d).signatures.select("doc_id", F.round(hashing.jaccard(F.col("calls"), F.col("names")), 9).alias("jaccard"))


@query("C27_cosine", "select a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * cast(x as double)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: cast(x as double) * cast(x as double))))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def c27(spark, d):
    e = Views(spark, d).table("embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(hashing.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("C28_min_max", "select p_partkey, round((p_retailprice - lo) / (hi - lo), 9) as scaled from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)")
def c28(spark, d):
    p = Views(spark, d).table("part")
    ends = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(ends, F.lit(True)).select("p_partkey", F.round(hashing.min_max(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 9).alias("scaled"))


@query("C30_callee_category", "select symbol, case when regexp_matches(symbol, 'get|fetch|load|read|find') then 'read' when regexp_matches(symbol, 'set|save|write|update|insert|create|delete') then 'write' when regexp_matches(symbol, 'log|print|debug|warn|error') then 'logging' when regexp_matches(symbol, 'test|assert|expect|mock') then 'testing' when regexp_matches(symbol, 'parse|format|convert|serialize|encode|decode') then 'transform' else 'other' end as category from (select distinct symbol from symbols)")
def c30(spark, d):
    return Views(spark, d).symbols.select("symbol").distinct().select("symbol", rules.callee_category(F.col("symbol")).alias("category"))


_INITS = ["getUser(1)", "self.cache.load(x)", "Vec::new()", "42", "'text'", "items.map(f)", "a(1)", "null", "db.query(q)", "plain"]
_INIT_OUT = ["getUser", "load", "new", None, None, None, None, None, "query", None]


@query("C32_initializer_call", f"select p_partkey, (['{chr(39).join(x.replace(chr(39), chr(39) * 2) + (chr(39) + ',' if False else '') for x in [])}'])[1] as call from part where false union all select p_partkey, ({'[' + ', '.join('null' if x is None else repr(x) for x in _INIT_OUT) + ']'})[p_partkey % 10 + 1] from part")
def c32(spark, d):
    init = F.element_at(F.array(*map(F.lit, _INITS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return Views(spark, d).table("part").select("p_partkey", rules.call_of_initializer(init).alias("call"))


@query("C33_truncate", "select doc_id, text[1:80] as head from documents")
def c33(spark, d):
    return Views(spark, d).table("documents").select("doc_id", text.truncate(F.col("text"), 80).alias("head"))


@query("C35_edge_codec", "select caller, callee, callee || case edge_kind when 'call' then '' else ':' || edge_kind end as encoded, edge_kind from edges")
def c35(spark, d):
    e = Views(spark, d).edges.select("caller", paths.edge_encode(F.col("callee"), F.col("edge_kind")).alias("encoded"))
    return e.select("caller", paths.edge_callee(F.col("encoded")).alias("callee"), "encoded", paths.edge_kind(F.col("encoded")).alias("edge_kind"))


@query("C36_split_quoted", "select p_partkey, p_name || '|' || p_brand || ',x|' || p_size as parts from part")
def c36(spark, d):
    s = F.concat(F.lit('"'), F.col("p_name"), F.lit('", "'), F.col("p_brand"), F.lit(',x", '), F.col("p_size").cast("string"))
    return Views(spark, d).table("part").select("p_partkey", F.array_join(paths.split_quoted(s), "|").alias("parts"))


@query("C37_looks_like_hash", "select v, regexp_matches(v, '^[0-9a-f]{8}:[0-9a-f]{16}$') or regexp_matches(v, '^[0-9a-f]{16}$') as is_hash from (select md5(p_name)[1:8] || ':' || md5(p_name)[9:24] as v from part union select md5(p_name)[1:16] from part union select p_name from part)")
def c37(spark, d):
    m = F.md5(F.col("p_name").cast("binary"))
    p = Views(spark, d).table("part")
    v = p.select(F.concat_ws(":", F.substring(m, 1, 8), F.substring(m, 9, 16)).alias("v")).union(p.select(F.substring(m, 1, 16))).union(p.select("p_name")).distinct()
    return v.select("v", paths.looks_like_hash(F.col("v")).alias("is_hash"))


@query("C40_sanitize", "select distinct p_brand, regexp_replace(p_brand || '/' || p_type, '[^A-Za-z0-9_-]', '_', 'g') as file from part")
def c40(spark, d):
    return Views(spark, d).table("part").select("p_brand", text.sanitize_filename(F.concat_ws("/", "p_brand", "p_type")).alias("file")).distinct()


@query("C41_concerns", "select hash, array_to_string(list_filter([case when cognitive > 15 then 'very high complexity' when cognitive > 10 then 'high complexity' end, case when nesting > 4 then 'deep nesting' end], lambda x: x is not null), '; ') as concerns from symbols")
def c41(spark, d):
    return Views(spark, d).symbols.select("hash", F.array_join(rules.concerns(F.col("cognitive"), F.col("nesting")), "; ").alias("concerns"))


@query("C43_age", "select o_orderkey, case when date_diff('second', o_orderdate, timestamp '1998-08-02 00:30:00') < 3600 then 'fresh' else 'stale' end as state from orders")
def c43(spark, d):
    s = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.lit("1998-08-02 00:30:00").cast("timestamp_ntz").cast("timestamp"))
    return Views(spark, d).table("orders").select("o_orderkey", rules.age_state(s).alias("state"))


@query("C45_json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def c45(spark, d):
    return Views(spark, d).table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("C46_entities", "select item_id, text from benchmark")
def c46(spark, d):
    t = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return Views(spark, d).table("benchmark").select("item_id", text.decode_entities(t).alias("text"))


@query("U1_set_difference", "select source, lang, case when in_a then 'added' else 'removed' end as change from (select source, lang, bool_or(doc_id % 7 = 0) as in_a, bool_or(doc_id % 11 = 0) as in_b from documents where doc_id % 7 = 0 or doc_id % 11 = 0 group by 1, 2) where in_a <> in_b")
def u1(spark, d):
    from codeframe.operators import diff

    t = Views(spark, d).table("documents")
    return diff.added_removed(t.where("doc_id % 11 = 0"), t.where("doc_id % 7 = 0"), ["source", "lang"])


@query("U3_call_differences", "select doc_id, len(list_filter(list_distinct(names), lambda x: not list_contains(calls, x))) as extra, len(list_filter(list_distinct(calls), lambda x: not list_contains(names, x))) as missing from signatures")
def u3(spark, d):
    from codeframe.operators import duplicates

    extra, missing = duplicates.differences(F.col("calls"), F.col("names"))
    return Views(spark, d).signatures.select("doc_id", F.size(extra).cast("long").alias("extra"), F.size(missing).cast("long").alias("missing"))


@query("U7_vocabularies", "with a as (select distinct term from terms join documents using (doc_id) where source = 'src1'), b as (select distinct term from terms join documents using (doc_id) where source = 'src2') select term, case when a.term is null then 'b' when b.term is null then 'a' else 'both' end as side from a full join b using (term)")
def u7(spark, d):
    t = Views(spark, d).table("documents").where("source in ('src1', 'src2')").select("source", F.explode(text.lower_terms(F.col("text"))).alias("term"))
    side = F.when(F.bool_and(F.col("source") == "src1"), "a").when(F.bool_and(F.col("source") == "src2"), "b").otherwise("both")
    return t.groupBy("term").agg(side.alias("side"))


@query("U8_changed_files", "select distinct path from (select path from changes where change_type = 'modified' union all select path from changes where o_orderkey % 3 = 0)")
def u8(spark, d):
    c = Views(spark, d).changes
    return c.where("change_type = 'modified'").select("path").unionByName(c.where("o_orderkey % 3 = 0").select("path")).distinct()

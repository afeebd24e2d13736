"""Registration of named queries with their SQL, and the canonical views in both languages."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: FNV-1a 64 of a string's UTF-8 bytes as a number.
FNV_NUMBER = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(list_filter(string_split(regexp_replace(hex(encode({0})), '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: cast(('0x' || x) as HUGEINT))), lambda h, y: (xor(h, y) * 1099511628211) % 18446744073709551616)"
#: Common table expressions for DuckDB; each may use those above it.
VIEWS: dict[str, str] = {
    "files": "select doc_id, 'src/' || source || '/' || lang || '/doc' || doc_id || '.txt' as file, lang as language, source, text, n_chars from documents",
    "lines": "select doc_id, file, unnest(string_split(text, chr(10))) as line_text, cast(generate_subscripts(string_split(text, chr(10)), 1) as bigint) as line from files",
    "symbols": """select cast(p_partkey as varchar) as hash, replace(p_name, ' ', '_') as symbol, p_brand as module,
        case p_type when 'ECONOMY' then 'function' when 'LARGE' then 'struct' when 'MEDIUM' then 'class' when 'PROMO' then 'interface' when 'SMALL' then 'method' else 'enum' end as kind,
        'src/' || lower(replace(p_brand, '#', '')) || '/file' || (p_partkey % 40) || '.ts' as file,
        cast(p_partkey % 97 + 1 as bigint) as start_line, cast(p_partkey % 97 + 1 + p_size as bigint) as end_line,
        case when p_size % 6 <= 1 then 'low' when p_size % 6 <= 3 then 'medium' else 'high' end as risk,
        cast(p_size as bigint) as cognitive, cast(p_size % 7 as bigint) as nesting, p_partkey % 3 = 0 as is_exported, p_partkey % 11 = 0 as is_escape_local, cast(p_partkey % 5 as bigint) as arity from part""",
    "edges": """select distinct cast(a.l_partkey as varchar) as caller, cast(b.l_partkey as varchar) as callee, case a.l_returnflag when 'A' then 'call' when 'N' then 'read' else 'write' end as edge_kind
        from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1""",
    "pairs": "select distinct caller, callee from edges",
    "externals": "select distinct cast(l.l_partkey as varchar) as caller, 'ext:' || n_name || ':' || s_name as callee from lineitem l join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey",
    "fan": """select s.hash, coalesce(i.n, 0) as fan_in, coalesce(o.n, 0) as fan_out from symbols s
        left join (select callee, count(*) as n from pairs group by 1) i on i.callee = s.hash left join (select caller, count(*) as n from pairs group by 1) o on o.caller = s.hash""",
    "layers": """select event_id as seq, cast(user_id as varchar) as hash, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 else cast(floor(value) as bigint) % 4 end as layer,
        case when event_type = 'error' then 'deleted' else 'active' end as state, 'src/u' || (user_id % 10) || '.ts' as file, value from events""",
    "resolved": "select * from (select *, row_number() over (partition by hash order by layer desc) as r from (select *, row_number() over (partition by layer, hash order by seq desc) as w from layers) where w = 1) where r = 1",
    "changes": "select 'src/o' || o_orderkey || '.ts' as path, case o_orderstatus when 'P' then 'modified' when 'O' then 'added' else 'deleted' end as change_type, o_orderpriority as language, o_orderkey from orders",
    "terms": """select distinct doc_id, lower(w) as term from (select doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+')) as w from documents) where strlen(w) >= 2
        and lower(w) not in ('and','are','an','as','at','a','by','be','for','if','is','in','it','of','on','or','the','to','was','with','const','fn','impl','let','mut','pub','self','var','e','i','j','k','n','s','t','x','y')""",
    "signatures": """select doc_id, source as module, list_sort(list_filter(words, lambda w: not regexp_matches(w, '^\\p{Lu}'))) as calls, list_sort(list_filter(words, lambda w: regexp_matches(w, '^\\p{Lu}'))) as names, cast(n_chars % 8 as bigint) as params
        from (select doc_id, source, n_chars, list_distinct(list_filter(string_split(regexp_replace(text, '[\\s]+', ' ', 'g'), ' '), lambda w: w <> '')) as words from documents)""",
    "sigfp": f"select *, {FNV_NUMBER.format("array_to_string(calls, '|')")} as call_fp, {FNV_NUMBER.format("array_to_string(names, '|')")} as state_fp from signatures",
    "repos": "select source as repo, count(*) as files, sum(n_chars) as chars, count(distinct lang) as languages, max(n_chars) as largest, sum(case when lang = 'en' then 1 else 0 end) as en, sum(case when lang = 'de' then 1 else 0 end) as de, sum(case when lang = 'fr' then 1 else 0 end) as fr, sum(case when lang = 'es' then 1 else 0 end) as es from documents group by 1",
}


def with_views(sql: str) -> str:
    """The statement with the views that it needs, directly or through others, in front."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in VIEWS.items():
            if name not in need and re.search(rf"\b(from|join|,)\s+{name}\b", text):
                need.add(name)
                todo.append(body)
    ctes = [f"{name} as ({body})" for name, body in VIEWS.items() if name in need]
    if not ctes:
        return sql
    if sql.lstrip().lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + sql.lstrip()[len("with recursive") :]
    if sql.lstrip().lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + sql.lstrip()[5:]
    return "with " + ", ".join(ctes) + " " + sql


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the same in DuckDB's SQL, over tables and views."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add

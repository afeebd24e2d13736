"""Named rules over calls, risk, complexity and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IO_CALLS = sorted("fetch invoke axios request get post put delete open read write readFile readFileSync writeFile writeFileSync".split())
UTILITY_CALLS = sorted(
    (
        "any all allSettled assign Boolean charAt charCodeAt concat debug endsWith entries error every filter find forEach freeze from includes indexOf info isArray join keys log map match Number of parse "
        "parseFloat parseInt pop push race reduce reject replace resolve seal shift slice some sort splice split startsWith String stringify substr substring test toLowerCase toString toUpperCase trim unshift values warn"
    ).split()
)
CLIENTS = sorted("superagent got ky axios fetch invoke request".split())
HTTP = sorted("options head delete patch put post get".split())
QUERY_HOOKS = ["queryClient"]
DATA_CALLS = sorted("mutate migrate execute query delete update select insert".split())
CHAIN = ["catch", "finally", "then"]
SCHEMA = sorted("uuid time date double real numeric char varchar jsonb timestamp boolean bigint integer text serial index unique references default primaryKey notNull".split())
MATH = sorted("exp log tan cos sin max min pow sqrt abs random round ceil floor".split())
ARRAY = sorted("at values keys entries copyWithin fill flatMap flat lastIndexOf indexOf reverse sort join concat unshift shift pop push splice slice every some findIndex find forEach reduce map filter".split())
STRING = sorted("repeat padEnd padStart endsWith startsWith search match replaceAll replace charCodeAt charAt substr substring toUpperCase toLowerCase trim split".split())
OBJECT = sorted("valueOf toString hasOwnProperty seal freeze assign entries values keys".split())
INIT_NOISE = sorted("remove insert get pop push from into as_str as_ref err ok unwrap_or unwrap is_empty len to_string clone collect filter map iter".split())


def is_hook(name: Column) -> Column:
    return name.rlike(r"^use\p{Lu}")


def is_io(name: Column) -> Column:
    return name.isin(IO_CALLS)


def is_utility_call(name: Column, obj: Column) -> Column:
    return F.coalesce(obj == "console", F.lit(False)) | name.isin(UTILITY_CALLS)


def call_name(name: Column, obj: Column) -> Column:
    return F.concat_ws(".", obj, name)


def is_meaningful_call(name: Column, obj: Column) -> Column:
    """Hooks, setters, clients and data calls always; chains, schema builders and collection methods never; else yes."""
    o = F.coalesce(obj, F.lit(""))
    return (
        F.when(is_hook(name) | name.rlike(r"^set\p{Lu}"), True)
        .when(name.isin(QUERY_HOOKS + CLIENTS) | (o.isin(CLIENTS) & name.isin(HTTP)) | name.isin(DATA_CALLS), True)
        .when(name.isin(CHAIN + SCHEMA), False)
        .when(obj.isNotNull() & (((o == "Math") & name.isin(MATH)) | ((o == "Object") & name.isin(OBJECT)) | name.isin(STRING)), False)
        .when(name.isin(ARRAY), False)
        .otherwise(True)
    )


def risk_level(score: Column) -> Column:
    return F.when(score <= 1, "low").when(score <= 3, "medium").otherwise("high")


def risk_rank(level: Column) -> Column:
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def file_risk_score(deps: Column, states: Column, branches: Column, insertions: Column, public: Column) -> Column:
    """Points of a file's summary: imports up to 3, state, bands of control flow, I/O and persistence hints, public surface."""
    low = F.transform(insertions, lambda s: F.lower(s))
    io = F.size(F.filter(low, lambda s: s.rlike("network|fetch|invoke|i/o|file")))
    keep = F.size(F.filter(low, lambda s: s.rlike("storage|database|persist")))
    bands = (branches > 0).cast("int") + (branches > 5).cast("int") + (branches > 15).cast("int")
    return F.least(deps, F.lit(3)) + states + bands + 2 * io + F.when(public, 3).otherwise(0) + 3 * keep


def symbol_risk_score(branches: Column, io_calls: Column, loose_awaits: Column) -> Column:
    return F.least(branches, F.lit(3)) + 2 * io_calls + loose_awaits


def complexity_score(cognitive: Column, fan_out: Column, lines: Column) -> Column:
    over = F.when(fan_out > 10, F.floor((fan_out - 10) / 2)).otherwise(0)
    long_ = F.when(lines > 50, F.floor((lines - 50) / 25)).otherwise(0)
    return (cognitive + over + long_).cast("long")


def complexity_rating(score: Column) -> Column:
    return F.when(score <= 5, "simple").when(score <= 10, "moderate").when(score <= 20, "complex").otherwise("very_complex")


def instability(ca: Column, ce: Column) -> Column:
    return F.when(ca + ce == 0, 0.5).otherwise(ce / (ca + ce))


def severity_of_cvss(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def severity_rank(level: Column) -> Column:
    return F.when(level == "critical", 4).when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def duplicate_kind(similarity: Column) -> Column:
    return F.when(similarity >= 0.98, "exact").when(similarity >= 0.90, "near").otherwise("divergent")


def concerns(cognitive: Column, nesting: Column) -> Column:
    """What a validation report says about complexity, in order."""
    return F.array_compact(F.array(F.when(cognitive > 15, "very high complexity").when(cognitive > 10, "high complexity"), F.when(nesting > 4, "deep nesting")))


def callee_category(name: Column) -> Column:
    """The first group whose words a callee's name has."""
    n = F.lower(name)
    return (
        F.when(n.rlike("get|fetch|load|read|find"), "read").when(n.rlike("set|save|write|update|insert|create|delete"), "write").when(n.rlike("log|print|debug|warn|error"), "logging")
        .when(n.rlike("test|assert|expect|mock"), "testing").when(n.rlike("parse|format|convert|serialize|encode|decode"), "transform").otherwise("other")
    )


def update_strategy(has_index: Column, base_moved: Column, changed: Column, total: Column) -> Column:
    """How an index with so many changed files is brought up to date."""
    return (
        F.when(~has_index, "full_rebuild").when(base_moved, "rebase").when(changed == 0, "fresh").when(changed < 10, "incremental")
        .when(changed < F.ceil(total * 0.3), "rebase").otherwise("full_rebuild")
    )


def drift_percent(changed: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(changed / total * 100.0)


def refresh_mode(has_index: Column, stale: Column, changed: Column) -> Column:
    return F.when(~has_index, "full").when(~stale, "none").when(changed <= 50, "partial").otherwise("full")


def call_of_initializer(init: Column) -> Column:
    """The called function of an initializer, or null: literals, types, short names and noise have none."""
    t = F.trim(init)
    literal = t.rlike(r"""^["']""") | t.isin("", "true", "false", "None", "null", "undefined") | t.try_cast("double").isNotNull()
    before = F.when(F.contains(t, F.lit("(")), F.split_part(t, F.lit("("), F.lit(1)))
    part = F.trim(F.regexp_extract(before, r"([^.:]*)$", 1))
    bad = part.rlike(r"^\p{Lu}") | (F.octet_length(part) < 2) | part.isin(INIT_NOISE)
    return F.when(~literal & before.isNotNull() & ~bad, part)


def symbol_name_of_line(line: Column) -> Column:
    """The name that a line of source defines, else its first word-like token."""
    tries = [r"(?:fn|func|function|def)\s+(\w+)", r"(?:class|struct|enum|trait|interface|type)\s+(\w+)", r"(?:const|let|var)\s+(\w+)", r"(\w+)"]
    got = [F.regexp_extract(line, t, 1) for t in tries]
    return F.coalesce(*(F.when(g != "", g) for g in got))


def insertions_in_order(items: Column) -> Column:
    """Network and storage first, the rest in its order."""
    first = lambda s: F.lower(s).rlike("network|storage|database")
    return F.concat(F.filter(items, first), F.filter(items, lambda s: ~first(s)))


def age_state(seconds: Column) -> Column:
    """An index under an hour old is fresh."""
    return F.when(seconds.isNull(), "missing").when(seconds < 3600, "fresh").otherwise("stale")

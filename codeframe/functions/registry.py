"""SQL names for the main expressions, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "cf_estimate_tokens": ("s string", "bigint", "cast(ceil(octet_length(s) / 3.8D) as bigint)"),
    "cf_fingerprint_similarity": ("a bigint, b bigint", "double", "1.0D - bit_count(a ^ b) / 64.0D"),
    "cf_jaccard": ("a array<string>, b array<string>", "double", "case when size(array_union(a, b)) = 0 then 1.0D else size(array_intersect(a, b)) / size(array_union(a, b)) end"),
    "cf_risk_level": ("score int", "string", "case when score <= 1 then 'low' when score <= 3 then 'medium' else 'high' end"),
    "cf_loc": ("s bigint, e bigint", "bigint", "case when e > s then e - s + 1 else 1 end"),
    "cf_edge_kind": ("e string", "string", "coalesce(nullif(regexp_extract(e, ':(call|read|write|readwrite|escape_read|escape_write|escape_readwrite)$', 1), ''), 'call')"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {returns} return {body}")
    return sorted(FUNCTIONS)

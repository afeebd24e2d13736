"""Source trees and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframe.functions import paths

SYMBOLS = (
    "symbol string, hash string, semantic_hash string, kind string, module string, file string, lines string, risk string, cognitive_complexity long, max_nesting long, is_escape_local boolean, framework_entry_point string, "
    "is_exported boolean, decorators string, arity long, is_async boolean, return_type string, ext_package string, base_classes string"
)
SIGNATURES = (
    "symbol_hash string, name string, file string, module string, start_line long, name_tokens array<string>, call_fingerprint long, control_flow_fingerprint long, state_fingerprint long, business_calls array<string>, param_count int, "
    "has_business_logic boolean, boilerplate_category string, line_count long"
)


def source_files(spark: SparkSession, root: str, max_depth: int = 10) -> DataFrame:
    """file (below the root), language, text, bytes and modified time of every supported file.

    Dot names and build folders are skipped; files without a known language are not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quote(base) + "/", "")
    out = raw.select(rel.alias("file"), "content", "length", F.col("modificationTime").alias("modified"))
    out = out.where(~paths.skip_path(F.col("file")) & (F.size(F.split("file", "/")) <= max_depth)).withColumn("language", paths.detect_language(F.col("file")))
    return out.where(F.col("language").isNotNull()).select("file", "language", F.decode("content", "utf-8").alias("text"), F.col("length").alias("bytes"), "modified")


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in s)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines are dropped, unknown fields ignored, absent ones null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def symbol_index(spark: SparkSession, path: str) -> DataFrame:
    """A symbol index as JSON lines, with start and end lines from ``lines``."""
    r = paths.parse_lines(F.coalesce("lines", F.lit("")))
    return json_lines(spark, path, SYMBOLS).withColumn("start_line", r["start"]).withColumn("end_line", r["end"])


def signature_index(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, SIGNATURES)


def call_graph(lines: DataFrame) -> DataFrame:
    """Edges of lines ``hash: ["callee", "callee:kind"]`` in column ``value``: caller, callee, edge_kind."""
    v = F.col("value")
    caller = F.regexp_extract(v, r'^\s*"?([^"\[]+?)"?\s*:\s*\[', 1)
    items = F.regexp_extract_all(F.regexp_extract(v, r":\s*\[(.*)\]\s*$", 1), F.lit(r'"([^"]*)"'), F.lit(1))
    each = lines.select(caller.alias("caller"), F.explode(items).alias("item")).where("caller <> ''")
    return each.select("caller", paths.edge_callee(F.col("item")).alias("callee"), paths.edge_kind(F.col("item")).alias("edge_kind"))


def sections(text: DataFrame, mark: str = "---") -> DataFrame:
    """Sections ``--- name ---`` of key: value lines, from (doc, line, value): doc, name, fields map.

    The running name is a window over a document's lines, so a document is one partition's work.
    """
    from pyspark.sql import Window as W

    name = F.regexp_extract("value", rf"^{mark}\s*(.+?)\s*{mark}\s*$", 1)
    w = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    body = text.withColumn("head", F.when(name != "", name)).withColumn("name", F.last("head", ignorenulls=True).over(w)).where("head is null and name is not null")
    kv = body.select("doc", "name", F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)).alias("v")).where("k <> ''")
    return kv.groupBy("doc", "name").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("k", "v")))).alias("fields"))


def toon_rows(lines: DataFrame) -> DataFrame:
    """Rows of tables ``name[n]{f1,f2}:`` from (doc, line, value): doc, table, row, fields map.

    Values stand between commas; commas in double quotes do not count.
    """
    from pyspark.sql import Window as W

    v = F.col("value")
    name = F.regexp_extract(v, r"^(\w+)\[(\d+)\]\{([^}]*)\}:\s*$", 1)
    w = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(name != "", F.struct(F.col("line").alias("at"), name.alias("table"), F.regexp_extract(v, r"\[(\d+)\]", 1).cast("long").alias("n"), F.split(F.regexp_extract(v, r"\{([^}]*)\}", 1), r"\s*,\s*").alias("names")))
    each = lines.withColumn("head", head).withColumn("t", F.last("head", ignorenulls=True).over(w)).where("head is null and t is not null").withColumn("row", F.col("line") - F.col("t.at"))
    cells = paths.split_quoted(F.trim("value"))
    return each.where("row <= t.n").select("doc", "t.table", "row", F.map_from_arrays(F.slice(F.col("t.names"), F.lit(1), F.size(cells)), F.slice(cells, F.lit(1), F.size("t.names"))).alias("fields"))


def toon_scalars(lines: DataFrame) -> DataFrame:
    """Top-level ``key: value`` lines: doc, key, value."""
    return lines.where(F.col("value").rlike(r"^\w+:\s*\S")).select("doc", F.split_part("value", F.lit(":"), F.lit(1)).alias("key"), F.trim(F.regexp_extract("value", r"^\w+:(.*)$", 1)).alias("value"))

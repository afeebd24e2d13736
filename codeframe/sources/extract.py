"""Source text to symbols, imports and calls by line rules, for languages with braces or indents.

A regular-expression extractor, not a parser: definitions, imports and calls of a
line are found by the rules of its language; the end of a symbol is the line before
the next definition at the same or a lesser indent, and a definition that ends in a
semicolon is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeframe.functions import hashing, paths, rules

#: Per language: definition (groups: keyword, name), import (group: what), export test.
RULES = {
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(fn|struct|enum|trait|mod|type)\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*pub\b"),
    "python": (r"^\s*(?:async\s+)?(def|class)\s+(\w+)", r"^\s*(?:from|import)\s+([\w.]+)", r"^\s*(?:async\s+)?(?:def|class)\s+[^_]"),
    "typescript": (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|enum|type)\s+(\w+)", r"""^\s*import\b.*?['"]([^'"]+)['"]""", r"^\s*export\b"),
    "go": (r"^\s*(func|type)\s+(?:\([^)]*\)\s*)?(\w+)", r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$""", r"^\s*(?:func|type)\s+(?:\([^)]*\)\s*)?\p{Lu}"),
    "java": (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(class|interface|enum|record)\s+(\w+)", r"^\s*import\s+(?:static\s+)?([\w.]+)", r"^\s*public\b"),
}
RULES["javascript"] = RULES["typescript"]
RULES["kotlin"] = (r"^\s*(?:(?:public|private|internal|open|data|suspend|override)\s+)*(fun|class|interface|object)\s+(\w+)", r"^\s*import\s+([\w.]+)", r"^\s*(?!.*\bprivate\b)")
RULES["csharp"] = (RULES["java"][0], r"^\s*using\s+([\w.]+)", r"^\s*public\b")
_KIND = {"fn": "function", "def": "function", "function": "function", "func": "function", "fun": "function", "record": "class", "object": "class", "mod": "module", "type": "type_alias"}


def _by_language(i: int, group: int, value: Column, lang: Column) -> Column:
    out: Column = F.lit("")
    for name, rule in RULES.items():
        out = F.when(lang == name, F.regexp_extract(value, rule[i], group)).otherwise(out)
    return out


def lines(files: DataFrame) -> DataFrame:
    return files.where(F.col("language").isin(*RULES)).select("file", "language", F.posexplode(F.split("text", "\r?\n"))).select("file", "language", (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("value"))


def symbols(files: DataFrame) -> DataFrame:
    """hash, symbol, kind, module, file, start_line, end_line, is_exported, cognitive, nesting, risk, base_classes."""
    n = files.select("file", F.size(F.split("text", "\r?\n")).cast("long").alias("n_lines"))
    each = lines(files)
    v, lang = F.col("value"), F.col("language")
    word = _by_language(0, 1, v, lang)
    indent = F.length(F.regexp_extract(v, r"^(\s*)", 1))
    exported: Column = F.lit(False)
    for name, rule in RULES.items():
        exported = F.when(lang == name, v.rlike(rule[2])).otherwise(exported)
    defs = each.withColumn("symbol", _by_language(0, 2, v, lang)).where("symbol <> ''").select("file", "language", "line", "symbol", word.alias("word"), indent.alias("indent"), v.rlike(r";\s*$").alias("closed"), exported.alias("is_exported"), F.nullif(F.regexp_extract(v, r"class\s+\w+\s*(?:\(|:|extends)\s*([\w, .]+)", 1), F.lit("")).alias("base_classes"))
    w = W.partitionBy("file").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    later = F.collect_list(F.struct("line", "indent")).over(w)
    nxt = F.element_at(F.filter(later, lambda x: x["indent"] <= F.col("indent")), 1)["line"]
    spans = defs.withColumn("next_line", F.when(F.size(F.filter(later, lambda x: x["indent"] <= F.col("indent"))) > 0, nxt)).join(n, "file").withColumn("end_line", F.when(F.col("closed"), F.col("line")).otherwise(F.coalesce(F.col("next_line") - 1, F.col("n_lines"))))
    flow = each.where(v.rlike(r"\b(if|for|while|switch|match|try|loop)\b")).select("file", F.col("line").alias("at"), F.floor(F.length(F.regexp_extract(v, r"^(\s*)", 1)) / 4).alias("nest"))
    inner = spans.select("file", "line", "end_line", F.floor(F.col("indent") / 4).alias("base")).join(flow, "file").where("at >= line and at <= end_line")
    depth = F.greatest(F.col("nest") - F.col("base") - 1, F.lit(0))
    cog = inner.groupBy("file", "line").agg(F.sum(1 + depth).alias("cognitive"), F.max(depth).alias("nesting"), F.count("*").alias("branches"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), F.col("word")), F.col("word"))
    out = spans.join(cog, ["file", "line"], "left").fillna(0, ["cognitive", "nesting", "branches"])
    semantic = hashing.fnv1a_hex(F.concat_ws(":", paths.namespace(F.col("file")), "symbol", kind, F.lit("0")))
    return out.select(
        F.concat_ws(":", F.substring(hashing.fnv1a_hex(F.col("file")), 9, 8), semantic).alias("hash"), "symbol", kind.alias("kind"), paths.module_name(F.col("file")).alias("module"), "file",
        F.col("line").alias("start_line"), "end_line", "is_exported", F.col("cognitive").cast("long").alias("cognitive"), F.col("nesting").cast("long").alias("nesting"),
        rules.risk_level(rules.symbol_risk_score(F.col("branches"), F.lit(0), F.lit(0))).alias("risk"), "base_classes",
    )


def imports(files: DataFrame) -> DataFrame:
    each = lines(files)
    return each.withColumn("imported", _by_language(1, 1, F.col("value"), F.col("language"))).where("imported <> ''").select("file", "imported").distinct()


def calls(files: DataFrame, syms: DataFrame) -> DataFrame:
    """(file, name, caller): every call inside a symbol; the innermost symbol that holds the line calls."""
    from codeframe.operators.search import innermost
    from codeframe.sources.patterns import calls_of

    each = lines(files).select("file", "line", F.explode(calls_of(F.col("value"))).alias("name"))
    spots = innermost(each.select("file", "line").distinct(), syms.select("file", "hash", "start_line", "end_line"), "file").select("file", "line", F.col("hash").alias("caller"))
    own = syms.select("file", F.col("start_line").alias("line"), F.col("symbol").alias("name"))
    return each.join(own, ["file", "line", "name"], "left_anti").join(spots, ["file", "line"]).select("file", "name", "caller").distinct()

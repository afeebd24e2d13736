"""A small catalogue of vulnerability patterns, and fingerprints of source text to match it with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframe.functions import hashing
from codeframe.functions.rules import severity_of_cvss

#: (family, CVE, CWE, CVSS, languages, calls, control flow, confidence), written for this catalogue from public advisories.
CATALOGUE = [
    ("log4shell", "CVE-2021-44228", "CWE-917", 10.0, "java kotlin", "lookup getContext", "IT", 0.9),
    ("log4shell", "CVE-2021-45046", "CWE-917", 9.0, "java kotlin", "lookup format", "I", 0.85),
    ("spring4shell", "CVE-2022-22965", "CWE-94", 9.8, "java kotlin", "getClass getClassLoader setPropertyValues", "FI", 0.85),
    ("sql_injection", "CWE-89-concat", "CWE-89", 8.8, "java python typescript javascript csharp go", "execute format", "I", 0.8),
    ("sql_injection", "CWE-89-raw", "CWE-89", 8.1, "python typescript javascript", "query raw", "T", 0.8),
    ("command_injection", "CWE-78-shell", "CWE-78", 9.1, "python go rust shell", "system popen", "I", 0.8),
    ("command_injection", "CWE-78-exec", "CWE-78", 8.6, "javascript typescript", "exec spawn", "T", 0.8),
    ("deserialization", "CWE-502-pickle", "CWE-502", 9.8, "python", "loads load", "T", 0.85),
    ("deserialization", "CWE-502-object", "CWE-502", 9.1, "java csharp", "readObject deserialize", "T", 0.85),
    ("xss", "CWE-79-html", "CWE-79", 6.1, "javascript typescript", "innerHTML write", "I", 0.75),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per pattern and language: cve_id, cwe_id, severity, language, calls, fingerprints, confidence."""
    rows = [(f, cve, cwe, score, langs.split(), sorted(calls.split()), flow, conf) for f, cve, cwe, score, langs, calls, flow, conf in CATALOGUE]
    raw = spark.createDataFrame(rows, "family string, cve_id string, cwe_id string, cvss double, languages array<string>, calls array<string>, flow string, confidence double")
    return raw.select(
        "family", "cve_id", "cwe_id", severity_of_cvss(F.col("cvss")).alias("severity"), F.explode("languages").alias("language"), "calls", "confidence",
        hashing.set_fingerprint(F.col("calls")).alias("call_fp"), hashing.fnv1a(F.col("flow")).alias("cf_fp"), hashing.fnv1a(F.lit("")).alias("state_fp"),
    )


def calls_of(source: Column) -> Column:
    """Called names of a text, sorted and distinct; keywords that look like calls are left out."""
    names = F.regexp_extract_all(source, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin("if", "for", "while", "switch", "match", "catch", "return", "function", "fn", "def", "func"))))


def control_flow_of(source: Column) -> Column:
    """Letters of control-flow keywords in their order: I, F, W, S, M, T, L."""
    words = F.regexp_extract_all(source, F.lit(r"\b(if|for|while|switch|match|try|loop)\b"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")


def state_of(source: Column) -> Column:
    """Names that are assigned, sorted and distinct."""
    names = F.regexp_extract_all(source, F.lit(r"(?:let|var|const|mut)\s+([A-Za-z_]\w*)\s*="), F.lit(1))
    return F.array_sort(F.array_distinct(names))


def fingerprints(files: DataFrame) -> DataFrame:
    """(doc_id, language, calls, call_fp, cf_fp, state_fp) of whole source texts."""
    c = files.select("doc_id", "language", calls_of(F.col("text")).alias("calls"), control_flow_of(F.col("text")).alias("flow"), state_of(F.col("text")).alias("names"))
    return c.select("doc_id", "language", "calls", hashing.set_fingerprint(F.col("calls")).alias("call_fp"), hashing.fnv1a(F.col("flow")).alias("cf_fp"), hashing.set_fingerprint(F.col("names")).alias("state_fp"))

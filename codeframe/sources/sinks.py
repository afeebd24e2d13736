"""Writing an index: partitioned tables in ordered, resumable steps; exports; incremental overwrite."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps in the order in which an index is written.
STEPS = ("registry", "overview", "modules", "symbols", "graph", "signatures", "search")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole: Spark leaves _SUCCESS last."""
    fs, p = _fs(spark, path + "/_SUCCESS")
    return fs.exists(p)


def write_index(root: str, tables: dict[str, DataFrame], resume: bool = True) -> list[str]:
    """Write each table below ``root``; with ``resume`` whole tables of an earlier try stay.  Returns what was written.

    symbols are partitioned by module; others are plain.  A manifest is written last.
    """
    written = []
    spark = next(iter(tables.values())).sparkSession
    for name in sorted(tables, key=lambda n: (STEPS.index(n) if n in STEPS else len(STEPS), n)):
        path = f"{root}/{name}"
        if resume and done(spark, path):
            continue
        w = tables[name].write.mode("overwrite")
        (w.partitionBy("module") if name == "symbols" and "module" in tables[name].columns else w).parquet(path)
        written.append(name)
    manifest = json.dumps({"tables": sorted(tables), "at": int(time.time())})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")
    return written


def overwrite_modules(df: DataFrame, path: str) -> None:
    """Replace only the partitions (modules) that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def write_layers(writes: DataFrame, path: str) -> None:
    writes.write.mode("overwrite").partitionBy("layer").parquet(path)


def export_graph(root: str, nodes: DataFrame, edges: DataFrame, module_edges: DataFrame, imports: DataFrame, inheritance: DataFrame) -> None:
    """The five export tables; edges of one caller lie together, so that a reader of one node touches few files."""
    for name, df, key in (("nodes", nodes, "hash"), ("edges", edges, "caller"), ("module_edges", module_edges, None), ("imports", imports, None), ("inheritance", inheritance, None)):
        out = df.repartition(key).sortWithinPartitions(key) if key else df
        out.write.mode("overwrite").parquet(f"{root}/{name}")


def batch_size(wanted: int | None, least: int = 100, most: int = 50_000, default: int = 5_000) -> int:
    """Rows per JDBC batch of an export, held between bounds."""
    return default if wanted is None else max(least, min(most, wanted))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def toon(df: DataFrame, name: str) -> str:
    """A small result as a TOON table, for display: at most 1000 rows, read in order."""
    rows = df.limit(1000).collect()
    cell = lambda v: "" if v is None else f'"{v}"' if isinstance(v, str) and ("," in v or '"' in v) else str(v)
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(df.columns)}}}:", *("  " + ",".join(cell(v) for v in r) for r in rows)])

"""The canonical tables of a code index, bound to the tables at hand.

A deployment reads these from its own index; here parts are symbols, neighbouring
line items are call edges, documents are files and events are layer writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeframe.functions import rules


class Views:
    """Lazy views over one folder of tables; each property is a fresh plan that Catalyst prunes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def files(self) -> DataFrame:
        path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select("doc_id", path.alias("file"), F.col("lang").alias("language"), "source", "text", "n_chars")

    @property
    def lines(self) -> DataFrame:
        return self.files.select("doc_id", "file", F.posexplode(F.split("text", "\n"))).select("doc_id", "file", F.col("col").alias("line_text"), (F.col("pos") + 1).cast("long").alias("line"))

    @property
    def symbols(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        kinds = {"ECONOMY": "function", "LARGE": "struct", "MEDIUM": "class", "PROMO": "interface", "SMALL": "method"}
        kind: Column = F.lit("enum")
        for k, v in kinds.items():
            kind = F.when(F.col("p_type") == k, v).otherwise(kind)
        return self.table("part").select(
            key.cast("string").alias("hash"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"), F.col("p_brand").alias("module"), kind.alias("kind"),
            F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/file"), (key % 40).cast("string"), F.lit(".ts")).alias("file"),
            (key % 97 + 1).cast("long").alias("start_line"), (key % 97 + 1 + size).cast("long").alias("end_line"), rules.risk_level(size % 6).alias("risk"),
            size.cast("long").alias("cognitive"), (size % 7).cast("long").alias("nesting"), (key % 3 == 0).alias("is_exported"), (key % 11 == 0).alias("is_escape_local"), (key % 5).cast("long").alias("arity"),
        )

    def _neighbours(self) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
        a = items.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").cast("string").alias("caller"), "l_returnflag")
        b = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("callee"))
        return a.join(b, ["l_orderkey", "l_linenumber"])

    @property
    def edges(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "read").otherwise("write")
        return self._neighbours().select("caller", "callee", kind.alias("edge_kind")).distinct()

    @property
    def pairs(self) -> DataFrame:
        return self._neighbours().select("caller", "callee").distinct()

    @property
    def externals(self) -> DataFrame:
        items = self.table("lineitem").select("l_partkey", "l_suppkey")
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws(":", F.lit("ext"), "n_name", "s_name").alias("callee"))
        return items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").cast("string").alias("caller"), "callee").distinct()

    @property
    def layers(self) -> DataFrame:
        kind = F.col("event_type")
        layer = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2).when(kind == "signup", 3).otherwise(F.floor("value") % 4)
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("hash"), layer.cast("long").alias("layer"), F.when(kind == "error", "deleted").otherwise("active").alias("state"),
            F.concat(F.lit("src/u"), (F.col("user_id") % 10).cast("string"), F.lit(".ts")).alias("file"), "value",
        )

    @property
    def changes(self) -> DataFrame:
        s = F.col("o_orderstatus")
        path = F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".ts"))
        return self.table("orders").select(path.alias("path"), F.when(s == "P", "modified").when(s == "O", "added").otherwise("deleted").alias("change_type"), F.col("o_orderpriority").alias("language"), "o_orderkey")

    @property
    def signatures(self) -> DataFrame:
        """Of every whole text its distinct words: those that begin with a capital are names, the others calls."""
        words = F.array_except(F.split(F.col("text"), r"\s+"), F.array(F.lit("")))
        rows = self.table("documents").select("doc_id", F.col("source").alias("module"), words.alias("w"), (F.col("n_chars") % 8).alias("params"))
        rows = rows.withColumn("names", F.sort_array(F.filter("w", lambda x: x.rlike(r"^\p{Lu}"))))
        return rows.select("doc_id", "module", F.sort_array(F.array_except("w", "names")).alias("calls"), "names", "params")

    @property
    def repos(self) -> DataFrame:
        per = [F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")]
        return self.table("documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("languages"), F.max("n_chars").alias("largest"), *per)

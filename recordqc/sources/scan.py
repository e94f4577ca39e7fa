"""File inventory, content hashes and chunked payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordqc.functions.files import extension, is_system_name

C = F.col
SCAN_EXTENSIONS = ["pdf", "dwg", "ifc", "zip"]  # fixed values
CHUNK = 30000  # characters per stored part, fixed value


def catalog_scan(spark: SparkSession, root: str, exts: list[str] = SCAN_EXTENSIONS) -> DataFrame:
    """Path, size and time of every wanted file below ``root``; contents are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", C("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), name.alias("file_name")) \
              .where(extension(C("file_name")).isin(exts) & ~is_system_name(C("file_name")))


def with_hash(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.sha2("content", 256).alias("hash"))


def chunk_payloads(df: DataFrame, keys: list[str], text: str, size: int = CHUNK) -> DataFrame:
    """Numbered parts of at most ``size`` characters."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return df.select(*keys, text, F.explode(F.sequence(F.lit(1), n)).alias("part")) \
             .select(*keys, "part", F.substr(text, (C("part") - 1) * size + 1, F.lit(size)).alias("payload"))


def reassemble(parts: DataFrame, keys: list[str], schema: StructType | str | None = None) -> DataFrame:
    """Whole texts from their parts in part order; with a schema, unreadable texts are dropped."""
    one = parts.groupBy(*keys, "part").agg(F.first("payload").alias("payload"))
    out = one.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "payload"))), lambda s: s["payload"]), "").alias("text"))
    if schema is None:
        return out
    parsed = out.withColumn("record", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(C("record").isNotNull()).drop("text")

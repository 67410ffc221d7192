"""Bodies stored once by the hash of their content, and fetched for the hits of a search only.

The table is partitioned by the first digits of the hash and sorted by hash
inside, so a fetch of a few hashes opens the files of their ranges and reads the
row groups that may hold them; no body of another document is read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_DIGITS = 2  # 256 ranges of hashes
SCHEMA = "hash string, body string, hash_range string"


def _range():
    return F.substring("hash", 1, RANGE_DIGITS).alias("hash_range")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(hash, body, hash_range); an empty table before the first write."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def add(contents: DataFrame, path: str) -> None:
    """Append the bodies (hash, body) that are not stored yet; equal hashes are stored once."""
    known = stored(contents.sparkSession, path).select("hash", "hash_range")
    once = contents.groupBy("hash").agg(F.any_value("body").alias("body"))
    new = once.select("hash", "body", _range()).join(known, ["hash_range", "hash"], "left_anti")
    ordered = new.hint("rebalance", "hash_range").sortWithinPartitions("hash_range", "hash")
    ordered.write.mode("append").partitionBy("hash_range").parquet(path)


def fetch(spark: SparkSession, path: str, hashes: list[str]) -> DataFrame:
    """(hash, body) of a bounded list of hashes, by filters that reach the files."""
    ranges = sorted({h[:RANGE_DIGITS] for h in hashes})
    wanted = F.col("hash_range").isin(ranges) & F.col("hash").isin(sorted(set(hashes)))
    return stored(spark, path).filter(wanted).select("hash", "body").dropDuplicates(["hash"])


def attach(hits: DataFrame, path: str) -> DataFrame:
    """Hits, a bounded number, with their body: the one they carry, else the stored one, else ''."""
    spark = hits.sparkSession
    carried = F.col("body") if "body" in hits.columns else F.lit(None).cast("string")
    hashes = [r["hash"] for r in hits.filter(carried.isNull() & F.col("hash").isNotNull()).select("hash").distinct().collect()]
    found = fetch(spark, path, hashes).select("hash", F.col("body").alias("_stored"))
    return hits.join(F.broadcast(found), "hash", "left").select(
        *[c for c in hits.columns if c != "body"], F.coalesce(carried, "_stored", F.lit("")).alias("body")
    )

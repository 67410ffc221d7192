"""Wallet folders: one markdown file per record below a collection folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import documents
from turnlake.sources import walletsource

FILE_COLUMNS = "collection string, path string, file_name string, bytes bigint, modified_at timestamp"


def _load(spark: SparkSession, source: str, folder: str, glob: str | None, **options) -> DataFrame | None:
    reader = spark.read.format(source).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    for name, value in options.items():
        reader = reader.option(name, value)
    try:
        return reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _located(collection: str, root: str) -> list[Column]:
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.regexp_extract(full, rf"/{collection}/(.*)\z", 1)
    return [
        F.lit(collection).alias("collection"),
        below.alias("path"),
        F.element_at(F.split(below, "/"), -1).alias("file_name"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ]


def scan(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """(collection, path, file_name, bytes, modified_at, content) of all ``*.md`` files.

    A missing folder is an empty collection.
    """
    found = _load(spark, "text", f"{root}/{collection}", "*.md", wholetext=True)
    if found is None:
        return spark.createDataFrame([], f"{FILE_COLUMNS}, content string")
    return found.select(*_located(collection, root), F.col("value").alias("content"))


def list_files(spark: SparkSession, root: str, collection: str, glob: str | None = "*.md") -> DataFrame:
    """The same without contents: file metadata only, no file is read."""
    found = _load(spark, "binaryFile", f"{root}/{collection}", glob)
    if found is None:
        return spark.createDataFrame([], FILE_COLUMNS)
    return found.select(*_located(collection, root))


def turns(spark: SparkSession, root: str) -> DataFrame:
    """Parsed turn documents, newest first."""
    return documents.parse_turns_lenient(scan(spark, root, "turns")).orderBy(F.desc("timestamp"), "path")


def turn(spark: SparkSession, root: str, turn_id: str) -> DataFrame:
    """The turn with an id; no row when there is none."""
    parsed = documents.parse_turns_lenient(scan(spark, root, "turns"))
    return parsed.filter(F.col("turn_id") == turn_id).limit(1)


def captures(spark: SparkSession, root: str) -> DataFrame:
    """Front matter and message count of conversation documents that have an id."""
    files = scan(spark, root, "conversations")
    headed = files.withColumn("head", documents.parse_conversation_head(F.col("content")))
    return headed.filter(F.col("head.id").isNotNull()).select(
        "path",
        F.col("head.id").alias("capture_id"),
        F.col("head.tool").alias("tool"),
        F.col("head.model").alias("model"),
        F.col("head.timestamp").alias("ts"),
        F.col("head.incognito").alias("incognito"),
        F.col("head.n_messages").alias("n"),
        "content",
    )


def memories(spark: SparkSession, root: str) -> DataFrame:
    return documents.parse_memories(scan(spark, root, "memories")).orderBy("created_at", "memory_id")


def session_of_file(file_name: Column) -> Column:
    """Session id of ``{session}-{index}.md``; NULL for other names."""
    return F.nullif(F.regexp_extract(file_name, r"\A(.+)-\d+\.md\z", 1), F.lit(""))


def day_of_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"\A(\d{4}-\d{2}-\d{2})/", 1), F.lit(""))


def folders(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """(folder, files, bytes, newest) of a collection, each folder listed in its own task, no file opened."""
    return listed(spark, root, [collection]).groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified_at").alias("newest")
    )


def listed(spark: SparkSession, root: str, collections: list[str], suffix: str = ".md") -> DataFrame:
    """Files of several collections without their contents."""
    walletsource.register(spark)
    reader = spark.read.format("wallet").option("collections", ",".join(collections)).option("content", "false")
    return reader.option("suffix", suffix).load(root)


def read_day(spark: SparkSession, root: str, collection: str, day: str) -> DataFrame:
    """Documents of one day; other folders are not listed."""
    walletsource.register(spark)
    return spark.read.format("wallet").option("collections", collection).load(root).filter(F.col("folder") == day)


def last_capture(spark: SparkSession, root: str) -> DataFrame:
    """One row (last_capture_at): newest file of the newest day folder."""
    files = list_files(spark, root, "turns").withColumn("day", day_of_path(F.col("path")))
    newest = F.max(F.when(F.col("day").isNotNull(), F.struct("day", "modified_at")))
    return files.agg(newest.alias("newest")).select(F.col("newest.modified_at").alias("last_capture_at"))


def status(spark: SparkSession, root: str) -> DataFrame:
    """One row: turn and session counts, last capture, bytes of the wallet."""
    turns_agg = list_files(spark, root, "turns").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.countDistinct(session_of_file(F.col("file_name"))).alias("session_count"),
    )
    size = _load(spark, "binaryFile", root, None)
    total = size.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).scalar() if size is not None else F.lit(0)
    return turns_agg.withColumn("last_capture_at", last_capture(spark, root).scalar()).withColumn("bytes", total)

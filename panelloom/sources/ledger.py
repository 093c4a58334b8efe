"""Ledger of ingested datasets: an append-only parquet table.

A deletion is appended too, and reading leaves deleted datasets out by an
anti-join. Nothing is rewritten in place, so a job lost half-way leaves the
ledger readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelloom.sources.storage import store

SCHEMA = (
    "dataset_id string, filename string, pack_key string, content_hash string, stored_path string, "
    "raw_row_count bigint, clean_row_count bigint, quarantined_row_count bigint, health_score int, "
    "encoding_detected string, quality_json string, created_at timestamp, deleted boolean"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


#: Where the four 64-bit parts of a SHA-256 in hexadecimal begin.
PARTS = (1, 17, 33, 49)


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file, byte for byte: one file is one value, so for files up to 2 GB.

    `file_digests` identifies files of any size.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path"), F.sha2("content", 256).alias("file_hash"))


def merged(digest: Column) -> Column:
    """Aggregate: one digest for many, whatever their order and how they are grouped.

    Each is bound to its place before it comes here, so the sums of its four parts tell
    permutations apart. Sums are taken map-side, in fixed width (38 digits hold 10^18 of them).
    """
    parts = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)")) for at in PARTS]
    return F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256)


def line_digest(place: Column, line: Column) -> Column:
    """SHA-256 of a line and its place: lines of any content, places written alike."""
    text = F.concat(place.cast("string"), F.lit(":"), F.coalesce(line, F.lit("")))
    return F.sha2(text.cast("binary"), 256)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, number (from 0, within the file), line; no line is moved.

    Rows of a block are numbered where they are read. The blocks of a file, one row each, are
    counted up in a window, and every line adds its block's offset.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = store(blocks.select("file", "block", offset.alias("offset")), "line_offsets")
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("id") + F.col("offset")).alias("number"), "line"
    )


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, lines, file_hash: the lines of each file and their order, for files of any size.

    Files are read in blocks by as many tasks as they have. Equal for any splitting, different
    if two lines are swapped, changed, lost or repeated. How lines end is not part of it.
    """
    lines = numbered_lines(spark, path)
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        merged(line_digest(F.col("number"), F.col("line"))).alias("file_hash"),
    )


#: Files up to this size are identified by their bytes, an input with a larger one by its lines.
WHOLE_FILE = 64 << 20


def content_digest(spark: SparkSession, path: str | list[str], whole_file: int = WHOLE_FILE) -> DataFrame:
    """One row (content_hash, files) for a whole input, whatever its files' names and order.

    The size of a file belongs to its content, so equal inputs are identified alike.
    """
    sizes = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("most"))
    small = (sizes.first()["most"] or 0) <= whole_file
    return dataset_hash(content_hash(spark, path) if small else file_digests(spark, path))


def dataset_hash(file_hashes: DataFrame) -> DataFrame:
    """One row (content_hash, files), whatever the order of the files; a single file keeps its hash."""
    return file_hashes.agg(
        F.when(F.count(F.lit(1)) == 1, F.max("file_hash")).otherwise(merged(F.col("file_hash"))).alias("content_hash"),
        F.count(F.lit(1)).alias("files"),
    )


def append(records: DataFrame, ledger: str) -> None:
    """Add dataset records; missing fields are null, `created_at` defaults to now."""
    types = dict(part.split() for part in SCHEMA.split(", "))
    defaults = {"created_at": F.current_timestamp(), "deleted": F.lit(False)}
    columns = []
    for name in FIELDS:
        value = F.col(name) if name in records.columns else defaults.get(name, F.lit(None))
        columns.append(value.cast(types[name]).alias(name))
    records.select(*columns).write.mode("append").parquet(ledger)


def read(spark: SparkSession, ledger: str) -> DataFrame:
    """Datasets that are not deleted."""
    rows = spark.read.schema(SCHEMA).parquet(ledger)
    gone = rows.filter("deleted").select("dataset_id").distinct()
    return rows.filter("NOT deleted").join(gone, "dataset_id", "left_anti").drop("deleted")


def newest(spark: SparkSession, ledger: str, n: int = 50) -> DataFrame:
    return read(spark, ledger).orderBy(F.desc("created_at"), "dataset_id").limit(n)


def by_hash(spark: SparkSession, ledger: str, content_hash: str, pack_key: str) -> DataFrame:
    same = (F.col("content_hash") == content_hash) & (F.col("pack_key") == pack_key)
    return read(spark, ledger).filter(same)


def not_ingested(candidates: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Candidates (content_hash, pack_key, ...) the ledger does not hold yet."""
    return candidates.join(
        ledger_rows.select("content_hash", "pack_key"), ["content_hash", "pack_key"], "left_anti"
    )


def delete(dataset_ids: DataFrame, ledger: str) -> None:
    """Mark datasets as deleted; their dependants go with them in `without_deleted`."""
    append(dataset_ids.select("dataset_id").withColumn("deleted", F.lit(True)), ledger)


def without_deleted(dependants: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Rows of a dependent table whose dataset is still in the ledger."""
    return dependants.join(ledger_rows.select("dataset_id"), "dataset_id", "left_semi")

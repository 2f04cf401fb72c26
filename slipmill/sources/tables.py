"""File manifests, correction logs and model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"
FEEDBACK = "id string, source string, source_file string, voucher_id long, timestamp timestamp_ntz, raw_ocr_text string, corrections map<string,struct<original:string,corrected:string>>"
CROPS = f"id string, original_filename string, timestamp timestamp_ntz, user_crop {BOX}, auto_crop {BOX}, image_size struct<width:long,height:long>"


IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff")
#: A glob of the image files' names, in any case.
IMAGE_FILES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in IMAGES) + "}"


def file_manifest(spark: SparkSession, path: str, batch_id: str, pattern: str = IMAGE_FILES) -> DataFrame:
    """A row per file whose name matches: name, path, size, hash, type, batch, status. The content goes once it is hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.when(kind.isin(*IMAGES), F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").otherwise(kind)))
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes"), F.md5("content").alias("file_hash"), mime.alias("mime_type"),
        F.lit(batch_id).alias("upload_batch_id"), F.lit("pending").alias("processing_status"),
    )


def duplicate_files(manifest: DataFrame) -> DataFrame:
    """(file_path, first_path) of files whose content an earlier path has."""
    first = manifest.groupBy("file_hash").agg(F.min("file_path").alias("first_path"), F.count("*").alias("n")).where("n > 1")
    return manifest.join(first, "file_hash").where("file_path <> first_path").select("file_path", "first_path")


def mark_processed(manifest: DataFrame, vouchers: DataFrame) -> DataFrame:
    """manifest with status and voucher_id of the files that vouchers (file_path, voucher_id) came from."""
    done = manifest.join(vouchers.select("file_path", "voucher_id"), "file_path", "left")
    return done.withColumn("processing_status", F.when(F.col("voucher_id").isNotNull(), "processed").otherwise(F.col("processing_status")))


def read_feedback(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """Correction logs; lines that aren't records go, the last `limit` by time stay (ties by id)."""
    rows = spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(paths).where("id IS NOT NULL")
    return rows if limit is None else rows.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def append_feedback(rows: DataFrame, path: str) -> None:
    """Appends the records in which something was corrected."""
    rows.where(F.size("corrections") > 0).write.mode("append").json(path)


def read_crop_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CROPS).option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")


def append_crop_annotations(rows: DataFrame, path: str) -> None:
    """Appends annotations that have an id, a file name and the user's box; others are rejected."""
    rows.dropna(subset=["id", "original_filename"]).where("user_crop IS NOT NULL").write.mode("append").json(path)


def write_model(model: DataFrame, folder: str, version: str) -> None:
    """A model table as Parquet under its version; an existing version isn't overwritten."""
    model.write.parquet(f"{folder}/version={version}")


def read_model(spark: SparkSession, folder: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")

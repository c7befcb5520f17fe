"""Chunk files: JSON arrays of ``{text, metadata}``, one file a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.docx import scan

METADATA = (
    "source string, source_stem string, contract_title string, file_path string, chunk_index int, total_chunks_in_doc int, chunk_size int, "
    "clause_type string, clause_header string, contract_party string, clause_priority int, chunk_preview string"
)
FILE = ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in METADATA.split(", "))
SCHEMA = f"array<struct<text: string, metadata: struct<{FILE}>>>"


METADATA_NAMES = [p.split()[0] for p in METADATA.split(", ")]
KEPT = [p.split()[0] for p in METADATA.split(", ") if p.split()[0] != "chunk_index"]  # the place is that in the file


def scan_chunk_files(spark: SparkSession, *folders: str, suffix: str = r"\.json$") -> DataFrame:
    """``source_file, content_hash, file_size, content`` of the JSON files below the folders; missing folders are skipped.

    Files that ``sinks.write_chunk_files`` wrote end in ``.txt``.
    """
    files = scan(spark, *folders, suffix=suffix, ignore_case=False)
    return files.select(F.col("path").alias("source_file"), F.md5("content").alias("content_hash"), F.col("length").alias("file_size"), F.col("content").cast("string").alias("content"))


def load_chunks(files: DataFrame, now: str) -> DataFrame:
    """The chunks of scanned files with place and import time; empty texts are left out, a broken file gives no rows."""
    parsed = files.select("source_file", F.from_json("content", SCHEMA).alias("c")).where("c IS NOT NULL")
    rows = parsed.select("source_file", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "x")).where("x.text <> ''")
    return rows.select(
        F.md5(F.concat_ws("#", "source_file", "chunk_index")).alias("id"), F.col("x.text").alias("document"), "source_file", F.substring_index("source_file", "/", -1).alias("file_name"),
        "chunk_index", "total_chunks", F.lit(now).alias("import_time"), *(F.col(f"x.metadata.{n}").alias(n) for n in KEPT),
    )

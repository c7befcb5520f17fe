"""Corpus statistics over chunk tables. Every report is a grouped aggregate; ordering keys are explicit columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMPORTANT, HIGH, SHOWN, TOP_TYPES = 15, 10, 15, 3  # priority limits, clauses shown, types shown


def by_document(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Number of chunks, average, largest and smallest length, and important clauses of each document."""
    size = F.length("text")
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("n_chunks"), F.round(F.avg(size), 6).alias("avg_length"), F.max(size).alias("max_length"), F.min(size).alias("min_length"), F.count_if(F.col("clause_priority") <= IMPORTANT).alias("n_important")
    )


def overall(chunks: DataFrame, document: str) -> DataFrame:
    """Documents, chunks and average length of the corpus."""
    return chunks.agg(F.countDistinct(document).alias("n_documents"), F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("avg_length"))


def histogram(chunks: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Count and percentage of each value, in all or within ``keys``. The window runs over values, not over rows."""
    keys = keys or []
    counts = chunks.groupBy(*keys, column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 6))


def top_values(chunks: DataFrame, column: str, keys: list[str], order: str = "chunk_index", k: int = TOP_TYPES) -> DataFrame:
    """The ``k`` most frequent values within ``keys``; of equal counts the one seen first."""
    counts = chunks.groupBy(*keys, column).agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at", column))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def important(chunks: DataFrame, document: str, order: str = "chunk_index", k: int = SHOWN) -> DataFrame:
    """The first ``k`` important clauses of each document; a preview where the priority is high."""
    rows = chunks.where(F.col("clause_priority") <= IMPORTANT)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(document).orderBy(order))).where(F.col("place") <= k)
    return rows.withColumn("shown", F.when(F.col("clause_priority") <= HIGH, F.col("chunk_preview")))


def continuity(chunks: DataFrame, document: str, index: str = "chunk_index") -> DataFrame:
    """Missing places between the first and last of each document, and whether the count is as expected."""
    found = chunks.groupBy(document).agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.collect_set(index).alias("__have"))
    missing = F.array_sort(F.array_except(F.sequence("first_index", "last_index"), F.col("__have")))
    found = found.withColumn("missing", missing).withColumn("n_found", F.size("__have")).withColumn("n_expected", F.col("last_index") - F.col("first_index") + 1)
    return found.withColumn("is_complete", F.col("n_found") == F.col("n_expected")).drop("__have")


def _probe(rows: pd.DataFrame, base: str) -> pd.DataFrame:
    """Names one after the other; a taken one is tried with ``_1``, ``_2`` and so on."""
    taken: set[str] = set()
    last: dict[str, int] = {}
    names = []
    for name in rows[base]:
        free, n = name, last.get(name, 0)
        while free in taken:
            n += 1
            free = f"{name}_{n}"
        last[name] = n
        taken.add(free)
        names.append(free)
    return rows.assign(folder=names)


def folder_names(documents: DataFrame, base: str, order: list[str]) -> DataFrame:
    """A folder of its own for each document: the base name, with ``_1``, ``_2`` for later ones of the same base, until free.

    Names can only meet within a family: bases that are equal up to a numbering at their end. A family with one base is
    numbered by a window; one with several (a, a_1) is numbered in order, each name tried until it is free.
    """
    rows = documents.withColumn("__family", F.regexp_replace(base, r"(_[0-9]+)+\z", ""))
    mixed = rows.groupBy("__family").agg(F.min(base).alias("a"), F.max(base).alias("b")).where("a <> b").select("__family")
    place = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    plain = rows.join(mixed, "__family", "left_anti").withColumn("__n", place)
    plain = plain.withColumn("folder", F.when(F.col("__n") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("__n").cast("string")))).drop("__n", "__family")
    met = rows.join(mixed, "__family", "left_semi")
    schema = T.StructType([*met.schema.fields, T.StructField("folder", T.StringType())])
    probed = met.groupBy("__family").applyInPandas(lambda part: _probe(part.sort_values(order, kind="stable"), base), schema).drop("__family")
    return plain.unionByName(probed)


def overall_report(chunks: DataFrame, folders: DataFrame, document: str = "file_path") -> DataFrame:
    """One row a document with its counts and the folder and title it is kept under."""
    return by_document(chunks, [document]).join(folders, document, "left")


def report_lines(chunks: DataFrame, document: str = "file_path", columns: tuple[str, ...] = ("clause_type", "contract_party")) -> DataFrame:
    """The statistics of each document as text: counts, lengths, histograms (largest first, then first seen), gaps."""
    sizes = by_document(chunks, [document]).join(continuity(chunks, document).select(document, "missing"), document)
    head = F.concat_ws("\n", F.concat(F.lit("chunks: "), "n_chunks"), F.concat(F.lit("average length: "), F.round("avg_length", 0).cast("long")), F.concat(F.lit("longest: "), "max_length"), F.concat(F.lit("shortest: "), "min_length"))
    gaps = F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join(F.transform("missing", lambda x: x.cast("string")), ", "))).otherwise("complete")
    report = sizes.select(document, head.alias("__head"), gaps.alias("__gaps"))
    for column in columns:
        counts = chunks.groupBy(document, column).agg(F.count("*").alias("n"), F.min("chunk_index").alias("first_at"))
        counts = counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(document)))
        line = F.format_string("  %s: %d (%.1f%%)", F.coalesce(F.col(column), F.lit("-")), F.col("n"), F.col("percent"))
        lines = counts.groupBy(document).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_at", line.alias("l")))).alias("x"))
        report = report.join(lines.select(document, F.concat(F.lit(f"{column}:\n"), F.array_join(F.transform("x", lambda r: r.l), "\n")).alias(f"__{column}")), document, "left")
    return report.select(document, F.concat_ws("\n", "__head", *(f"__{c}" for c in columns), "__gaps").alias("report"))

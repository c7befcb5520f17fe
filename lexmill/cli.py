"""Command line: ``python -m lexmill.cli clean|split|import|info|review|search ...``."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import embed, index, prompt, retrieve, stats
from lexmill.plans import pipelines
from lexmill.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("clean", help="clean Word files into Word files of the same layout")
    s.add_argument("--input-dir", required=True)
    s.add_argument("--output-dir", required=True)
    s.add_argument("--kind", choices=("contract", "law"), default="contract")
    s = sub.add_parser("info", help="count, columns, one row and a search of a store")
    s.add_argument("--store", required=True)
    s = sub.add_parser("split", help="clean and split Word files")
    s.add_argument("--input-dir", required=True)
    s.add_argument("--output-dir", required=True)
    s.add_argument("--kind", choices=("contract", "law"), default="contract")
    s.add_argument("--chunk-size", type=int, help="accepted, without effect: clauses are not cut by size")
    s.add_argument("--min-length", type=int)
    s = sub.add_parser("import", help="bring a store up to date with chunk files")
    s.add_argument("--store", required=True)
    s.add_argument("folders", nargs="+")
    s = sub.add_parser("search", help="the nearest rows of a text")
    s.add_argument("--store", required=True)
    s.add_argument("--text", required=True)
    s.add_argument("--k", type=int, default=5)
    s = sub.add_parser("review", help="retrieve and ask a language model")
    s.add_argument("--store", default="")
    s.add_argument("--clause", required=True)
    s.add_argument("--url", required=True)
    s.add_argument("--output")
    s.add_argument("--simple", action="store_true")
    return p


def _opened(spark: SparkSession, path: str) -> index.Store:
    """The store at a path; without one there the first by name beside it."""
    root, _, name = path.rstrip("/").rpartition("/")
    return index.open_collection(spark, root or ".", name)


def clean(spark: SparkSession, a: argparse.Namespace) -> int:
    counts = pipelines.clean_files(spark, a.input_dir, a.output_dir, a.kind)
    sinks.write_table(counts, f"{a.output_dir}/report", one_file=True)
    counts.show(truncate=False)
    return 0


def info(spark: SparkSession, a: argparse.Namespace) -> int:
    store = _opened(spark, a.store)
    for name, value in {**store.info(), "first": store.peek(), **store.smoke_test()}.items():
        print(f"{name}: {value}")
    return 0


def split(spark: SparkSession, a: argparse.Namespace) -> int:
    chunks = pipelines.clean_and_split(spark, a.input_dir, a.kind, a.min_length)
    chunks.write.mode("overwrite").parquet(f"{a.output_dir}/chunks")
    rows = spark.read.parquet(f"{a.output_dir}/chunks")
    priority = F.col("clause_priority") if "clause_priority" in rows.columns else F.lit(None).cast("int")
    rows = rows.withColumn("clause_priority", priority)
    folders = stats.folder_names(rows.select("file_path", T.folder_name(F.regexp_replace("source", r"(.)\.[^.]*\z", "$1")).alias("base")).distinct(), "base", ["file_path"])
    if "contract_party" not in rows.columns:
        rows = rows.withColumn("contract_party", F.lit(None).cast("string"))
    sinks.write_reports(stats.report_lines(rows).join(folders, "file_path"), f"{a.output_dir}/reports", "folder")
    for name, report in (("documents", stats.overall_report(rows, folders)), ("types", stats.histogram(rows, "clause_type")), ("overall", stats.overall(rows, "file_path")), ("continuity", stats.continuity(rows, "file_path"))):
        sinks.write_table(report, f"{a.output_dir}/statistics/{name}", one_file=name in ("types", "overall"))
    return 0


def review(spark: SparkSession, a: argparse.Namespace) -> int:
    """With retrieval, else without; 1 if neither gives an answer."""
    client = lambda: embed.HttpClient(a.url)
    row = None
    if a.simple:
        row = pipelines.simple_review(spark, a.clause, client)
    else:
        try:
            row = pipelines.review(spark, _opened(spark, a.store), a.clause, client)
        except Exception as e:  # noqa: BLE001
            print(f"no retrieval: {e}", file=sys.stderr)
            row = pipelines.simple_review(spark, a.clause, client, "fallback_simple")
    found = row.first()
    if found.response is None:
        return 1
    print(found.response)
    if a.output:
        sinks.write_table(spark.createDataFrame([found.asDict()], row.schema), a.output, one_file=True)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if a.command in ("clean", "split", "info"):
        return {"clean": clean, "split": split, "info": info}[a.command](spark, a)
    if a.command == "import":
        store = index.Store(spark, a.store)
        now = datetime.datetime.now().isoformat()  # noqa: DTZ005
        store.create(a.store.rstrip("/").rsplit("/", 1)[-1], "hashing", pipelines.seed_row(spark, now), now)
        pipelines.import_folders(spark, store, a.folders, now).show(truncate=False)
        store.describe(a.store.rstrip("/").rsplit("/", 1)[-1], "hashing", now)
        return 0
    if a.command == "search":
        vector = [float(x) for x in embed.HashingEmbedder()([a.text])[0]]
        hits = retrieve.top_k(_opened(spark, a.store).index(), vector, a.k, "id")
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("distance", "id")))  # k rows
        for r in prompt.hit_line(hits, ["import_time", "source", "clause_header"]).orderBy("rank").collect():
            print(r.line)
        return 0
    return review(spark, a)


if __name__ == "__main__":
    sys.exit(main())

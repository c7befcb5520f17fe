"""End-to-end plans: clean and split, import, review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import cleaning, embed, index, prompt, retrieve, segment
from lexmill.runtime import durable
from lexmill.sources import chunks, docx, sinks


def _read(spark: SparkSession, folder: str, kind: str, recursive: bool) -> DataFrame:
    """The paragraphs of the Word files of a folder, parsed once. Statutes end in small or capital letters throughout."""
    files = docx.scan(spark, folder, recursive=recursive) if kind == "contract" else docx.scan(spark, folder, recursive=recursive, suffix=r"\.(docx?|DOCX?)$", ignore_case=False)
    return durable(docx.read_paragraphs(files), "paragraphs")


def clean_files(spark: SparkSession, folder: str, target: str, kind: str) -> DataFrame:
    """Cleans the Word files below a folder into Word files of the same layout below another; gives the counts by folder."""
    read = _read(spark, folder, kind, True)
    cleaned = cleaning.clean_contract(read) if kind == "contract" else cleaning.clean_law(read)
    made = sinks.cleaned_documents(cleaned)
    root = read.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    path = F.regexp_replace("file_path", r"\Afile:/*", "/")
    sinks.write_files(made.withColumn("file_path", sinks.output_name(path, root, target)))
    facts = docx.extracted(read).join(made.select("file_path", F.lit(True).alias("made")), "file_path", "left")
    return cleaning.report(facts.withColumn("folder", cleaning.folder_of("file_path")).withColumn("extraction_success", F.col("extraction_success") & F.col("made").isNotNull()), ["folder"])


def seed_row(spark: SparkSession, now: str, model: str = "hashing", make: Callable = embed.HashingEmbedder) -> DataFrame:
    """The system row of a new store."""
    text = "合同数据库"
    facts = F.create_map(*(F.lit(x) for x in ("db_version", "1.0", "created_at", now, "total_files", "0", "last_updated", now, "model_info", model, "source", "system", "type", "system_info", "clause_header", text)))
    row = spark.range(1).select(F.lit("system").alias("id"), F.lit(text).alias("document"), F.lit("system").alias("source_file"), facts.alias("metadata"))
    return embed.embed(row, "document", "embedding", make)


def clean_and_split(spark: SparkSession, folder: str, kind: str, min_length: int | None = None, recursive: bool = True) -> DataFrame:
    """Word documents of one kind to clauses, without an exchange but the one by document."""
    read = _read(spark, folder, kind, recursive)
    facts = docx.extracted(read).select("file_path", "file_name", "file_stem", "contract_title", "extraction_success")
    cleaned = cleaning.clean_contract(read) if kind == "contract" else cleaning.clean_law(read)
    docs = cleaning.document_text(cleaned).join(facts, "file_path")
    if kind == "contract":
        return segment.split_contract(docs, min_length or segment.CONTRACT_MIN)
    return segment.split_law(docs, min_length or segment.LAW_MIN)


def import_folders(spark: SparkSession, store: index.Store, folders: list[str], now: str, make: Callable = embed.HashingEmbedder) -> DataFrame:
    """Brings a store up to date with chunk files; gives the counters. Unchanged files are neither parsed nor embedded."""
    files = chunks.scan_chunk_files(spark, *folders)
    changes = durable(index.classify(files.drop("content"), store.manifest()), "changes")
    fresh = files.join(changes.where("status IN ('new', 'modified')").select("source_file"), "source_file", "left_semi")
    rows = durable(embed.embed(chunks.load_chunks(fresh, now), "document", "embedding", make), "rows")
    store.apply(rows, changes, index.new_manifest(store.manifest(), changes, rows, F.lit(now)))
    return index.import_stats(changes, rows)


def review(spark: SparkSession, store: index.Store, clause: str, client: Callable, k: int = 2, make: Callable = embed.HashingEmbedder) -> DataFrame:
    """Retrieve, render, ask: one review result. ``client`` makes the language model's callable."""
    vector = [float(x) for x in make()([clause])[0]] if clause else []
    hits = retrieve.top_k(store.index(), vector, k, "id") if vector else store.index().limit(0).withColumn("similarity", F.lit(0.0)).withColumn("distance", F.lit(0.0))
    hits = hits.withColumn("rank", F.row_number().over(_by_distance())).withColumn("one", F.lit(1))
    context = prompt.format_hits(hits, ["one"]).select("one", "context")
    ask = spark.createDataFrame([(1, clause)], "one int, clause string").join(context, "one", "left").withColumn("retrieved_knowledge", F.coalesce("context", F.lit(prompt.NOTHING_FOUND)))
    ask = ask.withColumn("prompt", prompt.review_prompt("clause", "retrieved_knowledge"))
    return embed.ask(ask.select("clause", "retrieved_knowledge", "prompt"), "prompt", "response", client).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _by_distance():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy("distance", "id")  # at most k rows


def simple_review(spark: SparkSession, clause: str, client: Callable, mode: str = "simple") -> DataFrame:
    """A review without retrieval; ``fallback_simple`` uses the shortest prompt."""
    text = prompt.simple_prompt("clause") if mode == "simple" else prompt.fallback_prompt("clause")
    asked = spark.createDataFrame([(clause, mode)], "clause string, mode string").withColumn("prompt", text)
    return embed.ask(asked, "prompt", "response", client).select("clause", "mode", "response", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))

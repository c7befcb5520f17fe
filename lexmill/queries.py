"""Queries of the core operators, by name. Each reads its whole tables; the equivalent SQL stands in ``lexmill.oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import cleaning, embed, index, prompt, retrieve, segment, stats
from lexmill.oracle import SQL as SQL
from lexmill.runtime import once, shared_dir, spread, table
from lexmill.sources import chunks, docx, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW = "2025-01-01T00:00:00"  # the moment of the imports below
QUERY_STEP = 100  # rows whose id this divides are the query set of the searches


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- segmentation ------------------------------------------------------------------------------------------------------


@query
def law_clause_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.split_law(table(spark, d, "extracted_docs"))


@query
def law_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(law_clause_chunks(spark, d), "clause_type")


@query
def contract_clause_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.split_contract(table(spark, d, "extracted_docs"))


@query
def contract_paragraph_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_docs").where("extraction_success AND full_text IS NOT NULL")
    parts = F.filter(segment.split_paragraphs(F.col("full_text")), lambda p: F.length(p) >= segment.CONTRACT_MIN)
    rows = docs.select("file_path", F.posexplode(parts).alias("chunk_index", "text"))
    return rows.select("*", T.clip(T.strip(T.first_line("text")), 50).alias("clause_header"))


@query
def contract_clause_types(spark: SparkSession, d: str) -> DataFrame:
    rows = once(table(spark, d, "chunks").select("chunk_id", "text"), line=T.strip(T.first_line("text")))
    return rows.select("chunk_id", segment.contract_type("text", F.col("line")).alias("contract_type"), segment.law_type("text").alias("law_type"), segment.contract_party("text").alias("party"))


# --- statistics --------------------------------------------------------------------------------------------------------


@query
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_document(table(spark, d, "chunks"), ["file_path"])


@query
def chunk_stats_overall(spark: SparkSession, d: str) -> DataFrame:
    return stats.overall(table(spark, d, "chunks"), "file_path")


@query
def chunk_type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "chunks"), "clause_type")


@query
def chunk_type_histogram_by_file(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "chunks"), "clause_type", ["file_path"])


@query
def contract_party_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "chunks"), "contract_party")


@query
def contract_party_histogram_by_file(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "chunks"), "contract_party", ["file_path"])


@query
def contract_top3_types(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_values(table(spark, d, "chunks"), "clause_type", ["file_path"])


@query
def important_clauses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "file_path", "chunk_index", "clause_priority", "chunk_preview").distinct()
    return stats.important(rows, "file_path")


@query
def chunk_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Places without a typed clause, by file."""
    found = stats.continuity(table(spark, d, "chunks").where("clause_type IS NOT NULL"), "file_path")
    return found.withColumn("missing", F.array_join("missing", ","))


@query
def folder_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_docs").select("file_path", T.folder_name("file_stem").alias("base"))
    return stats.folder_names(rows, "base", ["file_path"])


# --- cleaning ----------------------------------------------------------------------------------------------------------


@query
def clean_contract_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_contract(table(spark, d, "paragraphs")).select("file_path", "pos", "text", "style", "role")


@query
def clean_law_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_law(table(spark, d, "paragraphs")).select("file_path", "pos", "text", "hierarchy_level", "is_law_section", "role", "spacer_before")


@query
def law_spacers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.spaced(cleaning.clean_law(table(spark, d, "paragraphs")))


@query
def line_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Every single test of the cleaners on every paragraph."""
    rows = table(spark, d, "paragraphs")
    tests = [f(c, k).alias(f"{n}_{k}") for n, f in (("box", cleaning.is_box), ("furniture", cleaning.is_furniture), ("indicated", cleaning.is_indicated), ("page_number", cleaning.is_page_number)) for k in ("contract", "law") for c in ("text",)]
    return rows.select("file_path", "pos", *tests, cleaning.is_footnote("text").alias("footnote"), cleaning.is_decoration("text").alias("decoration"), cleaning.is_law_head("text").alias("law_head"))


@query
def neighbor_context_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lone numbers between paragraphs that name no section; page marks like ``- 3 -`` are taken as their number first."""
    rows = table(spark, d, "paragraphs").withColumn("text", F.regexp_replace(T.strip("text"), r"\A- *([0-9]+) *-\z", "$1"))
    return cleaning.lone_numbers(rows).where("is_lone_number").select("file_path", "pos", "text")


@query
def hierarchy_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paragraphs").select("file_path", "pos", cleaning.hierarchy(T.strip("text")).alias("level"), T.contains_any("text", cleaning.LAW_SECTIONS).alias("is_section"))


@query
def contract_document_text(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.document_text(cleaning.clean_contract(table(spark, d, "paragraphs")))


@query
def cleaning_report(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.report(table(spark, d, "extracted_docs"))


@query
def contract_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paragraphs").withColumn("text", T.strip("text")).where(F.length("text") > 0)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)
    stems = table(spark, d, "extracted_docs").select("file_path", "file_stem")
    return rows.groupBy("file_path").agg(ordered.alias("p")).join(stems, "file_path", "left").select("file_path", T.contract_title(F.col("p"), F.col("file_stem")).alias("title"))


@query
def standardize_contract(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "text")).select("chunk_id", T.standard_contract("text").alias("text"))


@query
def standardize_law(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "text")).select("chunk_id", T.standard_law("text").alias("text"))


@query
def standardize_parts(spark: SparkSession, d: str) -> DataFrame:
    """The single standardisers on paragraphs."""
    p = table(spark, d, "paragraphs")
    return p.select(
        "file_path", "pos", T.dates("text", True).alias("dated"), T.law_references("text").alias("cited"), T.contract_amounts("text").alias("amounts"), T.law_numbers("text").alias("numbers"),
        T.law_clause_numbers("text").alias("law_clauses"), T.contract_clause_numbers("text").alias("contract_clauses"), T.numeral_value(F.regexp_extract("text", f"第([{T.NUMERALS}]+)条", 1), 20).alias("numeral"),
    )


@query
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select("chunk_id", T.preview("text", 100).alias("law_preview"), T.preview("text", 120).alias("contract_preview"), F.substring("text", 1, 60).alias("line_preview"), T.clip(T.strip(T.first_line("text")), 50).alias("head"))


# --- index and import --------------------------------------------------------------------------------------------------


def _scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_docs")
    return docs.select(F.col("file_path").alias("source_file"), F.md5("full_text").alias("content_hash"), F.coalesce(F.octet_length("full_text"), F.lit(0)).cast("long").alias("file_size"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("chunk_id").cast("string").alias("id"), F.col("text").alias("document"), F.col("file_path").alias("source_file")).distinct()


def _sized(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("file_size", F.coalesce("file_size", F.lit(0)))


@query
def md5_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d)


@query
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return _sized(index.latest_entries(table(spark, d, "manifest")))


@query
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return index.classify(_scan(spark, d), table(spark, d, "manifest"))


@query
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The index after an import: what the manifest knows is in it, what is new or changed is loaded."""
    changes = manifest_diff(spark, d)
    rows = _rows(spark, d)
    known = rows.join(table(spark, d, "manifest").select("source_file").distinct(), "source_file", "left_semi").withColumn("id", F.concat(F.lit("old-"), "id"))
    return index.upsert(known.select("id", "document", "source_file"), rows, changes).select("id", "source_file", "document")


@query
def manifest_after_import(spark: SparkSession, d: str) -> DataFrame:
    return _sized(index.new_manifest(table(spark, d, "manifest"), manifest_diff(spark, d), _rows(spark, d), F.lit(NOW)))


@query
def import_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.import_stats(manifest_diff(spark, d), _rows(spark, d))


@query
def collection_count(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("n_files"))


# --- retrieval ---------------------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("document"), "source")
    return e.join(docs, "vec_id", "left")


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of the row with the smallest id."""
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    scored = e.join(F.broadcast(first)).withColumn("distance", F.round(retrieve.cosine_distance(F.col("embedding"), F.col("q")), 6) + 0.0)
    return scored.where("distance IS NOT NULL").orderBy("distance", "vec_id").limit(5).select("vec_id", "label", "distance", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query
def vector_topk_many(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieve.top_k_many(e, e.where(f"vec_id % {QUERY_STEP} = 0"), 3)


@query
def vector_topk_where(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    some = e.where(retrieve.where_metadata({"$and": [{"label": {"$gte": 3}}, {"label": {"$nin": [5, 7]}}]}))
    return retrieve.top_k_many(some, e.where(f"vec_id % {QUERY_STEP} = 0"), 3)


@query
def vector_topk_where_document(spark: SparkSession, d: str) -> DataFrame:
    corpus = _corpus(spark, d).where(retrieve.where_document({"$and": [{"$contains": "第一条"}, {"$not_contains": "质押"}]}, F.col("document")))
    e = table(spark, d, "embeddings")
    return retrieve.top_k_many(corpus.select("vec_id", "embedding"), e.where(f"vec_id % {QUERY_STEP} = 0"), 3)


@query
def format_hits(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the query rows in both renderings."""
    hits = vector_topk_many(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("hit_id"), F.col("text").alias("document")), "hit_id", "left")
    a = prompt.format_hits(hits, ["query_id"])
    return a.join(prompt.format_hits(hits, ["query_id"], cleaned=False).withColumnRenamed("context", "raw_context"), "query_id")


@query
def hashing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "result").select("result_id", "clause").distinct()
    return embed.embed(spread(rows), "clause", "embedding").select("result_id", F.posexplode("embedding").alias("k", "x")).select("result_id", "k", F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def pooled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Each label's unit mean vector."""
    return embed.pooled_by_key(table(spark, d, "embeddings"), ["label"], "embedding").select("label", "k", F.round("x", 5).alias("x"))


# --- prompts -----------------------------------------------------------------------------------------------------------


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "result").select("result_id", "clause", "retrieved_knowledge", "prompt", "response", "time_seconds").distinct()


@query
def context_cleaner(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("result_id", prompt.clean_context("retrieved_knowledge").alias("context"))


@query
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("result_id", prompt.review_prompt("clause", "retrieved_knowledge").alias("review"), prompt.long_prompt("clause", F.coalesce("retrieved_knowledge", F.lit(""))).alias("long_review"))


@query
def plain_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("result_id", prompt.simple_prompt("clause").alias("simple"), prompt.fallback_prompt("clause").alias("fallback"))


@query
def timeout_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).select("result_id", prompt.timeout_seconds("prompt").alias("seconds"))


@query
def latency_classes(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d).groupBy(prompt.latency_class("time_seconds").alias("latency")).agg(F.count("*").alias("n"))


@query
def review_json(spark: SparkSession, d: str) -> DataFrame:
    """Review results as the JSON that is written out, read back field by field."""
    rows = _reviews(spark, d).join(table(spark, d, "result").select("result_id", "review_time").distinct(), "result_id")
    made = rows.select("result_id", F.to_json(F.struct("clause", "retrieved_knowledge", "prompt", "response", "time_seconds", F.col("review_time").alias("timestamp")), {"ignoreNullFields": "false"}).alias("json"))
    fields = "clause string, retrieved_knowledge string, prompt string, response string, time_seconds double, timestamp string"
    return made.select("result_id", F.from_json("json", fields).alias("r"), F.size(F.json_object_keys("json")).alias("n_fields")).select("result_id", "r.*", "n_fields")


@query
def cleaning_report_by_folder(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "extracted_docs").withColumn("folder", cleaning.folder_of("file_path"))
    return cleaning.report(docs, ["folder"])


@query
def statistics_with_folders(spark: SparkSession, d: str) -> DataFrame:
    """The overall report: counts of each document with the folder and title it is kept under."""
    titles = table(spark, d, "extracted_docs").select("file_path", "contract_title")
    return stats.overall_report(table(spark, d, "chunks"), folder_names(spark, d).drop("base").join(titles, "file_path"))


@query
def replaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows taken out and put in by the import of ``incremental_upsert``, by file."""
    rows = _rows(spark, d)
    known = rows.join(table(spark, d, "manifest").select("source_file").distinct(), "source_file", "left_semi")
    return index.replaced_counts(known, rows, manifest_diff(spark, d))


# --- files: written, found and read back -------------------------------------------------------------------------------


def _round_trip(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"


@query
def chunk_files_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Chunk files, one JSON array a document in a folder of its own, written, scanned and loaded."""
    c = table(spark, d, "chunks").drop("chunk_id", "loaded_at", "import_time").withColumnRenamed("header", "clause_header").distinct()
    c = c.withColumn("document", F.md5("file_path"))
    path = _round_trip(spark, "chunks")
    sinks.write_chunk_files(c, path, "document", chunks.METADATA_NAMES)
    loaded = chunks.load_chunks(chunks.scan_chunk_files(spark, path, suffix=r"\.txt$"), NOW)
    return loaded.select("document", "source", "file_path", "total_chunks", "total_chunks_in_doc", "source_stem", "contract_title", "clause_type", "clause_header", "contract_party", "clause_priority", "chunk_size", "chunk_preview").distinct()


@query
def word_files_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph tables written as Word files, scanned and parsed: text, style, size, weight, slant and alignment."""
    p = table(spark, d, "paragraphs").select("file_path", "pos", F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "").alias("text"), "style", "font_size", "is_bold", "is_italic", "alignment")
    path = _round_trip(spark, "word")
    files = sinks.paragraph_documents(p).withColumn("file_path", F.concat(F.lit(f"{path}/"), F.md5("file_path"), F.lit(".docx")))
    sinks.write_files(files)
    read = docx.read_paragraphs(docx.scan(spark, path)).where("style <> 'Table'")
    return read.select(F.substring_index(F.substring_index("file_path", "/", -1), ".", 1).alias("document"), "pos", "text", "style", "font_size", "is_bold", "is_italic", "alignment")


@query
def word_texts_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned contracts written as Word files and extracted again: number of paragraphs and text of each document."""
    cleaned = cleaning.clean_contract(table(spark, d, "paragraphs")).withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    path = _round_trip(spark, "cleaned")
    files = sinks.cleaned_documents(cleaned).withColumn("file_path", F.concat(F.lit(f"{path}/"), F.md5("file_path"), F.lit(".docx")))
    sinks.write_files(files)
    read = docx.extracted(docx.read_paragraphs(docx.scan(spark, path)))
    return read.select(F.col("file_stem").alias("document"), "full_text", "total_paragraphs", "extraction_success")

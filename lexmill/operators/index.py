"""The incrementally maintained index: change detection by content hash, set-based upsert, snapshots, store metadata.

A store is a folder. Rows lie in buckets by a hash of their file: ``data/<n>/bucket=<b>`` is bucket b as commit n wrote it,
``manifest/<n>`` the manifest of that commit, ``config.json`` the description. ``commits/<n>`` is the commit itself: one small
file, created under its own number and never replaced, which says for every bucket which commit wrote it last. The highest
number is in force. A commit writes only the buckets whose files changed, then its commit file, which can be created once
only: a job that is lost before leaves the previous state whole, and of two writers of one number the later one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("processed_at", T.StringType()), T.StructField("document_count", T.IntegerType()), T.StructField("file_size", T.LongType())])


def latest_entries(manifest: DataFrame) -> DataFrame:
    """One entry a file: the one processed last."""
    best = F.max(F.struct("processed_at", "content_hash", "document_count", "file_size")).alias("m")
    return manifest.groupBy("source_file").agg(best).select("source_file", "m.content_hash", "m.processed_at", "m.document_count", "m.file_size")


def classify(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each scanned file (``source_file, content_hash``) as new, unchanged, modified or failed (no hash)."""
    known = latest_entries(manifest).select("source_file", F.col("content_hash").alias("__old"))
    known = known.withColumn("__known", F.lit(True))
    status = F.when(F.col("content_hash").isNull(), "failed").when(F.col("__known").isNull(), "new").when(F.col("__old").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("modified")
    return scan.join(known, "source_file", "left").withColumn("status", status).drop("__old", "__known")


def upsert(index: DataFrame, rows: DataFrame, changes: DataFrame, purge_missing: bool = False) -> DataFrame:
    """The index with the rows of modified and new files in place of the old ones.

    A changed file without rows failed to load: its old rows stay. Files that are gone stay unless purged.
    """
    loaded = rows.select("source_file").distinct()
    changed = changes.where("status IN ('new', 'modified')").join(loaded, "source_file", "left_semi").select("source_file")
    kept = index.join(changed, "source_file", "left_anti")
    if purge_missing:
        kept = kept.join(changes.select("source_file"), "source_file", "left_semi")
    return kept.unionByName(rows.join(changed, "source_file", "left_semi"), allowMissingColumns=True)


def replaced_counts(index: DataFrame, rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``source_file, deleted, added``: for each changed file that was loaded, the rows taken out and put in."""
    added = rows.groupBy("source_file").agg(F.count("*").alias("added"))
    changed = changes.where("status IN ('new', 'modified')").select("source_file").join(added, "source_file")
    gone = index.join(changed.select("source_file"), "source_file", "left_semi").groupBy("source_file").agg(F.count("*").alias("deleted"))
    return changed.join(gone, "source_file", "left").select("source_file", F.coalesce("deleted", F.lit(0)).alias("deleted"), "added")


def new_manifest(manifest: DataFrame, changes: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The manifest after an import: entries of files that were loaded are replaced."""
    counts = rows.groupBy("source_file").agg(F.count("*").cast("int").alias("document_count"))
    fresh = changes.where("status IN ('new', 'modified')").join(counts, "source_file").select("source_file", "content_hash", now.cast("string").alias("processed_at"), "document_count", F.col("file_size").cast("long").alias("file_size"))
    return latest_entries(manifest).join(fresh, "source_file", "left_anti").unionByName(fresh)


def import_stats(changes: DataFrame, rows: DataFrame) -> DataFrame:
    """Counters of one import: files by status, chunks read and added, and the share of files written."""
    counts = rows.groupBy("source_file").agg(F.count("*").alias("__n"))
    files = changes.join(counts, "source_file", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    fresh = F.col("status").isin("new", "modified")
    done = fresh & (F.col("__n") > 0)
    return files.agg(
        F.count("*").alias("scanned_files"),
        F.count_if((F.col("status") == "new") & (F.col("__n") > 0)).alias("new_files"),
        F.count_if((F.col("status") == "modified") & (F.col("__n") > 0)).alias("modified_files"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged_files"),
        F.count_if((F.col("status") == "failed") | (fresh & (F.col("__n") == 0))).alias("failed_files"),
        F.coalesce(F.sum(F.when(fresh, F.col("__n"))), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum(F.when(done, F.col("__n"))), F.lit(0)).alias("added_chunks"),
        F.round(F.count_if(done) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"),
    )


BUCKETS = 64  # of a new store
BUCKET = "bucket"


def bucket_of(file: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("int")


class Store:
    """A collection on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")

    def exists(self) -> bool:
        return self.current() > 0

    def current(self) -> int:
        """The number of the commit in force, 0 without one."""
        if not self._fs.exists(self._at("commits")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("commits"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _commit(self) -> dict:
        number = self.current()
        if not number:
            raise FileNotFoundError(f"no store in {self.path}")
        commit = json.loads(self.spark.read.text(f"{self.path}/commits/{number}", wholetext=True).first()[0])
        return commit | {"schema": T.StructType.fromJson(commit["schema"])}

    def index(self) -> DataFrame:
        return self._read(self._commit())

    def _read(self, commit: dict, only: list[int] | None = None) -> DataFrame:
        wanted = [f"{self.path}/data/{n}/{BUCKET}={b}" for b, n in commit["written"].items() if only is None or int(b) in only]
        if not wanted:
            return self.spark.createDataFrame([], commit["schema"])
        return self.spark.read.schema(commit["schema"]).parquet(*wanted)

    def manifest(self) -> DataFrame:
        """The manifest in force, empty where there is no commit. A manifest that cannot be read is an error, not an empty one."""
        number = self.current()
        if not number:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{number}")

    def commit(self, index: DataFrame, manifest: DataFrame) -> int:
        """A commit of the whole index."""
        buckets = self._commit()["buckets"] if self.exists() else BUCKETS
        return self._write(index, manifest, buckets, {})

    def apply(self, rows: DataFrame, changes: DataFrame, manifest: DataFrame, purge_missing: bool = False) -> int:
        """A commit of ``upsert``: only the buckets of files that are loaded anew (or purged) are read and written."""
        now = self._commit()
        changed = changes.where("status IN ('new', 'modified')").select("source_file")
        touched = changed
        if purge_missing:
            touched = touched.unionByName(self._read(now).select("source_file").distinct().join(changes.select("source_file"), "source_file", "left_anti"))
        only = [r[0] for r in touched.select(bucket_of("source_file", now["buckets"]).alias(BUCKET)).distinct().collect()]  # a number a bucket
        old = self._read(now, only)
        schema = _all_fields(old.schema, rows.schema)
        return self._write(upsert(old, rows, changes, purge_missing), manifest, now["buckets"], {b: n for b, n in now["written"].items() if int(b) not in only}, schema)

    def _write(self, index: DataFrame, manifest: DataFrame, buckets: int, kept: dict, schema: T.StructType | None = None) -> int:
        number = self.current() + 1
        data = f"{self.path}/data/{number}"
        # one task may write many buckets, but each bucket is a few files: rows are put together by bucket and a salt
        index.withColumn(BUCKET, bucket_of("source_file", buckets)).repartition(BUCKET, F.pmod(F.xxhash64("source_file", F.lit(1)), F.lit(8))).write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        fresh = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"data/{number}"))]
        written = kept | {n.split("=")[1]: number for n in fresh if n.startswith(f"{BUCKET}=")}
        commit = {"number": number, "buckets": buckets, "written": written, "schema": json.loads((schema or index.schema).json())}
        self._text(f"commits/{number}", json.dumps(commit, ensure_ascii=False), once=True)
        return number

    def vacuum(self, keep: int = 1) -> None:
        """Removes what the last ``keep`` commits do not read."""
        numbers = range(max(1, self.current() - keep + 1), self.current() + 1)
        wanted = {(int(n), b) for k in numbers for b, n in json.loads(self.spark.read.text(f"{self.path}/commits/{k}", wholetext=True).first()[0])["written"].items()}
        for folder in self._fs.listStatus(self._at("data")):
            number = int(folder.getPath().getName())
            for bucket in self._fs.listStatus(folder.getPath()):
                name = bucket.getPath().getName()
                if number < numbers[0] and name.startswith(f"{BUCKET}=") and (number, name.split("=")[1]) not in wanted:
                    self._fs.delete(bucket.getPath(), True)
        for name in ("manifest", "commits"):
            for entry in self._fs.listStatus(self._at(name)):
                number = entry.getPath().getName()
                if number.isdigit() and int(number) < numbers[0]:
                    self._fs.delete(entry.getPath(), True)

    def _text(self, name: str, text: str, once: bool = False) -> None:
        """A small file, whole or not at all: written beside and renamed. ``once``: an existing one is an error."""
        if once and self._fs.exists(self._at(name)):
            raise FileExistsError(f"{self.path}/{name}")
        self._fs.mkdirs(self._at(name).getParent())
        aside = self._at(f"{name}.{uuid.uuid4().hex}.new")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if not once:
            self._fs.delete(self._at(name), False)
        if not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{self.path}/{name}")

    def create(self, name: str, embedding_model: str, seed: DataFrame | None = None, created_at: str = "") -> None:
        """A new store with its description and, if given, a system row; an existing one is left alone."""
        if self.exists():
            return
        schema = "id string, document string, source_file string, metadata map<string,string>, embedding array<float>"
        empty = self.spark.createDataFrame([], schema)
        self.commit(seed if seed is not None else empty, self.spark.createDataFrame([], MANIFEST))
        self.describe(name, embedding_model, created_at)

    def describe(self, name: str, embedding_model: str, created_at: str = "") -> None:
        """Writes ``config.json`` with the number of rows in force."""
        config = {"collection_name": name, "embedding_model": embedding_model, "created_at": created_at, "version": "1.0", "total_documents": self.index().count(), "index_type": "exact", "similarity_metric": "cosine"}
        self._text("config.json", json.dumps(config, ensure_ascii=False, indent=2))

    def info(self) -> dict:
        """Name, number of rows and names of the metadata columns."""
        rows = self.index()
        return {"path": self.path, "count": rows.count(), "columns": rows.columns}

    def peek(self) -> dict | None:
        """One row, any."""
        row = self.index().drop("embedding").first()
        return row.asDict() if row else None

    def smoke_test(self) -> dict:
        """Can the store be read and searched: its count and the nearest row of its first vector."""
        from lexmill.operators import retrieve

        rows = self.index()
        first = rows.where("embedding IS NOT NULL").first() if "embedding" in rows.columns else None
        hit = retrieve.top_k(rows, [float(x) for x in first.embedding], 1, "id").first() if first else None
        return {"count": rows.count(), "hit": hit.id if hit else None}


def _all_fields(one: T.StructType, two: T.StructType) -> T.StructType:
    """The fields of both, those of the first first."""
    return T.StructType([*one.fields, *(f for f in two.fields if f.name not in one.names)])


def collections(spark: SparkSession, root: str) -> list[str]:
    """Names of the stores below a folder; on any error none."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and Store(spark, s.getPath().toString()).exists())
    except Exception:  # noqa: BLE001
        return []


def open_collection(spark: SparkSession, root: str, name: str) -> Store:
    """The named store, else the first by name, else an error."""
    names = collections(spark, root)
    if not names:
        raise FileNotFoundError(f"no collection in {root}")
    return Store(spark, f"{root}/{name if name in names else names[0]}")

"""Session helpers shared by every operator: tables, arguments and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of parts) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session whose executors are this machine itself (``local[...]``) may leave it unset: a temporary folder is made
    and set. On a cluster each executor would write to its own disk, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    A parquet table instead of ``checkpoint()`` keeps the copy compressed and lets later stages read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns that are worked out a single time a row, however often they are used.

    Plain projections are merged, and with them an expression is repeated wherever its column is used; the generator
    that makes the columns here keeps the optimizer from that.
    """
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), F.inline(F.array(made)))


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, for work that outweighs moving its input.

    Inputs that already have enough partitions, as any large table has, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parallelism(spark: SparkSession, factor: int = 1) -> int:
    """Partitions for explicitly placed exchanges; follows ``spark.sql.shuffle.partitions``, which the deployment sizes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)

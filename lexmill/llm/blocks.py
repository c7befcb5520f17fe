"""Groups of equal keys, met in blocks of bounded size, so that no group has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import durable, parallelism

BLOCK = 2048  # rows of a block, about; a task holds two


def block_pairs(df: DataFrame, key: str, rows_in_group: Column, identity: Column, block: int = BLOCK) -> DataFrame:
    """Adds ``block_key`` and ``side``: each row goes to every pair of blocks its own block belongs to.

    A group of up to ``block`` rows stays one block (side 0, met with itself). A larger one is cut by a hash of
    ``identity`` into blocks; the pair (i, i) holds block i as side 0, the pair (i, j) block i as side 0 and block j as
    side 1. So each pair of rows meets exactly once, and a hot group is spread over many tasks.
    """
    many = F.greatest(F.lit(1), F.ceil(rows_in_group / F.lit(block))).cast("int")
    cut = df.withColumn("__n", many).withColumn("__own", F.pmod(F.xxhash64(identity, F.lit(7)), F.col("__n")).cast("int"))
    met = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    met = met.withColumn("block_key", F.when(F.col("__n") == 1, F.col(key)).otherwise(F.xxhash64(key, low, high)))
    met = met.withColumn("side", (F.col("__own") > F.col("__other")).cast("int"))
    return met.drop("__n", "__own", "__other")


def packed(members: DataFrame, keys: list[str], identity: str, n: str, block: int) -> DataFrame:
    """The distinct members of each group as arrays of about ``block`` at most: ``__of`` arrays a group, numbered ``__slice``."""
    of = F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(block))).cast("int")
    cut = members.withColumn("__of", of).withColumn("__slice", F.pmod(F.xxhash64(identity, F.lit(7)), F.col("__of")).cast("int"))
    return cut.groupBy(*keys, "__of", "__slice").agg(F.collect_set(identity).alias("__ids"))


def _spelled(met: DataFrame) -> DataFrame:
    """Arrays ``a`` and ``b`` to pairs; ``same``: both are one array. Narrow, so it runs where the arrays lie."""
    one = met.select(F.explode("a").alias("x"), "b", "same")
    two = one.select("x", F.explode("b").alias("y"), "same").where("NOT same AND x <> y OR x < y")
    return two.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def pairs_within(members: DataFrame, keys: list[str], identity: str, n: str, block: int = BLOCK) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``) of each two members of a group, once; ``n`` is (at least) the group's size.

    What is exchanged are arrays of members, and each pair of arrays of a hot group is a row of its own.
    """
    slices = durable(packed(members, keys, identity, n, block), "packed")  # read twice
    alone = slices.where("__of = 1").select(F.col("__ids").alias("a"), F.col("__ids").alias("b"), F.lit(True).alias("same"))
    many = slices.where("__of > 1")
    one = many.select(*keys, "__slice", F.col("__ids").alias("a"), F.explode(F.sequence("__slice", F.col("__of") - 1)).alias("__other"))
    met = one.join(many.select(*keys, F.col("__slice").alias("__other"), F.col("__ids").alias("b")), [*keys, "__other"])
    met = met.repartition(parallelism(members.sparkSession), *keys, "__slice", "__other").select("a", "b", (F.col("__slice") == F.col("__other")).alias("same"))
    return _spelled(alone.unionByName(met)).distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id_a, id_b`` (``id_a < id_b``) of the members (``class, id, n``) of each pair ``class_a, class_b`` of different classes.

    The joins carry arrays of members, so a hot class travels as a few rows, and each pair of arrays is spelled out on its
    own.
    """
    slices = durable(packed(members, ["class"], "id", "n", block), "packed")  # read twice
    one = slices.select(F.col("class").alias("class_a"), F.col("__slice").alias("__s"), F.col("__ids").alias("a"))
    two = slices.select(F.col("class").alias("class_b"), F.col("__slice").alias("__t"), F.col("__ids").alias("b"))
    met = pairs.select("class_a", "class_b").join(one, "class_a").join(two, "class_b")
    met = met.repartition(parallelism(pairs.sparkSession), "class_a", "__s", "class_b", "__t")
    return _spelled(met.select("a", "b", F.lit(False).alias("same"))).distinct()

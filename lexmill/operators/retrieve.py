"""Exact cosine retrieval with metadata and text filters.

Vectors are packed into blocks, one row a block; the stated query set meets the corpus block by block in matrix products,
each task keeps its own best ``k`` of a query, and only those are exchanged and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.runtime import spread

_COMPARE = {"$eq": "__eq__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def where_metadata(condition: dict, column=F.col) -> Column:
    """A metadata filter: ``{field: value}``, comparison operators, ``$in``, ``$nin``, ``$and``, ``$or``.

    A row without the field (null) is not equal to any value, so ``$ne`` and ``$nin`` keep it; other comparisons drop it.
    """
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [where_metadata(c, column) for c in value]))
        elif isinstance(value, dict):
            for op, operand in value.items():
                if op in ("$in", "$nin"):
                    parts.append(column(key).isin(operand) if op == "$in" else ~F.coalesce(column(key).isin(operand), F.lit(False)))
                elif op == "$ne":
                    parts.append(~column(key).eqNullSafe(operand))
                else:
                    parts.append(getattr(column(key), _COMPARE[op])(operand))
        else:
            parts.append(column(key) == value)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def where_document(condition: dict, text: Column) -> Column:
    """A text filter: ``$contains``, ``$not_contains``, ``$and``, ``$or``."""
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [where_document(c, text) for c in value]))
        elif key == "$contains":
            parts.append(F.contains(text, F.lit(value)))
        elif key == "$not_contains":
            parts.append(~F.contains(text, F.lit(value)))
        else:
            raise ValueError(f"unknown text filter {key}")
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos`` in double precision; null for a vector of length zero or of another dimension."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), 1 - dot(a, b) / norm)


def top_k(corpus: DataFrame, query: list[float] | Column, k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to one query vector, by distance and then id."""
    q = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    scored = corpus.withColumn("distance", F.round(cosine_distance(F.col(vector), q), 6) + 0.0).where("distance IS NOT NULL")
    return scored.withColumn("similarity", F.round(1 - F.col("distance"), 6)).orderBy("distance", key).limit(k)


_BLOCK = "ids binary, vectors binary, width int"


def _packer(rows: int):
    """Rows ``id, vector`` as blocks: ids and unit vectors in double precision, one block a dimension. Vectors of length zero have no direction."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            batch = batch.filter(pa.compute.and_(pa.compute.is_valid(batch.column(0)), pa.compute.is_valid(batch.column(1))))
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for width in np.unique(sizes[sizes > 0]).tolist():
                some = batch.filter(pa.array(sizes == width))
                v = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                norm = np.sqrt((v * v).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                v, own = v[good] / norm[good, None], some.column(0).to_numpy()[good]
                for at in range(0, len(own), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([own[at : at + rows].tobytes()]), pa.array([v[at : at + rows].tobytes()]), pa.array([width], pa.int32())], ["ids", "vectors", "width"])

    return run


def _smallest(d: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first of each row by distance and id; ties at the k-th distance are kept until ids decide."""
    if d.shape[1] > 4 * k:
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        most = int((d <= bound).sum(1).max())
        order = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        d, n = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
    order = np.lexsort((n, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)


def _scorer(k: int, held_blocks: int = 256):
    """Pairs of a query block and a corpus block to the best ``k`` of each query, kept over the pairs of a task.

    At most ``held_blocks`` query blocks are held with their best; before more come, what is held is given out.
    """

    def give(best: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, (d, n) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(ids, np.int64), d.shape[1])), pa.array(n.reshape(-1)), pa.array(d.reshape(-1))], ["query_id", "hit_id", "distance"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in stream:
            for width, q_width, q_ids, q, ids, v in zip(*(batch.column(c).to_pylist() for c in ("width", "q_width", "q_ids", "q_vectors", "ids", "vectors"))):
                if width != q_width:
                    continue
                left, right = np.frombuffer(q, np.float64).reshape(-1, width), np.frombuffer(v, np.float64).reshape(-1, width)
                d = np.round(1 - left @ right.T, 6) + 0.0
                n = np.broadcast_to(np.frombuffer(ids, np.int64), d.shape)
                d, n = _smallest(d, n, k)
                if q_ids in best:
                    d, n = _smallest(np.concatenate([best[q_ids][0], d], 1), np.concatenate([best[q_ids][1], n], 1), k)
                elif len(best) >= held_blocks:
                    yield from give(best)
                    best = {}
                best[q_ids] = d, n
        yield from give(best)

    return run


def top_k_many(corpus: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", query_rows: int = 512, corpus_rows: int = 4096) -> DataFrame:
    """``query_id, hit_id, distance, similarity, rank`` of the ``k`` nearest corpus rows of every query row.

    Both sides become blocks of vectors, one row a block, and the stated query set meets the corpus block by block; what is
    exchanged are a task's best ``k`` of each query. Nothing comes to the driver. The blocks of the queries are broadcast
    if Spark knows them to be small (``spark.sql.autoBroadcastJoinThreshold``), else both sides are read block by block.
    Exact; null vectors, those of length zero and those of another dimension are nobody's neighbours.
    """
    pack = lambda rows, n: rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_packer(n), _BLOCK)
    asked = pack(queries, query_rows).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"))
    # block against block; no equality as a key, since all blocks of one dimension would meet in one task
    found = pack(spread(corpus), corpus_rows).crossJoin(asked).mapInArrow(_scorer(k), "query_id long, hit_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "hit_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("similarity", F.round(1 - F.col("distance"), 6))

"""Splitting oversized items at natural boundaries, by agglomerative merging.

A text is first cut into atomic segments at every natural boundary (blank line, line, sentence, part of a sentence,
comma or blank). All adjacent segments wait in a heap, the weakest boundary first, and two are merged as long as the
merged body and the overlap (the first piece has none) fit into the limit, so that the boundaries that stay are the strongest ones. A stretch
without any boundary is cut at the limit, but not before a combining sign. Each piece after the first begins with the end
of its predecessor: the longest stretch of at most the overlap that starts at a natural boundary (after a cut without a
boundary: exactly the overlap).

The bodies of the pieces, laid end to end, are the text. Defined cases: a text within its limit and a null text give no
pieces; a null type, or a type without a rule, has the rule ``*``; without any rule, or with a limit that is null or not
positive, nothing is cut; an overlap that is null, negative or not smaller than the limit (it would leave no room) is 0; of
rows with one id the one loaded last counts, of those loaded at one time the longest; columns that are not named are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.runtime import table

# Strength of a boundary by what stands before it; the first pattern that fits counts.
_BOUNDARY = re.compile(r"(?P<s5>\n[^\S\n]*\n\s*)|(?P<s4>\r?\n\s*)|(?P<s3>[。！？!?]+[”’」』）)\"']*\s*|\.(?=\s)\s+|…+)|(?P<s2>[；;：:]\s*)|(?P<s1>[，,、]\s*|\s+)")
HARD = 0


def segments(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments of ``text``, each at most ``limit`` long, and the strength of the boundary there."""
    ends, strength, start = [], [], 0
    for m in _BOUNDARY.finditer(text):
        end = m.end()
        while end - start > limit:  # no boundary in reach
            cut = _hard_cut(text, start, limit)
            ends.append(cut)
            strength.append(HARD)
            start = cut
        if end > start:
            ends.append(end)
            strength.append(int(m.lastgroup[1]))
            start = end
    while len(text) - start > limit:
        start = _hard_cut(text, start, limit)
        ends.append(start)
        strength.append(HARD)
    if start < len(text):
        ends.append(len(text))
        strength.append(5)
    return ends, strength


def _hard_cut(text: str, start: int, limit: int) -> int:
    """The last place at most ``limit`` from ``start`` that is not inside a combining sequence; ``limit`` if all are."""
    for at in range(start + limit, start, -1):
        if not (unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mn", "Me", "Cf") or text[at - 1] == "‍"):
            return at
    return start + limit


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, body start, end)`` of each piece; ``text[start:end]`` has at most ``limit`` characters."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = overlap if 0 < overlap < limit else 0
    room = limit - overlap
    fits = lambda a, size: size <= (room if start[a] else limit)  # the first piece has no overlap before it
    ends, strength = segments(text, room)
    n = len(ends)
    start = [0, *ends[:-1]]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(strength[k], ends[k + 1] - start[k], k, k + 1) for k in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and nxt[a] == b and ends[b] - start[a] == size) or not fits(a, size):
            continue
        ends[a], strength[a], alive[b], nxt[a] = ends[b], strength[b], False, nxt[b]
        if nxt[b] < n:
            prv[nxt[b]] = a
            heapq.heappush(heap, (strength[a], ends[nxt[b]] - start[a], a, nxt[b]))
        if prv[a] >= 0:
            p = prv[a]
            heapq.heappush(heap, (strength[p], ends[a] - start[p], p, a))
    bodies = [(start[k], ends[k], strength[k]) for k in range(n) if alive[k]]
    found = []
    for k, (a, b, _) in enumerate(bodies):
        lead = 0
        if k and overlap:
            before_a, _, kind = bodies[k - 1]
            low = max(before_a, a - overlap)
            if kind == HARD:
                lead = a - low
            else:
                spots = [m.end() for m in _BOUNDARY.finditer(text, low, a) if low <= m.end() < a]
                if low == before_a and a - low <= overlap:
                    spots.append(low)
                lead = a - min(spots) if spots else 0
        found.append((a - lead, a, b))
    return found


_SCHEMA = "chunk_id long, chunk_index int, header string, max_chars int, overlap_chars int, piece_index int, n_pieces int, start int, body_start int, end int, piece string"


def _cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    for batch in stream:
        rows = []
        for chunk_id, text, chunk_index, header, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            cut = pieces(text, limit, overlap)
            rows += [(chunk_id, chunk_index, header, limit, overlap, k, len(cut), a, b, e, text[a:e]) for k, (a, b, e) in enumerate(cut)]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def split_oversized(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """The pieces of every chunk whose text is longer than the limit of its rule."""
    limits = rules.groupBy("clause_type").agg(F.max(F.struct(F.col("max_chars").cast("int").alias("m"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("o"))).alias("r"))
    own = limits.where("clause_type <> '*'").select(F.col("clause_type").alias("__type"), F.col("r").alias("__own"))
    rest = limits.where("clause_type = '*'").select(F.col("clause_type").alias("__any"), F.col("r").alias("__rest"))
    slim = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text").cast("string").alias("text"), F.col("chunk_index").cast("int").alias("chunk_index"), "header", "clause_type", "loaded_at")
    slim = slim.where("chunk_id IS NOT NULL").withColumn("size", F.coalesce(F.length("text"), F.lit(-1)))
    # a narrow pass finds the delivery that counts; only long texts are exchanged
    last = slim.groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "size")).alias("last"))
    ruled = slim.where("text IS NOT NULL").join(own, F.col("clause_type") == F.col("__type"), "left")
    ruled = ruled.join(rest, F.when(F.col("__own").isNull(), "*") == F.col("__any"), "left").withColumn("__r", F.coalesce("__own", "__rest"))
    long = ruled.where("__r.m > 0 AND size > __r.m").select("chunk_id", "loaded_at", "size", "text", "chunk_index", "header", F.col("__r.m").alias("max_chars"), F.greatest(F.col("__r.o"), F.lit(0)).alias("overlap_chars"))
    once = long.groupBy("chunk_id").agg(F.max(F.struct("loaded_at", "size", "text", "chunk_index", "header", "max_chars", "overlap_chars")).alias("r"))
    once = once.join(last, "chunk_id").where(F.col("last").eqNullSafe(F.struct("r.loaded_at", "r.size")))
    return once.select("chunk_id", "r.text", "r.chunk_index", "r.header", "r.max_chars", "r.overlap_chars").mapInArrow(_cut, _SCHEMA)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_rules"))
    return found.where("piece_index = 0").select("chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_rules"))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized chunk: the hash of its pieces' bodies laid end to end, and whether all pieces keep limit and overlap."""
    found = p5_pieces(spark, sf_dir).withColumn("body", F.substring("piece", F.col("body_start") - F.col("start") + 1, F.col("end") - F.col("body_start")))
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_index", "body"))), lambda x: x.body), "")
    return found.groupBy("chunk_id").agg(F.md5(bodies).alias("bodies"), F.bool_and(F.length("piece") <= F.col("max_chars")).alias("within_limit"), F.bool_and(F.col("body_start") - F.col("start") <= F.col("overlap_chars")).alias("within_overlap"))

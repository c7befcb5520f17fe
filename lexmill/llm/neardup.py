"""Near-duplicate texts by signature trees, over a collection too large for pairwise comparison.

A text is the set of its runs of four characters (skeleton without white space); two texts are alike if the Jaccard
similarity of their sets reaches ``THRESHOLD``. Copies (equal 128-bit hashes of the skeleton) are one class from the start.

* Routing: minhash values send a class to ``BANDS`` trees by ``ROWS`` values each. This is the candidate step, and the only
  probabilistic one: a pair of similarity s meets in some tree with probability 1 - (1 - s^ROWS)^BANDS. A tree over the
  whole collection would compare nodes of size n^2 at its upper levels, since the bitmaps of unrelated texts are full.
* Trees: the classes of one route are the leaves, in order of size, each with a bitmap of its tokens and the size of its
  set; inner nodes hold the OR of their children's bitmaps and the range of their sizes. A dual traversal from (root,
  root) drops a pair of nodes when the size ranges exclude the similarity or when the overlap that the bitmaps still allow
  (common bits plus the tokens that share bits) is too small for it. All trees of a batch are built and walked at once.
  Routes with many classes are cut into blocks, met pair by pair.
* What reaches the leaves is compared exactly, set against set: no false pair is given.

Defined cases: null texts and ids belong to no class; texts shorter than four characters are alike only to equal ones; an
id that comes twice counts once; columns other than id and text are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.blocks import block_pairs, expand_pairs, pairs_within
from lexmill.llm.skeleton import skeleton
from lexmill.llm.spans import _slices
from lexmill.runtime import durable, parallelism, spread, table

THRESHOLD = 0.6
RUN = 4  # characters of a token
BANDS, ROWS = 80, 5
WORDS = 8  # 64-bit words of a bitmap
FAN = 8  # children of an inner node
PART_BYTES, PARTS = 32_000_000, 16  # routes held at once by a task, about, and the parts there are at least
KEY = 6  # bytes of a route that travel; two routes that agree in them only cost a tree more work
_FULL = np.uint32(0xFFFFFFFF)


def compact(text: str) -> str:
    """The skeleton without white space."""
    return "".join(skeleton(text).split())


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _tokens(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs and the number of the text of each."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = np.maximum(lens - run + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) + np.repeat((np.cumsum(lens) - lens) - (np.cumsum(count) - count), count)
    h = np.zeros(len(at), np.uint64)
    for k in range(run):
        h = h << np.uint64(21) ^ h >> np.uint64(43) ^ cp[at + k]
    return _mix(h, 1), owner


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _short(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of digests: the handle of a class while candidates are searched."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _signatures(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id``, digest and handle of the class, number of distinct runs and bitmap of each text."""
    for batch in _slices(stream):
        texts = [compact(t) for t in batch.column(1).to_pylist()]
        h, owner = _tokens(texts)
        low = np.unique(owner.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
        size = np.bincount((low >> np.uint64(44)).astype(np.int64), minlength=len(texts))
        bits = np.zeros((len(texts), WORDS), np.uint64)
        spot = (h & np.uint64(64 * WORDS - 1)).astype(np.int64)
        np.bitwise_or.at(bits.reshape(-1), owner * WORDS + (spot >> 6), np.uint64(1) << (spot & 63).astype(np.uint64))
        digests = [_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(_short(digests)), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(WORDS))],
            ["id", "form", "class", "size", *(f"w{k}" for k in range(WORDS))],
        )


def _route(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Node keys of the last upper level, one a tree: ``ROWS`` minhash values each, by one permutation a row."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (n, 1))
    for row in range(ROWS):
        g = _mix(h, 11 + row)
        bin_of = ((g >> np.uint64(40)) * np.uint64(BANDS) >> np.uint64(24)).astype(np.int64)
        least = np.full(n * BANDS, _FULL)
        np.minimum.at(least, owner * BANDS + bin_of, (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        least = least.reshape(n, BANDS)
        filled = least.copy()
        for turn in range(1, 200):  # an empty bin borrows from others, in an order that is the same for all texts
            empty = filled == _FULL
            if not empty.any():
                break
            lend = _mix(np.arange(BANDS, dtype=np.uint64), 1000 * (row + 1) + turn) % np.uint64(BANDS)
            filled = np.where(empty, least[:, lend.astype(np.int64)], filled)
        filled = np.where(filled == _FULL, least.min(1)[:, None], filled)
        keys = _mix(keys ^ filled.astype(np.uint64), 31 + row)
    return keys


def _router(parts: int):
    """The routes of all texts, packed by part; equal texts of a batch go once."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream, 6_000_000):
            texts = list({compact(t) for t in batch.column(0).to_pylist()})
            texts = [t for t in texts if len(t) >= RUN]
            if not texts:
                continue
            ids = _short([_digest(t) for t in texts])
            keys = _route(*_tokens(texts), len(texts)).reshape(-1)
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            doc = np.repeat(np.arange(len(texts)), BANDS)
            order = np.argsort(part, kind="stable")
            part, keys, doc = part[order], keys[order], doc[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            rows = []
            for a, b in zip(cut, np.append(cut[1:], len(part))):
                some, many = np.unique(doc[a:b], return_counts=True)
                rows.append((int(part[a]), keys[a:b].view(np.uint8).reshape(-1, 8)[:, 8 - KEY :].tobytes(), ids[some].tobytes(), many.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "keys", "ids", "many"])

    return run


def _joined(pieces: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """The routes of one part that at least two classes take: one row a class."""
    sent = np.concatenate([np.frombuffer(k, np.uint8) for k, _, _ in pieces]).reshape(-1, KEY)
    keys = np.zeros((len(sent), 8), np.uint8)
    keys[:, 8 - KEY :] = sent
    keys = keys.view(np.uint64).reshape(-1)
    ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(m, np.uint8)) for _, i, m in pieces])
    order = np.argsort(keys, kind="stable")
    twin = keys[order][1:] == keys[order][:-1]
    order = order[np.append(twin, False) | np.append(False, twin)]  # alone on its route: ends here
    keys, ids = keys[order], ids[order]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))[: len(keys)]
    keys, ids = keys[fresh], ids[fresh]
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    count = count[which]
    ok = count > 1
    node, ids, count = keys[ok].view(np.int64), ids[ok], count[ok]
    for at in range(0, len(node), 100_000):
        to = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(node[to]), pa.array(ids[to]), pa.array(count[to])], ["node", "class", "rows"])


def _nodes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Part after part of a stream sorted by part; one part is held at a time."""
    held: list[tuple[bytes, bytes, bytes]] = []
    now = None
    for batch in stream:
        for part, *piece in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and held:
                yield from _joined(held)
                held = []
            now = part
            held.append(tuple(piece))
    if held:
        yield from _joined(held)


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


class Forest:
    """Signature trees over many groups of classes at once; level 0 holds the leaves, each group's in order of size.

    ``group``: numbers that do not fall, one tree each. All trees have one height; a small one ends in single children.
    """

    def __init__(self, group: np.ndarray, size: np.ndarray, bits: np.ndarray):
        slack = size - _popcount(bits)  # tokens that share a bit with others
        self.levels = [(size, size, slack, bits)]
        self.below: list[np.ndarray] = []  # of each level above the leaves: where the children of a node begin, and the end
        while True:
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            if len(start) == len(group) and self.below:
                break
            place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
            at = np.flatnonzero(place % FAN == 0)
            low, high, loose, have = self.levels[-1]
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(loose, at), np.bitwise_or.reduceat(have, at, axis=0)))
            self.below.append(np.append(at, len(group)))
            group = group[at]

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """Can any leaf below node i be alike to any below node j."""
        low, high, loose, have = self.levels[level]
        least = low[i] + low[j]
        ok = (high[i] >= t * low[j] - 1e-9) & (high[j] >= t * low[i] - 1e-9)
        near = np.flatnonzero(ok)
        i, j = i[near], j[near]
        overlap = np.minimum(np.minimum(high[i], high[j]), _popcount(have[i] & have[j]) + np.minimum(loose[i], loose[j]))
        ok[near] = overlap * (1 + t) >= t * least[near] - 1e-9
        return ok

    def traverse(self, i: np.ndarray, j: np.ndarray, t: float, limit: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves below the root pairs ``i, j`` that the bounds cannot tell apart, each once."""
        waiting = [(len(self.levels) - 1, i, j)]
        while waiting:
            level, i, j = waiting.pop()
            if level == 0:
                keep = i != j
                i, j = i[keep], j[keep]
            ok = self.possible(level, i, j, t)
            i, j = i[ok], j[ok]
            if level == 0:
                yield i, j
                continue
            edge = self.below[level - 1]
            for at in range(0, len(i), limit // FAN):
                a, b = i[at : at + limit // FAN], j[at : at + limit // FAN]
                many = edge[b + 1] - edge[b]
                total = (edge[a + 1] - edge[a]) * many
                which = np.repeat(np.arange(len(a)), total)
                place = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
                x, y = edge[a][which] + place // many[which], edge[b][which] + place % many[which]
                own = (a != b)[which] | (x <= y)
                waiting.append((level - 1, x[own], y[own]))


def _walker(t: float, rows: int = 32_768):
    def walk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        key, cls, size, side = (block.column(c).to_numpy() for c in ("block_key", "class", "size", "side"))
        bits = np.stack([block.column(f"w{k}").to_numpy() for k in range(WORDS)], 1).view(np.uint64)
        order = np.lexsort((size, side, key))
        key, cls, size, side, bits = key[order], cls[order], size[order].astype(np.int64), side[order], bits[order]
        tree = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
        head = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
        forest = Forest(tree, size, bits)
        # roots: a block's only tree with itself, the trees of its two sides with each other
        own, kind = key[head], side[head]
        twin = np.append(own[1:] == own[:-1], False)
        i = np.flatnonzero((kind == 0))
        j = np.where(twin[i], i + 1, i)
        for a, b in forest.traverse(i, j, t):
            a, b = cls[a], cls[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["class_a", "class_b"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks, about ``rows`` leaves at once; the stream is sorted by ``block_key``."""
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in stream:
            if not batch.num_rows:
                continue
            key = batch.column("block_key").to_numpy()
            if count >= rows:
                last = held[-1].column("block_key")[-1].as_py()
                at = int(np.argmax(key != last)) if (key != last).any() else len(key)
                if at < len(key):
                    yield from walk([*held, batch.slice(0, at)] if at else held)
                    held, count, batch = [], 0, batch.slice(at)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from walk(held)

    return run


def _checker(t: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream, 8_000_000):
            both = [*batch.column("text_a").to_pylist(), *batch.column("text_b").to_pylist()]
            at = {x: k for k, x in enumerate(dict.fromkeys(both))}
            h, owner = _tokens([compact(x) for x in at])
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
            h, owner = h[fresh], owner[fresh]
            size = np.bincount(owner, minlength=len(at))
            start = np.cumsum(size) - size
            which = np.array([at[x] for x in both], np.int64)
            pair = np.tile(np.arange(len(both) // 2), 2)
            n = size[which]
            place = np.arange(n.sum()) + np.repeat(start[which] - (np.cumsum(n) - n), n)
            # tokens that a pair has twice are common to both
            mark, of = h[place], np.repeat(pair, n)
            order = np.lexsort((mark, of))
            mark, of = mark[order], of[order]
            common = np.bincount(of[1:][(mark[1:] == mark[:-1]) & (of[1:] == of[:-1])], minlength=len(both) // 2)
            a, b = n[: len(both) // 2], n[len(both) // 2 :]
            keep = (common > 0) & (common >= t * (a + b - common) - 1e-9)
            yield batch.select(["class_a", "class_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def candidate_pairs(signed: DataFrame, slim: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The leaves of all trees in blocks, and the pairs of handles (``class_a, class_b``) that the trees leave over."""
    rows = signed.count()
    parts = max(PARTS, -(-rows * BANDS * 16 // PART_BYTES))
    packed = slim.select("text").mapInArrow(_router(parts), "part int, keys binary, ids binary, many binary").repartition(max(parallelism(signed.sparkSession), parts), "part").sortWithinPartitions("part")
    nodes = durable(packed.mapInArrow(_nodes, "node long, class long, rows long"), "nodes")
    leaves = signed.drop("id", "form").dropDuplicates(["class"])
    blocks = block_pairs(nodes.join(leaves, "class"), "node", F.col("rows"), F.col("class"))
    blocks = blocks.repartition(parallelism(signed.sparkSession), "block_key").sortWithinPartitions("block_key")
    return blocks, blocks.mapInArrow(_walker(threshold), "class_a long, class_b long").distinct()


def similar_classes(rows: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (``class, id, n``: a class is named by its smallest id, ``n`` is its size) and the pairs of different classes
    (``class_a, class_b``) that are alike."""
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    slim = spread(slim)
    words = ", ".join(f"w{k} long" for k in range(WORDS))
    signed = durable(slim.mapInArrow(_signatures, f"id long, form binary, class long, size int, {words}"), "signatures")
    single = signed.groupBy("id").agg(F.min(F.struct("form", F.col("class").alias("handle"))).alias("s")).select("id", "s.form", "s.handle")
    heads = durable(single.groupBy("form").agg(F.min("id").alias("class"), F.min("handle").alias("handle"), F.count("*").alias("n")), "classes")
    members = single.join(heads.select("form", "class", "n"), "form").select("class", "id", "n")
    candidates = durable(candidate_pairs(signed, slim, threshold)[1], "candidates")
    wanted = candidates.select(F.col("class_a").alias("handle")).unionByName(candidates.select(F.col("class_b").alias("handle"))).distinct()
    chosen = heads.join(wanted, "handle", "left_semi").select("handle", "class")
    texts = slim.join(chosen, slim["id"] == chosen["class"]).groupBy("handle", "class").agg(F.min("text").alias("text"))
    both = candidates.withColumnsRenamed({"class_a": "handle_a", "class_b": "handle_b"})
    for side in ("a", "b"):
        both = both.join(texts.select(F.col("handle").alias(f"handle_{side}"), F.col("class").alias(f"class_{side}"), F.col("text").alias(f"text_{side}")), f"handle_{side}")
    alike = durable(both.select("class_a", "class_b", "text_a", "text_b").mapInArrow(_checker(threshold), "class_a long, class_b long"), "alike")
    return members, alike


def alike_pairs(rows: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``id_a, id_b`` of all two rows that are alike, equal texts included."""
    members, alike = similar_classes(rows, key, text, threshold)
    linked = alike.select(F.col("class_a").alias("class")).unionByName(alike.select(F.col("class_b").alias("class"))).distinct()
    across = expand_pairs(alike, members.join(linked, "class", "left_semi"))
    return across.unionByName(pairs_within(members.where("n > 1"), ["class"], "id", "n"))


def components(edges: DataFrame) -> DataFrame:
    """``class, group``: the smallest class of each connected set, by FastSV: the least label of the neighbours' labels goes
    to a class and to its label's class, so trees are hooked whole and long chains take few rounds; it ends when nothing
    changes."""
    both = durable(edges.select(F.col("class_a").alias("x"), F.col("class_b").alias("y")).unionByName(edges.select(F.col("class_b").alias("x"), F.col("class_a").alias("y"))), "edges")
    label = durable(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("g")), "labels")
    changed = True
    while changed:
        above = label.join(label.select(F.col("x").alias("g"), F.col("g").alias("k")), "g").select("x", "g", "k")
        near = both.join(above.select(F.col("x").alias("y"), "k"), "y").groupBy("x").agg(F.min("k").alias("h"))
        met = durable(above.join(near, "x").select("x", "g", F.least("k", "h").alias("h")), "met")
        roots = met.groupBy(F.col("g").alias("x")).agg(F.min("h").alias("r"))
        after = durable(met.join(roots, "x", "left").select("x", "g", F.least("h", F.coalesce("r", "h")).alias("n")), "labels")
        changed = after.where("n < g").limit(1).count() > 0
        label = after.select("x", F.col("n").alias("g"))
    return label.select(F.col("x").alias("class"), F.col("g").alias("group"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alike_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "text")
    return found.select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its group (the smallest chunk id in it), the group's size in chunks and the links of its text."""
    members, alike = similar_classes(table(spark, sf_dir, "chunks"), "chunk_id", "text")
    joined = components(alike)
    members = members.select("class", "id")
    links = alike.select(F.col("class_a").alias("class")).unionByName(alike.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    classes = members.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("copies")).join(joined, "class", "left").withColumn("group", F.coalesce("group", "class")).join(links, "class", "left")
    whole = classes.groupBy("group").agg(F.min("first").alias("group_id"), F.sum("copies").alias("chunks_in_group"))
    return members.join(classes.select("class", "group", "links", "copies"), "class").join(whole, "group").select(F.col("id").alias("chunk_id"), "group_id", "chunks_in_group", F.coalesce("links", F.lit(0)).alias("links"), "copies")


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file names that share a group of alike chunks, one row a group and file name."""
    groups = p2_groups(spark, sf_dir).where("chunks_in_group > 1")
    names = table(spark, sf_dir, "chunks").select("chunk_id", "source").distinct()
    return groups.join(names, "chunk_id").groupBy("group_id", "source").agg(F.countDistinct("chunk_id").alias("chunks"))

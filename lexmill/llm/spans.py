"""Long exact spans shared between documents, by relative Lempel-Ziv parsing against indexed reference blocks.

Factor boundaries are set by content: of every window of phrase hashes the smallest is kept, so a long shared passage has
a phrase start in common, at the same place in both documents. All text around one phrase that several documents have is
a reference block. Its index holds, for each start before the phrase, the ``MIN_SPAN`` characters from there. A document
is factored greedily against every block it meets: from the leftmost start that another document of the block has, as far
as the index goes on with the next characters; at the boundary the factor is checked and joined with the one before.
Factors of at least ``MIN_SPAN`` characters are shared spans. Texts are never compared two by two: index entries are
grouped, so a passage in n documents costs n entries, and the documents of an entry are a group; ``p8_found`` alone
spells groups out as pairs.

Completeness: with phrases of ``PHRASE`` characters and windows of ``MIN_SPAN - PHRASE + 1`` phrases, any common passage of
``MIN_SPAN`` characters contains a whole window and so a common phrase start. Starts are left out only within text that is
proven periodic (equal to itself, shifted by the distance of the starts), where the first two and the last two of a run are
kept: a passage inside the run stands at the second start as well, which then is the one in common, and a passage that
goes beyond an end of the run contains the start at that end. Repeats with differing text between them are all kept.
A run counts as shared throughout only if a factor of ``MIN_SPAN`` characters lies within its periodic text: then the same
characters stand there again at every further period, and the factors of its first and last starts give the exact ends.
Entries are equal if phrase hash, start and hash of the characters are, 128 bits in all.

Defined cases: null and short texts share nothing; a passage repeated within one document alone is not shared; an id that
comes twice counts once; empty tables give no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.blocks import pairs_within
from lexmill.runtime import durable, parallelism, spread, table

MIN_SPAN = 120
PHRASE = 32  # a power of two
_END = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    now, have = values, 1
    while have * 2 <= width:
        now = best(now[:-have], now[have:])
        have *= 2
    rest = width - have
    return best(now[: len(now) - rest], now[rest:]) if rest else now


def phrase_starts(cp: np.ndarray, lens: np.ndarray, span: int = MIN_SPAN, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the sampled phrases in texts laid end to end, the phrases' hashes, and three numbers each, which are
    not 0 for the first two phrases of a thinned run: how far the last phrase but one ends from there, and how far the
    periodic text goes to the left and to the right (told exactly where a factor's text reaches)."""
    window = span - phrase + 1
    if len(cp) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
    h = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    size = 1
    while size < phrase:
        h = (h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        size *= 2
    h[h == _END] = np.uint64(0)
    ends = np.cumsum(lens)
    whole = np.zeros(len(cp) + 1, bool)  # does the phrase that starts here lie within its text
    for width, store in ((phrase, whole),):
        step = np.zeros(len(cp) + 1, np.int32)
        fit = lens >= width
        np.add.at(step, (ends - lens)[fit], 1)
        np.add.at(step, (ends - width + 1)[fit], -1)
        store[:] = np.cumsum(step) > 0
    full = np.zeros(len(cp) + 1, np.int32)  # does the window that starts here lie within its text
    fit = lens >= span
    np.add.at(full, (ends - lens)[fit], 1)
    np.add.at(full, (ends - span + 1)[fit], -1)
    n = len(h) - window + 1
    inside = np.cumsum(full)[:n] > 0
    low = np.where(inside, _sliding(h, window, np.minimum), np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), window, np.maximum)
    at = np.flatnonzero((high == h) & whole[: len(h)])
    # repeats of one phrase in one text at one distance, with the same text after each: a periodic run
    mark = h[at]
    text = np.searchsorted(ends, at, side="right")
    order = np.lexsort((at, mark, text))
    a, m, t = at[order], mark[order], text[order]
    step = np.diff(a)
    linked = (m[1:] == m[:-1]) & (t[1:] == t[:-1]) & (step <= window)
    inner = np.zeros(len(a) + 2, bool)  # by number + 1: does the run go on to both sides
    q = np.flatnonzero(linked[1:] & linked[:-1] & (step[1:] == step[:-1])) + 1
    far = step[q] > phrase  # up to the phrase's length the phrases themselves prove it
    inner[q[~far] + 1] = True
    q = q[far]
    col = np.arange(window)
    more = col < step[q][:, None]
    here = np.where(more, a[q][:, None] + col, 0)
    inner[q[(cp[here] == cp[np.where(more, here - step[q][:, None], 0)]).all(1)] + 1] = True
    keep = ~(inner[:-2] & inner[1:-1] & inner[2:])
    reach = np.zeros((len(a), 3), np.int64)
    first, last = np.flatnonzero(inner[1:] & ~inner[:-1]), np.flatnonzero(inner[:-1] & ~inner[1:]) - 1
    first, last = first[last - first > 1], last[last - first > 1]
    period, run = step[first - 1] if len(first) else first, t[first]
    low, high = (ends - lens)[run], ends[run]
    col = np.arange(span)
    back, on = a[first - 1][:, None] - 1 - col, a[last + 1][:, None] + phrase + col
    in_back, in_on = back >= low[:, None], on < high[:, None]
    in_back &= cp[np.where(in_back, back, 0)] == cp[np.where(in_back, back + period[:, None], 0)]
    in_on &= cp[np.where(in_on, on, 0)] == cp[np.where(in_on, on - period[:, None], 0)]
    left, right = (np.where(x.all(1), span, x.argmin(1)) for x in (in_back, in_on))
    for x in (first - 1, first):
        reach[x] = np.stack([a[last] + phrase - a[x], left + a[x] - a[first - 1], a[last + 1] + phrase + right - a[x]], 1)
    a, m, reach = a[keep], m[keep], reach[keep]
    order = np.argsort(a, kind="stable")
    return a[order], m[order], reach[order]


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(stream: Iterator[pa.RecordBatch], size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about ``size`` bytes, at least a row each."""
    for batch in stream:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _sampler(span: int, phrase: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream):
            texts = batch.column(1).to_pylist()
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            at, mark, reach = phrase_starts(_codes(texts), lens, span, phrase)
            ends = np.cumsum(lens)
            text = np.searchsorted(ends, at, side="right")
            place = at - (ends - lens)[text]
            ids = batch.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), ids, pa.array(place.astype(np.int32)), *(pa.array(r.astype(np.int32)) for r in reach.T)], ["mark", "doc", "place", *_RUN])

    return run


_RUN = ["reach", "run_left", "run_right"]
_CUT = f"mark long, rows long, doc long, place int, {' int, '.join(_RUN)} int, before string, after string"


def _cutter(span: int, phrase: int):
    side = span - phrase
    names = [c.split()[0] for c in _CUT.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.string()] * 2

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream):
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted"))):
                for w in wanted:
                    p = w["place"]
                    rows.append((w["mark"], w["rows"], doc, p, *(w[c] for c in _RUN), text[max(0, p - side) : p], text[p : p + span]))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


# --- the index of a reference block --------------------------------------------------------------------------------------


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    h = (values ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _index(mark: np.ndarray, before: list[str], after: list[str], span: int, phrase: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(left, rows, keys)`` for every possible factor start, from the leftmost: the rows whose text holds ``span``
    characters from ``left`` characters before the phrase, and a key that those with equal characters have in common."""
    side = span - phrase
    n_before, n_after = (np.fromiter(map(len, t), np.int64, len(t)) for t in (before, after))
    grid = np.zeros((side + span, len(mark)), np.uint64)
    for texts, lens, start in ((before, n_before, side - n_before), (after, n_after, np.full(len(mark), side))):
        row = np.repeat(np.arange(len(texts)), lens)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) + start[row]
        grid[col, row] = (_codes(texts).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grid ^= grid >> np.uint64(32)
    base = 0xBF58476D1CE4E5B9
    total = np.zeros((side + span + 1, len(mark)), np.uint64)
    for k in range(side + span):
        total[k + 1] = total[k] * np.uint64(base) + grid[k]
    far = np.uint64(pow(base, span, 1 << 64))
    own = mark.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for at in range(side + 1):
        rows = np.flatnonzero((at >= side - n_before) & (at + span <= side + n_after))
        if len(rows):
            yield side - at, rows, _mixed(total[at + span, rows] - total[at, rows] * far ^ own[rows], side - at + 1)


def _groups(doc: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (in order of document) put together by key, where each group starts, and which rows bring a new document."""
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    fresh = np.append(True, doc[rows][1:] != doc[rows][:-1])
    fresh[start] = True
    return rows, start, fresh


def _whole_blocks(stream: Iterator[pa.RecordBatch], rows: int = 16_384) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole reference blocks; the stream is sorted by ``mark``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        mark = batch.column("mark").to_numpy()
        cuts = np.append(0, np.flatnonzero(mark[1:] != mark[:-1]) + 1)
        if held and held[-1].column("mark")[-1].as_py() == int(mark[0]):
            cuts = cuts[1:]
        at = 0
        for cut in cuts.tolist():
            if count + cut - at >= rows and (held or cut > at):
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                yield pa.Table.from_batches(held)
                held, count, at = [], 0, cut
        held.append(batch.slice(at))
        count += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _read(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The block in order of document."""
    block = block.take(pa.array(np.argsort(block.column("doc").to_numpy(), kind="stable")))
    return block, block.column("mark").to_numpy(), block.column("doc").to_numpy()


def _parser(span: int, phrase: int):
    """Factors of each context against the block it stands in: from the leftmost start that another document has, as long
    as it goes on there."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(stream):
            block, mark, doc = _read(block)
            place, reach, run_left, run_right = (block.column(c).to_numpy() for c in ("place", *_RUN))
            first, last, whole = np.full(len(doc), -1), np.full(len(doc), -1), np.zeros(len(doc), bool)
            for left, rows, keys in _index(mark, block.column("before").to_pylist(), block.column("after").to_pylist(), span, phrase):
                rows, start, fresh = _groups(doc, rows, keys)
                many = np.add.reduceat(fresh, start, dtype=np.int64) > 1
                hit = rows[np.repeat(many, np.diff(np.append(start, len(rows))))]
                first[hit] = np.where(first[hit] < 0, left, first[hit])
                last[hit] = left
                # a span shared inside a run stands in it at every further period: shared as far as the last ones tell
                whole[hit[(reach[hit] > 0) & (run_left[hit] >= left) & (run_right[hit] >= span - left)]] = True
            hit = np.flatnonzero(first >= 0)
            if len(hit):
                end = np.where(whole[hit], np.maximum(span - last[hit], reach[hit]), span - last[hit])
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array((place[hit] - first[hit]).astype(np.int32)), pa.array((place[hit] + end).astype(np.int32))], ["doc", "a", "b"])

    return run


_MEMBERS = "g1 long, g2 long, n long, doc long"


def _grouper(span: int, phrase: int):
    """Documents with one factor in common: each set of documents once a batch, named by two sums over its members."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(stream):
            block, mark, doc = _read(block)
            one, two = _mixed(doc.view(np.uint64), 0x51ED27), _mixed(doc.view(np.uint64), 0x2545F491)
            known = np.zeros(0, np.uint64)
            for _, rows, keys in _index(mark, block.column("before").to_pylist(), block.column("after").to_pylist(), span, phrase):
                rows, start, fresh = _groups(doc, rows, keys)
                rows = rows[fresh]  # each document of a group once
                group = (np.cumsum(np.bincount(start, minlength=len(fresh))) - 1)[fresh]
                size = np.bincount(group)
                edge = np.append(0, np.cumsum(size)[:-1])
                g1, g2 = np.add.reduceat(one[rows], edge), np.add.reduceat(two[rows], edge)
                name = g1 * np.uint64(0x9E3779B97F4A7C15) + g2
                _, head = np.unique(name, return_index=True)
                take = np.zeros(len(name), bool)
                take[head] = True
                take &= (size > 1) & ~np.isin(name, known)
                if not take.any():
                    continue
                known = np.append(known, name[take])
                kept = take[group]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g1[group[kept]].view(np.int64), g2[group[kept]].view(np.int64), size[group[kept]], doc[rows[kept]])], ["g1", "g2", "n", "doc"])

    return run


def _spreader(span: int, phrase: int):
    """The index entries of contexts as rows, for blocks too large for one task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(stream):
            mark = batch.column("mark").to_numpy()
            for left, rows, keys in _index(mark, batch.column("before").to_pylist(), batch.column("after").to_pylist(), span, phrase):
                some = batch.select(["mark", "c", "d", "lo", "hi", "f1", "f2"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), left, np.int32)), *some.columns], ["key", "left", *some.schema.names])

    return run


class ReferenceBlocks:
    """The text around every phrase start that at least two documents have, by phrase.

    A block of up to ``block`` contexts is indexed inside one task. The contexts of a larger one are put together where
    they are equal, and their index entries go through the exchange as rows, so no block has to fit into a task.
    """

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = MIN_SPAN, phrase: int = PHRASE, block: int = 50_000):
        self.span, self.phrase = span, phrase
        docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where(f"doc IS NOT NULL AND length(text) >= {span}")
        docs = spread(docs)
        starts = durable(docs.mapInArrow(_sampler(span, phrase), f"mark long, doc long, place int, {' int, '.join(_RUN)} int"), "phrases")
        common = starts.groupBy("mark").agg(F.count("*").alias("rows"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("mark", "rows")
        wanted = starts.join(common, "mark").groupBy("doc").agg(F.collect_set(F.struct("mark", "rows", "place", *_RUN)).alias("wanted"))
        cut = durable(docs.join(wanted, "doc").mapInArrow(_cutter(span, phrase), _CUT), "contexts")
        parts = parallelism(docs.sparkSession)
        self.small = cut.where(F.col("rows") <= block).repartition(parts, "mark").sortWithinPartitions("mark")
        self.large = cut.where(F.col("rows") > block).withColumn("c", F.xxhash64("before", F.lit(1), "after")).withColumn("d", F.xxhash64("after", F.lit(2), "before"))

    def _entries(self) -> tuple[DataFrame, DataFrame]:
        """Index entries of the large blocks, and the shared ones with the name of their set of documents."""
        name = lambda seed: F.pmod(F.sum(F.xxhash64("doc", F.lit(seed)).cast("decimal(38,0)")), F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
        contexts = self.large.groupBy("mark", "c", "d").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), name(1).alias("f1"), name(2).alias("f2"))
        entries = durable(contexts.mapInArrow(_spreader(self.span, self.phrase), "key long, left int, mark long, c long, d long, lo long, hi long, f1 long, f2 long"), "entries")
        total = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(str(2**63)).cast("decimal(20,0)")).cast("long").alias(c)
        return entries, entries.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), total("f1"), total("f2")).where("lo < hi").select("key", "f1", "f2")

    def factors(self) -> DataFrame:
        """``doc, a, b``: the part around each phrase start that other documents have too."""
        found = self.small.mapInArrow(_parser(self.span, self.phrase), "doc long, a int, b int")
        entries, shared = self._entries()
        hits = entries.join(shared.select("key"), "key").groupBy("mark", "c", "d").agg(F.collect_set("left").alias("lefts"))
        sites = self.large.drop("before", "after", "rows").join(hits, ["mark", "c", "d"])
        whole = (F.col("reach") > 0) & F.exists("lefts", lambda x: (F.col("run_left") >= x) & (F.col("run_right") >= self.span - x))
        end = self.span - F.array_min("lefts")
        end = F.when(whole, F.greatest(end, "reach")).otherwise(end)
        return found.unionByName(sites.select("doc", (F.col("place") - F.array_max("lefts")).cast("int").alias("a"), (F.col("place") + end).cast("int").alias("b")))

    def members(self) -> DataFrame:
        """``g1, g2, n, doc``: the sets of documents that have a factor in common, one row a member."""
        found = self.small.mapInArrow(_grouper(self.span, self.phrase), _MEMBERS)
        entries, shared = self._entries()
        heads = shared.groupBy("f1", "f2").agg(F.min("key").alias("key"))
        sites = self.large.select("mark", "c", "d", "doc").distinct()
        large = entries.join(heads.select("key", F.col("f1").alias("g1"), F.col("f2").alias("g2")), "key").join(sites, ["mark", "c", "d"]).select("g1", "g2", "doc").distinct()
        sizes = large.groupBy("g1", "g2").agg(F.count("*").alias("n"))
        return found.unionByName(large.join(sizes, ["g1", "g2"]).select("g1", "g2", "n", "doc"))


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = MIN_SPAN, phrase: int = PHRASE, block: int = 50_000) -> DataFrame:
    """``doc_a, doc_b``: each two documents that have a common passage of at least ``span`` characters, once."""
    members = ReferenceBlocks(documents, key, text, span, phrase, block).members()
    return pairs_within(members, ["g1", "g2"], "doc", "n").select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def shared_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = MIN_SPAN, phrase: int = PHRASE, block: int = 50_000) -> DataFrame:
    """``group_id, docs, doc_id``: the sets of documents that have a passage in common, one row a member, without pairs.

    Two documents share a passage exactly if they are members of one group.
    """
    members = ReferenceBlocks(documents, key, text, span, phrase, block).members()
    return members.select(F.concat_ws("-", F.hex("g1"), F.hex("g2")).alias("group_id"), F.col("n").alias("docs"), F.col("doc").alias("doc_id")).distinct()


def shared_parts(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = MIN_SPAN, phrase: int = PHRASE, block: int = 50_000) -> DataFrame:
    """``doc_id, start, length``: the parts of each document that stand in others too, overlapping ones made one."""
    parts = ReferenceBlocks(documents, key, text, span, phrase, block).factors().distinct()
    seen = Window.partitionBy("doc").orderBy("a", "b")  # bounded by one document's length
    parts = parts.withColumn("far", F.max("b").over(seen.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("no", F.sum((F.col("far").isNull() | (F.col("a") > F.col("far"))).cast("int")).over(seen))
    return parts.groupBy("doc", "no").agg(F.min("a").alias("start"), F.max("b").alias("end")).select(F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("length"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"))


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_groups(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_parts(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its characters that are shared, 0 where none are."""
    documents = table(spark, sf_dir, "documents")
    parts = shared_parts(documents).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"), F.count("*").alias("spans"))
    return documents.select("doc_id", F.length("text").alias("n_chars")).dropDuplicates(["doc_id"]).join(parts, "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), F.round(F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)), 6).alias("shared_part")
    )

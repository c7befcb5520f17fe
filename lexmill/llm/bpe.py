"""Byte-level BPE over a whole corpus by merge replay.

A batch of texts is cut into words with array operations, equal words are kept once, and the merge list of a public
tokenizer is replayed over the distinct words in rank order. An inverted index leads from each mergeable token pair to
the places where it stands, so a merge touches only those places and their two neighbours. The texts then take over
their words' ids. Nothing is shuffled: every input partition is its own small corpus, cut into batches of a bounded
number of characters.

Defined results: a null text gives null ids (count null), an empty text gives an empty list (count 0).
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.runtime import spread, table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BATCH_BYTES = 6_000_000  # UTF-8 bytes of text encoded at once; bounds a worker's memory, not what is read

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_classes: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode general categories L*, N* and White_Space."""
    global _classes
    if _classes is None:
        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for cp in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(cp))[0]
            if major == "L":
                table[cp] = _LETTER
            elif major == "N":
                table[cp] = _NUMBER
        spaces = [0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(9, 14), *range(0x2000, 0x200B)]
        table[spaces] = _SPACE
        _classes = table
    return _classes


def _words(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask of the positions at which a word starts. ``cp``: code points of texts laid end to end; ``first``: text starts.

    The word rule is that of the tokenizer family: contractions, an optional blank before letters, numbers or other
    signs, and white space, of which the last sign before a word is left to that word.
    """
    n = len(cp)
    kind = _char_classes()[cp]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    new_run = np.empty(n, bool)
    new_run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new_run[1:])
    new_run |= begins[:n]
    start = new_run.copy()
    # white space: the last sign of a run that a word follows stands apart from the rest of the run
    run_at = np.flatnonzero(new_run)
    run_end = np.append(run_at[1:], n)
    followed = (kind[run_at] == _SPACE) & ~begins[run_end]
    last = run_end[followed] - 1
    start[last] = True
    blank = last[cp[last] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe of its own, right after no other sign and no blank
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        quote = quote[quote + 1 < n]
        after = quote[(kind[quote + 1] == _LETTER) & ~begins[quote + 1]]
        a, b = cp[after + 1], np.where(after + 2 < n, cp[np.minimum(after + 2, n - 1)], 0)
        b = np.where(begins[np.minimum(after + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[after[one | two] + 1] = False
        for hit, width in ((after[one], 2), (after[two & ~one], 3)):
            end = hit + width
            start[end[end < n]] = True
    return start


class MergeReplay:
    """The merge list of one byte-level tokenizer file, and the replay of it over a set of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        rest = [b for b in range(256) if b not in set(shown)]
        glyph = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_ids = np.array([vocab[glyph[b]] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left.astype(np.int64) << 32 | self.right
        self._order = np.argsort(key)
        self._keys = key[self._order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], -1)

    def encode(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of ``data`` laid end to end, and the number of ids of each word."""
        tok = self.byte_ids[np.frombuffer(data, np.uint8)].copy()
        n = len(tok)
        if n == 0:
            return tok, np.zeros(len(starts), np.int64)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        nxt[np.append(starts[1:], n) - 1] = -1
        prv[starts] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)  # rank of a pair -> places of its left token
        waiting: list[int] = []
        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            places, ranks = places[known], ranks[known]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.append(0, cut)].tolist(), np.split(places, cut)):
                if r not in index:
                    heapq.heappush(waiting, r)
                index[r].append(group)

        at = np.flatnonzero(nxt >= 0)
        add(at, self._ranks(tok[at], tok[nxt[at]]))
        while waiting:
            r = heapq.heappop(waiting)
            found = index.pop(r)
            pos = np.unique(np.concatenate(found))
            a, b = self.left[r], self.right[r]
            pos = pos[(tok[pos] == a) & (nxt[pos] >= 0)]
            pos = pos[tok[nxt[pos]] == b]
            if a == b and len(pos) > 1:  # aaa: of overlapping places every other one, from the left
                chained = np.append(False, nxt[pos[:-1]] == pos[1:])
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - head) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            tok[pos] = self.made[r]
            tok[gone] = -1
            after = nxt[gone]
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            before = before[before >= 0]
            here = pos[has]
            places = np.concatenate([before, here])
            add(places, self._ranks(tok[places], tok[nxt[places]]))
        alive = tok >= 0
        return tok[alive], np.add.reduceat(alive, starts, dtype=np.int64)


_loaded: dict[str, MergeReplay] = {}


def replay(name: str, folder: str) -> MergeReplay:
    """The tokenizer of a file ``<folder>/<name>.json``, read once a worker."""
    path = f"{folder}/{name}.json"
    if path not in _loaded:
        _loaded[path] = MergeReplay(path)
    return _loaded[path]


def encode_texts(texts: list[str], merges: MergeReplay, want_ids: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Ids of all texts laid end to end (None unless wanted) and the number of ids of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.zeros(len(texts), np.int64)
    kept = np.flatnonzero(lens)
    if not len(kept):
        return np.zeros(0, np.int32), counts
    whole = "".join(texts)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lens)
    first = (ends - lens)[kept]
    start = np.flatnonzero(_words(cp, first))
    size = np.diff(np.append(start, len(cp)))
    # a word's fingerprint: difference of prefix sums of mixed code points times powers, moved to power 0
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    mixed = (cp.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.full(len(cp), base))
    total = np.append(np.uint64(0), np.cumsum(mixed * power))
    back = np.cumprod(np.full(len(cp), inverse))
    mark = (total[start + size] - total[start]) * back[start]
    mark = (mark ^ mark >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) ^ size.astype(np.uint64)
    _, pick, which = np.unique(mark, return_index=True, return_inverse=True)
    # exactness: a word that only shares the fingerprint of another is encoded for itself
    owner = np.repeat(start[pick][which] - start, size)
    same = cp == cp[np.minimum(np.arange(len(cp)) + owner, len(cp) - 1)]
    odd = np.flatnonzero(~np.logical_and.reduceat(same, start) | (size != size[pick][which]))
    if len(odd):
        which = which.copy()
        which[odd] = len(pick) + np.arange(len(odd))
        pick = np.append(pick, odd)
    w_start, w_size = start[pick], size[pick]
    parts = [whole[s : s + k] for s, k in zip(w_start.tolist(), w_size.tolist())]
    coded = [p.encode("utf-8", "replace") for p in parts]
    b_len = np.fromiter(map(len, coded), np.int64, len(coded))
    ids, n_ids = merges.encode(b"".join(coded), np.cumsum(b_len) - b_len)
    per_word = n_ids[which]
    word_of_text = np.searchsorted(start, first)
    counts[kept] = np.add.reduceat(per_word, word_of_text)
    if not want_ids:
        return None, counts
    source = (np.cumsum(n_ids) - n_ids)[which]
    shift = np.repeat(source - (np.cumsum(per_word) - per_word), per_word)
    return ids[np.arange(len(shift)) + shift], counts


def _batches(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at most ``limit`` bytes of text; a single longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0

    def give() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in stream:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lens)
        at, gone = 0, 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, gone + limit - size, side="right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - gone
                gone = int(total[to - 1])
            if to < batch.num_rows:
                yield give()
                held, size = [], 0
            at = to
    if held:
        yield give()


def _encoder(name: str, folder: str, want_ids: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = replay(name, folder)
        for batch in _batches(stream, BATCH_BYTES):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            missing = np.array([t is None for t in texts], bool)
            ids, counts = encode_texts([t or "" for t in texts], merges, want_ids)
            names = [*batch.schema.names[:-1], "ids" if want_ids else "n_tokens"]
            others = batch.columns[:-1]
            if not want_ids:
                yield pa.RecordBatch.from_arrays([*others, pa.array(counts, mask=missing)], names)
                continue
            edge = np.append(0, np.cumsum(counts))
            for at in range(0, len(texts), 2_000):
                to = min(at + 2_000, len(texts))
                values = pa.array(ids[edge[at] : edge[to]], pa.int32())
                offsets = pa.array((edge[at : to + 1] - edge[at]).astype(np.int32), mask=np.append(missing[at:to], False))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in others), pa.ListArray.from_arrays(offsets, values)], names)

    return run


def encode(rows: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``ids`` of every row: the ids of its text, without special tokens.

    Null text: null ids. Empty text: an empty list. Repeated rows are encoded each time. Columns that are not named are
    not read, so their names cannot clash.
    """
    slim = rows.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(_encoder(tokenizer, folder, True), schema)


def token_counts(rows: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row, by the same replay; null for a null text, 0 for an empty one."""
    slim = rows.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(_encoder(tokenizer, folder, False), schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])

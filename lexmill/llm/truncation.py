"""Text cut off by field limits or in mid-transfer.

The lengths carry the search, the whole table is its ground:

* lengths: for each source, field and unit (characters, bytes) windows over the distinct lengths give the discrete hazard
  of ending at a length. Each is tested against the pooled hazard of the lengths around it: given all endings of the
  neighbourhood, the number at the length is binomial with its share of the values at risk; likewise against the numbers
  on each side, since hazards rise by themselves where few values are left. The largest of the exact upper tails counts,
  and those of all lengths are held against one false discovery rate (Benjamini-Hochberg). The unit is the distinct value, so stock answers
  count once; endings made by the retrieval step (a hit shortened to 100 characters and ``...``) are no events.
* endings: how often the last characters of a value are followed by the end of a sentence, a line or a value elsewhere in
  the field. At a significant length an ending counts as incomplete unless the field mostly ends there; the same if a
  sorted neighbour goes on from the value. Elsewhere it counts only if the field hardly ever ends there.
* form, for what neither can tell: marks of a cut, list entries that the prompt (built before storing) shows to be longer
  or more, answers in the prompt's format that stop before the last section.

Defined cases: null, empty and blank values are no cuts; a null source is a source of its own; of rows with one id the one
loaded last counts; a null prompt shows nothing; a bare placeholder and a response that only repeats what was asked are no
cuts; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.neardup import compact
from lexmill.llm.spans import _slices
from lexmill.runtime import durable, parallelism, table

TAIL = 5  # characters of an ending; a shorter value is weighed whole
NEIGHBOURS = 12  # lengths on either side that a length is held against
GUARD = 2  # lengths next to it that are left out: a limit in bytes shows up to two bytes early
RATE = 0.01  # false discovery rate
RARE, USUAL = 0.2, 0.8  # share of ends after an ending: below, it is none by itself; above, it is one even at a limit

# The sections of the answer format, first, second and last, in both languages.
SECTIONS = (("风险等级", "风险点", "复核提示"), ("Risk level", "Risk points", "Review note"))
FIELDS = ("retrieved_knowledge", "response")
# What stands for an empty answer.
PLACEHOLDERS = {
    "", "-", "--", "/", ".", "...", "…", "……", "无", "空", "略", "暂无", "(空)", "[空]", "(无)", "待补充", "未填写", "none", "null", "nil", "nan", "n/a", "na", "undefined", "empty", "tbd", "todo", "[]", "{}", "()", '""', "''", "“”", "\\n",
}
MARK = re.compile(r"(…|\.\.\.|�|[\[（(【<][^\[\]（）()【】<>]{0,12}(截断|过长|超长|未完|省略|truncated|cut off)[^\[\]（）()【】<>]{0,12}[\]）)】>])\Z")
SHORT_HIT = re.compile(r"\d+\. \[[^\]\n]*\] ?[^\n]{100}\.\.\.\Z")
HIT = re.compile(r"\d+\. \[[^\]\n]*\d\] ?[^\s\]]")
_LISTED = re.compile(r"【检索结果|\d+\. \[")
_NUMBERED = re.compile(r"\d+\. ")
_HEAD = re.compile(r"(\d+)\. \[[^\]]*\] ?")
_REF_HEAD = re.compile(r"\d+\. (\[[^\]]*\] ?)?")
_SIGNS = "。！？!?"
_ABBREVIATED = re.compile(r"(\d|\b(ref|no|cf|art|cl|No|Art|[A-Z]|[A-Z]\.[A-Z]|a\.s))\.\Z")
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "​﻿"  # U+3000 is the last white space
_ZERO = str.maketrans("123456789", "0" * 9)


def latest(rows: DataFrame) -> DataFrame:
    """One row an id: of repeated deliveries the one loaded last."""
    columns = ["loaded_at", "source", "clause", "retrieved_knowledge", "prompt", "response"]
    one = rows.where("result_id IS NOT NULL").groupBy(F.col("result_id").cast("long").alias("result_id")).agg(F.max(F.struct(*columns)).alias("r"))
    return one.select("result_id", *(f"r.{c}" for c in columns[1:]))


def repeats(response: str | None, asked: str, run: int = 6, share: float = 0.7) -> bool:
    """Does the response only repeat what was asked: most of its runs of characters stand there."""
    form = compact(response or "")
    if len(form) < run:
        return False
    asked = compact(asked)
    if form in asked:
        return True
    if any(s in form for pair in SECTIONS for s in ("".join(pair[2].split()),)) and "[" not in form:
        return False  # an answer with all its sections quotes the clause at most
    runs = [form[k : k + run] for k in range(len(form) - run + 1)]
    return sum(r in asked for r in runs) >= share * len(runs)


# --- one value -----------------------------------------------------------------------------------------------------------


def _bare(value: str) -> bool:
    """Is the value a placeholder for no answer."""
    return len(value) < 16 and compact(value).lower() in PLACEHOLDERS


def _listed(prompt: str | None) -> list[str]:
    """The hits that the prompt shows, on one line each."""
    part = re.split(r"【参考资料】|\[References\]", prompt or "", maxsplit=1)
    if len(part) < 2:
        return []
    lines = re.split(r"【回答格式】|\[Format\]", part[1], maxsplit=1)[0].split("\n")
    return [" ".join(_REF_HEAD.sub("", x, count=1).split()) for x in lines if _NUMBERED.match(x) and "无相关" not in x]


def _broken_list(value: str, last: str, prompt: str | None) -> bool:
    """Does a list of hits stop before what the prompt, built from the whole list, shows of it."""
    if not _LISTED.match(value):
        return False
    if not HIT.match(last):
        return True
    refs = _listed(prompt)
    hits = sum(bool(HIT.match(x)) for x in value.split("\n"))
    if 0 < hits < len(refs):
        return True
    no = int(_HEAD.match(last)[1]) - 1
    if not 0 <= no < len(refs):
        return False
    hit = " ".join(_HEAD.sub("", last, count=1).split())
    return refs[no].startswith(hit) and len(refs[no]) > len(hit) + 1


def _stops(value: str) -> bool:
    """Does an answer in the prompt's format stop before its last section."""
    for first, second, final in SECTIONS:
        begun, closed = first in value, final in value
        if closed and not value.rpartition(final)[2].lstrip(" :：\n\t").strip():
            return True
        if begun and second in value and not closed:
            return True
        if begun and re.match(rf"{first}\s*[:：]?\s*\S{{0,6}}\Z", value) or len(value) > 1 and first.startswith(value) and value[-1] not in "。.":
            return True
    return False


def _hashes(cp: np.ndarray, at: np.ndarray, field: int) -> np.ndarray:
    h = np.full(len(at), field + 1, np.uint64)
    for k in range(TAIL):
        h = (h ^ cp[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end, digits alike, each with ``TAIL - 1`` signs 0 before and a line end after it; and their lengths."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    lead = "\0" * (TAIL - 1)
    cp = np.frombuffer("".join(f"{lead}{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cp[(cp > 0x30) & (cp <= 0x39)] = 0x30
    return cp, lens


_FACTS = "result_id long, source string, field_name string, chars int, bytes int, key binary, event boolean, sealed boolean, form boolean, copied boolean, tail long"


def _facts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each value that is not blank shows by itself."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()]
    for batch in _slices(stream):
        rows, tails = [], []
        for rid, source, clause, prompt, *stored in zip(*(batch.column(c).to_pylist() for c in ("result_id", "source", "clause", "prompt", *FIELDS))):
            for n, (field, text) in enumerate(zip(FIELDS, stored)):
                value = (text or "").rstrip(_BLANKS)
                if not value:
                    continue
                last = value.rpartition("\n")[2]
                short = bool(SHORT_HIT.match(last))
                mark = None if short else MARK.search(value[-40:])
                sign = value[-1]
                sealed = not mark and (short or sign in _SIGNS or sign == "." and not _ABBREVIATED.search(value[-8:]))
                form = bool(mark) or (_stops(value) if n else _broken_list(value, last, prompt))
                size = text if not mark else value[: len(value) - len(mark[0])]
                copied = (form or not sealed) and (_bare(value) or bool(n) and repeats(value, f"{prompt or ''}\n{clause or ''}"))
                rows.append((rid, source, field, len(size), len(size.encode("utf-8", "surrogatepass")), xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass")), not short, sealed, form, copied))
                tails.append(value[-TAIL:])
        if not rows:
            continue
        cp, lens = _codes(tails)
        ends = np.cumsum(lens + TAIL) - 1 - TAIL
        field = np.array([FIELDS.index(r[2]) for r in rows])
        tail = np.where(field == 0, _hashes(cp, ends, 0), _hashes(cp, ends, 1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), pa.array(tail)], names)


# --- lengths -------------------------------------------------------------------------------------------------------------


def upper_tail(n: np.ndarray, total: np.ndarray, share: np.ndarray, terms: int = 64) -> np.ndarray:
    """``P(X >= n)`` of binomials: the first terms summed, the rest bounded by a geometric series."""
    log_gamma = np.frompyfunc(math.lgamma, 1, 1)
    n, total, share = n.astype(float), total.astype(float), np.clip(share, 1e-300, 1 - 1e-12)
    rest = total - n
    first = (log_gamma(total + 1) - log_gamma(n + 1) - log_gamma(rest + 1)).astype(float) + n * np.log(share) + rest * np.log1p(-share)
    odds = share / (1 - share)
    series, term = np.ones(len(n)), np.ones(len(n))
    for k in range(terms):
        term = term * np.maximum(rest - k, 0) / (n + k + 1) * odds
        series += term
    ratio = np.minimum(np.maximum(rest - terms, 0) / (n + terms + 1) * odds, 0.999)
    tail = np.exp(np.maximum(first, -700)) * (series + term * ratio / (1 - ratio))
    return np.where(n <= total * share, 1.0, np.minimum(tail, 1.0))


_TESTS = "source string, field_name string, unit string, length int, n long, at_risk long, left_n long, right_n long, left_risk long, right_risk long"


def _p_values(sides: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n, at_risk, left_n, right_n, left_risk, right_risk = (batch.column(c).to_numpy() for c in ("n", "at_risk", "left_n", "right_n", "left_risk", "right_risk"))
            near = left_risk + right_risk
            p = np.where(near > 0, upper_tail(n, n + left_n + right_n, at_risk / (at_risk + np.maximum(near, 1))), 1.0)
            # where few are left the hazard rises by itself, and where lengths set in it rises from 0: a limit also stands
            # out from the numbers on either side, of those that come so far
            for count, risk in ((left_n, left_risk), (right_n, right_risk)):
                p = np.maximum(p, np.where(risk > 0, upper_tail(n, n + count, np.full(len(n), sides)), 0.0))
            yield batch.append_column("p", pa.array(p, pa.float64()))

    return run


def length_hazards(facts: DataFrame, rate: float = RATE, around: int = NEIGHBOURS) -> DataFrame:
    """Every length of every source, field and unit with its hazard, its neighbours' hazard, p-value and whether it is a limit.

    The windows run over lengths, not over rows, so a hot source costs no more than a rare one. Lengths without endings
    get a row only within ``around`` of one that has some, since further ones bear on no test.
    """
    key = ["source", "field_name", "unit"]
    values = facts.groupBy("source", "field_name", "key").agg(F.min("chars").alias("chars"), F.min("bytes").alias("bytes"), F.max("event").alias("event"))
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    counts = values.select("source", "field_name", "event", F.explode(units).alias("u")).groupBy("source", "field_name", "u.unit", "u.length").agg(F.count("*").alias("left"), F.count_if("event").alias("n"))
    w = Window.partitionBy(*key).orderBy("length")
    counts = counts.withColumn("at_risk", F.sum("left").over(Window.partitionBy(*key).orderBy(F.desc("length"))))
    counts = counts.withColumn("before", F.lag("length").over(w))
    # the rows of the lengths around: up to ``around`` after the one before, from ``around`` before this one
    gap = F.col("length") - F.coalesce("before", F.col("length") - around - 1)
    offsets = F.when(gap <= 2 * around, F.sequence(F.lit(0), gap - 1)).otherwise(F.concat(F.sequence(F.lit(0), F.lit(around)), F.sequence(gap - around, gap - 1)))
    every = counts.select(*key, F.explode(offsets).alias("o"), "length", "n", "at_risk")
    every = every.select(*key, (F.col("length") - F.col("o")).alias("length"), F.when(F.col("o") == 0, F.col("n")).otherwise(0).alias("n"), "at_risk", (F.col("o") == 0).alias("seen"))
    for side, over in (("left", w.rangeBetween(-around, -GUARD - 1)), ("right", w.rangeBetween(GUARD + 1, around))):
        every = every.withColumn(f"{side}_n", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn(f"{side}_risk", F.coalesce(F.sum("at_risk").over(over), F.lit(0)))
    tests = every.where("seen AND n > 0").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _TESTS.split(", ")))
    tests = durable(tests.mapInArrow(_p_values(1 / (1 + around - GUARD)), f"{_TESTS}, p double"), "tests")
    tests = tests.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("base", (F.col("left_n") + F.col("right_n")) / F.greatest(F.col("left_risk") + F.col("right_risk"), F.lit(1)))
    # ranks over all tests: cells of p-values are summed up, and only within a cell rows are put in order
    tests = tests.withColumn("cell", F.floor(F.greatest(F.log("p"), F.lit(-700.0)) * -8).cast("int"))
    alone = Window.partitionBy(F.lit(1))  # one row a cell, at most 5,601
    cells = tests.groupBy("cell").agg(F.count("*").alias("c")).withColumn("tests", F.sum("c").over(alone))
    cells = cells.withColumn("less", F.sum("c").over(alone.orderBy(F.desc("cell"))) - F.col("c"))
    ranked = tests.where(F.col("p") <= rate).join(cells.select("cell", "less", "tests"), "cell")
    ranked = ranked.withColumn("rank", F.col("less") + F.row_number().over(Window.partitionBy("cell").orderBy("p", *key, "length")))
    last = ranked.where(F.col("p") <= F.col("rank") * rate / F.col("tests")).agg(F.max("p").alias("last"))
    return tests.crossJoin(F.broadcast(last)).select(*key, "length", "n", "at_risk", "hazard", "base", "p", F.coalesce(F.col("p") <= F.col("last"), F.lit(False)).alias("is_limit"))


# --- endings -------------------------------------------------------------------------------------------------------------


def distinct_values(rows: DataFrame) -> DataFrame:
    """``field_name, value``: every value once; copies are put together before the exchange."""
    entries = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in FIELDS))
    return rows.select(F.explode(entries).alias("e")).select("e.field_name", F.rtrim("e.value", F.lit(_BLANKS)).alias("value")).where("value <> ''").distinct()


def _count_runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(stream, 6_000_000):
        fields = batch.column(0).to_pylist()
        every = [v.rstrip(_BLANKS) for v in batch.column(1).to_pylist()]
        for n, field in enumerate(FIELDS):
            texts = [v for f, v in zip(fields, every) if f == field and v]
            if not texts:
                continue
            cp, lens = _codes(texts)
            at = np.arange(lens.sum()) + np.repeat(np.arange(len(texts)) * TAIL, lens)
            _, pick, which = np.unique(h := _hashes(cp, at, n), return_index=True, return_inverse=True)
            ended = np.bincount(which, np.isin(cp[at + TAIL], [ord(c) for c in "。.！？!?\n"]))
            yield pa.RecordBatch.from_arrays([pa.array(h[pick].view(np.int64)), pa.array(np.bincount(which)), pa.array(ended.astype(np.int64))], ["tail", "seen", "ended"])


def endings(texts: DataFrame) -> DataFrame:
    """``tail, seen, ended``: the runs of ``TAIL`` characters of all values, and how often an end follows.

    Each batch counts its own runs first, so what is exchanged are distinct runs with their numbers.
    """
    return texts.mapInArrow(_count_runs, "tail long, seen long, ended long").groupBy("tail").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def _next_ones(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted values of one range: keys of those the next one goes on from, and the range's first and last value."""
    part = TaskContext.get().partitionId()
    mark = lambda f, v: xxhash.xxh3_128_digest(v.rstrip(_BLANKS).encode("utf-8", "surrogatepass"))
    held: tuple[str, str] | None = None
    first = None
    names, kinds = ["part", "side", "field_name", "value", "key"], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()]
    for batch in stream:
        rows = []
        for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first is None:
                first = now
            elif held and held[0] == now[0] and now[1].startswith(held[1]):
                rows.append((part, 0, held[0], None, mark(*held)))
            held = now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    if held:
        rows = [(part, 1, *first, mark(*first)), (part, 2, *held, mark(*held))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def shortened(texts: DataFrame) -> DataFrame:
    """``field_name, key`` of the values that another one goes on from.

    All distinct values of both fields are sorted, over ranges of equal size; in that order a value that others begin with
    stands right before one of them. The ranges meet by their first and last values alone, two rows a range.
    """
    ranges = parallelism(texts.sparkSession)
    met = durable(texts.repartitionByRange(ranges, "field_name", "value").sortWithinPartitions("field_name", "value").mapInArrow(_next_ones, "part int, side int, field_name string, value string, key binary"), "sorted")
    edges = met.where("side > 0")
    order = Window.partitionBy(F.lit(1)).orderBy("part", "side")  # two rows a range
    following = edges.withColumn("next", F.lead("value").over(order)).withColumn("next_field", F.lead("field_name").over(order))
    over = following.where("side = 2 AND next_field = field_name AND startswith(next, value)")
    return met.where("side = 0").select("field_name", "key").unionByName(over.select("field_name", "key")).distinct()


# --- verdict -------------------------------------------------------------------------------------------------------------


def weighed_values(rows: DataFrame) -> DataFrame:
    """Every value that is not blank with what speaks for a cut: ``at_limit``, ``goes_on``, ``ends_here`` (the share of other
    places where an end follows its last characters; null where its sign closes it), ``stock_here`` (the same with the
    copies of the whole value: a stock answer is no cut, wherever it ends), ``form``, ``copied``."""
    rows = durable(latest(rows), "reviews")
    columns = rows.select("result_id", F.col("source").cast("string").alias("source"), *(F.col(c).cast("string").alias(c) for c in ("clause", "prompt", *FIELDS)))
    facts = durable(columns.mapInArrow(_facts, _FACTS), "facts")
    limits = length_hazards(facts).where("is_limit").select("source", "field_name", "unit", "length")
    texts = durable(distinct_values(rows), "texts")
    open_ = facts.where("NOT sealed")
    counted = endings(texts).join(open_.select("tail").distinct(), "tail", "left_semi")
    weighed = open_.join(counted, "tail", "left").join(shortened(texts).withColumn("goes_on", F.lit(True)), ["field_name", "key"], "left")
    copies = open_.groupBy("field_name", "key").agg((F.count("*") - 1).alias("copies"))
    weighed = weighed.join(copies, ["field_name", "key"])
    # without the value itself, which ends there
    share = lambda seen, ended: F.when(seen > 0, ended / seen).otherwise(0.0)
    seen, ended = F.coalesce("seen", F.lit(1)) - 1, F.coalesce("ended", F.lit(1)) - 1
    weighed = weighed.withColumn("ends_here", share(seen, ended)).withColumn("stock_here", share(seen + F.col("copies"), ended + F.col("copies")))
    for unit in ("chars", "bytes"):
        one = limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("field_name").alias("f"), F.col("length").alias("l"), F.lit(True).alias(f"at_{unit}"))
        weighed = weighed.join(one, F.col("source").eqNullSafe(one.s) & (F.col("field_name") == one.f) & (F.col(unit) == one.l), "left").drop("s", "f", "l")
    weighed = weighed.withColumn("at_limit", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False)))
    names = ["result_id", "source", "field_name", "at_limit", "goes_on", "ends_here", "stock_here", "form", "copied"]
    weighed = weighed.withColumn("goes_on", F.coalesce("goes_on", F.lit(False))).select(*names)
    closed = facts.where("sealed").select("result_id", "source", "field_name", F.lit(False).alias("at_limit"), F.lit(False).alias("goes_on"), *(F.lit(None).cast("double").alias(c) for c in ("ends_here", "stock_here")), "form", "copied")
    return weighed.unionByName(closed)


def cut_values(rows: DataFrame, form: bool = True) -> DataFrame:
    """``result_id, source, field_name, is_cut, by`` of all values that are not blank; ``by`` is the first evidence that
    tells: ``limit``, ``neighbour``, ``ending``, ``form``. ``form=False`` leaves the last one out."""
    by = F.when(F.col("at_limit") & (F.col("ends_here") < USUAL), "limit").when(F.col("goes_on") & (F.col("stock_here") < USUAL), "neighbour").when(F.col("stock_here") < RARE, "ending")
    by = by.when(F.col("form"), "form") if form else by
    found = weighed_values(rows).withColumn("by", F.when(~F.col("copied"), by))
    return found.select("result_id", "source", "field_name", F.col("by").isNotNull().alias("is_cut"), "by")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "result")).where("is_cut").select("result_id", "field_name")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut values of each source and field, and the evidence that told."""
    found = cut_values(table(spark, sf_dir, "result"))
    counts = [F.count_if(F.col("by") == b).alias(f"by_{b}") for b in ("limit", "neighbour", "ending", "form")]
    return found.groupBy("source", "field_name").agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("cut_share"), *counts)


def p3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each source, field and unit."""
    rows = latest(table(spark, sf_dir, "result")).select("result_id", F.col("source").cast("string").alias("source"), *(F.col(c).cast("string").alias(c) for c in ("clause", "prompt", *FIELDS)))
    found = length_hazards(durable(rows.mapInArrow(_facts, _FACTS), "facts"))
    return found.where("is_limit").select("source", "field_name", "unit", "length", "n", F.round("hazard", 6).alias("hazard"), F.round("base", 6).alias("neighbour_hazard"))

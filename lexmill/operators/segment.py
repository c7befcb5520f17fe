"""Segmentation of statutes and contracts into typed clauses with metadata. No shuffle; built-in expressions but for one step.

A pattern takes the rest of its line, so it starts at most once in a line. Statutes are split at marks put before the
starts. In contracts a start near an accepted one is dropped, by priority, so their starts are folded in order with their
offsets, and the text between accepted starts is exploded with its place.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from lexmill.functions import text as T
from lexmill.runtime import once, spread

_N, _L, _D = f"[{T.NUMERALS}]+", f"[{T.NUMERALS_LONG}]+", T.DIGIT

# Clause starts of statutes in order, with the label a chunk gets that begins so.
LAW_STARTS = [
    ("中文条款", f"第{_L}条"), ("数字条款", f"第{_D}+条"), ("章节标题", f"第{_N}章"), ("小节标题", f"第{_N}节"), ("编号条款", rf"{_D}+\.{_D}+(\.{_D}+)*"),
    ("中文序号", f"{_N}[、.]"), ("括号中文", f"[（(]{_N}[）)]"), ("括号数字", f"[（(]{_D}+[）)]"), ("带圈数字", "[①-⑩]"), ("字母编号", "[a-zA-Z][)、.]"),
]
PLAIN = "普通文本"

# Clause starts of contracts by priority (1 first); True: only at the start of a line.
CONTRACT_STARTS = [
    ("中文条款", f"第{_L}条", False), ("数字条款", f"第{_D}+条", False), ("章节标题", f"第{_N}章", False), ("小节标题", f"第{_N}节", False),
    ("甲方信息", "甲方[：:]", True), ("乙方信息", "乙方[：:]", True), ("借款人信息", "借款人[：:]", True), ("贷款人信息", "贷款人[：:]", True), ("出借人信息", "出借人[：:]", True), ("保证人信息", "保证人[：:]", True),
    ("金额条款", "贷款金额[：:]", True), ("利率条款", "贷款利率[：:]", True), ("还款条款", "还款方式[：:]", True), ("违约条款", "违约责任[：:]", True), ("争议条款", "争议解决[：:]", True), ("担保条款", "担保条款[：:]", True), ("保密条款", "保密条款[：:]", True),
    ("数字编号", rf"{_D}+[\.、]", True), ("小数编号", rf"{_D}+\.{_D}+", True), ("括号编号", f"[（(][{T.NUMERALS}{_D}]+[）)]", True), ("带圈编号", "[①-⑩]", True), ("中文序号", f"{_N}[、.]", True),
    ("大写金额", "人民币[零壹贰叁肆伍陆柒捌玖拾佰仟万亿元整]+", False), ("货币金额", rf"¥[{T.SPACE}]*{_D}+[,{_D}]*\.?{_D}*", False), ("日期条款", f"{_D}{{4}}年{_D}{{1,2}}月{_D}{{1,2}}日", True), ("期限条款", "[合同协议]期[限间][：:]", True),
]
# Words that tell the type of a clause, in order.
CONTRACT_WORDS = [
    ("当事人", "当事人信息"), ("贷款", "贷款条款"), ("借款", "借款条款"), ("还款", "还款条款"), ("利息", "利息条款"), ("利率", "利率条款"),
    ("担保", "担保条款"), ("抵押", "抵押条款"), ("质押", "质押条款"), ("保证", "保证条款"), ("违约", "违约条款"), ("赔偿", "赔偿条款"),
    ("争议", "争议条款"), ("仲裁", "仲裁条款"), ("诉讼", "诉讼条款"), ("保密", "保密条款"), ("生效", "生效条款"), ("终止", "终止条款"),
    ("解除", "解除条款"), ("通知", "通知条款"), ("送达", "送达条款"), ("附件", "附件条款"), ("签字", "签字条款"), ("盖章", "盖章条款"),
]
PARTIES = ["甲方", "乙方", "借款人", "贷款人", "出借人", "保证人", "抵押人"]
PREAMBLE, PREAMBLE_PRIORITY, PARAGRAPH_PRIORITY = "合同前言", 0, 999
LAW_MIN, CONTRACT_MIN = 20, 30
NEAR = 5  # a start this close to an earlier one is none


def _lines(text: Column, wanted: str) -> Column:
    """The lines of a text in which ``wanted`` occurs, with the offset of each: ``array<struct<at, line>>``."""
    none = F.array().cast("array<struct<at:int,line:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(x.rlike(wanted), F.concat(acc.out, F.array(F.struct(acc.at.alias("at"), x.alias("line"))))).otherwise(acc.out)
        return F.struct((acc.at + F.length(x) + 1).alias("at"), more.alias("out"))

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: acc.out)


def _in_line(line: Column, pattern: str, anchored: bool) -> Column:
    """Offset of the pattern's first occurrence in a line, null without one."""
    if anchored:
        return F.when(line.rlike(rf"\A(?:{pattern})"), F.lit(0))
    return F.when(line.rlike(pattern), F.length(F.regexp_extract(line, rf"\A([^\n]*?)(?:{pattern})", 1)))


def law_slices(text: Column) -> Column:
    """The stripped text between neighbouring clause starts of a statute; what precedes the first start is a slice too.

    A mark is put before the first occurrence of each pattern in each line and the text is split at the marks, so the
    work is one pass over the text for each pattern, however many clauses there are.
    """
    marked = text
    for _, pattern in LAW_STARTS:
        marked = F.regexp_replace(marked, rf"(?:{pattern})[^\n]*", f"{T.MARK}$0")
    return F.transform(F.split(marked, T.MARK, -1), T.strip)


def law_type(c: Column | str) -> Column:
    c = T.col(c)
    found = None
    for label, pattern in LAW_STARTS:
        hit = c.rlike(rf"\A(?:{pattern})")
        found = F.when(hit, label) if found is None else found.when(hit, label)
    return found.otherwise(PLAIN)


def split_law(docs: DataFrame, min_length: int = LAW_MIN) -> DataFrame:
    """Chunks of statutes: ``file_path, source, chunk_index, total_chunks_in_doc, text, ...`` of every extracted document."""
    docs = spread(docs.where("extraction_success AND full_text IS NOT NULL").select("file_path", F.col("file_name").alias("source"), F.col("full_text").alias("t")))
    docs = once(docs, chunks=F.filter(law_slices(F.col("t")), lambda c: (F.length(c) >= min_length) & (F.length(c) > 0)))
    rows = docs.select("file_path", "source", F.size("chunks").alias("total_chunks_in_doc"), F.posexplode("chunks").alias("chunk_index", "text"))
    rows = rows.withColumn("chunk_size", F.length("text")).withColumn("clause_type", law_type("text"))
    header = F.when(F.col("clause_type") == PLAIN, PLAIN).otherwise(T.clip(T.strip(T.first_line(F.substring("text", 1, 50))), 30))
    return rows.withColumn("clause_header", header).withColumn("chunk_preview", T.preview("text", 100))


# --- contracts ---------------------------------------------------------------------------------------------------------


def _candidates(text: Column) -> Column:
    """All starts of a contract as ``array<struct<p, s>>``, by priority and offset."""

    def of(x: Column) -> Column:
        found = []
        for priority, (_, pattern, anchored) in enumerate(CONTRACT_STARTS, 1):
            if priority != 24:
                o = _in_line(x.line, pattern, anchored)
                found.append(F.when(o.isNotNull(), F.struct(F.lit(priority).alias("p"), (x.at + o).cast("int").alias("s"))))
        return F.filter(F.array(*found), lambda o: o.isNotNull())

    any_start = "|".join(f"(?:{'^' if a else ''}(?:{p}))" for k, (_, p, a) in enumerate(CONTRACT_STARTS, 1) if k != 24)
    by_line = F.flatten(F.transform(_lines(text, any_start), of))
    # amounts with a currency sign may go on in the next line, so they are found in the whole text
    money = CONTRACT_STARTS[23][1]
    cut = F.split(F.regexp_replace(text, rf"(?:{money})[^\n]*", f"{T.MARK}$0"), T.MARK, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<p:int,s:int>>").alias("out"))
    step = lambda acc, x: F.struct((acc.at + F.length(x)).alias("at"), F.concat(acc.out, F.array(F.struct(F.lit(24).alias("p"), (acc.at + F.length(x)).cast("int").alias("s")))).alias("out"))
    amounts = F.when(F.contains(text, F.lit("¥")), F.aggregate(F.slice(cut, 1, F.size(cut) - 1), empty, step, lambda acc: acc.out))
    return F.array_sort(F.concat(by_line, F.coalesce(amounts, F.array().cast("array<struct<p:int,s:int>>"))))


_STARTS = types.ArrayType(types.StructType([types.StructField("s", types.IntegerType()), types.StructField("p", types.IntegerType())]))


@F.pandas_udf(_STARTS)
def _accepted(found: pd.Series) -> pd.Series:
    """Of ``(p, s)`` in order, those not within ``NEAR`` of one taken before; each is looked up among its two neighbours only."""

    def take(rows) -> list[tuple[int, int]]:  # noqa: ANN001
        at: list[int] = []
        kept = []
        for r in rows:
            k = bisect_left(at, r["s"])
            if (k < len(at) and at[k] - r["s"] < NEAR) or (k and r["s"] - at[k - 1] < NEAR):
                continue
            at.insert(k, r["s"])
            kept.append({"s": r["s"], "p": r["p"]})
        return sorted(kept, key=lambda r: r["s"])

    return found.map(take)


def contract_positions(text: Column) -> Column:
    """Accepted starts in order of offset, ``array<struct<s, p>>``: a candidate within ``NEAR`` of an accepted one is dropped.

    Whether a start is accepted hangs on all those before it, so this step alone runs in Arrow batches.
    """
    return _accepted(_candidates(text))


def contract_type(c: Column | str, line: Column | None = None) -> Column:
    """Type of a clause from its first line: the first start that fits, a key word near the start, else its length.

    ``line`` is the stripped first line where the caller has it as a column already.
    """
    c = T.col(c)
    line = T.strip(T.first_line(c)) if line is None else line
    found = None
    for label, pattern, _ in CONTRACT_STARTS:
        hit = line.rlike(rf"\A(?:{pattern})")
        found = F.when(hit, label) if found is None else found.when(hit, label)
    for word, label in CONTRACT_WORDS:
        found = found.when(F.contains(F.substring(line, 1, 50), F.lit(word)), label)
    return found.when(F.length(c) < 100, "短条款").when(F.length(c) < 300, "中等条款").otherwise("长条款")


def contract_party(c: Column | str) -> Column:
    start = F.substring(T.col(c), 1, 200)
    found = None
    for party in PARTIES:
        hit = start.rlike(f"{party}[：:]")
        found = F.when(hit, party) if found is None else found.when(hit, party)
    return found.otherwise("其他")


def split_paragraphs(text: Column) -> Column:
    """Stripped paragraphs between blank lines."""
    return F.transform(F.split(text, rf"\n[{T.SPACE}]*\n+", -1), T.strip)


def split_contract(docs: DataFrame, min_length: int = CONTRACT_MIN) -> DataFrame:
    """Clauses of contracts with type, header, party and priority; documents without a clause start by paragraphs."""
    docs = docs.where("extraction_success AND full_text IS NOT NULL").select("file_path", F.col("file_name").alias("source"), F.col("file_stem").alias("source_stem"), "contract_title", F.col("full_text").alias("t"))
    docs = spread(docs)
    docs = once(docs, found=contract_positions(F.col("t")))
    cut = lambda s, e: T.strip(F.substring(F.col("t"), s + 1, e - s))
    item = lambda text, p, head: F.struct(text.alias("text"), p.cast("int").alias("priority"), head.alias("head"))
    clauses = F.transform("found", lambda x, i: item(cut(x.s, F.coalesce(F.get(F.col("found"), i + 1).s, F.length("t"))), x.p, x.s))
    lead = F.when(F.get("found", F.lit(0)).s > 0, F.array(item(cut(F.lit(0), F.get("found", F.lit(0)).s), F.lit(PREAMBLE_PRIORITY), F.lit(None).cast("int")))).otherwise(F.array().cast("array<struct<text:string,priority:int,head:int>>"))
    paragraphs = F.transform(split_paragraphs(F.col("t")), lambda p: item(p, F.lit(PARAGRAPH_PRIORITY), F.lit(None).cast("int")))
    every = F.when(F.size("found") > 0, F.concat(lead, clauses)).otherwise(paragraphs)
    docs = once(docs, chunks=F.filter(every, lambda c: (F.length(c.text) >= min_length) & (F.length(c.text) > 0)))
    rows = docs.select("file_path", "source", "source_stem", "contract_title", "t", F.size("chunks").alias("total_chunks_in_doc"), F.posexplode("chunks").alias("chunk_index", "c"))
    rows = rows.select("*", F.col("c.text").alias("text"), F.col("c.priority").alias("clause_priority"), F.col("c.head").alias("head")).drop("c")
    rows = once(rows, line=T.strip(T.first_line("text")))
    by_priority = F.element_at(F.array(*(F.lit(label) for label, _, _ in CONTRACT_STARTS)), F.greatest(F.least("clause_priority", F.lit(len(CONTRACT_STARTS))), F.lit(1)))
    clause = F.col("clause_priority").between(1, len(CONTRACT_STARTS))
    rows = rows.withColumn("clause_type", F.when(clause, by_priority).otherwise(contract_type("text", F.col("line"))))
    money = F.regexp_extract(F.substring(F.col("t"), F.col("head") + 1, F.length("t")), rf"\A(?:{CONTRACT_STARTS[23][1]})[^\n]*", 0)
    start = T.first_line(F.substring(F.col("t"), F.col("head") + 1, F.length("t")))
    header = F.when(F.col("clause_priority") == PREAMBLE_PRIORITY, PREAMBLE).when(F.col("clause_priority") == 24, T.strip(money)).when(clause, T.strip(start)).otherwise(T.clip("line", 50))
    rows = rows.withColumn("clause_header", header).withColumn("contract_party", contract_party("text"))
    rows = rows.withColumn("chunk_size", F.length("text")).withColumn("chunk_preview", T.preview("text", 120))
    return rows.drop("t", "head", "line")

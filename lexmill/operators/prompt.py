"""Rendering of retrieval results and prompts, and the rules around a review call. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

# Sentences and templates of the review dialogue.
NOTHING_FOUND = "知识库中没有找到相关内容。"
HEADING = "【检索到的相关知识】"
NO_REFERENCES = "【参考资料】\n无相关参考资料。"
REVIEW = (
    "【角色设定】\n你是一名资深银行法律合规官。\n\n【审查任务】\n请根据以下参考材料，审查合同条款。\n\n【待审条款】\n",
    "\n\n",
    "\n\n【审查要求】\n1. 识别主要风险\n2. 指出与标准的差异\n3. 给出具体修改建议\n\n【输出格式】\n请按以下格式回答：\n风险等级：[高/中/低]\n风险点：\n1. [风险描述]\n差异分析：\n- [差异点]\n修改建议：\n[具体修改文本]\n复核提示：\n[复核事项]",
)
LONG_REVIEW = (
    "【角色设定】\n你是一名资深银行法律合规官，具有10年银行合同审查经验。\n\n【审查任务】\n请根据以下参考材料，严格审查待审合同条款。\n\n【待审条款】\n",
    "\n\n【参考资料】\n",
    "\n\n【审查要求】\n1. **风险识别**：识别法律合规风险、信用风险、操作风险\n2. **差异对比**：与银行标准范本逐条对比差异\n3. **修改建议**：给出具体、可执行的修改文本\n4. **依据引用**：每个判断必须引用参考材料中的具体条款\n\n【输出格式】\n### 风险等级：[高/中/低]\n### 风险点列表：\n1. [风险描述，类型，影响]\n### 差异分析：\n- [差异点1：原文 vs 标准条款]\n### 修改建议：\n[具体修改后的条款文本]\n### 复核提示：\n[需要人工重点复核的事项]",
)
SIMPLE = ("请审查以下银行合同条款：\n\n", "\n\n请指出其中的风险并提供修改建议。")
FALLBACK = "请审查合同条款: "


def clean_context(c: Column | str) -> Column:
    """Retrieved text without similarity tags and bracketed parts, on one line."""
    c = F.regexp_replace(F.coalesce(T.col(c), F.lit("")), r"\[相似度: [0-9.]+\]", "")
    c = F.regexp_replace(c, r"\[[^\]]*\]", "")
    return T.strip(F.regexp_replace(c, rf"[{T.SPACE}]+", " "))


def references(context: Column | str) -> Column:
    """The reference lines of a context, at most 80 characters each: what follows the first number mark, else all."""
    lines = F.filter(F.split(F.coalesce(T.col(context), F.lit("")), "\n", -1), lambda x: (x != "") & ~F.startswith(x, F.lit("【")))
    kept = F.filter(F.transform(lines, clean_context), lambda x: x != "")
    return F.transform(kept, lambda x: F.substring(F.regexp_replace(x, r"(?s)\A.*?\. ", ""), 1, 80))


def review_prompt(clause: Column | str, context: Column | str, most: int = 3) -> Column:
    """The review prompt with the first references, numbered anew."""
    found = F.slice(references(context), 1, most)
    numbered = F.transform(found, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    block = F.when(F.size(found) > 0, F.concat(F.lit("【参考资料】\n"), F.array_join(numbered, "\n"))).otherwise(NO_REFERENCES)
    return F.concat(F.lit(REVIEW[0]), T.col(clause), F.lit(REVIEW[1]), block, F.lit(REVIEW[2]))


def long_prompt(clause: Column | str, context: Column | str) -> Column:
    return F.concat(F.lit(LONG_REVIEW[0]), T.col(clause), F.lit(LONG_REVIEW[1]), T.col(context), F.lit(LONG_REVIEW[2]))


def simple_prompt(clause: Column | str) -> Column:
    return F.concat(F.lit(SIMPLE[0]), T.col(clause), F.lit(SIMPLE[1]))


def fallback_prompt(clause: Column | str) -> Column:
    return F.concat(F.lit(FALLBACK), T.col(clause))


def format_hits(hits: DataFrame, keys: list[str], rank: str = "rank", document: str = "document", similarity: str = "similarity", cleaned: bool = True) -> DataFrame:
    """The hits of each query as one context. Cleaned: 100 characters, empty ones left out with their number; else 150."""
    text = clean_context(document) if cleaned else F.coalesce(F.col(document), F.lit(""))
    line = F.concat(F.col(rank).cast("string"), F.lit(". [相似度: "), F.format_string("%.3f", F.coalesce(F.col(similarity), F.lit(0.0))), F.lit("] "), T.clip(text, 100 if cleaned else 150))
    rows = hits.withColumn("__line", F.when((text != "") | F.lit(not cleaned), line))
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col("__line").alias("l")))), lambda x: x.l), lambda x: x.isNotNull())
    return rows.groupBy(*keys).agg(F.array_join(F.concat(F.array(F.lit(HEADING)), lines), "\n").alias("context"))


def timeout_seconds(prompt: Column | str) -> Column:
    size = F.length(T.col(prompt))
    return F.when(size < 100, 30).when(size < 300, 60).when(size < 500, 120).otherwise(180)


def latency_class(seconds: Column | str) -> Column:
    s = T.col(seconds)
    return F.when(s > 60, "slow").when(s > 30, "long").when(s.isNotNull(), "good")


def hit_line(hits: DataFrame, fields: list[str]) -> DataFrame:
    """Console form of hits: four decimals, the named metadata, 200 characters of text."""
    shown = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return hits.withColumn("line", F.concat_ws(" | ", F.format_string("%d. %.4f", F.col("rank"), F.col("similarity")), *shown, T.clip("document", 200)))

"""Cleaning of paragraph tables: page furniture, formatting, standard forms and hierarchy.

Input: one row a paragraph with ``file_path``, ``pos`` and the columns of the paragraph record. Order is carried by ``pos``;
every rule on neighbours or on a place in the document is a window over one document. Nothing else shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.runtime import once

# Page furniture and marks of each kind of document.
FURNITURE = {
    "contract": ["机密", "保密", "内部文件", "草稿", "DRAFT", "第.*页.*共.*页", "Page.*of.*", "合同编号.*", "Contract No.*", "日期.*", "Date.*"],
    "law": ["机密", "保密", "内部文件", "草稿", "DRAFT", "第.*页.*共.*页", "Page.*of.*", "文件编号.*", "Document No.*", "印发日期.*", "发布日期.*", "国务院办公厅", "中共中央办公厅", "公报", "公告", "通知"],
}
INDICATORS = {
    "contract": ["confidential", "internal", "draft", "page", "页码", "第.*页", "合同编号", "contract no", "日期", "date"],
    "law": ["confidential", "internal", "draft", "page", "页码", "第.*页", "文件编号", "document no", "印发日期", "发布日期"],
}
BOXES = {"contract": "┌┐└┘├┤┬┴┼│", "law": "┌┐└┘├┤┬┴┼│┃"}
BULLETS = {"contract": "●◆■▲★◎※◇", "law": "●◆■▲★◎※◇▣"}
LIST_STARTS = {"contract": ["•", "-", "1.", "2.", "3.", "（", "("], "law": ["•", "-", "1.", "2.", "3.", "（", "(", "《", "["]}
LAW_HEAD_KEEP = ["令", "公告", "通知", "决定"]
LAW_TITLES = ["总则", "分则", "附则", "法律责任", "罚则"]
EMPHASIS = ["甲方", "乙方", "第一条"]
CONTRACT_SECTIONS = [
    "甲方", "乙方", "丙方", "丁方", "第一条", "第二条", "第三条", "第四条",
    "第五条", "第1条", "第2条", "第3条", "第4条", "第5条", "Article 1", "Article 2",
    "Article 3", "第一章", "第二章", "第三章", "合同双方", "合同标的", "合同价款", "付款方式",
    "违约责任", "争议解决", "保密条款", "签字页", "签署", "盖章",
]
LAW_SECTIONS = [
    "第一章", "第二章", "第三章", "第四章", "第五章", "第一节", "第二节", "第三节",
    "第四节", "第五节", "第一编", "第二编", "第三编", "第四编", "第五编", "第一条",
    "第二条", "第三条", "第四条", "第五条", "第1条", "第2条", "第3条", "第4条",
    "第5条", "Article 1", "Article 2", "Article 3", "总则", "分则", "附则", "法律依据",
    "立法目的", "适用范围", "定义", "释义", "法律责任", "罚则", "处罚", "施行日期",
    "生效日期", "废止日期", "颁布机关", "发布机关", "中华人民共和国", "国务院令", "部令", "办法",
    "条例", "规定", "细则", "决定", "司法解释", "批复", "答复",
]


def any_line(patterns: list[str], ignore_case: bool = False) -> str:
    """One expression for "one of the patterns occurs"; a dot stops at a line feed only."""
    return f"(?{'iud' if ignore_case else 'd'})(?:{'|'.join(patterns)})"


def is_box(c: Column | str, kind: str) -> Column:
    return T.col(c).rlike(f"[{BOXES[kind]}]")


def is_furniture(c: Column | str, kind: str) -> Column:
    """Page furniture when paragraphs are read: key words, short page lines, and for laws short document numbers."""
    c = T.col(c)
    found = c.rlike(any_line(FURNITURE[kind], True)) | ((F.length(c) < 50) & (c.rlike(rf"\A{T.DIGIT}+\z") | F.contains(c, F.lit("页")) | F.contains(c, F.lit("Page"))))
    return found | (c.rlike(r"[〔\]【】]") & (F.length(c) < 30)) if kind == "law" else found


def is_indicated(c: Column | str, kind: str) -> Column:
    """Page furniture in the second pass, on the text in small letters."""
    return F.lower(T.col(c)).rlike(any_line(INDICATORS[kind]))


def is_page_number(c: Column | str, kind: str) -> Column:
    forms = [rf"[{T.SPACE}]*{T.DIGIT}+[{T.SPACE}]*", rf"-[{T.SPACE}]*{T.DIGIT}+[{T.SPACE}]*-", rf"{T.DIGIT}+/{T.DIGIT}+"] + ([rf"\[{T.DIGIT}+\]"] if kind == "law" else [])
    return T.strip(c).rlike(rf"\A(?:{'|'.join(forms)})\z")


def is_footnote(c: Column | str) -> Column:
    return T.col(c).rlike(rf"\A(?:注{T.DIGIT}+：|注释{T.DIGIT}+：|\[{T.DIGIT}+\]|[①②③])")


def is_decoration(c: Column | str) -> Column:
    return T.strip(c).rlike(r"\A(?:=+|-+|~+|★+|☆+)\z")


def is_law_head(c: Column | str) -> Column:
    return T.col(c).rlike(rf"(?d)\A(?:.*(?:令|公告|通知)第{T.DIGIT}+号|【.*】\n?\z|〔.*〕\n?\z)")


def hierarchy(c: Column | str) -> Column:
    """Level of a heading: chapter 1, section 2, article 3, paragraph 4, bracketed number 5, a titled part 2, else 0."""
    c = T.col(c)
    level = None
    for value, unit in enumerate("章节条款", 1):
        hit = c.rlike(rf"\A第(?:[{T.NUMERALS}]+|{T.DIGIT}+){unit}")
        level = F.when(hit, value) if level is None else level.when(hit, value)
    level = level.when(c.rlike(rf"\A\((?:[{T.NUMERALS}]+|{T.DIGIT}+)\)"), 5)
    return level.when(T.contains_any(c, LAW_TITLES), 2).otherwise(0)


def clean_format(c: Column | str, kind: str) -> Column:
    """Single blanks, no bullets outside lists, stripped."""

    def unbulleted(x: Column) -> Column:
        listed = F.lit(False)
        for start in LIST_STARTS[kind]:
            listed = listed | F.startswith(x, F.lit(start))
        return F.when(listed, x).otherwise(F.translate(x, BULLETS[kind], ""))

    return T.strip(T.let(T.collapse(c), unbulleted))


def extract(paragraphs: DataFrame, kind: str) -> DataFrame:
    """What the reader keeps: no empty, boxed or furniture paragraphs; tables always. ``raw`` is the unstripped text."""
    rows = once(paragraphs.withColumn("raw", F.col("text")), text=T.strip("text"))
    table = F.coalesce(F.col("style") == "Table", F.lit(False))
    plain = (F.length("text") > 0) & ~is_box("text", kind) & ~is_furniture("raw", kind)
    return rows.where(table & (F.length("raw") > 0) | ~table & plain)


def lone_numbers(rows: DataFrame) -> DataFrame:
    """Marks numbers of their own line between neighbours that name no section (``is_lone_number``)."""
    order = Window.partitionBy("file_path").orderBy("pos")
    before, after = F.lag("text").over(order), F.lead("text").over(order)
    number = T.strip("text").rlike(rf"\A{T.DIGIT}+\z")
    return rows.withColumn("is_lone_number", F.coalesce(number & ~T.contains_any(before, CONTRACT_SECTIONS) & ~T.contains_any(after, CONTRACT_SECTIONS), F.lit(False)))


def clean_contract(paragraphs: DataFrame) -> DataFrame:
    """The cleaned paragraphs of contracts, with the role each has in the cleaned document."""
    rows = lone_numbers(extract(paragraphs, "contract"))
    rows = rows.where(~is_indicated("text", "contract") & ~F.col("is_lone_number") & ~is_page_number("text", "contract"))
    rows = once(rows, text=clean_format("text", "contract")).where(F.length("text") > 0)
    rows = once(rows, text=T.standard_contract("text"))
    bold = F.coalesce(F.col("is_bold"), F.lit(False)) | T.contains_any("text", EMPHASIS)
    return rows.withColumn("role", F.when(F.col("style") == "Table", "table").when(bold, "bold").otherwise("plain")).drop("raw", "is_lone_number")


def clean_law(paragraphs: DataFrame) -> DataFrame:
    """The cleaned paragraphs of statutes, with section flag, level, spacer before and role."""
    rows = once(extract(paragraphs, "law"), is_law_section=T.contains_any("text", LAW_SECTIONS), hierarchy_level=hierarchy("text"))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("pos"))
    rows = rows.withColumn("place", place).where(~is_indicated("text", "law"))
    rows = rows.where(~((F.col("place") <= 3) & is_law_head("text") & ~T.contains_any("text", LAW_HEAD_KEEP)))
    rows = rows.where(~is_page_number("text", "law")).where(~is_footnote("text")).where(~is_decoration("text"))
    rows = once(rows, text=clean_format("text", "law")).where(F.length("text") > 0)
    rows = once(rows, text=T.standard_law("text"))
    level = F.col("hierarchy_level")
    role = F.when(F.col("style") == "Table", "table").when(level > 0, F.concat(F.lit("heading"), F.least(level, F.lit(3)).cast("string")))
    role = role.when(F.coalesce(F.col("is_bold"), F.lit(False)) & (F.col("font_size") > 12), "title").when(F.coalesce(F.col("is_italic"), F.lit(False)), "italic").otherwise("plain")
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("pos")) == 1
    spacer = F.when(first, F.lit(None)).when(level.isin(1, 2), 1.0).when(level == 3, 0.5)
    return rows.withColumn("role", role).withColumn("spacer_before", spacer.cast("double")).drop("raw", "place")


def spaced(rows: DataFrame) -> DataFrame:
    """The statute with its spacers as rows of their own: ``seq`` orders them."""
    own = F.struct(F.lit(1).alias("k"), F.col("text").alias("t"), F.col("style").alias("s"), F.col("font_size").alias("z"))
    gap = F.struct(F.lit(0).alias("k"), F.lit("").alias("t"), F.lit("Empty").alias("s"), F.col("spacer_before").alias("z"))
    both = F.when(F.col("spacer_before").isNull(), F.array(own)).otherwise(F.array(gap, own))
    rows = rows.select("file_path", "pos", F.explode(both).alias("x"))
    return rows.select("file_path", (F.col("pos") * 2 + F.col("x.k")).alias("seq"), F.col("x.t").alias("text"), F.col("x.s").alias("style"), F.col("x.z").alias("font_size"))


def document_text(rows: DataFrame) -> DataFrame:
    """Cleaned paragraphs as one text a document, the way the splitters read it: tables behind a marker, no spacers."""
    parts = F.when(F.col("role") == "table", F.array(F.lit("[表格内容]"), F.col("text"))).otherwise(F.array("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), parts.alias("parts"))))
    return rows.groupBy("file_path").agg(ordered.alias("rows")).select("file_path", F.array_join(F.flatten(F.transform("rows", lambda r: r.parts)), "\n\n").alias("full_text"), F.size("rows").alias("total_paragraphs"))


def report(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcome of a cleaning run: files, cleaned, failed, in all or by ``keys``."""
    counts = [F.count("*").alias("n_files"), F.count_if("extraction_success").alias("n_cleaned"), F.count_if(~F.col("extraction_success")).alias("n_failed")]
    return results.groupBy(*keys).agg(*counts) if keys else results.agg(*counts)


def folder_of(path: Column | str) -> Column:
    """The folder of a path, empty for a bare name."""
    return F.regexp_extract(T.col(path), r"(?s)\A(.*)/[^/]*\z", 1)

"""Cleaning rules on hand-made paragraphs."""

from lexmill.operators import cleaning as C

COLUMNS = "file_path string, pos int, text string, original_text string, style string, font_size double, is_bold boolean, is_italic boolean, alignment string, keep boolean, is_law_section boolean, hierarchy_level int"


def paragraphs(spark, texts, style="Normal"):
    rows = [("f", i, t, t, "Table" if t.startswith("T:") else style, 11.0, False, False, "LEFT", True, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def texts(df):
    return [r.text for r in df.orderBy("pos").collect()]


def test_contract(spark):
    given = ["借款合同", "  ", "┌──┬──┐", "保密义务", "- 3 -", "12", "3/10", "甲方：某公司", "T:a\t\tb", "● 第五条  付款  1,234,567元", "- ● 列表", "Update"]
    found = C.clean_contract(paragraphs(spark, given))
    assert texts(found) == ["借款合同", "甲方：某公司", "T:a b", "第5条 付款 1234,567元", "- ● 列表"]
    roles = {r.text: r.role for r in found.collect()}
    assert roles["甲方：某公司"] == "bold" and roles["T:a b"] == "table"


def test_law(spark):
    given = ["国务院令第5号", "〔2020〕1号的说明文字不止三十个字符所以单凭长度它不会被当作文号删除还要再长一些", "第一章 总则", "第一条 本法", "注1：脚注", "①脚注", "====", "[4]", "2020年1月2号", "最后一段"]
    found = C.clean_law(paragraphs(spark, given))
    assert texts(found) == ["国务院令第5号", given[1], "第1章 总则", "第1条 本法", "2020年1月2日", "最后一段"]
    by = {r.text: r for r in found.collect()}
    assert by["第1章 总则"].hierarchy_level == 1 and by["第1章 总则"].spacer_before == 1.0 and by["第1章 总则"].role == "heading1"
    assert by["第1条 本法"].spacer_before == 0.5
    spaced = [(r.text, r.style) for r in C.spaced(found).orderBy("seq").collect()]
    assert spaced[2:4] == [("", "Empty"), ("第1章 总则", "Normal")]


def test_document_text_and_nulls(spark):
    found = C.document_text(C.clean_contract(paragraphs(spark, ["借款合同", "T:单元", "乙方"]))).collect()
    assert found[0].full_text == "借款合同\n\n[表格内容]\n\nT:单元\n\n乙方" and found[0].total_paragraphs == 3
    rows = spark.createDataFrame([("f", 0, None, None, None, None, None, None, None, None, None, None), ("f", 1, "正文", None, None, None, None, None, None, None, None, None)], COLUMNS)
    assert texts(C.clean_contract(rows)) == ["正文"] and texts(C.clean_law(rows)) == ["正文"]


def test_lone_numbers(spark):
    found = C.lone_numbers(paragraphs(spark, ["12", "正文", "13", "正文", "14", "甲方", "15"]))
    assert [r.pos for r in found.where("is_lone_number").collect()] == [2]

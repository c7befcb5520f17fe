"""Column functions on text against Python and hand cases."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.functions import text as T


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in rows.select("i", f("c").alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "given_text", "expected"),
    [
        (T.thousands, "1,234,567", "1234,567"),
        (T.law_clause_numbers, "第五条", "第5条"),
        (T.law_clause_numbers, "第十一条", "第十一条"),
        (T.law_clause_numbers, "(三)第二章", "(3)第2章"),
        (T.contract_clause_numbers, "Article   7", "Article 7"),
        (T.law_references, "《民法典》 第 十一 条", "《民法典》第11条"),
        (T.law_references, "《x》第二十一条", "《x》第二十一条"),
        (T.law_references, "《 x 》第 ３ 条", "《 x 》第３条".replace("《 x", "《x")),
        (T.dates, "2024-1-2 2023.10.1", "2024年1月2日 2023年10月1日"),
        (lambda c: T.dates(c, True), "2020年1月2号", "2020年1月2日"),
        (T.law_numbers, "百分之12，5元人民币", "12%，5元"),
        (T.contract_amounts, "RMB 12.5 yuan，人民币 3 元", "人民币12.5元，人民币3元"),
        (T.folder_name, ' ..a<b>"c|? ', 'a_b_c_'),
        (T.folder_name, "", "未命名合同"),
        (T.folder_name, None, "未命名合同"),
        (lambda c: T.numeral_value(c, 20), "十九", "19"),
        (lambda c: T.numeral_value(c, 10), "十九", "十九"),
        (lambda c: T.clip(c, 3), "abcd", "abc..."),
        (lambda c: T.preview(c, 3), "a\nbc", "a b..."),
    ],
)
def test_hand_cases(spark, f, given_text, expected):
    assert run(spark, f, [given_text]) == [expected.replace("《x 》", "《x 》")]


def test_strip_and_collapse_match_python(spark):
    sample = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["a", "​", "\U00020bb7"]
    values = [f"{s}x{s}{s}y{s}" for s in sample]
    assert run(spark, T.strip, values) == [v.strip() for v in values]
    assert run(spark, T.collapse, values) == [re.sub(r"\s{2,}", " ", v) for v in values]


# Whole texts through all standardisers of a kind; what follows from the rules is written out.
@pytest.mark.parametrize(
    ("f", "given_text", "expected"),
    [
        (T.standard_law, "第一章第三节第十条第二款(五)", "第1章第3节第10条第2款(5)"),
        (T.standard_law, "第十一章第二十条", "第十一章第二十条"),  # one numeral only outside citations
        (T.standard_law, "依《 合同法 》 第 十二 条、《票据法》第7 条", "依《合同法 》第12条、《票据法》第7条"),  # the blank before the closing sign belongs to the name
        (T.standard_law, "《a》第二十条，《a》第二十二条", "《a》第20条，《a》第二十二条"),
        (T.standard_law, "2020/1/2至2021.03.04，2022年5月6号，2023年7月8日", "2020年1月2日至2021年03月04日，2022年5月6日，2023年7月8日"),
        (T.standard_law, "20240-1-2", "2" + "0240年1月2日"),
        (T.standard_law, "1,000元人民币，12，345，678元，百分之30", "1000元，12345，678元，30%"),
        (T.standard_law, "（三）百分之三", "（三）百分之三"),
        (T.standard_contract, "第五条 Article  3 2024-1-2 RMB 5 yuan 人民币 1,234.5 元", "第5条 Article 3 2024年1月2日 人民币5元 人民币1234.5元"),
        (T.standard_contract, "第五章 2020年1月2号 5元人民币", "第五章 2020年1月2号 5元人民币"),  # rules of statutes only
        (T.standard_contract, "", ""),
    ],
)
def test_standardisers_by_hand(spark, f, given_text, expected):
    assert run(spark, f, [given_text]) == [expected]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("第一二十条章节(三)0１9,，.-/年月日号元人民币百分之《》 　"), max_size=40), min_size=20, max_size=60))
def test_standardisers_hold_what_they_do_not_change(spark, values):
    """What no rule is about stays; single steps are at rest after one run, but for the thousands, which are one pass by rule."""
    plain = [re.sub(r"[第(人百《0-9０-９]", "", v) for v in values]
    assert run(spark, T.standard_law, plain) == plain
    assert run(spark, T.standard_contract, [p.replace("Article", "") for p in plain]) == plain
    for step in (T.law_clause_numbers, T.contract_clause_numbers, T.law_references):
        once = run(spark, step, values)
        assert run(spark, step, once) == once
    # no step makes or loses letters: only numerals, digits, separators, blanks and the words of the rules may change
    keep = lambda t: re.sub(r"[第章节条款一二三四五六七八九十0-9０-９()\s　,，./\-年月日号人民币百分之%元《》]", "", t)
    assert [keep(v) for v in run(spark, T.standard_law, values)] == [keep(v) for v in values]


def test_inner_mark_never_stays(spark):
    values = ["《a》第二十一条", "《a》第三条\x01", "\x01第一条"]
    assert run(spark, T.law_references, values) == ["《a》第二十一条", "《a》第3条\x01", "\x01第一条"]

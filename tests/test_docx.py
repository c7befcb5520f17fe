"""Word documents: round trip, first-run properties, tables, broken files."""

import io
import zipfile

from lexmill.operators import cleaning
from lexmill.plans import pipelines
from lexmill.sources import docx, sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def build(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


BODY = (
    '<w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>借款合同</w:t></w:r><w:r><w:t>（副本）</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t> 甲 </w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    '<w:p/><w:p><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t>第一条 贷款金额为人民币1,000元，用于购买设备并按照约定的用途使用资金</w:t><w:br/><w:t>下一行</w:t></w:r></w:p>'
)


def test_parse():
    rows = docx.parse(build(BODY))
    assert rows[0] == ("借款合同（副本）", "Normal", 14.0, True, False, "CENTER")
    assert rows[1][0] == "" and rows[1][2] == 11.0
    assert rows[2][0].endswith("\n下一行") and rows[2][3:5] == (False, True)
    assert rows[3] == ("甲\t乙", "Table", 10.0, False, False, "LEFT")


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DOCX").write_bytes(build(BODY))
    (tmp_path / "b.doc").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("x")
    files = docx.scan(spark, str(tmp_path), str(tmp_path / "missing"))
    assert files.count() == 2 and docx.scan(spark, str(tmp_path), recursive=False).count() == 1
    assert docx.scan(spark, str(tmp_path / "missing")).count() == 0
    read = docx.read_paragraphs(files)
    facts = {r.file_name: r for r in docx.extracted(read).collect()}
    assert facts["a.DOCX"].contract_title == "借款合同（副本）" and facts["a.DOCX"].total_paragraphs == 2 and facts["a.DOCX"].file_stem == "a"
    assert not facts["b.doc"].extraction_success and facts["b.doc"].error
    cleaned = cleaning.clean_contract(read)
    built = {r.file_path: bytes(r.content) for r in sinks.cleaned_documents(cleaned).collect()}
    again = docx.parse(next(iter(built.values())))
    assert [r[0] for r in again] == ["借款合同（副本）", "第1条 贷款金额为人民币1000元，用于购买设备并按照约定的用途使用资金\n下一行", "[表格内容]", "甲\t乙"]
    chunks = pipelines.clean_and_split(spark, str(tmp_path), "contract").collect()
    assert [c.clause_type for c in chunks][-1] in ("数字条款", "中文条款")
    assert pipelines.clean_and_split(spark, str(tmp_path), "law", 5).count() > 0
    written = sinks.cleaned_documents(cleaned).withColumn("file_path", sinks.output_name(docx.F.col("file_path"), f"file:{tmp_path}", str(tmp_path / "out")))
    sinks.write_files(written)
    assert (tmp_path / "out" / "sub" / "a.docx").exists()


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 1, "b", "t"), ("f1", 0, "a", "t"), ("f2", 0, "c", None)], "folder string, chunk_index int, text string, clause_type string")
    out = {r.folder: r.json for r in sinks.chunk_documents(rows, ["folder"], ["chunk_index", "clause_type"]).collect()}
    assert out["f1"].index('"a"') < out["f1"].index('"b"')
    sinks.write_chunks(rows, str(tmp_path / "x"), "folder")
    assert spark.read.json(str(tmp_path / "x")).count() == 3

"""The command line on small folders."""

from lexmill import cli

from .test_docx import BODY, build


def test_split_import_search(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(build(BODY))
    assert cli.main(["split", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--min-length", "5"]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() > 0
    assert spark.read.json(str(tmp_path / "out" / "statistics" / "overall")).first().n_documents == 1
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('[{"text": "利率条款", "metadata": {"source": "a.docx"}}]', encoding="utf-8")
    assert cli.main(["import", "--store", str(tmp_path / "store"), str(tmp_path / "json")]) == 0
    assert cli.main(["search", "--store", str(tmp_path / "store"), "--text", "利率"]) == 0
    shown = capsys.readouterr().out
    assert "利率条款" in shown and "1. " in shown
    assert cli.main(["search", "--store", str(tmp_path / "elsewhere"), "--text", "利率"]) == 0  # the first store beside it
    assert cli.main(["info", "--store", str(tmp_path / "store")]) == 0
    assert "count: 2" in capsys.readouterr().out  # with the system row
    assert cli.main(["clean", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "cleaned")]) == 0
    assert (tmp_path / "cleaned" / "a.docx").exists()
    assert list((tmp_path / "out" / "reports").glob("*/*.txt"))
    assert cli.main(["review", "--store", str(tmp_path / "missing"), "--clause", "x", "--url", "http://127.0.0.1:9/"]) == 1

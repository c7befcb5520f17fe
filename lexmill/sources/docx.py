"""Word documents as paragraph tables. Files are listed and read by Spark; each is parsed where it was read.

A paragraph's font size, weight and slant are those of its first run. Tables follow all paragraphs, one row each: cells
joined by tabs, rows by line feeds. A file that cannot be parsed gives one row with ``error`` and nothing else.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "file_path string, pos int, text string, style string, font_size double, is_bold boolean, is_italic boolean, alignment string, error string"
ALIGNMENT = {"left": "LEFT", "start": "LEFT", "center": "CENTER", "right": "RIGHT", "end": "RIGHT", "both": "JUSTIFY", "distribute": "JUSTIFY"}
DEFAULT_SIZE = 11.0


def scan(spark: SparkSession, *folders: str, recursive: bool = True, suffix: str = r"\.docx?$", ignore_case: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of the files below existing folders whose name ends so."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [f for f in folders if path(f).getFileSystem(hadoop).exists(path(f))]
    if not there:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there)
    return files.where(F.col("path").rlike(f"(?i){suffix}" if ignore_case else suffix))


def _on(run: ElementTree.Element | None, tag: str) -> bool:
    found = run.find(f"{_W}rPr/{_W}{tag}") if run is not None else None
    return found is not None and found.get(f"{_W}val", "true") not in ("0", "false", "none")


def _text(node: ElementTree.Element) -> str:
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in node.iter())


def _table(table: ElementTree.Element) -> str:
    rows = []
    for row in table.iter(f"{_W}tr"):
        cells = ["\n".join(_text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
        rows.append("\t".join(c for c in cells if c))
    return "\n".join(r for r in rows if r)


def parse(content: bytes) -> list[tuple]:
    """``(text, style, font size, bold, italic, alignment)`` of each paragraph, then of each table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else None
    rows = []
    for p in body.findall(f"{_W}p"):
        run = p.find(f"{_W}r")
        style, jc = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}jc")
        size = run.find(f"{_W}rPr/{_W}sz") if run is not None else None
        own = style.get(f"{_W}val") if style is not None else None
        points = float(size.get(f"{_W}val")) / 2 if size is not None and re.fullmatch(r"\d+(\.\d+)?", size.get(f"{_W}val", "")) else DEFAULT_SIZE
        rows.append((_text(p), names.get(own, own) or "Normal", points, _on(run, "b"), _on(run, "i"), ALIGNMENT.get(jc.get(f"{_W}val"), "LEFT") if jc is not None else "LEFT"))
    for table in body.findall(f"{_W}tbl"):
        rows.append((_table(table), "Table", 10.0, False, False, "LEFT"))
    return rows


def _parse_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for part in parts:
        rows: list[tuple] = []
        for path, content in zip(part.path, part.content):
            try:
                rows += [(path, k, *r, None) for k, r in enumerate(parse(bytes(content)))]
            except Exception as e:  # noqa: BLE001
                rows.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=names)


def read_paragraphs(files: DataFrame) -> DataFrame:
    """The paragraph table of scanned files, parsed where they are read: the scan cuts the listing into tasks by size
    (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``), so contents are not exchanged before they are parsed."""
    return files.select("path", "content").mapInPandas(_parse_all, SCHEMA)


def extracted(paragraphs: DataFrame) -> DataFrame:
    """One row a file: its paragraphs, stripped, without empty ones and tables, joined by blank lines."""
    rows = paragraphs.withColumn("text", T.strip("text"))
    kept = F.when((F.length("text") > 0) & (F.col("style") != "Table"), F.struct("pos", "text"))
    found = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(kept)).alias("p"), F.max("error").alias("error"))
    texts = F.transform("p", lambda x: x.text)
    name = F.substring_index("file_path", "/", -1)
    stem = F.regexp_replace(name, r"(.)\.[^.]*\z", "$1")
    title = F.when(F.col("error").isNotNull(), "提取失败").otherwise(T.contract_title(texts, stem))
    return found.select("file_path", name.alias("file_name"), stem.alias("file_stem"), title.alias("contract_title"), F.array_join(texts, "\n\n").alias("full_text"), F.size("p").alias("total_paragraphs"), F.col("error").isNull().alias("extraction_success"), "error")

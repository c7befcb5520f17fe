"""Sinks: chunk files and reports by document, cleaned Word documents, review results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def chunk_documents(chunks: DataFrame, keys: list[str], metadata: list[str]) -> DataFrame:
    """One row a document: its chunks in order as one JSON array."""
    item = F.struct(F.col("chunk_index").alias("__i"), F.struct(F.col("text"), F.struct(*metadata).alias("metadata")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda r: r.x)
    return chunks.groupBy(*keys).agg(F.to_json(ordered, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_chunk_files(chunks: DataFrame, path: str, folder: str, metadata: list[str]) -> None:
    """One JSON array a document, in a folder of its own, on any file system that Spark writes to."""
    made = chunk_documents(chunks, [folder], metadata)
    made.select(folder, "json").write.mode("overwrite").partitionBy(folder).text(path)


def write_chunks(chunks: DataFrame, path: str, folder: str) -> None:
    """Chunks as JSON lines, a folder a document, sorted by place."""
    chunks.repartition(folder).sortWithinPartitions(folder, "chunk_index").write.mode("overwrite").partitionBy(folder).json(path)


def write_reports(reports: DataFrame, path: str, folder: str) -> None:
    """The text report of each document, in a folder of its own."""
    reports.select(folder, "report").write.mode("overwrite").partitionBy(folder).text(path)


def write_table(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """A report as JSON lines; ``one_file`` for reports of a bounded number of rows."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").json(path)


def output_name(path, source_root: str, target_root: str):  # noqa: ANN001, ANN201
    """Where a cleaned document goes: the same folder below the target, with the ending ``.docx``."""
    return F.concat(F.lit(target_root.rstrip("/")), F.regexp_replace(F.substring(path, len(source_root.rstrip("/")) + 1, 1 << 20), r"\.[^./]*\z", ".docx"))


# The default font and size of cleaned documents.
FONT, FONT_SIZE = "宋体", 12


def _paragraph(text: str, role: str, spacer: float | None = None) -> str:
    size = "28" if role == "title" else str(2 * FONT_SIZE)
    props = {"bold": "<w:b/>", "italic": "<w:i/>", "title": "<w:b/>"}.get(role, "<w:b/>" if role.startswith("heading") else "")
    props += f'<w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:eastAsia="{FONT}"/><w:sz w:val="{size}"/>'
    style = f'<w:pStyle w:val="Heading{role[-1]}"/>' if role.startswith("heading") else ""
    indent = '<w:ind w:firstLine="480"/>' if role == "indented" else ""
    blank = f'<w:p><w:pPr><w:spacing w:line="{int(240 * spacer)}" w:lineRule="auto"/></w:pPr></w:p>' if spacer else ""
    lines = '</w:t><w:br/><w:t xml:space="preserve">'.join('</w:t><w:tab/><w:t xml:space="preserve">'.join(map(escape, line.split("\t"))) for line in text.split("\n"))
    return f'{blank}<w:p><w:pPr>{style}{indent}</w:pPr><w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{lines}</w:t></w:r></w:p>'


def _zipped(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def docx_bytes(rows: list[tuple]) -> bytes:
    """A minimal Word document of ``(text, role[, spacer before])`` paragraphs; a table follows its marker."""
    return _zipped("".join(_paragraph("[表格内容]", "italic") + _paragraph(t, "plain") if role == "table" else _paragraph(t, role, *more) for t, role, *more in rows))


def _plain_paragraph(text: str, style: str | None, size: float | None, bold: bool | None, italic: bool | None, alignment: str | None) -> str:
    """A paragraph of one run with its own style, size, weight, slant and alignment."""
    jc = {"CENTER": "center", "RIGHT": "right", "JUSTIFY": "both", "LEFT": "left"}.get(alignment or "", "left")
    named = f'<w:pStyle w:val="{escape(style, {chr(34): "&quot;"})}"/>' if style else ""
    props = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f'<w:sz w:val="{size * 2:g}"/>' if size else "")
    lines = '</w:t><w:br/><w:t xml:space="preserve">'.join('</w:t><w:tab/><w:t xml:space="preserve">'.join(map(escape, line.split("\t"))) for line in text.split("\n"))
    return f'<w:p><w:pPr>{named}<w:jc w:val="{jc}"/></w:pPr><w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{lines}</w:t></w:r></w:p>'


def paragraph_documents(rows: DataFrame) -> DataFrame:
    """``file_path, content``: a paragraph table as Word files, in order of ``pos``."""
    names = ["text", "style", "font_size", "is_bold", "is_italic", "alignment"]
    ordered = F.array_sort(F.collect_list(F.struct("pos", *names)))

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"file_path": part.file_path, "content": [_zipped("".join(_plain_paragraph(r["text"] or "", *(r[n] for n in names[1:])) for r in rows)) for rows in part.rows]})

    return rows.groupBy("file_path").agg(ordered.alias("rows")).mapInPandas(build, "file_path string, content binary")


def cleaned_documents(rows: DataFrame) -> DataFrame:
    """``file_path, content``: the cleaned paragraphs of each document as a Word file. Statutes (with ``hierarchy_level``)
    get their spacers, and paragraphs of level 0 are indented."""
    law = "spacer_before" in rows.columns
    spacer = F.col("spacer_before") if law else F.lit(None).cast("double")
    role = F.when((F.col("role") == "plain") & (F.coalesce("hierarchy_level", F.lit(0)) == 0), "indented").otherwise(F.col("role")) if law else F.col("role")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text", role.alias("role"), spacer.alias("spacer"))))

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"file_path": part.file_path, "content": [docx_bytes([(r["text"], r["role"], r["spacer"]) for r in rows]) for rows in part.rows]})

    return rows.groupBy("file_path").agg(ordered.alias("rows")).mapInPandas(build, "file_path string, content binary")


def write_files(files: DataFrame) -> None:
    """Writes ``file_path, content`` rows to a file system that the workers reach by path."""

    def put(rows) -> None:  # noqa: ANN001
        from pathlib import Path

        for r in rows:
            target = Path(r.file_path.removeprefix("file://").removeprefix("file:"))
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.part")
            part.write_bytes(bytes(r.content))
            part.rename(target)

    files.foreachPartition(put)

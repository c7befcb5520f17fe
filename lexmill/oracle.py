"""The SQL of the core queries, for an engine that runs it on the same tables."""

from __future__ import annotations

from lexmill.functions import text as T
from lexmill.operators import cleaning as C
from lexmill.operators import prompt as P
from lexmill.operators import segment as S

SQL: dict[str, str] = {}


def _q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A[{T.SPACE}]+|[{T.SPACE}]+\\z', '', 'g')"


def _clip(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


def _line(c: str) -> str:
    return f"split_part({c}, chr(10), 1)"


def _preview(c: str, n: int) -> str:
    return f"replace(substr({c}, 1, {n}), chr(10), ' ') || CASE WHEN length({c}) > {n} THEN '...' ELSE '' END"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _case(arms: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms) + f" ELSE {other} END"


def _sub(c: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(to)}, 'g')"
    return c


def _replace(c: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


_D, _SP = T.DIGIT, T.SPACE
_NUM = list(enumerate(T.NUMERALS, 1))
_WORDS20 = [*T.NUMERALS, *("十" + n for n in T.NUMERALS[:9]), "二十"]


def _contract_numbers(c: str) -> str:
    return _sub(_replace(c, *((f"第{s}条", f"第{v}条") for v, s in _NUM)), (rf"Article[{_SP}]*({_D}+)", r"Article \1"))


def _law_clauses(c: str) -> str:
    return _replace(c, *((f"第{s}{u}", f"第{v}{u}") for u in "章节条款" for v, s in _NUM), *((f"({s})", f"({v})") for v, s in _NUM))


def _dates(c: str, day_word: bool = False) -> str:
    d4, d2 = rf"({_D}{{4}})", rf"({_D}{{1,2}})"
    rules = [(rf"{d4}[-/]{d2}[-/]{d2}", r"\1年\2月\3日"), (rf"{d4}\.{d2}\.{d2}", r"\1年\2月\3日")]
    return _sub(c, *rules, *([(rf"{d4}年{d2}月{d2}号", r"\1年\2月\3日")] if day_word else []))


_THOUSANDS = (rf"({_D}+)[,，]({_D}{{3}})", r"\1\2")


def _amounts(c: str) -> str:
    n = rf"[{_SP}]*({_D}+(?:\.{_D}+)?)[{_SP}]*"
    return _sub(c, _THOUSANDS, (rf"人民币{n}元", r"人民币\1元"), (rf"RMB{n}yuan", r"人民币\1元"))


def _numbers(c: str) -> str:
    return _sub(c, _THOUSANDS, (rf"({_D}+)元人民币", r"\1元"), (rf"百分之({_D}+)", r"\1%"))


def _refs(c: str) -> str:
    name, mark = rf"《[{_SP}]*([^》]+)[{_SP}]*》[{_SP}]*第[{_SP}]*", "\ufdd0"
    c = _sub(c, (rf"{name}({_D}+)[{_SP}]*条", r"《\1》第\2条"), (rf"{name}([{T.NUMERALS}]+)[{_SP}]*条", rf"{mark}《\1》第\2条"))
    c = _sub(c, *((rf"{mark}(《[^》]+》)第{w}条", rf"\1第{v}条") for v, w in enumerate(_WORDS20, 1)))
    return _replace(c, (mark, ""))


def _standard_contract(c: str) -> str:
    return _amounts(_dates(_contract_numbers(c)))


def _standard_law(c: str) -> str:
    return _numbers(_refs(_dates(_law_clauses(c), True)))


# --- segmentation ------------------------------------------------------------------------------------------------------

_LINES = """
    d AS (SELECT file_path, file_name, file_stem, contract_title, full_text AS t FROM extracted_docs WHERE extraction_success AND full_text IS NOT NULL),
    u AS (SELECT file_path, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
    l AS (SELECT file_path, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o0 FROM u)"""


def _found(pattern: str, p: int, anchored: bool = False) -> str:
    if anchored:
        return f"SELECT file_path, o0 AS s, {p} AS p FROM l WHERE regexp_matches(line, {_q(f'^(?:{pattern})')})"
    return f"SELECT file_path, o0 + length(regexp_extract(line, {_q(rf'^([^\n]*?)(?:{pattern})')}, 1)) AS s, {p} AS p FROM l WHERE regexp_matches(line, {_q(pattern)})"


_law_type = _case([(f"regexp_matches(text, {_q(f'^(?:{p})')})", _q(label)) for label, p in S.LAW_STARTS], _q(S.PLAIN))
_LAW = f"""{_LINES},
    s AS ({" UNION ".join(_found(p, 0) for _, p in S.LAW_STARTS)} UNION SELECT file_path, 0, 0 FROM d),
    e AS (SELECT s.file_path, s.s, lead(s.s) OVER (PARTITION BY s.file_path ORDER BY s.s) AS n FROM s),
    c AS (SELECT e.file_path, e.s, {_strip("substr(d.t, e.s + 1, coalesce(e.n, length(d.t)) - e.s)")} AS text, d.file_name AS source FROM e JOIN d USING (file_path)),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY s) - 1 AS chunk_index, count(*) OVER (PARTITION BY file_path) AS total_chunks_in_doc FROM c WHERE length(text) >= {S.LAW_MIN}),
    z AS (SELECT *, {_law_type} AS clause_type FROM k)"""
SQL["law_clause_chunks"] = f"""WITH {_LAW}
    SELECT file_path, source, total_chunks_in_doc::INTEGER AS total_chunks_in_doc, chunk_index::INTEGER AS chunk_index, text, length(text)::INTEGER AS chunk_size, clause_type,
        CASE WHEN clause_type = '{S.PLAIN}' THEN '{S.PLAIN}' ELSE {_clip(_strip(_line("substr(text, 1, 50)")), 30)} END AS clause_header, {_preview("text", 100)} AS chunk_preview FROM z"""
SQL["law_type_histogram"] = f"WITH {_LAW} SELECT clause_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM z GROUP BY clause_type"


def _contract_type(c: str) -> str:
    line = _strip(_line(c))
    arms = [(f"regexp_matches(ln, {_q(f'^(?:{p})')})", _q(label)) for label, p, _ in S.CONTRACT_STARTS]
    arms += [(f"contains(substr(ln, 1, 50), {_q(w)})", _q(label)) for w, label in S.CONTRACT_WORDS]
    body = _case([*arms, (f"length({c}) < 100", "'短条款'"), (f"length({c}) < 300", "'中等条款'")], "'长条款'")
    return f"(SELECT {body} FROM (SELECT {line} AS ln))"


def _party(c: str) -> str:
    return _case([(f"regexp_matches(substr({c}, 1, 200), {_q(f'{p}[：:]')})", _q(p)) for p in S.PARTIES], "'其他'")


_PARAGRAPHS = rf"string_split_regex(t, '\n[{_SP}]*\n+')"
_label = "CASE p " + " ".join(f"WHEN {k} THEN {_q(label)}" for k, (label, _, _) in enumerate(S.CONTRACT_STARTS, 1)) + " END"
SQL["contract_clause_chunks"] = f"""WITH RECURSIVE {_LINES},
    cand AS ({" UNION ALL ".join(_found(p, k, a) for k, (_, p, a) in enumerate(S.CONTRACT_STARTS, 1))}),
    o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY p, s) AS k FROM cand),
    r AS (SELECT file_path, 0::BIGINT AS k, []::BIGINT[] AS acc FROM d
        UNION ALL SELECT o.file_path, o.k, CASE WHEN len(list_filter(r.acc, lambda a: abs(a - o.s) < {S.NEAR})) > 0 THEN r.acc ELSE list_append(r.acc, o.s) END FROM r JOIN o ON o.file_path = r.file_path AND o.k = r.k + 1),
    f AS (SELECT file_path, unnest(max_by(acc, k)) AS s FROM r GROUP BY file_path),
    q AS (SELECT f.file_path, f.s, min(o.p) AS p FROM f JOIN o ON o.file_path = f.file_path AND o.s = f.s GROUP BY 1, 2),
    e AS (SELECT *, lead(s) OVER (PARTITION BY file_path ORDER BY s) AS n FROM q),
    w AS (SELECT e.file_path, e.s, e.p, {_strip("substr(d.t, e.s + 1, coalesce(e.n, length(d.t)) - e.s)")} AS text, {_strip(_line("substr(d.t, e.s + 1)"))} AS clause_header FROM e JOIN d USING (file_path)
        UNION ALL SELECT d.file_path, -1, 0, {_strip("substr(d.t, 1, m.s)")}, '{S.PREAMBLE}' FROM d JOIN (SELECT file_path, min(s) AS s FROM q GROUP BY 1) m USING (file_path) WHERE m.s > 0
        UNION ALL SELECT file_path, i, 999, x, {_clip(_strip(_line("x")), 50)} FROM (SELECT file_path, {_strip("x")} AS x, i FROM (SELECT file_path, unnest({_PARAGRAPHS}) AS x, generate_subscripts({_PARAGRAPHS}, 1) AS i FROM d WHERE file_path NOT IN (SELECT file_path FROM q)))),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY s) - 1 AS chunk_index, count(*) OVER (PARTITION BY file_path) AS total FROM w WHERE length(text) >= {S.CONTRACT_MIN})
    SELECT k.file_path, d.file_name AS source, d.file_stem AS source_stem, d.contract_title, k.total::INTEGER AS total_chunks_in_doc, k.chunk_index::INTEGER AS chunk_index, k.text, k.p::INTEGER AS clause_priority,
        CASE WHEN p BETWEEN 1 AND {len(S.CONTRACT_STARTS)} THEN {_label} ELSE {_contract_type("k.text")} END AS clause_type, k.clause_header, {_party("k.text")} AS contract_party, length(k.text)::INTEGER AS chunk_size, {_preview("k.text", 120)} AS chunk_preview
    FROM k JOIN d USING (file_path)"""
SQL["contract_paragraph_fallback"] = f"""WITH d AS (SELECT file_path, full_text AS t FROM extracted_docs WHERE extraction_success AND full_text IS NOT NULL),
    x AS (SELECT file_path, {_strip("x")} AS text, i FROM (SELECT file_path, unnest({_PARAGRAPHS}) AS x, generate_subscripts({_PARAGRAPHS}, 1) AS i FROM d))
    SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY i) - 1)::INTEGER AS chunk_index, text, {_clip(_strip(_line("text")), 50)} AS clause_header FROM x WHERE length(text) >= {S.CONTRACT_MIN}"""
SQL["contract_clause_types"] = f"SELECT chunk_id, {_contract_type('text')} AS contract_type, {_law_type} AS law_type, {_party('text')} AS party FROM chunks"

# --- statistics --------------------------------------------------------------------------------------------------------

SQL["chunk_stats"] = "SELECT file_path, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_length, max(length(text))::INTEGER AS max_length, min(length(text))::INTEGER AS min_length, count(*) FILTER (clause_priority <= 15) AS n_important FROM chunks GROUP BY file_path"
SQL["chunk_stats_overall"] = "SELECT count(DISTINCT file_path) AS n_documents, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_length FROM chunks"
for _name, _column in (("chunk_type_histogram", "clause_type"), ("contract_party_histogram", "contract_party")):
    SQL[_name] = f"SELECT {_column}, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM chunks GROUP BY {_column}"
    SQL[f"{_name}_by_file"] = f"SELECT file_path, {_column}, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY file_path), 6) AS percent FROM chunks GROUP BY file_path, {_column}"
SQL["contract_top3_types"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY n DESC, first_at, clause_type NULLS FIRST)::INTEGER AS place FROM
    (SELECT file_path, clause_type, count(*) AS n, min(chunk_index) AS first_at FROM chunks GROUP BY ALL)) WHERE place <= 3"""
SQL["important_clauses"] = """SELECT *, CASE WHEN clause_priority <= 10 THEN chunk_preview END AS shown FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index)::INTEGER AS place FROM
    (SELECT DISTINCT chunk_id, file_path, chunk_index, clause_priority, chunk_preview FROM chunks WHERE clause_priority <= 15)) WHERE place <= 15"""
SQL["chunk_continuity"] = """WITH g AS (SELECT file_path, min(chunk_index) AS a, max(chunk_index) AS b, list(DISTINCT chunk_index) AS have FROM chunks WHERE clause_type IS NOT NULL GROUP BY file_path)
    SELECT file_path, a AS first_index, b AS last_index, coalesce(array_to_string(list_filter(range(a, b + 1), lambda x: NOT list_contains(have, x)), ','), '') AS missing, len(have)::INTEGER AS n_found, b - a + 1 AS n_expected, len(have) = b - a + 1 AS is_complete FROM g"""
_base = f"substr(regexp_replace(regexp_replace(regexp_replace(coalesce(file_stem, ''), '[<>:\"/\\\\|?*\\n\\r\\t]', '_', 'g'), '\\A[. ]+|[. ]+\\z', '', 'g'), '_+', '_', 'g'), 1, 80)"
SQL["folder_names"] = f"""WITH b AS (SELECT file_path, CASE WHEN length({_strip(_base)}) = 0 THEN '{T.UNNAMED}' ELSE {_base} END AS base FROM extracted_docs),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY file_path) - 1 AS n FROM b),
    f AS (SELECT *, CASE WHEN n = 0 THEN base ELSE base || '_' || n END AS folder FROM n),
    m AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n, file_path) - 1 AS m FROM f)
    SELECT file_path, base, CASE WHEN m = 0 THEN folder ELSE folder || '_' || m END AS folder FROM m"""

# --- cleaning ----------------------------------------------------------------------------------------------------------


def _box(c: str, kind: str) -> str:
    return f"regexp_matches({c}, '[{C.BOXES[kind]}]')"


def _furniture(c: str, kind: str) -> str:
    found = f"(regexp_matches({c}, {_q('(?i)' + '|'.join(C.FURNITURE[kind]))}) OR (length({c}) < 50 AND (regexp_matches({c}, '\\A{_D}+\\z') OR contains({c}, '页') OR contains({c}, 'Page'))))"
    return f"({found} OR (regexp_matches({c}, '[〔\\]【】]') AND length({c}) < 30))" if kind == "law" else found


def _indicated(c: str, kind: str) -> str:
    return f"regexp_matches(lower({c}), {_q('|'.join(C.INDICATORS[kind]))})"


def _page(c: str, kind: str) -> str:
    forms = [rf"[{_SP}]*{_D}+[{_SP}]*", rf"-[{_SP}]*{_D}+[{_SP}]*-", rf"{_D}+/{_D}+"] + ([rf"\[{_D}+\]"] if kind == "law" else [])
    return f"regexp_matches({_strip(c)}, {_q(rf'\A(?:{"|".join(forms)})\z')})"


_foot = f"regexp_matches(text, '\\A(?:注{_D}+：|注释{_D}+：|\\[{_D}+\\]|[①②③])')"
_deco = f"regexp_matches({_strip('text')}, '\\A(?:=+|-+|~+|★+|☆+)\\z')"
_head = f"regexp_matches(text, '\\A(?:.*(?:令|公告|通知)第{_D}+号|【.*】\\n?\\z|〔.*〕\\n?\\z)')"


def _hierarchy(c: str) -> str:
    arms = [(f"regexp_matches({c}, '\\A第(?:[{T.NUMERALS}]+|{_D}+){u}')", str(v)) for v, u in enumerate("章节条款", 1)]
    return _case([*arms, (f"regexp_matches({c}, '\\A\\((?:[{T.NUMERALS}]+|{_D}+)\\)')", "5"), (_any(c, C.LAW_TITLES), "2")], "0")


def _format(c: str, kind: str) -> str:
    one = f"regexp_replace({c}, '[{_SP}]{{2,}}', ' ', 'g')"
    listed = " OR ".join(f"starts_with({one}, {_q(s)})" for s in C.LIST_STARTS[kind])
    return _strip(f"CASE WHEN {listed} THEN {one} ELSE translate({one}, '{C.BULLETS[kind]}', '') END")


def _extract(kind: str) -> str:
    table = "coalesce(style = 'Table', false)"
    return f"""x AS (SELECT * REPLACE ({_strip("text")} AS text), text AS raw FROM paragraphs),
    y AS (SELECT * FROM x WHERE ({table} AND length(raw) > 0) OR (NOT {table} AND length(text) > 0 AND NOT {_box("text", kind)} AND NOT {_furniture("raw", kind)}))"""


_lone = f"""regexp_matches({_strip("text")}, '\\A{_D}+\\z') AND NOT {_any("lag(text) OVER o", C.CONTRACT_SECTIONS)} AND NOT {_any("lead(text) OVER o", C.CONTRACT_SECTIONS)}"""
_CONTRACT = f"""{_extract("contract")},
    a AS (SELECT *, coalesce({_lone}, false) AS lone FROM y WINDOW o AS (PARTITION BY file_path ORDER BY pos)),
    b AS (SELECT * REPLACE ({_format("text", "contract")} AS text) FROM a WHERE NOT {_indicated("text", "contract")} AND NOT lone AND NOT {_page("text", "contract")}),
    z AS (SELECT * REPLACE ({_standard_contract("text")} AS text) FROM b WHERE length(text) > 0),
    r AS (SELECT *, CASE WHEN style = 'Table' THEN 'table' WHEN coalesce(is_bold, false) OR {_any("text", C.EMPHASIS)} THEN 'bold' ELSE 'plain' END AS role FROM z)"""
SQL["clean_contract_paragraphs"] = f"WITH {_CONTRACT} SELECT file_path, pos, text, style, role FROM r"
SQL["contract_document_text"] = f"WITH {_CONTRACT} SELECT file_path, string_agg(CASE WHEN role = 'table' THEN '[表格内容]' || chr(10) || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS full_text, count(*)::INTEGER AS total_paragraphs FROM r GROUP BY file_path"
_LAWP = f"""{_extract("law")},
    a AS (SELECT * REPLACE ({_hierarchy("text")} AS hierarchy_level, {_any("text", C.LAW_SECTIONS)} AS is_law_section), row_number() OVER (PARTITION BY file_path ORDER BY pos) AS place FROM y),
    b AS (SELECT * REPLACE ({_format("text", "law")} AS text) FROM a WHERE NOT {_indicated("text", "law")} AND NOT (place <= 3 AND {_head} AND NOT {_any("text", C.LAW_HEAD_KEEP)}) AND NOT {_page("text", "law")} AND NOT {_foot} AND NOT {_deco}),
    z AS (SELECT * REPLACE ({_standard_law("text")} AS text) FROM b WHERE length(text) > 0),
    r AS (SELECT *, CASE WHEN style = 'Table' THEN 'table' WHEN hierarchy_level > 0 THEN 'heading' || least(hierarchy_level, 3) WHEN coalesce(is_bold, false) AND font_size > 12 THEN 'title' WHEN coalesce(is_italic, false) THEN 'italic' ELSE 'plain' END AS role,
        CASE WHEN row_number() OVER (PARTITION BY file_path ORDER BY pos) = 1 THEN NULL WHEN hierarchy_level IN (1, 2) THEN 1.0::DOUBLE WHEN hierarchy_level = 3 THEN 0.5::DOUBLE END AS spacer_before FROM z)"""
SQL["clean_law_paragraphs"] = f"WITH {_LAWP} SELECT file_path, pos, text, hierarchy_level, is_law_section, role, spacer_before FROM r"
SQL["law_spacers"] = f"WITH {_LAWP} SELECT file_path, pos * 2 + 1 AS seq, text, style, font_size FROM r UNION ALL SELECT file_path, pos * 2, '', 'Empty', spacer_before FROM r WHERE spacer_before IS NOT NULL"
_tests = ", ".join(f"{f('text', k)} AS {n}_{k}" for n, f in (("box", _box), ("furniture", _furniture), ("indicated", _indicated), ("page_number", _page)) for k in ("contract", "law"))
SQL["line_verdicts"] = f"SELECT file_path, pos, {_tests}, {_foot} AS footnote, {_deco} AS decoration, {_head} AS law_head FROM paragraphs"
SQL["neighbor_context_filter"] = f"WITH q AS (SELECT file_path, pos, regexp_replace({_strip('text')}, '\\A- *([0-9]+) *-\\z', '\\1') AS text FROM paragraphs) SELECT file_path, pos, text FROM (SELECT *, {_lone} AS lone FROM q WINDOW o AS (PARTITION BY file_path ORDER BY pos)) WHERE lone"
SQL["hierarchy_levels"] = f"SELECT file_path, pos, {_hierarchy(_strip('text'))} AS level, {_any('text', C.LAW_SECTIONS)} AS is_section FROM paragraphs"
SQL["cleaning_report"] = "SELECT count(*) AS n_files, count(*) FILTER (extraction_success) AS n_cleaned, count(*) FILTER (NOT extraction_success) AS n_failed FROM extracted_docs"
SQL["contract_titles"] = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY pos) AS n FROM (SELECT file_path, pos, {_strip("text")} AS text FROM paragraphs) WHERE length(text) > 0),
    f AS (SELECT file_path, min_by(text, n) FILTER (n <= 5 AND {_any("text", T.TITLE_WORDS)}) AS t FROM p GROUP BY file_path) SELECT f.file_path, coalesce({_clip(_strip("t"), 100)}, file_stem) AS title FROM f LEFT JOIN extracted_docs USING (file_path)"""
SQL["standardize_contract"] = f"SELECT chunk_id, {_standard_contract('text')} AS text FROM chunks"
SQL["standardize_law"] = f"SELECT chunk_id, {_standard_law('text')} AS text FROM chunks"
_numeral = "CASE n " + " ".join(f"WHEN {_q(w)} THEN '{v}'" for v, w in enumerate(_WORDS20, 1)) + " ELSE n END"
SQL["standardize_parts"] = f"""SELECT file_path, pos, {_dates("text", True)} AS dated, {_refs("text")} AS cited, {_amounts("text")} AS amounts, {_numbers("text")} AS numbers, {_law_clauses("text")} AS law_clauses, {_contract_numbers("text")} AS contract_clauses,
    {_numeral} AS numeral FROM (SELECT *, regexp_extract(text, '第([{T.NUMERALS}]+)条', 1) AS n FROM paragraphs)"""
SQL["text_previews"] = f"SELECT chunk_id, {_preview('text', 100)} AS law_preview, {_preview('text', 120)} AS contract_preview, substr(text, 1, 60) AS line_preview, {_clip(_strip(_line('text')), 50)} AS head FROM chunks"

# --- index and import --------------------------------------------------------------------------------------------------

_SCAN = "scan AS (SELECT file_path AS source_file, md5(full_text) AS content_hash, coalesce(octet_length(encode(full_text)), 0)::BIGINT AS file_size FROM extracted_docs)"
_MAN = "man AS (SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY processed_at DESC NULLS LAST, content_hash DESC NULLS LAST, document_count DESC NULLS LAST, file_size DESC NULLS LAST) = 1)"
_DIFF = f"""{_SCAN}, {_MAN},
    diff AS (SELECT s.*, CASE WHEN s.content_hash IS NULL THEN 'failed' WHEN m.source_file IS NULL THEN 'new' WHEN m.content_hash IS NOT DISTINCT FROM s.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM scan s LEFT JOIN man m USING (source_file))"""
_ROWS = "rws AS (SELECT DISTINCT chunk_id::VARCHAR AS id, text AS document, file_path AS source_file FROM chunks), cnt AS (SELECT source_file, count(*) AS n FROM rws GROUP BY 1)"
SQL["md5_fingerprint"] = f"WITH {_SCAN} SELECT * FROM scan"
SQL["manifest_latest"] = f"WITH {_MAN} SELECT source_file, content_hash, processed_at, document_count, coalesce(file_size, 0) AS file_size FROM man"
SQL["manifest_diff"] = f"WITH {_DIFF} SELECT * FROM diff"
SQL["incremental_upsert"] = f"""WITH {_DIFF}, {_ROWS}, chg AS (SELECT source_file FROM diff WHERE status IN ('new', 'modified') AND source_file IN (SELECT source_file FROM cnt))
    SELECT 'old-' || id AS id, source_file, document FROM rws WHERE source_file IN (SELECT source_file FROM manifest) AND source_file NOT IN (SELECT source_file FROM chg)
    UNION ALL SELECT id, source_file, document FROM rws WHERE source_file IN (SELECT source_file FROM chg)"""
SQL["manifest_after_import"] = f"""WITH {_DIFF}, {_ROWS}, fresh AS (SELECT d.source_file, d.content_hash, '2025-01-01T00:00:00' AS processed_at, c.n::INTEGER AS document_count, d.file_size FROM diff d JOIN cnt c USING (source_file) WHERE d.status IN ('new', 'modified'))
    SELECT source_file, content_hash, processed_at, document_count, coalesce(file_size, 0) AS file_size FROM man WHERE source_file NOT IN (SELECT source_file FROM fresh) UNION ALL SELECT * FROM fresh"""
SQL["import_stats"] = f"""WITH {_DIFF}, {_ROWS}, f AS (SELECT status, coalesce(n, 0) AS n, status IN ('new', 'modified') AS fresh FROM diff LEFT JOIN cnt USING (source_file))
    SELECT count(*) AS scanned_files, count(*) FILTER (status = 'new' AND n > 0) AS new_files, count(*) FILTER (status = 'modified' AND n > 0) AS modified_files, count(*) FILTER (status = 'unchanged') AS unchanged_files,
        count(*) FILTER (status = 'failed' OR (fresh AND n = 0)) AS failed_files, coalesce(sum(n) FILTER (fresh), 0)::BIGINT AS total_chunks, coalesce(sum(n) FILTER (fresh AND n > 0), 0)::BIGINT AS added_chunks,
        round(count(*) FILTER (fresh AND n > 0) * 100.0 / greatest(count(*), 1), 6) AS success_rate FROM f"""
SQL["collection_count"] = f"WITH {_ROWS} SELECT count(*) AS n, count(DISTINCT source_file) AS n_files FROM rws"

# --- retrieval ---------------------------------------------------------------------------------------------------------

_dist = "round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def _many(corpus: str) -> str:
    return f"""SELECT query_id, hit_id, distance, rank, round(1 - distance, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, hit_id)::INTEGER AS rank FROM
    (SELECT q.vec_id AS query_id, c.vec_id AS hit_id, {_dist.format(a="c.embedding", b="q.embedding")} AS distance FROM ({corpus}) c JOIN embeddings q ON q.vec_id % 100 = 0)) WHERE rank <= 3"""


SQL["vector_topk"] = f"""SELECT vec_id, label, distance, round(1 - distance, 6) AS similarity FROM (SELECT e.vec_id, e.label, {_dist.format(a="e.embedding", b="q.embedding")} AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)
    ORDER BY distance, vec_id LIMIT 5"""
SQL["vector_topk_many"] = _many("SELECT * FROM embeddings")
SQL["vector_topk_where"] = _many("SELECT * FROM embeddings WHERE label >= 3 AND label NOT IN (5, 7)")
SQL["vector_topk_where_document"] = _many("SELECT e.* FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE contains(d.text, '第一条') AND NOT contains(d.text, '质押')")


def _context(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\[相似度: [0-9.]+\\]', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '[{_SP}]+', ' ', 'g')")


_three = "round(similarity::DECIMAL(9, 6), 3)::DECIMAL(9, 3)::VARCHAR"
SQL["format_hits"] = f"""WITH h AS (SELECT h.*, coalesce(d.text, '') AS raw, {_context("d.text")} AS doc FROM ({_many("SELECT * FROM embeddings")}) h LEFT JOIN documents d ON d.doc_id = h.hit_id)
    SELECT query_id, concat_ws(chr(10), '{P.HEADING}', string_agg(CASE WHEN doc <> '' THEN rank || '. [相似度: ' || {_three} || '] ' || {_clip("doc", 100)} END, chr(10) ORDER BY rank)) AS context,
        concat_ws(chr(10), '{P.HEADING}', string_agg(rank || '. [相似度: ' || {_three} || '] ' || {_clip("raw", 150)}, chr(10) ORDER BY rank)) AS raw_context FROM h GROUP BY query_id"""
SQL["pooled_embeddings"] = """WITH m AS (SELECT label, k, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY label, k)
    SELECT label, k::INTEGER AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m"""

# --- prompts -----------------------------------------------------------------------------------------------------------

_R = "r AS (SELECT DISTINCT result_id, clause, retrieved_knowledge, prompt, response, time_seconds FROM result)"
SQL["context_cleaner"] = f"WITH {_R} SELECT result_id, {_context('retrieved_knowledge')} AS context FROM r"
SQL["build_prompt"] = f"""WITH {_R}, l AS (SELECT *, list_filter(string_split(coalesce(retrieved_knowledge, ''), chr(10)), lambda x: x <> '' AND NOT starts_with(x, '【')) AS ls FROM r),
    k AS (SELECT *, list_filter(list_transform(ls, lambda x: {_context("x")}), lambda x: x <> '') AS ks FROM l),
    f AS (SELECT *, list_transform(ks, lambda x: substr(CASE WHEN contains(x, '. ') THEN substr(x, instr(x, '. ') + 2) ELSE x END, 1, 80))[1:3] AS fs FROM k)
    SELECT result_id, {_q(P.REVIEW[0])} || clause || {_q(P.REVIEW[1])} || CASE WHEN len(fs) = 0 THEN {_q(P.NO_REFERENCES)} ELSE '【参考资料】' || chr(10) || array_to_string(list_transform(fs, lambda x, i: i || '. ' || x), chr(10)) END || {_q(P.REVIEW[2])} AS review,
        {_q(P.LONG_REVIEW[0])} || clause || {_q(P.LONG_REVIEW[1])} || coalesce(retrieved_knowledge, '') || {_q(P.LONG_REVIEW[2])} AS long_review FROM f"""
SQL["plain_prompts"] = f"WITH {_R} SELECT result_id, {_q(P.SIMPLE[0])} || clause || {_q(P.SIMPLE[1])} AS simple, {_q(P.FALLBACK)} || clause AS fallback FROM r"
SQL["timeout_tiers"] = f"WITH {_R} SELECT result_id, CASE WHEN length(prompt) < 100 THEN 30 WHEN length(prompt) < 300 THEN 60 WHEN length(prompt) < 500 THEN 120 ELSE 180 END AS seconds FROM r"
SQL["latency_classes"] = f"WITH {_R} SELECT CASE WHEN time_seconds > 60 THEN 'slow' WHEN time_seconds > 30 THEN 'long' WHEN time_seconds IS NOT NULL THEN 'good' END AS latency, count(*) AS n FROM r GROUP BY 1"
SQL["review_json"] = f"WITH {_R} SELECT DISTINCT r.*, t.review_time AS timestamp, 6::INTEGER AS n_fields FROM r JOIN result t USING (result_id)"
SQL["cleaning_report_by_folder"] = """SELECT regexp_extract(file_path, '(?s)\\A(.*)/[^/]*\\z', 1) AS folder, count(*) AS n_files, count(*) FILTER (extraction_success) AS n_cleaned, count(*) FILTER (NOT extraction_success) AS n_failed FROM extracted_docs GROUP BY 1"""
SQL["statistics_with_folders"] = f"""SELECT s.*, n.folder, d.contract_title FROM ({SQL["chunk_stats"]}) s LEFT JOIN ({SQL["folder_names"]}) n USING (file_path) LEFT JOIN extracted_docs d USING (file_path)"""
SQL["replaced_rows"] = f"""WITH {_DIFF}, {_ROWS} SELECT source_file, CASE WHEN source_file IN (SELECT source_file FROM manifest) THEN n ELSE 0 END AS deleted, n AS added FROM diff JOIN cnt USING (source_file) WHERE status IN ('new', 'modified')"""

# --- files -------------------------------------------------------------------------------------------------------------

SQL["chunk_files_read_back"] = f"""WITH c AS (SELECT DISTINCT * EXCLUDE (chunk_id, loaded_at, import_time) FROM chunks), n AS (SELECT file_path, count(*)::INTEGER AS total_chunks FROM c GROUP BY 1)
    SELECT DISTINCT text AS document, source, file_path, total_chunks, total_chunks_in_doc, source_stem, contract_title, clause_type, header AS clause_header, contract_party, clause_priority, chunk_size, chunk_preview FROM c JOIN n USING (file_path) WHERE text <> ''"""
_shown = "regexp_replace({}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
SQL["word_files_read_back"] = f"""SELECT md5(file_path) AS document, (row_number() OVER (PARTITION BY file_path ORDER BY pos) - 1)::INTEGER AS pos, replace(coalesce({_shown.format("text")}, ''), chr(13), chr(10)) AS text, coalesce(style, 'Normal') AS style,
    coalesce(font_size, 11) AS font_size, coalesce(is_bold, false) AS is_bold, coalesce(is_italic, false) AS is_italic, coalesce(alignment, 'LEFT') AS alignment FROM paragraphs QUALIFY coalesce(style, '') <> 'Table'"""
_seen = _strip(_shown.format("text"))
SQL["word_texts_read_back"] = f"""WITH {_CONTRACT}, t AS (SELECT file_path, pos * 2 AS place, '[表格内容]' AS t FROM r WHERE role = 'table' UNION ALL SELECT file_path, pos * 2 + 1, replace({_seen}, chr(13), chr(10)) FROM r)
    SELECT md5(file_path) AS document, string_agg(t, chr(10) || chr(10) ORDER BY place) AS full_text, count(*)::INTEGER AS total_paragraphs, true AS extraction_success FROM t WHERE length(t) > 0 GROUP BY file_path"""

"""Column functions on text. All are built-in expressions; white space and digits are those of Unicode.

Character classes are written so that every regular-expression engine in use reads them alike: no shorthand for white
space or digits, end of text as ``\\z``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIGIT = r"\p{Nd}"
NUMERALS = "一二三四五六七八九十"
NUMERALS_LONG = NUMERALS + "百千万零"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of two and more white-space signs as one blank; a single line end or tab stays."""
    return F.regexp_replace(col(c), rf"[{SPACE}]{{2,}}", " ")


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Does the text contain one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(col(c), F.lit(word))
    return found


def clip(c: Column | str, size: int) -> Column:
    """At most ``size`` characters, with ``...`` where some were left out."""
    c = col(c)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def first_line(c: Column | str) -> Column:
    return F.substring_index(col(c), "\n", 1)


def preview(c: Column | str, size: int) -> Column:
    """The first ``size`` characters on one line."""
    c = col(c)
    return F.concat(F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" ")), F.when(F.length(c) > size, "...").otherwise(""))


MARK = "\ufdd0"  # a noncharacter, which no text may hold; it marks places between two steps and never stays


# --- standardisers -----------------------------------------------------------------------------------------------------


def _numerals(c: Column, before: str, after: str) -> Column:
    """A single Chinese numeral between two literals as a number."""
    for value, sign in enumerate(NUMERALS, 1):
        c = F.replace(c, F.lit(f"{before}{sign}{after}"), F.lit(f"{before}{value}{after}"))
    return c


def numeral_value(c: Column | str, most: int) -> Column:
    """Number of a Chinese numeral up to ``most`` (10 or 20); anything else stays as it is."""
    words = [*NUMERALS, *("十" + n for n in NUMERALS[:9]), "二十"][:most]
    entries = [x for i, w in enumerate(words, 1) for x in (F.lit(w), F.lit(str(i)))]
    return F.coalesce(F.element_at(F.create_map(*entries), col(c)), col(c))


def contract_clause_numbers(c: Column | str) -> Column:
    c = let(col(c), lambda x: F.when(x.rlike(f"第[{NUMERALS}]条"), _numerals(x, "第", "条")).otherwise(x))
    return F.regexp_replace(c, rf"Article[{SPACE}]*({DIGIT}+)", "Article $1")


def law_clause_numbers(c: Column | str) -> Column:
    def all_units(x: Column) -> Column:
        for unit in "章节条款":
            x = _numerals(x, "第", unit)
        return _numerals(x, "(", ")")

    return let(col(c), lambda x: F.when(x.rlike(rf"第[{NUMERALS}][章节条款]|\([{NUMERALS}]\)"), all_units(x)).otherwise(x))


def dates(c: Column | str, with_day_word: bool = False) -> Column:
    """Numeric dates in the form of the language, without padding; optionally ``号`` as ``日``."""
    d4, d2 = rf"({DIGIT}{{4}})", rf"({DIGIT}{{1,2}})"
    c = F.regexp_replace(col(c), rf"{d4}[-/]{d2}[-/]{d2}", "$1年$2月$3日")
    c = F.regexp_replace(c, rf"{d4}\.{d2}\.{d2}", "$1年$2月$3日")
    return F.regexp_replace(c, rf"{d4}年{d2}月{d2}号", "$1年$2月$3日") if with_day_word else c


def thousands(c: Column | str) -> Column:
    """The thousands separator in one pass, so of several in one number every other one."""
    return F.regexp_replace(col(c), rf"({DIGIT}+)[,，]({DIGIT}{{3}})", "$1$2")


def contract_amounts(c: Column | str) -> Column:
    number = rf"[{SPACE}]*({DIGIT}+(?:\.{DIGIT}+)?)[{SPACE}]*"
    c = F.regexp_replace(thousands(c), rf"人民币{number}元", "人民币$1元")
    return F.regexp_replace(c, rf"RMB{number}yuan", "人民币$1元")


def law_numbers(c: Column | str) -> Column:
    c = F.regexp_replace(thousands(c), rf"({DIGIT}+)元人民币", "$1元")
    return F.regexp_replace(c, rf"百分之({DIGIT}+)", "$1%")


def law_references(c: Column | str) -> Column:
    """Citations in tight form; a Chinese article number up to twenty becomes a number."""
    name, mark = rf"《[{SPACE}]*([^》]+)[{SPACE}]*》[{SPACE}]*第[{SPACE}]*", MARK
    c = F.regexp_replace(col(c), rf"{name}({DIGIT}+)[{SPACE}]*条", "《$1》第$2条")
    c = F.regexp_replace(c, rf"{name}([{NUMERALS}]+)[{SPACE}]*条", f"{mark}《$1》第$2条")
    words = [*NUMERALS, *("十" + n for n in NUMERALS[:9]), "二十"]

    def numbered(x: Column) -> Column:
        for value, word in enumerate(words, 1):
            x = F.regexp_replace(x, rf"{mark}(《[^》]+》)第{word}条", f"$1第{value}条")
        return F.replace(x, F.lit(mark), F.lit(""))

    return let(c, lambda x: F.when(F.contains(x, F.lit(mark)), numbered(x)).otherwise(x))


def standard_contract(c: Column | str) -> Column:
    return contract_amounts(dates(contract_clause_numbers(c)))


def standard_law(c: Column | str) -> Column:
    return law_numbers(law_references(dates(law_clause_numbers(c), with_day_word=True)))


# --- names -------------------------------------------------------------------------------------------------------------

# Fixed values
TITLE_WORDS = ["合同", "协议", "协议书", "契约", "合约", "约定书"]
UNNAMED = "未命名合同"


def contract_title(paragraphs: Column, stem: Column) -> Column:
    """The first of five paragraphs that names a contract, else the file stem; without paragraphs a fixed name."""
    named = F.get(F.filter(F.slice(paragraphs, 1, 5), lambda p: contains_any(p, TITLE_WORDS)), F.lit(0))
    return F.when(F.size(paragraphs) == 0, F.lit(UNNAMED)).otherwise(F.coalesce(clip(strip(named), 100), stem))


def folder_name(c: Column | str) -> Column:
    """A name that every file system takes."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[<>:"/\\|?*\n\r\t]', "_")
    c = F.regexp_replace(F.regexp_replace(c, r"\A[. ]+|[. ]+\z", ""), "_+", "_")
    c = F.substring(c, 1, 80)
    return F.when(F.length(strip(c)) == 0, F.lit(UNNAMED)).otherwise(c)

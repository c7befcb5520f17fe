"""Defective prompt and response pairs, with the kind of defect.

``truncated`` is the verdict of the truncation operator on the response, which weighs neighbours in sorted order with a
long common start and the spikes of response lengths. The other kinds are rules on the pair:

* ``empty``: null, nothing but blanks or unseen characters, or a bare placeholder;
* ``copies_question``: most of the response's runs of characters stand in the prompt or the clause, with no section of an
  answer of its own;
* ``refusal``: no section of an answer, no copy, and words that decline;
* ``wrong_language``: outside quotations, the script or, in Latin letters, the runs of letters are not those of the
  language that the prompt asks for (a prompt that names none asks for the language it is written in); what English looks
  like is learned from the documents labelled so.

A pair can have several defects and gives one row for each. Defined cases: of rows with one id the one loaded last
counts; a null prompt asks for nothing, so neither copy nor wrong language can be told; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.neardup import compact
from lexmill.llm.truncation import PLACEHOLDERS, SECTIONS, cut_values, latest, repeats
from lexmill.runtime import durable, table

# Words that decline.
DECLINES = re.compile(
    r"抱歉|对不起|无法|不能|不便|不宜|没有权限|无权|超出|恕难|恕不|不予|跳过|不在服务|不允许|选择不|不作判断|不作评价|不发表|执业资格|并不具备|拦截|拒绝|不回答|敏感信息|"
    r"sorry|unable|cannot|can't|can’t|not able|declin|must refuse|outside what|outside the scope|usage policy|keeps me from|not permitted|rather not|licensed lawyer|won't|will not be able",
    re.IGNORECASE,
)

SAMPLE = 2_000  # labelled English documents that the language model is fitted on, at most
STRANGE = 0.43  # how far from usual English to text of unseen trigrams a text may lie and still pass as English
_QUOTED = re.compile(r"“[^”]*”|\"[^\"\n]*\"|「[^」]*」|『[^』]*』|《[^》]*》|`[^`]*`")
_KANA, _HANGUL, _HAN = re.compile(r"[぀-ゟ゠-ヿ]"), re.compile(r"[가-힣ᄀ-ᇿ]"), re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_OTHER = re.compile(r"[Ѐ-ӿ֐-ۿऀ-๿]")
_WORD = re.compile(r"[A-Za-zÀ-ɏḀ-ỿ']+")
_FOREIGN = re.compile(r"[^a-z]")


def trigrams(text: str) -> list[str]:
    """The runs of three letters of the Latin words of a text, with word borders; letters beyond a-z are one sign."""
    words = (f" {_FOREIGN.sub('*', w.lower().replace(chr(39), ''))} " for w in _WORD.findall(text))
    return [w[k : k + 3] for w in words for k in range(len(w) - 2)]


class English:
    """Letter trigrams of English; at most 28 ** 3 numbers, whatever the corpus."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 0.5 * 28**3
        self.floor = math.log(0.5 / total)
        self.log = {g: math.log((n + 0.5) / total) for g, n in counts.items()}
        usual = sum(n * self.log[g] for g, n in counts.items()) / max(sum(counts.values()), 1)
        self.least = usual + STRANGE * (self.floor - usual)

    def speaks(self, text: str) -> bool:
        """Is the text as likely as English text may be."""
        found = trigrams(text)
        return sum(self.log.get(g, self.floor) for g in found) >= self.least * len(found)


def _count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        counts = Counter(g for text in batch.column(0).to_pylist() for g in trigrams(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "n"])


def english(documents: DataFrame, most: int = SAMPLE) -> English | None:
    """The model of up to ``most`` documents labelled English, chosen by a hash of their id; None without any."""
    some = documents.where("lang = 'en' AND text IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most)
    counts = some.select("text").mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = {r.gram: r.n for r in counts.collect()}  # at most 28 ** 3 rows
    return English(found) if found else None


def asked_language(prompt: str | None) -> str | None:
    """``zh``, ``en`` or None: what the prompt asks for."""
    if not prompt or not prompt.strip():
        return None
    for language, words in (("zh", r"请?(用|使用|以)\s*(简体)?中文|(answer|reply|respond) in chinese"), ("en", r"(answer|reply|respond|write) in english|请?(用|使用|以)\s*英文|用英语")):
        if re.search(words, prompt, re.IGNORECASE):
            return language
    han, latin = len(_HAN.findall(prompt)), len(re.findall(r"[A-Za-z]", prompt))
    return "zh" if 2 * han >= latin else "en"


def language(text: str, model: English | None = None) -> str | None:
    """``zh``, ``en``, ``other`` or None (too little text to tell) of a text without its quotations.

    Scripts tell Chinese from others; text in Latin letters is English if the model finds it likely, or without a model.
    """
    free = _QUOTED.sub(" ", text)
    if len(_WORD.findall(free)) + len(_HAN.findall(free)) + len(_KANA.findall(free)) + len(_HANGUL.findall(free)) < 4:
        free = text
    han, kana, hangul, far = (len(p.findall(free)) for p in (_HAN, _KANA, _HANGUL, _OTHER))
    words = len(_WORD.findall(free))
    if kana >= 3 and kana * 8 >= han or hangul >= 3 and hangul * 3 >= han or far > han + words:
        return "other"
    if han >= max(2, words):
        return "zh"
    if words < 3:
        return None
    return "en" if model is None or model.speaks(free) else "other"


def defects(prompt: str | None, clause: str | None, response: str | None, model: English | None = None) -> list[str]:
    """The defects that the pair itself shows, without ``truncated``."""
    form = compact(response or "").lower()
    if form in PLACEHOLDERS:
        return ["empty"]
    found = []
    answered = any(first in response and (second in response or final in response) for first, second, final in SECTIONS) or bool(re.match(r"\s*(风险等级|Risk level)\s*[:：]", response))
    copied = bool(prompt or clause) and repeats(response, f"{prompt or ''}\n{clause or ''}")
    if copied:
        return ["copies_question"]
    asked, spoken = asked_language(prompt), language(response, model)
    if not answered and DECLINES.search(response) and spoken in ("zh", "en", None):
        found.append("refusal")
    if asked and spoken and asked != spoken:
        found.append("wrong_language")
    return found


def _judge(model: English | None):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [defects(*pair, model) for pair in zip(*(batch.column(c).to_pylist() for c in ("prompt", "clause", "response")))]
            at = [k for k, names in enumerate(found) for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("result_id").take(pa.array(at, pa.int64())), pa.array([n for names in found for n in names], pa.string())], ["result_id", "defect"])

    return run


def defective_pairs(rows: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``result_id, defect`` of every defective pair, one row a defect. ``documents`` (``doc_id, text, lang``) is what the
    language model is fitted on; without it all text in Latin letters passes as English."""
    slim = latest(rows).select("result_id", "prompt", "clause", "response")
    by_rule = slim.mapInArrow(_judge(None if documents is None else english(documents)), "result_id long, defect string")
    cut = cut_values(rows).where("is_cut AND field_name = 'response'").select("result_id", F.lit("truncated").alias("defect"))
    return by_rule.unionByName(cut).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(table(spark, sf_dir, "result"), table(spark, sf_dir, "documents"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of each source."""
    rows = table(spark, sf_dir, "result")
    found = durable(defective_pairs(rows, table(spark, sf_dir, "documents")), "defects")
    named = latest(rows).select("result_id", "source").join(found, "result_id", "left")
    return named.groupBy("source", "defect").agg(F.countDistinct("result_id").alias("n_pairs"))

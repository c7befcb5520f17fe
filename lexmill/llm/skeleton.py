"""One consistent form for text that reads the same: the skeleton of a string.

Decompose, replace every character by the prototype of its look-alikes, leave out what cannot be seen, decompose again.
Two strings read the same exactly when their skeletons are equal. Width, font and kind of a character or blank do not
matter; letter case, digits, circled and raised digits and visible accents do.

Defined cases: a null text has a null skeleton and belongs to no group; an empty text and a text of unseen characters
alone have the empty skeleton; an id that comes twice counts once; an empty table gives no rows; very long texts are
processed whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.blocks import expand_pairs, pairs_within
from lexmill.runtime import durable, table

# Letters that are drawn as the ASCII letter after them, as the Unicode confusables have it (one letter for one
# letter; of I, l and 1, which have one prototype there, the letter of the same case), by script, without rare phonetic signs and
# forms that differ in upright type; then dashes and kana.
LOOKALIKES = dict(
    p.split("=")
    for p in (
        "ı=i Ʀ=R ɑ=a ɡ=g ɣ=y ɩ=i ɪ=i ʋ=u ʏ=y ᴄ=c ᴏ=o ᴑ=o ᴜ=u ᴠ=v ᴡ=w ᴢ=z ꜱ=s Ꞙ=F ꞙ=f Ʝ=J Ꭓ=X "
        "Ϳ=J Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X α=a γ=y ι=i ν=v ο=o ρ=p σ=o υ=u Ϝ=F ϳ=j Ϻ=M ϲ=c Ϲ=C "
        "Ѕ=S І=I Ј=J А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X а=a е=e о=o р=p с=c у=y х=x ѕ=s і=i ј=j ѡ=w Ѵ=V ѵ=v Ү=Y ү=y һ=h ҽ=e Ӏ=I ӏ=l ԁ=d Ԍ=G ԛ=q Ԝ=W ԝ=w "
        "ꙇ=i Ԁ=D Ԛ=Q "
        "Ս=U Տ=S Օ=O ա=w գ=q զ=q հ=h ո=n ռ=n ս=u ց=g ք=f օ=o "
        "Ꭰ=D Ꭱ=R Ꭲ=T Ꭹ=Y Ꭺ=A Ꭻ=J Ꭼ=E Ꮃ=W Ꮇ=M Ꮋ=H Ꮍ=Y Ꮐ=G Ꮓ=Z Ꮢ=R Ꮤ=W Ꮥ=S Ꮩ=V Ꮪ=S Ꮮ=L Ꮯ=C Ꮲ=P Ꮶ=K Ᏻ=G Ᏼ=B ꭵ=i ꮁ=r ꮃ=w ꮓ=z ꮩ=v ꮪ=s ꮯ=c "
        "Ⲏ=H Ⲓ=I Ⲕ=K Ⲙ=M Ⲛ=N Ⲟ=O ⲟ=o Ⲣ=P ⲣ=p Ⲥ=C ⲥ=c Ⲧ=T Ⲩ=Y Ⲭ=X Ⳑ=L "
        "ꓐ=B ꓑ=P ꓒ=d ꓓ=D ꓔ=T ꓖ=G ꓗ=K ꓙ=J ꓚ=C ꓜ=Z ꓝ=F ꓟ=M ꓠ=N ꓡ=L ꓢ=S ꓣ=R ꓦ=V ꓧ=H ꓪ=W ꓫ=X ꓬ=Y ꓮ=A ꓰ=E ꓲ=I ꓳ=O ꓴ=U "
        "‐=- ‑=- −=- ⁃=- ⺀=冫 エ=工 ロ=口 カ=力 ニ=二 ハ=八 タ=夕 ト=卜"
    ).split()
)

# Radicals of U+2E81-2EF3 and the characters they are drawn as.
RADICALS = dict(
    p.split("=")
    for p in (
        "⺁=厂 ⺄=乙 ⺅=亻 ⺆=冂 ⺇=几 ⺈=刀 ⺉=刂 ⺊=卜 ⺋=㔾 ⺌=小 ⺍=小 ⺎=兀 ⺏=尣 ⺐=尢 ⺒=巳 ⺓=幺 ⺔=彑 ⺖=忄 ⺗=㣺 ⺘=扌 ⺙=攵 ⺛=旡 ⺜=日 ⺝=月 ⺞=歺 ⺟=母 ⺠=民 ⺡=氵 ⺢=氺 "
        "⺣=灬 ⺤=爫 ⺥=爫 ⺦=丬 ⺨=犭 ⺩=王 ⺬=示 ⺭=礻 ⺯=糹 ⺰=纟 ⺱=罓 ⺲=罒 ⺶=羊 ⺹=耂 ⺺=肀 ⺻=聿 ⺼=月 ⺽=臼 ⺾=艹 ⺿=艹 ⻀=艹 ⻁=虎 ⻂=衤 ⻃=覀 ⻄=西 ⻅=见 ⻆=角 ⻈=讠 ⻉=贝 ⻋=车 ⻌=辶 "
        "⻍=辶 ⻎=辶 ⻏=阝 ⻐=钅 ⻑=長 ⻒=镸 ⻓=长 ⻔=门 ⻖=阝 ⻗=雨 ⻘=青 ⻙=韦 ⻚=页 ⻛=风 ⻜=飞 ⻝=食 ⻟=飠 ⻠=饣 ⻢=马 ⻣=骨 ⻤=鬼 ⻥=鱼 ⻦=鸟 ⻧=卤 ⻨=麦 ⻩=黄 ⻪=黾 ⻫=斉 ⻬=齐 ⻭=歯 ⻮=齿 ⻯=竜 ⻰=龙 ⻱=龜 ⻲=亀 ⻳=龟"
    ).split()
)

_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<small>"}  # compatibility kinds that change width or font only
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10)}
_LINES = {0xA, 0xB, 0xC, 0xD, 0x85, 0x2028, 0x2029}


def _prototype(cp: int) -> str:
    ch = chr(cp)
    if cp in _LINES:
        return "\n"
    kind = unicodedata.category(ch)
    if cp == 0x9 or kind == "Zs":
        return " "
    if kind in ("Cf", "Cc") or cp in _UNSEEN or 0xE0100 <= cp <= 0xE01EF:
        return ""
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        tag, parts = parts[0], parts[1:]
        if tag not in _SAME_LOOK and not (tag == "<compat>" and len(parts) == 1 and cp != 0x17F) and not 0xFB00 <= cp <= 0xFB06:
            parts = []
    if not parts:
        return LOOKALIKES.get(ch) or RADICALS.get(ch) or ch
    return "".join(_prototype(int(p, 16)) for p in parts)


class _Prototypes(dict):
    """Prototype of each code point, worked out when it is first met."""

    def __missing__(self, cp: int) -> str:
        self[cp] = found = _prototype(cp)
        return found


_PROTOTYPES = _Prototypes()


def skeleton(text: str) -> str:
    """The consistent form of one text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    return unicodedata.normalize("NFD", text.translate(_PROTOTYPES))


@F.pandas_udf(T.StringType())
def skeleton_of(texts):  # noqa: ANN001, ANN201
    """``skeleton`` as a column function."""
    return texts.map(skeleton, na_action="ignore")


def _marks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = batch.column(1).to_pylist()
        form = pa.array([xxhash.xxh3_128_digest(skeleton(t).encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
        stored = pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), form, stored], ["id", "form", "stored"])


def same_look_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id_a, id_b``: each two rows whose texts have one skeleton but are stored as different characters, once.

    Only groups of one skeleton with at least two stored forms go into the pairing, so copies stored alike, however many,
    cost one partial aggregate; the forms are paired first, then each pair of forms is expanded to its rows. Both steps
    work on arrays of bounded size, so neither a skeleton with many forms nor a form with many rows meets in one task.
    """
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    marks = durable(slim.mapInArrow(_marks, "id long, form binary, stored binary"), "forms")
    classes = marks.groupBy("form", "stored").agg(F.count("*").alias("rows"))
    mixed = classes.groupBy("form").agg(F.count("*").alias("forms")).where("forms > 1")
    classes = durable(classes.join(mixed, "form"), "classes")
    pairs = pairs_within(classes, ["form"], "stored", "forms").select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"))
    members = marks.join(classes.select("form", "stored", F.col("rows").alias("n")), ["form", "stored"]).select(F.col("stored").alias("class"), "id", "n")
    return expand_pairs(pairs, members)


def groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every row with the id of its group (the smallest id of equal skeleton) and the number of stored forms there."""
    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    marks = durable(slim.mapInArrow(_marks, "id long, form binary, stored binary"), "forms").distinct()
    # copies count once on the way to a group's totals, so a hot group costs a partial aggregate
    by_form = marks.groupBy("form", "stored").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    heads = by_form.groupBy("form").agg(F.min("first").alias("group_id"), F.count("*").alias("stored_forms"), F.sum("rows").alias("rows_in_group"))
    return marks.join(heads, "form").select("id", "group_id", "stored_forms", "rows_in_group")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        same_look_pairs(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("table_name"), "id_a", "id_b")
        for name, key, text in (("chunks", "chunk_id", "text"), ("result", "result_id", "clause"))
    ]
    return found[0].unionByName(found[1])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        groups(table(spark, sf_dir, name), key, text).select(F.lit(name).alias("table_name"), "*")
        for name, key, text in (("chunks", "chunk_id", "text"), ("result", "result_id", "clause"))
    ]
    return found[0].unionByName(found[1])


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause in its consistent form."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("id"), skeleton_of("text").alias("form"))
    result = table(spark, sf_dir, "result").select(F.lit("result").alias("table_name"), F.col("result_id").alias("id"), skeleton_of("clause").alias("form"))
    return chunks.unionByName(result)

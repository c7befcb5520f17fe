"""Segmentation against an independent model on templated and random texts."""

import random
import re

from pyspark.sql import functions as F

from lexmill.operators import segment as S


def strings(n, seed):
    rng = random.Random(seed)
    bits = ["第一条", "第二十条", "第3章", "第三章", "第四节", "1.2", "3、", "甲方：", "乙方:", "（一）", "(12)", "①", "a)", "贷款金额：", "违约责任:", "人民币壹万", "¥ 1,000.5", "¥\n20", "2024年1月2日", "合期限：", "一、", "利率", "　", "\n", "\n\n", " ", "文本内容", "\U00020bb7", "担保与抵押", "\r", "\x85"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def frame(spark, texts):
    rows = [(f"f{i:04}", f"n{i}.docx", f"n{i}", "t", t, True) for i, t in enumerate(texts)] + [("bad", "b", "b", "t", None, False)]
    return spark.createDataFrame(rows, "file_path string, file_name string, file_stem string, contract_title string, full_text string, extraction_success boolean")


def python(pattern):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    return pattern.replace(S._D, r"\d").replace(f"[{S.T.SPACE}]", f"[{spaces}]")


def test_law_chunks(spark):
    texts = strings(300, 1)
    got = {}
    for r in S.split_law(frame(spark, texts), 5).orderBy("file_path", "chunk_index").collect():
        got.setdefault(r.file_path, []).append(r.text)
        assert r.chunk_size == len(r.text)
    for i, t in enumerate(texts):
        starts = sorted({m.start() for _, p in S.LAW_STARTS for m in re.finditer(f"(?:{python(p)})[^\n]*", t)} | {0})
        want = [t[a:b].strip() for a, b in zip(starts, [*starts[1:], len(t)])]
        assert got.get(f"f{i:04}", []) == [w for w in want if len(w) >= 5], t


def model(t, least):
    found = []
    for priority, (_, p, anchored) in enumerate(S.CONTRACT_STARTS, 1):
        for m in re.finditer(f"{'(?m:^)' if anchored else ''}(?:{python(p)})[^\n]*", t):
            if all(abs(m.start() - s) >= 5 for s, _, _ in found):
                found.append((m.start(), priority, m[0].strip()))
    found.sort()
    if not found:
        parts = [x.strip() for x in re.split(r"\n\s*\n+", t)]
        return [(x, 999) for x in parts if x and len(x) >= least]
    out = [(t[: found[0][0]].strip(), 0)] if found[0][0] else []
    out += [(t[s:e].strip(), p) for (s, p, _), e in zip(found, [*(f[0] for f in found[1:]), len(t)])]
    return [(x, p) for x, p in out if x and len(x) >= least]


def test_contract_clauses(spark):
    texts = strings(400, 2)
    got = {}
    priorities = set()
    for r in S.split_contract(frame(spark, texts), 4).orderBy("file_path", "chunk_index").collect():
        got.setdefault(r.file_path, []).append((r.text, r.clause_priority))
        priorities.add(r.clause_priority)
    for i, t in enumerate(texts):
        assert got.get(f"f{i:04}", []) == model(t, 4), t
    assert {0, 1, 4, 5, 6, 11, 14, 18, 20, 22, 23, 24, 25, 26, 999} <= priorities
    assert 19 not in priorities


def test_types_and_parties(spark):
    rows = spark.createDataFrame([("合同期限：x",), ("合期限：x",), ("1.1 定义",), ("关于抵押",), ("x" * 99,), ("x" * 299,), ("x" * 300,), ("前文 借款人：y",)], "t string")
    types = [r.x for r in rows.select(S.contract_type("t").alias("x")).collect()]
    assert types == ["短条款", "期限条款", "数字编号", "抵押条款", "短条款", "中等条款", "长条款", "借款条款"]
    assert rows.select(S.contract_party("t").alias("x")).collect()[-1].x == "借款人"


def test_empty_table(spark):
    empty = frame(spark, []).where("false")
    assert S.split_law(empty).count() == 0
    assert S.split_contract(empty).count() == 0


def test_every_law_label_occurs(spark):
    texts = ["第一条x", "第3条x", "第一章x", "第一节x", "1.2 x", "一、x", "（一）x", "(1)x", "①x", "a)x", "文本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in rows.select(S.law_type(F.col("t")).alias("x")).collect()] == [*(label for label, _ in S.LAW_STARTS), S.PLAIN]

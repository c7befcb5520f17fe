"""Skeletons and near-duplicate search against brute force, with nulls, copies, long texts and clashing columns."""

import random

import pytest

from lexmill.llm import neardup as N
from lexmill.llm import skeleton as S
from lexmill.llm.blocks import block_pairs, expand_pairs, pairs_within
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢＣ１，", "ABC1,"), ("Cоmраny", "Company"), ("é", "é"), ("a b", "a b"), ("利​率", "利率"), ("⽇⽉", "日月"), ("⺠⻅", "民见"), ("不", "不"), ("𝟢𝟣", "01"), ("a‑b", "a-b"), ("｡､", "。、"), ("x️", "x"), ("a\tb", "a　b"), ("ǘ", "ǘ")],
)
def test_same_look(a, b):
    assert S.skeleton(a) == S.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("1", "①"), ("é", "e"), ("2", "²"), ("0", "O"), ("己", "已"), ("ab", "a b"), ("未", "末"), ("½", "1⁄2")])
def test_other_look(a, b):
    assert S.skeleton(a) != S.skeleton(b)


def test_form_is_stable():
    for cp in list(range(0x20, 0x3400)) + list(range(0xF900, 0x10000)) + list(range(0x1D400, 0x1D800)):
        if not 0xD800 <= cp <= 0xDFFF:
            once = S.skeleton(chr(cp))
            assert S.skeleton(once) == once, hex(cp)


def test_pairs(spark):
    rows = [(1, "Ａ条款", "x"), (2, "A条款", "y"), (2, "A条款", "y"), (3, "A条款", "z"), (4, None, "n"), (None, "A条款", "n"), (5, "", "e"), (6, "​", "e"), (7, "长" * 50_000, "l"), (8, "长" * 50_000 + "﻿", "l")]
    df = spark.createDataFrame(rows, "id long, text string, form string")  # a column named as an inner one
    found = {(r.id_a, r.id_b) for r in S.same_look_pairs(df, "id", "text").collect()}
    assert found == {(1, 2), (1, 3), (5, 6), (7, 8)}
    assert S.same_look_pairs(df.where("false"), "id", "text").count() == 0
    groups = {r.id: (r.group_id, r.stored_forms, r.rows_in_group) for r in S.groups(df, "id", "text").collect()}
    assert groups[3] == (1, 2, 3) and 4 not in groups


def corpus(n=260, seed=5):
    rng = random.Random(seed)
    words = ["借款人", "应当", "在到期日", "归还", "贷款本息", "并承担", "违约责任", "抵押物", "由第三方", "评估", "费用", "，", "。", "利率为", "年化", "百分之六"]
    rows = []
    for i in range(n):
        base = "".join(rng.choice(words) + chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(3, 60)))
        rows.append((3 * i, base))
        for k in range(rng.choice([0, 0, 1, 2])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 18))):
                text[rng.randrange(len(text))] = chr(0x4E00 + rng.randrange(3000))
            rows.append((3 * i + k + 1, "".join(text)))
    return rows


def jaccard(a, b):
    x, y = ({t[k : k + 4] for k in range(len(t) - 3)} for t in (N.compact(a), N.compact(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_near_duplicates(spark):
    rows = corpus() + [(9000, "同"), (9001, "同"), (9002, "异"), (9003, None), (9004, ""), (9005, " "), (9006, "Ａ" + "很长的条款" * 3000), (9007, "A" + "很长的条款" * 3000 + "尾")]
    rows += rows[:5]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "chunk_id long, text string, class string")
    got = {(r.id_a, r.id_b) for r in N.alike_pairs(df, "chunk_id", "text").collect()}
    texts = {i: t for i, t in rows if t is not None}
    ids = sorted(texts)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if N.compact(texts[a]) == N.compact(texts[b]) or jaccard(texts[a], texts[b]) >= 0.6}
    assert got == want and (9000, 9001) in got and (9004, 9005) in got and (9006, 9007) in got
    assert N.alike_pairs(df.where("false"), "chunk_id", "text").count() == 0


def test_tree_keeps_every_alike_pair():
    import numpy as np

    texts = sorted({N.compact(t) for _, t in corpus(120, 8)})
    h, owner = N._tokens(texts)
    sets = [set(h[owner == k].tolist()) for k in range(len(texts))]
    size = np.array([len(s) for s in sets])
    bits = np.zeros((len(texts), N.WORDS), np.uint64)
    for k, s in enumerate(sets):
        for v in s:
            b = v & (64 * N.WORDS - 1)
            bits[k, b >> 6] |= np.uint64(1) << np.uint64(b & 63)
    order = np.argsort(size, kind="stable")
    # one tree over all, and the same leaves twice as the two sides of a block
    forest = N.Forest(np.zeros(len(order), np.int64), size[order], bits[order])
    root = np.zeros(1, np.int64)
    kept = {(min(order[a], order[b]), max(order[a], order[b])) for i, j in forest.traverse(root, root, 0.6) for a, b in zip(i, j)}
    twice = np.append(order, order)
    sides = N.Forest(np.repeat([0, 1], len(order)), size[twice], bits[twice])
    across = {(twice[a], twice[b]) for i, j in sides.traverse(root, root + 1, 0.6) for a, b in zip(i, j)}
    assert kept == {(a, b) for a, b in across if a < b}
    alike = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert alike <= kept and len(kept) < len(texts) * (len(texts) - 1) / 8


def test_blocks_meet_once(spark):
    df = spark.range(50).withColumn("k", F.lit(1).cast("long"))
    met = block_pairs(df, "k", F.lit(50), F.col("id"), 10).collect()
    groups = {}
    for r in met:
        groups.setdefault(r.block_key, []).append((r.id, r.side))
    pairs = []
    for rows in groups.values():
        far = [i for i, s in rows if s]
        near = [i for i, s in rows if not s]
        pairs += [tuple(sorted((a, b))) for a in near for b in far] if far else [(a, b) for a in near for b in near if a < b]
    assert len(pairs) == len(set(pairs)) == 50 * 49 // 2


@pytest.mark.parametrize("block", [3, 2048])
def test_packed_pairs(spark, block):
    """Hot groups are cut into arrays; pairs are the same."""
    members = spark.createDataFrame([(k, i, n) for k, n in ((1, 20), (2, 2), (3, 1)) for i in range(100 * k, 100 * k + n)] + [(1, 100, 20)], "class long, id long, n long")
    found = [(r.id_a, r.id_b) for r in pairs_within(members, ["class"], "id", "n", block).collect()]
    assert len(found) == len(set(found)) == 20 * 19 // 2 + 1 and all(a < b for a, b in found)
    links = spark.createDataFrame([(1, 2), (1, 3)], "class_a long, class_b long")
    found = [(r.id_a, r.id_b) for r in expand_pairs(links, members, block).collect()]
    assert sorted(found) == sorted((a, b) for a in range(100, 120) for b in (200, 201, 300))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 101)], "class_a long, class_b long")
    found = {r["class"]: r.group for r in N.components(edges).collect()}
    assert found[20] == 0 and found[40] == 21 and found[101] == 100

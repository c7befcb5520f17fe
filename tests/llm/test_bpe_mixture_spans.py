"""Encoding against the public library, mixing against its targets, shared spans against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe, mixture, spans

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def ids_of(texts):
    ids, counts = bpe.encode_texts(texts, bpe.replay("byte_bpe_50k", bpe.TOKENIZERS))
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


CASES = ["", " ", "\n", "it's we'll 're don't 'test 'Tis (’s '' ''s  x 's\n's", "   a  b \n\n c   ", "a" * 999, "　第　 一条", "a\x85b\x1cc\x1d d", "²½①Ⅷ x", "<|endoftext|> hi", "\t\tdon't", "𠮷👍🏽", "a\xa0b", "'", "x'", "'s", " 's", "'re've", "借款人应当" * 400]


def test_hand_cases(library):
    assert ids_of(CASES) == [library.encode(t, add_special_tokens=False).ids for t in CASES]


LIBRARY = tokenizers.Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sSretdmlv第一条，a1　.-_"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), min_size=1, max_size=20))
def test_any_text(texts):
    assert ids_of(texts) == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


def test_columns(spark, library):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9)], "doc_id long, text string, ids int")
    found = sorted((r.doc_id, r.ids) for r in bpe.encode(df, ["doc_id"]).collect() if r.ids is not None)
    assert found == [(1, [64, 275]), (1, [64, 275]), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in bpe.token_counts(df, ["doc_id"]).collect()} == {(1, 2), (2, None), (3, 0)}
    assert bpe.encode(df.where("false"), ["doc_id"]).count() == 0


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(i, "a b " * rng.randint(1, 40), rng.choice(["x", "x", "x", "x", "y", "z"]), "c") for i in range(900)]
    docs += [(9001, None, "x", "c"), (9002, "", "x", "c"), (9003, "a b", None, "c"), (0, docs[0][1], docs[0][2], "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, weight string")
    targets = spark.createDataFrame([("x", 0.2, 1), ("y", 0.5, 3), ("z", 0.2, 4), ("none", 0.1, 2), ("off", 0.0, 1)], "source string, target_share double, max_repeats int")
    sizes = mixture.sized(df).cache()
    plan = mixture.budgets(sizes, targets)
    mixed = mixture.mix(sizes, plan)
    rows = mixed.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r for r in mixture.shares(plan, mixed).collect()}
    assert abs(shares["x"].actual_share - 2 / 9) < 0.01 and abs(shares["y"].actual_share - 5 / 9) < 0.01 and shares["none"].tokens_used == 0
    assert all(r.uses <= {"x": 1, "y": 3, "z": 4}[r.source] for r in rows)
    assert all(s.tokens_used <= s.tokens_budget for s in shares.values())
    y = [r.uses for r in rows if r.source == "y"]
    assert max(y) == 3 and min(y) >= 2  # complete epochs come first
    assert sorted(map(tuple, mixture.mix(sizes, plan).collect())) == sorted(map(tuple, rows))
    none = mixture.sized(df.where("false"))
    assert mixture.mix(none, mixture.budgets(none, targets)).count() == 0


def shared(texts, span):
    at = {}
    for i, t in texts.items():
        for p in range(len(t) - span + 1):
            at.setdefault(t[p : p + span], set()).add(i)
    pairs, cover = set(), {}
    for i, t in texts.items():
        hit = [False] * len(t)
        for p in range(len(t) - span + 1):
            others = at[t[p : p + span]]
            if len(others) > 1:
                hit[p : p + span] = [True] * span
                pairs |= {tuple(sorted((i, j))) for j in others if i != j}
        cover[i] = sum(hit)
    return pairs, cover


def test_spans(spark):
    rng = random.Random(2)
    letters = "借款人应当归还本息利率条款担保𠮷"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (119, 120, 121, 150, 400)]
    texts = {}
    for i in range(60):
        parts = [make(rng.randint(0, 200))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            parts += [p[rng.choice([0, 0, 5]) :], make(rng.randint(0, 90))]
        texts[i] = "".join(parts)
    texts |= {100: "=" * 500, 101: "x" + "=" * 130 + "y", 102: "=" * 119, 103: "ab" * 200, 104: "zz" + "ab" * 90, 105: passages[4] * 2, 106: ""}
    rows = [(i, t, 1) for i, t in texts.items()] + [(0, texts[0], 1), (107, None, 1), (None, passages[4], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    pairs, cover = shared(texts, 120)
    found = [(r.doc_a, r.doc_b) for r in spans.shared_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs and (100, 101) in pairs and (103, 104) in pairs
    got = {}
    for r in spans.shared_parts(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert {i: n for i, n in cover.items() if n} == got
    assert spans.shared_pairs(df.where("false")).count() == 0

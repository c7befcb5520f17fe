"""Shared spans of table-like and periodic texts against brute force."""

import random

import pytest

from lexmill.llm import spans
from tests.llm.test_bpe_mixture_spans import shared


def documents(seed):
    """Texts of rows with the same heads, and of runs that begin and end anywhere in their period."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = {}
    for group in range(25):
        heads = [make(rng.choice([32, 33, 36, 40])) for _ in range(2)]
        lines = [h + make(rng.randint(1, 50)) for h in heads for _ in range(5)]
        units = [make(rng.choice([1, 3, 20, 33, 45, 60, 85, 89, 95])) for _ in range(2)]
        for k in range(rng.randint(2, 4)):
            parts = []
            for _ in range(rng.randint(1, 3)):
                parts.append(make(rng.choice([0, 0, 1, 5, 40, 100])))
                if rng.random() < 0.5:
                    u, n = rng.choice(units), rng.choice([rng.randint(119, 124), rng.randint(119, 900)])
                    o = rng.randrange(len(u))
                    parts.append((u * (n // len(u) + 2))[o : o + n])
                else:
                    parts.append("".join(rng.choice(lines) for _ in range(rng.randint(1, 12))))
            texts[10 * group + k] = "".join(parts)
    # a long run that begins and ends with its phrase, and a part of it that does not
    unit = make(60)
    texts |= {1000: unit * 10, 1001: (unit * 4)[45:165], 1002: make(30) + (unit * 4)[20:141]}
    return texts


def test_pairs_of_tables_and_runs(spark):
    texts = documents(4)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in spans.shared_pairs(df).collect()} == shared(texts, 120)[0]


def pairs_of(rows):
    """Pairs of members of one group."""
    groups = {}
    for r in rows:
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    assert all(len(g) == max(r.docs for r in rows if r.group_id == name) for name, g in list(groups.items())[:20])
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


@pytest.mark.parametrize("block", [50_000, 1])
def test_groups_of_tables_and_runs(spark, block):
    """Blocks inside tasks and blocks spread as rows give the same groups and pairs."""
    texts = documents(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = shared(texts, 120)[0]
    assert pairs_of(spans.shared_groups(df, block=block).collect()) == expected
    assert {(r.doc_a, r.doc_b) for r in spans.shared_pairs(df, block=block).collect()} == expected


@pytest.mark.parametrize("block", [50_000, 200])
def test_one_passage_in_many_documents(spark, block):
    """A group costs its members, not its pairs: 50,000 documents would have 1.2 billion."""
    n = 50_000 if block > 200 else 2_000
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij") for _ in range(150))
    rows = [(i, "".join(rng.choice("klmnopqrst") for _ in range(20)) + passage + "".join(rng.choice("klmnopqrst") for _ in range(20))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = spans.shared_groups(df, block=block).groupBy("group_id").agg({"doc_id": "count", "docs": "max"}).collect()
    assert max(r[1] for r in found) == n and max(r[2] for r in found) == n
    parts = spans.shared_parts(df, block=block).collect()
    assert len(parts) == n and all(r.start <= 20 and r.start + r.length >= 170 for r in parts)


@pytest.mark.parametrize("block", [50_000, 1])
def test_parts_of_tables_and_runs(spark, block):
    texts = documents(4)
    got = {i: [False] * len(t) for i, t in texts.items()}
    for r in spans.shared_parts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect():
        got[r.doc_id][r.start : r.start + r.length] = [True] * r.length
    assert {i: sum(hit) for i, hit in got.items()} == shared(texts, 120)[1]


def test_long_runs_stay_thin():
    text = "x" + "=" * 5000 + "y"
    cp = spans._codes([text])
    assert len(spans.phrase_starts(cp, spans.np.array([len(text)]))[0]) < 10

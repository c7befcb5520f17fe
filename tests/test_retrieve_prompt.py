"""Retrieval against brute force; prompts against golden texts; embedding and statistics."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import embed, prompt, retrieve, stats


def vectors(spark, n=200, size=8, seed=3):
    rng = np.random.default_rng(seed)
    data = [(int(i), [float(x) for x in v], int(i % 5)) for i, v in enumerate(rng.normal(size=(n, size)))]
    data += [(n, [0.0] * size, 0), (n + 1, None, 0), (n + 2, [1.0] * (size - 1), 0), (n + 3, data[0][1], 1)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


def test_top_k(spark):
    data, df = vectors(spark)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data if v and len(v) == 8 and any(v)}
    got = {}
    for r in retrieve.top_k_many(df.repartition(3), df.where("vec_id % 100 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.hit_id, r.distance))
    assert set(got) == {0, 100}
    for q, found in got.items():
        want = sorted((round(1 - float(unit[q] @ v), 6) + 0.0, i) for i, v in unit.items())[:4]
        assert [(d, i) for _, i, d in sorted(found)] == want
    one = retrieve.top_k(df, data[0][1], 4).collect()
    assert [r.vec_id for r in one] == [i for _, i, _ in sorted(got[0])]
    blocks = retrieve.top_k_many(df, df.where("vec_id < 50"), 4, query_rows=7, corpus_rows=11)
    whole = retrieve.top_k_many(df, df.where("vec_id < 50"), 4)
    assert blocks.select("query_id").distinct().count() == 50 and sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))


def test_smallest_keeps_ties():
    rng = np.random.default_rng(3)
    for _ in range(50):
        d = rng.integers(0, 4, (5, 40)).astype(float)
        n = np.broadcast_to(rng.permutation(40), d.shape)
        got = retrieve._smallest(d, n, 3)
        for r in range(5):
            assert list(zip(*(x[r] for x in got))) == sorted(zip(d[r], n[r]))[:3]


def test_filters_keep_rows_without_the_field(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    where = lambda c: [r.n for r in rows.where(retrieve.where_metadata(c)).orderBy("n").collect()]
    assert where({"t": {"$ne": "a"}}) == [2] and where({"t": {"$nin": ["a"]}}) == [2] and where({"t": {"$ne": "b"}}) == [1, 2] and where({"t": {"$gt": ""}}) == [1]


def test_pooled_embedder():
    model = lambda ids, mask: np.stack([ids, ids * 0 + 1.0], -1) * 1.0
    found = embed.PooledEmbedder(lambda t: [ord(c) - 96 for c in t], model, most=3)(["abc", "abcd", "", "b"])
    assert np.allclose(found[0], found[1]) and np.allclose(found[3], np.array([2, 1]) / np.sqrt(5)) and not found[2].any()


def test_filters(spark):
    rows = spark.createDataFrame([(1, "甲乙"), (2, "乙"), (3, "丙")], "n int, t string")
    where = lambda c: [r.n for r in rows.where(retrieve.where_metadata(c)).orderBy("n").collect()]
    assert where({"n": 2}) == [2] and where({"n": {"$gt": 1, "$ne": 3}}) == [2] and where({"$or": [{"n": {"$lte": 1}}, {"n": {"$in": [3]}}]}) == [1, 3] and where({}) == [1, 2, 3]
    assert [r.n for r in rows.where(retrieve.where_document({"$and": [{"$contains": "乙"}, {"$not_contains": "甲"}]}, F.col("t"))).collect()] == [2]


def test_prompts(spark):
    context = "【检索到的相关知识】\n1. [相似度: 0.649] 第十条　利率 [注]\n2. [相似度: 0.627] " + "长" * 90 + "\n\n3. [x]\n无编号"
    row = spark.createDataFrame([("条款", context)], "c string, k string").select(prompt.review_prompt("c", "k").alias("p"), prompt.clean_context("k").alias("x"), prompt.references("k").alias("r")).first()
    assert row.r == ["第十条 利率", "长" * 80, "3.", "无编号"]
    assert row.p.startswith("【角色设定】\n你是一名资深银行法律合规官。\n\n【审查任务】\n请根据以下参考材料，审查合同条款。\n\n【待审条款】\n条款\n\n【参考资料】\n1. 第十条 利率\n2. 长")
    assert row.p.endswith("修改建议：\n[具体修改文本]\n复核提示：\n[复核事项]") and "3. 3.\n\n【审查要求】" in row.p
    none = spark.createDataFrame([("条款", None)], "c string, k string").select(prompt.review_prompt("c", "k").alias("p")).first()
    assert "无相关参考资料。" in none.p
    tiers = spark.createDataFrame([("x" * n,) for n in (99, 100, 300, 500)], "p string").select(prompt.timeout_seconds("p").alias("s"))
    assert [r.s for r in tiers.collect()] == [30, 60, 120, 180]
    kinds = spark.createDataFrame([(61.0,), (60.0,), (30.0,), (None,)], "s double").select(prompt.latency_class("s").alias("k"))
    assert [r.k for r in kinds.collect()] == ["slow", "long", "good", None]


def test_format_hits(spark):
    hits = spark.createDataFrame([(1, 1, "[a] 文" + "字" * 120, 0.6494), (1, 2, "[only]", 0.5), (1, 3, "末", None)], "q int, rank int, document string, similarity double")
    found = prompt.format_hits(hits, ["q"]).first().context.split("\n")
    assert found == ["【检索到的相关知识】", "1. [相似度: 0.649] 文" + "字" * 99 + "...", "3. [相似度: 0.000] 末"]
    raw = prompt.format_hits(hits, ["q"], cleaned=False).first().context.split("\n")
    assert raw[2] == "2. [相似度: 0.500] [only]"


def test_embedding(spark):
    rows = embed.embed(spark.createDataFrame([(1, "利率"), (2, ""), (3, None)], "i int, t string"), "t", "v").orderBy("i").collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-5 and rows[1].v is None and rows[2].v is None
    tokens, mask = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    want = np.array([2.0, 3.0]) / np.sqrt(13)
    assert np.allclose(embed.mean_pool(tokens, mask)[0], want)
    got = spark.createDataFrame([(tokens[0].tolist(), [1, 1, 0])], "v array<array<double>>, m array<int>").select(embed.mean_pooled(F.col("v"), F.col("m")).alias("x")).first().x
    assert np.allclose(got, want)


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 20), ("a", 4, "y", 12), ("b", 2, None, None)], "f string, chunk_index int, clause_type string, clause_priority int").withColumn("text", F.lit("文本")).withColumn("chunk_preview", F.lit("p"))
    c = {r.f: r for r in stats.continuity(rows, "f").collect()}
    assert c["a"].missing == [2, 3] and not c["a"].is_complete and c["b"].is_complete
    assert [(r.f, r.clause_type) for r in stats.top_values(rows, "clause_type", ["f"], k=1).orderBy("f").collect()] == [("a", "y"), ("b", None)]
    assert stats.important(rows, "f").count() == 2
    for bases, want in ((["n", "n", "n_1", "n"], ["n", "n_1", "n_1_1", "n_2"]), (["n_1", "n", "n", "n_1", "m", "m"], ["n_1", "n", "n_2", "n_1_1", "m", "m_1"]), (["a", "a", "a_1", "a_1"], ["a", "a_1", "a_1_1", "a_1_2"])):
        names = spark.createDataFrame([(str(k), b) for k, b in enumerate(bases)], "p string, b string")
        assert [r.folder for r in stats.folder_names(names, "b", ["p"]).orderBy("p").collect()] == want
    report = {r.f: r.report for r in stats.report_lines(rows.withColumn("contract_party", F.lit("甲方")), "f").collect()}
    assert "y: 2 (66.7%)" in report["a"] and "missing: 2, 3" in report["a"] and report["b"].endswith("complete")

"""Splitting, cut values and defective pairs on hand-made rows."""

import random

from pyspark.sql import functions as F

from lexmill.llm import pairs, splitting, truncation


def test_pieces():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["条", "款", "a", "́", "，", "。", "；", "\n", "\n\n", " ", "\r\n", "\U0001f44d", "‍"]) if rng.random() < rng.choice([0.05, 0.4]) else "文" for _ in range(rng.randint(0, 300)))
        limit, overlap = rng.randint(5, 80), rng.randint(0, 60)
        found = splitting.pieces(text, limit, overlap)
        assert "".join(text[b:e] for _, b, e in found) == text
        assert all(e - a <= limit and b - a <= (overlap if overlap < limit else 0) for a, b, e in found)
        assert all(e > b for _, b, e in found) or not text


def test_natural_boundaries():
    text = "第一句话在这里。第二句话也在这里。\n第三句话另起一行。第四句话结束。"
    found = [text[b:e] for _, b, e in splitting.pieces(text, 20, 0)]
    assert found == ["第一句话在这里。第二句话也在这里。\n", "第三句话另起一行。第四句话结束。"]
    assert [(a, b, e) for a, b, e in splitting.pieces("x" * 25, 10, 4)] == [(0, 0, 6), (2, 6, 12), (8, 12, 18), (14, 18, 24), (20, 24, 25)]
    assert [(a, b, e) for a, b, e in splitting.pieces("x" + "́" * 30 + "y" * 5, 34, 0)] == [(0, 0, 34), (34, 34, 36)]


def test_split_table(spark):
    rules = spark.createDataFrame([("A", 10, 2), ("B", None, None), ("*", 20, 50)], "clause_type string, max_chars int, overlap_chars int")
    rows = [(1, "句。" * 8, 4, "头", "A", None, 1), (2, "句。" * 8, 4, None, "C", None, 1), (3, "句。" * 30, None, "", None, None, 1), (4, None, 1, "h", "A", None, 1), (5, "句。" * 30, 1, "h", "B", None, 1), (1, "句。" * 8, 4, "头", "A", None, 1), (6, "长" * 100_000, 0, "h", "A", None, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, chunk_index int, header string, clause_type string, loaded_at timestamp, piece int")
    found = splitting.split_oversized(chunks, rules).collect()
    assert {r.chunk_id for r in found} == {1, 3, 6} and all(len(r.piece) <= r.max_chars for r in found)
    assert [r.header for r in found if r.chunk_id == 1][0] == "头" and sum(r.end - r.body_start for r in found if r.chunk_id == 6) == 100_000
    later = chunks.where("chunk_id = 1").limit(1).select("chunk_id", F.lit("短").alias("text"), "chunk_index", "header", "clause_type", F.current_timestamp().alias("loaded_at"), "piece")
    assert {r.chunk_id for r in splitting.split_oversized(chunks.unionByName(later), rules).collect()} == {3, 6}  # delivered again, short
    assert splitting.split_oversized(chunks.where("false"), rules).count() == 0
    assert splitting.split_oversized(chunks, rules.where("false")).count() == 0


PROMPT = "【角色】\n你在银行合同审查岗工作。\n\n【任务】\n对照参考资料审查下面的条款。\n\n【待审条款】\n{c}\n\n【参考资料】\n{r}\n\n【回答格式】\n风险等级：[高/中/低]\n风险点：[逐条列出]\n差异分析：[逐条列出]\n修改建议：[改写文本]\n复核提示：[复核事项]\n请用中文作答。"
WHOLE = "风险等级：低\n风险点：\n1. 期限偏短：乙方可能无法按期归还第{n}号贷款。\n差异分析：\n- 本条缺少利率上限第{n}项。\n修改建议：\n注明计息基准日。\n复核提示：{e}"
ENDS = ["核对外币折算日。", "核对外币折算日", "检查附件是否齐备。", "检查附件是否齐备。（详见附件）", "检查附件是否齐备"]


def reviews():
    rows, cut, defect = [], set(), {}
    refs = [f"第{n}条 甲方应当按季提交第{n}份报表，差额先行提存。" for n in range(3)]
    know = "\n".join(f"{k + 1}. [相似度: 0.7{k}0] {r}" for k, r in enumerate(refs))

    def add(response, knowledge=know, prompt=PROMPT, clause="借款利率为年化百分之六，按季结息，到期一次归还。"):
        n = len(rows)
        rows.append((n, f"s{n % 3}", clause, knowledge, prompt.format(c=clause, r="\n".join(f"{k + 1}. {r}" for k, r in enumerate(refs))), response, None))
        return n

    for n in range(60):
        add(WHOLE.format(n=n, e=ENDS[n % 5]))
    for n, end in enumerate([17, 40, 55, 70]):
        cut.add((add(WHOLE.format(n=100 + n, e=ENDS[0])[:end]), "response"))
    cut.add((add(WHOLE.format(n=7, e="核对外币")), "response"))
    cut.add((add(WHOLE.format(n=8, e="核对外币折算…")), "response"))
    cut.add((add(WHOLE.format(n=9, e="")), "response"))
    for text in (know[:-9], know[:60], know.rsplit("\n", 1)[0], know.rsplit("] ", 1)[0] + "] ", know[:-3] + "�"):
        cut.add((add(WHOLE.format(n=3, e=ENDS[0]), text), "retrieved_knowledge"))
    add(WHOLE.format(n=3, e=ENDS[0]), know[:-1])  # the last sign alone
    add(WHOLE.format(n=3, e=ENDS[0]), know.rsplit("] ", 1)[0] + "] " + "长" * 100 + "...", PROMPT)
    add("风险等级：低。条款完整。", None)
    for text in (None, "", "  \n", "​", "N/A", "无", "{}", "（空）"):
        defect[add(text)] = "empty"
    for text in ("抱歉，我不能提供法律建议，请咨询持证律师。", "这需要执业资格，我并不具备，请换一个话题。"):
        defect[add(text)] = "refusal"
    for text in ("借款利率为年化百分之六，按季结息，到期一次归还。", "【待审条款】借款利率为年化百分之六，按季结息", "问题：借款利率为年化百分之六,按季结息,到期一次归还"):
        defect[add(text)] = "copies_question"
    for text in ("Risk level: low\nRisk points: The seal is misused is not addressed by the clause.\nReview note: check the ledger of the bank.", "リスク水準は高いです。利息計算の方法が明らかではありません。", "Niveau de risque : moyen. La clause ne précise pas le calcul des intérêts et de la garantie.", "위험 수준: 중간. 이자 계산 방식과 통지 기간이 분명하지 않습니다."):
        defect[add(text)] = "wrong_language"
    add("抱歉，前次意见遗漏一项，现更正如下。\n" + WHOLE.format(n=5, e=ENDS[2]))
    for r in list(rows)[-3:]:
        rows.append(r)
    return rows, cut, defect


SCHEMA = "result_id long, source string, clause string, retrieved_knowledge string, prompt string, response string, loaded_at timestamp"


def test_cut_values_and_pairs(spark):
    rows, cut, defect = reviews()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", value string")
    found = {(r.result_id, r.field_name) for r in truncation.cut_values(df).where("is_cut").collect()}
    assert found == cut, [(i, f, rows[i]) for i, f in sorted(found ^ cut)]
    got = {(r.result_id, r.defect) for r in pairs.defective_pairs(df, spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    assert got == {(i, d) for i, d in defect.items()} | {(i, "truncated") for i, f in cut if f == "response"}
    assert truncation.cut_values(df.where("false")).count() == 0 and pairs.defective_pairs(df.where("false")).count() == 0


def test_nulls_everywhere(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None), (2, None, None, "x" * 200_000, None, "y" * 200_000, None), (None, "s", "c", "k", "p", "r", None)], SCHEMA)
    assert {r.result_id for r in truncation.cut_values(df).collect()} == {2}
    assert {(r.result_id, r.defect) for r in pairs.defective_pairs(df).collect() if r.defect == "empty"} == {(1, "empty")}


def facts(spark, rows):
    """``(source, field, length, event)`` as the facts of distinct values."""
    rows = [(s, f, n, n, str(k).encode(), e) for k, (s, f, n, e) in enumerate(rows)]
    return spark.createDataFrame(rows, "source string, field_name string, chars int, bytes int, key binary, event boolean")


def test_hazards(spark):
    import random as r

    rng = r.Random(4)
    rows = [("s", "response", rng.randint(50, 400), True) for _ in range(3000)] + [("s", "response", 260, True)] * 80
    rows += [("t", "response", 100, False)] * 50 + [("t", "response", rng.randint(50, 150), True) for _ in range(500)]
    long = facts(spark, rows)
    found = {(row.source, row.length) for row in truncation.length_hazards(long).where("is_limit AND unit = 'chars'").collect()}
    assert found == {("s", 260)}  # endings that are no events make no limit
    stock = long.withColumn("key", F.when(F.col("chars") == 260, F.lit(b"x")).otherwise(F.col("key")))
    assert not truncation.length_hazards(stock).where("is_limit").count()  # one value, however often, counts once
    assert truncation.length_hazards(long.where("false")).count() == 0


def test_hazards_against_brute_force(spark):
    import random as r
    from math import comb

    rng = r.Random(9)
    lengths = [rng.choice([3, 9, 10, 40, 41, 60, 61, 62, 90, 200, 1000]) for _ in range(60)] + [60] * 12
    rows = truncation.length_hazards(facts(spark, [("s", "response", n, True) for n in lengths])).where("unit = 'chars'").collect()
    pvalues = {}
    for x in sorted(set(lengths)):
        risk = lambda y: sum(n >= y for n in lengths)
        near = [y for y in range(x - 12, x + 13) if abs(y - x) > 2]
        # lengths further from any ending than the window bear on no test
        seen = [y for y in near if y >= min(lengths) - 12 and y <= max(lengths)]
        n, m = lengths.count(x), sum(lengths.count(y) for y in near)
        exposure = sum(risk(y) for y in seen)
        tail = lambda n, total, share: 1.0 if n <= total * share else sum(comb(total, k) * share**k * (1 - share) ** (total - k) for k in range(n, total + 1))
        pvalues[x] = tail(n, n + m, risk(x) / (risk(x) + exposure)) if exposure else 1.0
        for side in ([y for y in near if y < x], [y for y in near if y > x]):
            if any(risk(y) for y in side if y in seen):
                pvalues[x] = max(pvalues[x], tail(n, n + sum(lengths.count(y) for y in side), 1 / 11))
    for row in rows:
        assert abs(row.p - pvalues[row.length]) <= 1e-6 + 0.01 * pvalues[row.length], row


def test_sorted_neighbours(spark):
    texts = ["风险", "风险点在于利率", "风险点在于利率未定", "利率", "利", "x" * 90, "x" * 91, "其他"]
    df = spark.createDataFrame([("response", t) for t in texts] + [("retrieved_knowledge", "风险点")], "field_name string, value string")
    found = truncation.shortened(df)
    rows = spark.createDataFrame([("甲方\n", None), ("甲方", "　甲方 \t")], "response string, retrieved_knowledge string")
    assert {tuple(r) for r in truncation.distinct_values(rows).collect()} == {("response", "甲方"), ("retrieved_knowledge", "　甲方")}  # blanks at the end do not go on
    expected = {truncation.xxhash.xxh3_128_digest(t.encode()) for t in texts if any(o != t and o.startswith(t) for o in texts)}
    assert {bytes(r.key) for r in found.collect()} == expected and len(expected) == 4


def test_languages(spark):
    assert pairs.asked_language("x 请用中文作答。") == "zh" and pairs.asked_language("Answer in English.") == "en" and pairs.asked_language(None) is None
    model = pairs.english(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert len(model.log) <= 28**3 and pairs.english(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert pairs.language("条款原文“Each Guarantor shall prepay the loan at once”未区分担保与保证。", model) == "zh"
    assert pairs.language("The clause is not addressed and the shortfall is swept.", model) == "en"
    assert pairs.language("I am afraid that this request goes beyond what I may answer.", model) == "en"
    for text in ("Risikostufe: hoch. Die Klausel lässt offen, wie die Zinsen berechnet werden, und die Sicherheit deckt nur einen Teil", "Điều khoản chưa nêu cách tính lãi và phạm vi bảo đảm", "La cláusula no precisa cómo se calculan los intereses ni el plazo de pago", "Het beding bepaalt niet hoe de rente wordt berekend en welke zekerheid geldt", "Umowa nie określa sposobu obliczania odsetek ani zakresu zabezpieczenia"):
        assert pairs.language(text, model) == "other", text
    assert pairs.language("Die Klausel ist offen") == "en" and pairs.language("ab") is None


def test_what_each_evidence_finds(spark):
    """Lengths carry the search: form rules left out, most cut values are found all the same."""
    rows = spark.read.parquet("/root/testdata/sf0.1/result.parquet")
    by = {r.by: r["count"] for r in truncation.cut_values(rows).where("is_cut").groupBy("by").count().collect()}
    total = sum(by.values())
    assert by["limit"] > 0.75 * total and by["limit"] + by.get("neighbour", 0) + by["ending"] > 0.93 * total
    assert truncation.cut_values(rows, form=False).where("is_cut").count() == total - by["form"]

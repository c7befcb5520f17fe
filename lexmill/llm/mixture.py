"""Mixing sources to target shares of the total token count.

The mixture is as large as the targets allow: every listed source that holds tokens can give at most ``max_repeats``
times its tokens, and the source that runs out first fixes the total. A source gets complete epochs of all its documents
first; what is left of its budget is drawn without replacement by Efraimidis-Spirakis sampling: each document has the
key ``-ln(u) / weight`` with ``u`` from a seeded hash of its id and a quality weight of its text, and the smallest keys
are taken while their prefix sum stays within the budget.

The prefix sums never sort a whole source in one task: keys fall into a fixed number of cells of equal probability,
tokens are summed by (source, cell) with map-side partial sums, the running sums are over cells (a bounded table), and
only the one cell of each source that the budget cuts through is put in exact order; the number of cells grows with the
largest source. A prefix that a long document ends early is continued over the documents that still fit, until none does:
what is left of a budget then is smaller than every document of the source that is not drawn yet.

Defined cases: documents with null text or no tokens are never drawn; a null source is not listed and gives nothing; a
listed source without documents, or with share 0 or null, or with less than one repeat, gives nothing and the others
keep their proportions among themselves; rows with an id seen before count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.bpe import TOKENIZERS, token_counts
from lexmill.runtime import durable, spread, table

CELLS, CELL_ROWS = 4096, 1024  # key cells of a source at least, and about how many documents a cell may hold
SEED = 20_240_229


def quality_weight(text: Column) -> Column:
    """Weight in [0.1, 1] from the text alone: the share of letters and digits, times the share of sentences that are not
    said again in the text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")) / F.greatest(F.length(text), F.lit(1))
    sentences = F.filter(F.split(text, r"[\n。！？.!?]+"), lambda x: x != "")
    fresh = F.size(F.array_distinct(sentences)) / F.greatest(F.size(sentences), F.lit(1))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters * fresh))


def sized(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id, source, weight, n_tokens`` of each document with tokens and a source, one row an id."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), quality_weight(text).alias("weight"), text.alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0")
    return token_counts(spread(rows), ["doc_id", "source", "weight"], "text", tokenizer, folder).where("n_tokens > 0").dropDuplicates(["doc_id"])


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a listed source: what it holds, its token budget, whole epochs and the tokens left to draw."""
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("docs"))
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.col("target_share").cast("double")).alias("target_share"), F.max(F.col("max_repeats").cast("long")).alias("max_repeats"))
    rows = listed.join(held, "source", "left")
    able = (F.col("held") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    alone = Window.partitionBy(F.lit(1))  # one row a listed source, so this window is bounded by the target table
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    rows = rows.withColumn("share", F.when(F.col("able"), F.col("target_share") / F.sum(F.when(F.col("able"), F.col("target_share"))).over(alone)).otherwise(0.0))
    rows = rows.withColumn("total", F.min(F.when(F.col("able"), F.col("max_repeats") * F.col("held") / F.col("share"))).over(alone))
    rows = rows.withColumn("budget", F.when(F.col("able"), F.floor(F.col("total") * F.col("share") + 1e-6)).otherwise(0))
    rows = rows.withColumn("epochs", F.when(F.col("able"), F.least("max_repeats", F.floor(F.col("budget") / F.col("held")))).otherwise(0))
    return rows.withColumn("rest", F.when(F.col("able") & (F.col("epochs") < F.col("max_repeats")), F.col("budget") - F.col("epochs") * F.col("held")).otherwise(0)).select(
        "source", "target_share", "max_repeats", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("docs", F.lit(0)).alias("docs"), "budget", "epochs", "rest"
    )


def _draw(keyed: DataFrame, drawn: DataFrame, budget: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens``: of each source the documents of smallest key, not drawn yet, whose running sum stays
    within ``rest``. Documents larger than the whole rest are passed over."""
    fits = keyed.join(F.broadcast(budget), "source").where("n_tokens <= rest").join(drawn.select("doc_id"), "doc_id", "left_anti")  # budget: a row a listed source
    cells = fits.groupBy("source", "cell").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("limit"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where("before < limit")
    cells = cells.withColumn("whole", F.col("before") + F.col("tokens") <= F.col("limit"))
    rows = fits.join(cells.select("source", "cell", "before", "whole"), ["source", "cell"])
    running = Window.partitionBy("source", "cell").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where("NOT whole").withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where("upto <= rest")
    return rows.where("whole").select("doc_id", "source", "n_tokens").unionByName(cut.select("doc_id", "source", "n_tokens"))


def mix(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` of every document that the mixture uses at least once.

    A long document may end a prefix well before its budget; what is left is drawn again, from the documents that fit
    into it and are not drawn yet, until nothing fits. Each round is over far fewer documents than the one before. The
    budget is never exceeded.
    """
    spark = sizes.sparkSession
    most = plan.agg(F.max("docs")).first()[0] or 0  # one number
    cells = max(CELLS, -(-most // CELL_ROWS))
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    keyed = sizes.withColumn("key", -F.log(u) / F.col("weight"))
    keyed = keyed.withColumn("cell", F.least(F.lit(cells - 1), F.floor((1 - F.exp(F.col("key") * -0.7)) * cells)))
    keyed = durable(keyed, "keyed")
    drawn = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    rest = {r.source: r.rest for r in plan.where("rest > 0").select("source", "rest").collect()}  # a number a listed source
    while rest:
        budget = spark.createDataFrame(list(rest.items()), "source string, rest long")
        more = durable(_draw(keyed, drawn, budget), "draw")
        used = {r.source: r.used for r in more.groupBy("source").agg(F.sum("n_tokens").alias("used")).collect()}
        drawn = drawn.unionByName(more)
        rest = {s: rest[s] - n for s, n in used.items() if rest[s] > n}  # a source that drew nothing is done
    once = drawn.select("doc_id", "source", "n_tokens", F.lit(1).cast("long").alias("uses"))
    epochs = sizes.join(plan.where("epochs > 0").select("source", "epochs"), "source").select("doc_id", "source", "n_tokens", F.col("epochs").cast("long").alias("uses"))
    return once.unionByName(epochs).groupBy("doc_id", "source", "n_tokens").agg(F.sum("uses").alias("uses"))


def shares(plan: DataFrame, mixture: DataFrame) -> DataFrame:
    """Targets and what was reached, one row a listed source."""
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"), F.count("*").alias("docs_used"), F.max("uses").alias("most_uses"))
    rows = plan.join(used, "source", "left").na.fill(0, ["tokens_used", "docs_used", "most_uses"])
    alone = Window.partitionBy(F.lit(1))
    return rows.select(
        "source", "target_share", "max_repeats", F.col("held").alias("tokens_held"), F.col("docs").alias("docs_held"), F.col("budget").alias("tokens_budget"), "tokens_used", "docs_used", "most_uses",
        F.round(F.col("tokens_used") / F.greatest(F.sum("tokens_used").over(alone), F.lit(1)), 6).alias("actual_share"),
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = durable(sized(table(spark, sf_dir, "documents")), "sizes")
    return sizes, durable(budgets(sizes, table(spark, sf_dir, "mix_targets")), "budgets")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_inputs(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, plan = _inputs(spark, sf_dir)
    return shares(plan, mix(sizes, plan))

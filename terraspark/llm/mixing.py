"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent,
normalised. The exponent lies between 0 (all sources equal) and 1 (as they are). It
is bisected, several halvings to a job, either to the entropy wanted or to the least
exponent at which no source is repeated more than the limit. The weights become
token budgets, and the budgets permuted blocks: the documents of a source are
hashed into blocks of about equal tokens, every epoch has its own order of the
blocks, and blocks are taken until the budget is full. The last block is cut
between documents; it is the only one whose documents are put in order, and blocks
are ordered in stretches, so that no task holds a source or all its blocks.

Tokens are estimated as a quarter of the UTF-8 bytes, rounded up, unless a column
is given. Null texts have 0 tokens; sources without tokens get no budget. A null
source is a source of its own. Repeated rows are drawn as often as they stand
there. An empty table gives an empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.llm.common import written


#: Blocks that are put in order together, on average.
STRETCH = 4096


@dataclass(frozen=True)
class Mixture:
    exponent: float
    entropy: float
    most_repeats: float
    log_norm: float
    total: int


def tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), source))


def _at(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(entropy, greatest weight over share, log of the norm) at each exponent: one job."""
    log = F.log(F.col("tokens") / float(total))
    cols = []
    for i, a in enumerate(exponents):
        cols += [F.sum(F.exp(log * a)).alias(f"z{i}"), F.sum(F.exp(log * a) * log).alias(f"l{i}"), F.max(log * (a - 1.0)).alias(f"m{i}")]
    r = sources.agg(*cols).first()
    return [(math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"], math.exp(r[f"m{i}"]) / r[f"z{i}"], math.log(r[f"z{i}"])) for i, a in enumerate(exponents)]


def fit_mixture(sources: DataFrame, budget: int | None = None, entropy_share: float | None = None, max_repeats: float | None = None) -> Mixture:
    """The exponent for ``sources(key, tokens)``; sources are summed on the executors, a few numbers reach the driver.

    entropy_share: wanted entropy as a share of that of equal weights, at most 1; what even
    exponent 1 exceeds gives exponent 1. max_repeats: greatest number of epochs of any source
    for a budget of tokens; if even exponent 1 exceeds it, exponent 1. With both, the greater
    exponent of the two holds.
    """
    sources = sources.filter(F.col("tokens") > 0)
    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total:
        return Mixture(1.0, 0.0, 0.0, 0.0, 0)
    scale = (budget or total) / total

    def enough(value: tuple[float, float, float]) -> bool:
        """Whether the exponent may be as great as here needs be: both conditions hold."""
        ok = entropy_share is None or value[0] <= entropy_share * math.log(n) + 1e-12
        return ok and (max_repeats is None or value[1] * scale <= max_repeats + 1e-12)

    low, high, parts = 0.0, 1.0, 16
    if enough(_at(sources, total, [0.0])[0]):
        high = 0.0
    for _ in range(8):
        if high - low < 1e-9:
            break
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        good = [enough(v) for v in _at(sources, total, grid)]
        k = good.index(True) if True in good else parts - 1
        low, high = ([low, *grid][k], [*grid, high][k])
    h, repeats, log_norm = _at(sources, total, [high])[0]
    return Mixture(high, h, repeats * scale, log_norm, total)


def mix(spark: SparkSession, docs: DataFrame, budget: int | None = None, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0, block_tokens: int = 250_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None) -> DataFrame:
    """(id, source, epoch, block, place double, draw long, tokens): the documents of the mixture, each as often as it is drawn.

    ``place`` (0 to 1) is how much of its source's budget comes before the block: ordering by
    place, block, draw gives a stream in which every stretch has about the target weights. A
    source's tokens stay below its budget by less than its last document, or equal it.
    """
    size = F.col(tokens_col).cast("long") if tokens_col else tokens(F.col(text_col))
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), source_key(F.col(source_col)).alias("_key"), F.coalesce(size, F.lit(0)).alias("_n"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_h"))
    d = written(spark, d, "sizes")
    sources = d.groupBy(F.col("_key").alias("key")).agg(F.sum("_n").alias("tokens"))
    sources = written(spark, sources, "sources")
    m = fit_mixture(sources, budget, entropy_share, max_repeats)
    budget = budget or m.total
    weight = F.exp(F.log(F.col("tokens") / float(max(m.total, 1))) * m.exponent - m.log_norm)
    plan = sources.filter(F.col("tokens") > 0).select("key", F.col("tokens").alias("_t"), F.floor(weight * float(budget)).alias("_budget"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).alias("_blocks"))
    # a handful of numbers for each source; joined by Spark's own choice
    b = d.join(plan, d["_key"] == plan["key"]).withColumn("_block", F.pmod("_h", "_blocks"))
    sums = b.groupBy("key", "_block").agg(F.sum("_n").alias("_bt"), F.first("_t").alias("_t"), F.first("_budget").alias("_budget"))
    # blocks of all epochs in their order: by a hash, in stretches of it of a bounded number of blocks; sums
    # within a stretch, and sums of whole stretches before it, so that no task orders all blocks of a source
    sums = sums.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("_budget") / F.col("_t")) - 1).cast("long"))))
    sums = sums.withColumn("_o", F.xxhash64("key", "_epoch", "_block", F.lit(seed)))
    stretches = F.ceil(F.greatest(F.lit(1), F.ceil(F.col("_t") / block_tokens)) / STRETCH)
    sums = sums.withColumn("_at", F.floor((F.col("_o").cast("double") + 2.0**63) / 2.0**64 * stretches))
    of = sums.groupBy("key", "_epoch", "_at").agg(F.sum("_bt").alias("_st"))
    of = of.withColumn("_sb", F.sum("_st").over(W.partitionBy("key").orderBy("_epoch", "_at").rowsBetween(W.unboundedPreceding, -1)))
    of = of.select(F.col("key").alias("_k"), F.col("_epoch").alias("_e"), F.col("_at").alias("_a"), F.coalesce("_sb", F.lit(0)).alias("_sb"))
    order = W.partitionBy("key", "_epoch", "_at").orderBy("_o", "_block")
    within = F.coalesce(F.sum("_bt").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = sums.withColumn("_within", within).join(of, (F.col("key") == F.col("_k")) & (F.col("_epoch") == F.col("_e")) & (F.col("_at") == F.col("_a")))
    taken = taken.withColumn("_before", F.col("_sb") + F.col("_within")).filter(F.col("_before") < F.col("_budget"))
    taken = written(spark, taken.select("key", "_block", "_epoch", "_before", "_bt", "_budget", (F.col("_before") + F.col("_bt") <= F.col("_budget")).alias("_whole")), "taken")
    got = b.select("_id", "_source", "_key", "_n", "_h", F.col("_block").alias("_b")).join(taken, (F.col("_key") == F.col("key")) & (F.col("_b") == F.col("_block")))
    got = got.withColumn("_draw", F.xxhash64("_h", "_epoch", F.lit(seed + 1)))
    whole = got.filter("_whole")
    cut = got.filter("NOT _whole")
    within = W.partitionBy("key", "_epoch", "_block").orderBy("_draw", "_id", "_h")
    cut = cut.withColumn("_sum", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("_before") + F.col("_sum") <= F.col("_budget")).drop("_sum")
    return whole.unionByName(cut).select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), (F.col("_before") / F.col("_budget")).alias("place"), F.col("_draw").alias("draw"), F.col("_n").alias("tokens"))

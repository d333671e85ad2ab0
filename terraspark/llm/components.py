"""Connected components of a link table by contraction rounds, with hot nodes in mind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import written


def connected_components(spark: SparkSession, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node long, root long) for every node of ``links(a long, b long)``; two nodes are connected if their roots are equal.

    In a round every node joins its neighbour of least rank, if less than its own;
    links are then between what the nodes have joined. Ranks are the ids in the
    first two rounds, which ends stars at once, then random by turns, which
    shrinks any graph by a constant factor. A node's neighbours are never gathered:
    minima are aggregated, partly before the shuffle, and joins can split a hot
    node. Rows with a null are dropped; no links give an empty table.
    """
    e = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = written(spark, e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    joined: list[DataFrame] = []
    for k in range(most_rounds):
        if e.isEmpty():
            break
        rank = (lambda c: F.col(c)) if k < 2 or k % 2 == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(rank("b").alias("r"), F.col("b"))).alias("m"))
        own = F.struct(rank("node").alias("r"), F.col("node").alias("b"))
        step = written(spark, least.select("node", F.least("m", own)["b"].alias("root")), "joined")
        joined.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = e.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = written(spark, e, "links")
    else:
        raise RuntimeError(f"not connected after {most_rounds} rounds")
    if not joined:
        return spark.createDataFrame([], "node long, root long")
    out = joined[-1]
    for step in reversed(joined[:-1]):
        later = out.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = step.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out

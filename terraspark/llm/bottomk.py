"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k least 64-bit hashes (as signed longs) of a
text's distinct shingles of five words; a text of fewer words is one shingle, a
text without words has an empty sketch. Words are runs without white space. Two
sketches estimate resemblance (share of the k least hashes of the union that both
hold), containment and the number of distinct shingles; sketches of parts merge to
the sketch of the whole, since the k least of a union are among the k least of the
parts. Sketches of fewer than k hashes are complete, and the estimates exact.

Null texts count as empty. Two empty sketches have resemblance 1, one gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraspark.llm.common import partitions

K = 256
WORDS = 5


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with column ``out``: the sketch of column ``text``. Columns _w and _h must be free."""
    df = df.withColumn("_w", F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    one = F.when(F.size("_w") > 0, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.array().cast("array<bigint>"))
    shingle = lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(words)))
    many = F.transform(F.sequence(F.lit(0), F.size("_h") - words), shingle)
    df = df.withColumn(out, F.when(F.size("_w") < words, one).otherwise(many))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(out)), 1, k)).drop("_w", "_h")


def union_least(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = union_least(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b holds too; null for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(union_least(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merged(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group. Hashes are made distinct and cut to the k least before the shuffle, so hot groups stay small."""
    flat = df.select(*by, F.explode(sketch).alias("_x")).distinct()
    least = flat.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_x"))).filter(F.col("_n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def in_order(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int | None = None) -> tuple[DataFrame, list[str]]:
    """Rows (_id, _t, _th, _c, _s, _u, _ghost) dealt into ranges, and the keys of a range.

    The order is that of descending ids, null ids last, and for rows of equal id that of
    the text's hash, then the text. Every range also holds, as a ghost after its own rows,
    the first row of the range that follows (the last range: of the first), so that each
    row's successor stands in its own range. Ranges follow the ids in about equal steps; a
    step of more than ``target`` rows is cut again, and what lies on one id by the hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    lo, hi, n = rows.agg(F.min("_id"), F.max("_id"), F.count(F.lit(1))).first()
    steps = 4 * partitions(spark)
    width = max(1.0, (float(hi or 0) - float(lo or 0) + 1) / steps)
    cell = F.coalesce(F.floor(F.col("_id").cast("double") / width), F.lit(-(2**62)))
    target = target or max(256, 2 * n // steps)
    # one row for each step: at most 4 x partitions + 2
    cells = rows.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_a"), F.max("_id").alias("_b")).filter(F.col("_n") > target)
    cells = cells.select("_c", "_a", F.greatest(F.lit(1.0), (F.col("_b").cast("double") - F.col("_a").cast("double") + 1) / F.ceil(2 * F.col("_n") / target)).alias("_v"))
    rows = rows.withColumn("_c", cell).join(F.broadcast(cells), "_c", "left")
    rows = rows.select("_id", "_t", F.xxhash64("_t").alias("_th"), "_c", F.coalesce(F.floor((F.col("_id").cast("double") - F.col("_a").cast("double")) / F.col("_v")), F.lit(0)).alias("_s"))
    # ranges that one id fills: as many rows as there are such ids above target
    same = rows.groupBy("_c", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").eqNullSafe(F.max("_id")).alias("_one")).filter((F.col("_n") > target) & F.col("_one"))
    same = same.select("_c", "_s", F.ceil(2 * F.col("_n") / target).alias("_k"))
    piece = F.floor((F.col("_th").cast("double") + 2.0**63) / 2.0**64 * F.col("_k"))
    rows = rows.join(F.broadcast(same), ["_c", "_s"], "left").withColumn("_u", F.coalesce(piece, F.lit(0))).select("_id", "_t", "_th", "_c", "_s", "_u")
    keys = ["_c", "_s", "_u"]
    # one row for each range: at most 2 x steps, and the cuts, which follow from target; the head is the greatest id's least hash
    heads = rows.groupBy(*keys).agg(F.max(F.struct("_id", F.bitwise_not("_th").alias("_nth"))).alias("_h"))
    order = W.orderBy(F.desc("_c"), F.desc("_s"), "_u")
    heads = heads.withColumn("_next", F.coalesce(F.lead("_h").over(order), F.first("_h").over(order)))
    wanted = heads.select(F.col("_next._id").alias("_wid"), F.bitwise_not("_next._nth").alias("_wth"), *(F.col(k).alias(f"_g{k}") for k in keys))
    ghosts = rows.drop(*keys).join(F.broadcast(wanted), rows["_id"].eqNullSafe(F.col("_wid")) & (F.col("_th") == F.col("_wth"))).dropDuplicates([f"_g{k}" for k in keys])
    ghosts = ghosts.select("_id", "_t", "_th", *(F.col(f"_g{k}").alias(k) for k in keys), F.lit(True).alias("_ghost"))
    return rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts), keys


def fingerprint_neighbours(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, target: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of its characters replaced by the first as
    many of the next document (descending id; after the last comes the first).
    """
    dealt, keys = in_order(spark, docs, id_col, text_col, target)
    # one shuffle of the texts; sketches are made after it, the window needs no other
    dealt = with_sketch(dealt.repartition(max(partitions(spark), 1), *keys), "_t", "_f", k)
    order = W.partitionBy(*keys).orderBy("_ghost", F.desc_nulls_last("_id"), "_th", "_t")
    pairs = dealt.withColumn("_nt", F.lead("_t").over(order)).withColumn("_nf", F.lead("_f").over(order)).filter(~F.col("_ghost"))
    n = F.char_length("_t")
    third = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("_n", n).withColumn("_e", F.concat(F.substring(F.col("_t"), F.lit(1), n - third), F.substring(F.col("_nt"), F.lit(1), third)))
    pairs = with_sketch(pairs, "_e", "_ef", k)
    return pairs.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_e"), 256).alias("edited_sha256"),
        as_text(F.col("_f")).alias("fingerprint"),
        as_text(F.col("_ef")).alias("edited_fingerprint"),
        resemblance(F.col("_f"), F.col("_ef"), k).alias("near_edited"),
        resemblance(F.col("_f"), F.col("_nf"), k).alias("near_next"),
        distinct_shingles(F.col("_f"), k).alias("n_shingles"),
    )

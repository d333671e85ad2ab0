"""Benchmark decontamination by a distributed positional index, in DataFrame functions only.

Words of corpus and test items are runs of ASCII letters and digits and of any
other characters above ASCII, A-Z in lower case. Steps:

1. How often every term of the test items occurs in the whole corpus; the terms of each
   test phrase in order of rarity.
2. The positional index holds the postings (term, document, position) of every term
   that is one of the two rarest of a phrase. It is stored as a table.
3. The two lists of a phrase, each moved by the term's place in it, are intersected:
   what both hold are the places where the phrase may start.
4. Only for documents with such a place, the postings of all other terms are stored
   too, and intersected with the places likewise, moved by their offsets. A phrase
   stands where no list lacks a place. Proximity matches need every term of a phrase
   within a span instead.

Terms and phrases of the test items go to all executors only when their number is
below a stated bound; else they are joined by shuffle, with the same result. Null
texts have no words; items without words match nothing; items shorter than a
window are one phrase. Equal rows of the corpus give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, named, written

#: Characters that separate words, as a pattern.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Test-side tables of more rows than this are joined by shuffle instead of being sent to every executor.
SENT_ROWS = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    # splitting leaves an empty part before a leading and after a trailing separator
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct phrases (item, words): every window of an item, or the whole of a shorter one."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - window))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i + 1, window))).alias("phrase")).distinct()


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT_ROWS else df.hint("merge")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text") -> DataFrame:
    """(term, n): occurrences in the whole corpus of each of ``terms``."""
    found = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    if n_terms <= SENT_ROWS:
        found = found.join(F.broadcast(terms), "term")
    found = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # summed where they lie; then only sums travel
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def ranked(phrase_table: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, terms): for every phrase whose terms all occur, its (n, term, at), rarest first."""
    each = phrase_table.select("phrase", F.posexplode("phrase").alias("at", "term")).join(counts, "term")
    each = each.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term", "at"))).alias("terms"))
    return each.filter(F.col("terms")[0]["n"] > 0)


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, key, term, pos) of ``terms(term)``. ``key`` is a hash of the text, so that several texts of one id stay apart; equal rows give equal postings."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return d.join(_sent(terms, n_terms), "term").select("doc", "key", "term", "pos")


def _places(index: DataFrame, wanted: DataFrame, n: int, which: int) -> DataFrame:
    """(pid, doc, key, start): the list of each phrase's term number ``which``, moved by its place in the phrase."""
    w = wanted.filter(F.size("terms") > which).select("pid", F.col("terms")[which]["term"].alias("term"), F.col("terms")[which]["at"].alias("at"))
    found = index.join(_sent(w, n), "term").select("pid", "doc", "key", (F.col("pos") - F.col("at")).alias("start"))
    return found.filter("start >= 0")


def _same(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of which ``doc`` may be null. Both sides grow with the corpus: the same plan at every size."""
    r = b.select(*(F.col(c).alias(f"_{c}") for c in b.columns)).hint("merge")
    cond = F.col(on[0]).eqNullSafe(F.col(f"_{on[0]}"))
    for c in on[1:]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(r, cond, how)


def candidates(index: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(pid, doc, key, start) that the lists of a phrase's two rarest terms agree on; of a phrase of one term, its list. ``wanted(pid, terms)``."""
    on = ["doc", "pid", "key", "start"]
    two = _same(_places(index, wanted, n, 0), _places(index, wanted, n, 1), on, "left_semi")
    one = _places(index, wanted.filter(F.size("terms") == 1), n, 0)
    return two.unionByName(one).distinct()


def other_postings(docs: DataFrame, among: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of ``terms`` in the documents of ``among(doc, key)`` alone."""
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("_t"))
    few = _same(d, among.select("doc", "key").distinct(), ["doc", "key"], "left_semi")
    p = few.select("doc", "key", F.posexplode(words(F.col("_t"))).alias("pos", "term"))
    return p.join(_sent(terms, n_terms), "term").select("doc", "key", "term", "pos").distinct()


def phrase_matches(found: DataFrame, others: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc, key, pid, start, len) of every exact occurrence: the candidates that no list of a phrase's other terms lacks."""
    c = found.join(_sent(wanted.select("pid", "terms", "len"), n), "pid")
    need = c.select("doc", "key", "pid", "start", "len", F.explode(F.slice("terms", F.lit(3), F.greatest(F.lit(1), F.size("terms")))).alias("_x"))
    need = need.select("doc", "key", "pid", "start", "len", F.col("_x.term").alias("term"), (F.col("start") + F.col("_x.at")).alias("pos"))
    held = _same(need, others, ["doc", "key", "term", "pos"], "left_semi").groupBy("doc", "key", "pid", "start", "len").agg(F.count(F.lit(1)).alias("_n"))
    whole = held.filter(F.col("_n") == F.col("len") - 2).drop("_n")
    return whole.unionByName(c.filter("len <= 2").select("doc", "key", "pid", "start", "len"))


def proximity_matches(index: DataFrame, wanted: DataFrame, n: int, span: int) -> DataFrame:
    """(doc, key, pid, pos): places of a phrase's rarest term around which all its terms stand within ``span`` words, in any order.

    ``index``: postings of all terms of ``wanted(pid, terms)``.
    """
    first = wanted.select("pid", F.col("terms")[0]["term"].alias("term"), F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("need"))
    c = index.join(_sent(first, n), "term").select("doc", "key", "pid", "pos", "need")
    each = c.withColumn("term", F.explode("need"))
    near = _same(each, index, ["doc", "key", "term"], "inner").filter(F.abs(F.col("_pos") - F.col("pos")) < span)
    near = near.groupBy("doc", "key", "pid", "pos", F.size("need").alias("_n")).agg(F.collect_set(F.struct(F.col("_pos").alias("at"), "term")).alias("_l"))
    inside = lambda b: F.size(F.array_distinct(F.transform(F.filter("_l", lambda t: (t["at"] >= b) & (t["at"] < b + span)), lambda t: t["term"])))
    return near.filter(F.exists(F.sequence(F.col("pos") - (span - 1), F.col("pos")), lambda b: inside(b) == F.col("_n"))).select("doc", "key", "pid", "pos")


def find_contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keyed: bool = False) -> DataFrame:
    """(id, n_words, n_hit, items): for every document its words, those inside any phrase of the items, and the items found, sorted as strings; with ``keyed`` also _key, the hash of the text."""
    mark = made()
    by_item = phrases(items, item_col, item_text, window)
    by_item = written(spark, by_item, "phrases")
    unique = by_item.select("phrase").distinct()
    n_phrases = unique.count()
    terms = unique.select(F.explode("phrase").alias("term")).distinct()
    n_terms = terms.count()
    rank = ranked(unique, term_counts(docs, terms, n_terms, text_col))
    rank = written(spark, rank.select(F.monotonically_increasing_id().alias("pid"), "phrase", "terms", F.size("terms").alias("len")), "ranked")
    rare = rank.select(F.explode(F.slice("terms", 1, 2)).alias("_x")).select("_x.term").distinct()
    index = written(spark, build_index(docs, rare, rare.count(), id_col, text_col), "postings")
    found = written(spark, candidates(index, rank, n_phrases), "candidates")
    others = written(spark, other_postings(docs, found, terms, n_terms, id_col, text_col), "other_postings")
    hits = phrase_matches(found, others, rank, n_phrases)
    hits = written(spark, hits, "hits")
    forget(spark, named(made(mark), "postings", "candidates", "other_postings"))
    # words inside the union of all occurrences
    inside = hits.select("doc", "key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    titles = by_item.join(rank.select("pid", "phrase"), "phrase").select("pid", F.col("item").cast("string").alias("item"))
    found = hits.select("doc", "key", "pid").distinct().join(_sent(titles, by_item.count()), "pid").select("doc", "key", "item").distinct()
    found = found.groupBy("doc", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = inside.join(found.withColumnsRenamed({"doc": "_d", "key": "_k"}), F.col("doc").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc", "key", "n_hit", "items")
    d = docs.select(F.col(id_col).alias(id_col), F.xxhash64(F.col(text_col)).alias("_key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = d.join(both, d[id_col].eqNullSafe(both["doc"]) & (d["_key"] == both["key"]), "left")
    return out.select(d[id_col], *(["_key"] if keyed else []), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: The same result in DuckDB SQL: every word against every phrase, by arrays of following words.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ph AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM ph),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hit AS (
  SELECT d.doc_id, d.i, ph.n, ph.item_id FROM dp d JOIN lens ON d.i + lens.n - 1 <= len(d.w)
  JOIN ph ON ph.n = lens.n AND ph.p = array_to_string(d.w[d.i:d.i + lens.n - 1], ' ')),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """All columns of the rows that hold no phrase of the items; of a repeated or null id only the rows whose text is hit go."""
    mark = made()
    hit = find_contamination(spark, docs, items, id_col, text_col, keyed=True, **kw).filter("n_hit > 0").select(F.col(id_col).alias("__hit_id"), F.col("_key").alias("__hit_key")).distinct()
    hit = written(spark, hit, "contaminated")
    forget(spark, made(mark)[:-1])
    # the same plan at every size: hits grow with the table and are never broadcast
    return docs.join(hit.hint("merge"), docs[id_col].eqNullSafe(F.col("__hit_id")) & (F.xxhash64(docs[text_col]) == F.col("__hit_key")), "left_anti")

"""The queries opN_<name> over whole tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 4096)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.html_density import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("_id", 3) != 1)
    return score_quality(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.bottomk import fingerprint_neighbours

    return fingerprint_neighbours(spark, table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    from terraspark.llm.decontam import ORACLE as sql

    return sql


@query("op9_decontamination", _op9_sql())
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.decontam import find_contamination

    found = find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.simhash import near_duplicates

    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.suffix import remove_repeats

    cut = remove_repeats(spark, table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _op11_sql() -> str:
    """Written from the contract: units and positions by code points, the restored text by cutting the output at its marks."""
    return r"""
    WITH drawn AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(sha256('7:' || doc_id), 8 * k + 1, 8))::UBIGINT) AS h
      FROM documents),
    cut AS (
      SELECT doc_id, text, len(units) AS n, units[:least(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT] AS p,
        units[greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT + 1:] AS s,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM drawn),
    texts AS (
      SELECT doc_id, text, n, form, coalesce(list_reduce(p, lambda a, b: a || b, ''), '') AS p, coalesce(list_reduce(s, lambda a, b: a || b, ''), '') AS s FROM cut),
    parts AS (
      SELECT *, substr(text, length(p) + 1, length(text) - length(p) - length(s)) AS m FROM texts),
    outs AS (
      SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(o) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN o
        WHEN 'psm' THEN regexp_replace(o, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2')
        ELSE regexp_replace(o, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1') END) AS restored_sha256
    FROM outs"""


@query("op11_fill_in_middle", _op11_sql())
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.fim import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


@query("op12_piece_encoding")
def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    """CRC-32 bit by bit; words at one edit are equal without the code point at the same place, or one is the other without one."""
    return r"""
    WITH runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{5,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents WHERE text IS NOT NULL),
    counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
    steps AS MATERIALIZED (
      SELECT list(list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    hashed AS (
      SELECT run, n, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(string_split(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\1 ', 'g')[:-2], ' '), lambda b: ('0x' || b)::UBIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS h FROM counted, steps),
    changed AS (
      SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    keys AS MATERIALIZED (
      SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS k FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (
      SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
    forms AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END::BIGINT AS form_n
      FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
    ways AS (
      WITH RECURSIVE w(word, here, next) AS (
        SELECT word, word, form FROM forms UNION ALL SELECT w.word, f.word, f.form FROM w JOIN forms f ON f.word = w.next)
      SELECT word, here AS root FROM w WHERE next IS NULL)
    SELECT word, n, n_near, form, form_n, root FROM forms JOIN ways USING (word)"""


@query("op13_spelling_variants", _op13_sql())
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraspark.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))

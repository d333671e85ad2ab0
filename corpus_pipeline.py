"""A corpus from raw documents to a training mixture, in five stages.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: documents that share four fifths of their shingles of five words
   are near duplicates; of each class the document of least id stays.
3. decontamination: documents that hold any phrase of the benchmark go.
4. pii: personal data in the texts is masked, and n_chars put right.
5. mixture: the documents to draw, with source, epoch, block and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspark.llm.common import forget, made, table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from terraspark.llm.toxicity import fit_toxicity, reject_toxic

    return reject_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from terraspark.llm.near import keep_one

    return keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from terraspark.llm.decontam import drop_contaminated

    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from terraspark.llm.pii import mask_pii

    return mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from terraspark.llm.mixing import mix

    return mix(spark, docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixture", mixture)]

#: SQL cannot express the classifier; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the others wrote on the way is removed once the next one's documents stand."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        mark = made()
        docs = written(spark, stage(spark, docs, sf_dir), name)
        *scratch, own = made(mark)
        forget(spark, scratch + last)
        last = [own]
    return STAGES[-1][1](spark, docs, sf_dir)

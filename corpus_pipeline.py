"""The corpus pipeline: documents to a clean, weighted training mix.

Every stage takes rows with null or repeated ids, null, empty or very long texts and further columns of any name, and keeps
the columns of documents; the last adds copies and taken. A null or empty text is not toxic, holds no benchmark words and no
personal data, is a near copy of the other empty ones (one of a group stays), and has no words to take. An empty table
passes as an empty table. Ties are settled by id and text hash, as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, mixing, pii, simhash, toxicity
from siltstone.llm.common import fold_of, n_staged, stage, sweep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models score 0.3 or more go; they learn from the folds that the toxicity query uses."""
    learn = fold_of(F.col("doc_id"), 4) != 2
    classes = toxicity.Classes(*toxicity.sample(docs.where(learn), table(spark, sf_dir, "labels").where(learn)))
    return toxicity.keep_ordinary(docs, classes)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within 3 bits, the document with the smallest id stays."""
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and words that disclose it are replaced; every document stays."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: the documents that it takes, their texts as sanitised, with copies and the words taken."""
    return mixing.take(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("pii", sanitise), ("mix", mix)]

#: The stages learn models, link fingerprints and round at random, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has staged goes once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), n_staged()
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
        sweep(before)
    return STAGES[-1][1](spark, docs, sf_dir)

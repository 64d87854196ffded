"""A training corpus from raw documents: five operators in a row, each on what the one before kept.

``run`` writes the result of every stage as Parquet in the shared folder and reads it
back as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.decontamination import uncontaminated
from quire.llm.exact_dedup import exact_kept
from quire.llm.mixing import labelled_domains, language_targets, mixed, repeats
from quire.llm.simhash import near_kept
from quire.llm.toxicity import not_toxic, toxicity_model
from quire.session import written

#: Fingerprints of three-word shingles that differ in at most two bits are linked.
NEAR = {"shingle": 3, "max_distance": 2}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, does not call toxic."""
    return not_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id."""
    return near_kept(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``mix_domain``, ``mix_rate`` and ``mix_copies``, how often each is to be read; those read never go.

    Columns of these names in the input are replaced.
    """
    docs = docs.drop("mix_domain", "mix_rate", "mix_copies")
    rows = mixed(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), language_targets)
    rows = rows.withColumn("copies", repeats(F.col("rate"), F.col("_doc.doc_id"))).filter("copies > 0")
    return rows.select("_doc.*", F.col("domain").alias("mix_domain"), F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Two stages learn models and one links fingerprints: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

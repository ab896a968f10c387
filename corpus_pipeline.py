"""A corpus made ready for training: toxic documents go, near copies go, personal data is
masked, and what is left is packed into sequences.

Each stage reads what the stage before it wrote.  Null and empty texts pass the first two
stages (they have no words to judge), stay as they are in the third and are packed as an end
id alone.  Very long texts are judged, masked and packed whole.  Rows that repeat an id are
judged each by the first stage; of those it leaves the second keeps one, the one with the
least text.  Rows with a null id are all kept.  An empty table gives no rows.  Columns beyond
those of ``documents`` pass the first three stages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm import dartminhash, packing, pii, toxicity
from chronoframe.llm.shared import bounded_batches, new_dir

#: No SQL: a learned score, sampled signatures and a tokenizer decide.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.dedup(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    length = F.length("text").cast("long")
    return masked.withColumn("n_chars", F.coalesce(length, "n_chars")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written to the shared folder."""
    folder = new_dir(spark, "pipeline")

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, apply = stage
        out = apply(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))

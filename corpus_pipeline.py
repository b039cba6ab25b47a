"""From raw documents to mixed, encoded training rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet to the shared folder and reads it back as the next stage's documents. What a stage
stored on its way is removed once its result is written, and a result once the next one is.

Defined cases, for all stages: null texts stay null and count as empty ones; rows of one
doc_id, null ones too, are documents of their own; an empty table gives an empty table; extra
columns are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscope.llm import op2_mixture, op3_bpe, op4_quality, op5_minhash, op10_repeats
from wallscope.llm.queries import TOKENIZER
from wallscope.session import discard, scratch_path, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; a score of exactly 0.5 is no rejection."""
    return op4_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near-duplicates; empty texts have no group."""
    return op5_minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also occur elsewhere; n_chars, if there is one, follows the text."""
    cut = op10_repeats.remove(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' weights (count to the power 0.7), in global random order."""
    return op2_mixture.mix(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text and the text decoded from them."""
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    decoded = op3_bpe.encode_decode(rows, TOKENIZER, key="row")
    return decoded.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("source mixture", mixture),
    ("BPE tokens", tokens),
]

#: The stages are no SQL; their tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        # Named outside the scope, so that it outlives what the stage stores.
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_scope(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs

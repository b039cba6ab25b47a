"""The queries of the operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscope.llm import (
    op1_fingerprint,
    op2_mixture,
    op3_bpe,
    op4_quality,
    op5_minhash,
    op6_langid,
    op7_license,
    op8_embeddings,
    op9_warc,
    op10_repeats,
    op11_neighbours,
    op12_spelling,
    op13_whitening,
)

#: File of the byte-level tokenizer; installed on every executor.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_fingerprint.compare(_table(spark, sf_dir, "documents"))
    for name in ("fingerprint", "edited_fingerprint"):
        found = found.withColumn(name, F.array_join(F.transform(name, lambda h: F.lower(F.hex(h))), " "))
    return found


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op2_mixture.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", "copy", "mix_key", "row.text")


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_bpe.encode_decode(_table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_langid.identify(_table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_license.scan(_table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = op9_warc.roundtrip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def digest(cut: DataFrame) -> DataFrame:
    """The columns of the repeat query."""
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(op10_repeats.cut(_table(spark, sf_dir, "documents")))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return op11_neighbours.search(vectors, vectors.where("vec_id % 100 = 0"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_spelling.variants(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fingerprint": _op1,
    "op2_mixture": _op2,
    "op3_bpe": _op3,
    "op4_quality": _op4,
    "op5_minhash": _op5,
    "op6_langid": _op6,
    "op7_license": _op7,
    "op8_embeddings": _op8,
    "op9_warc": _op9,
    "op10_repeats": _op10,
    "op11_neighbours": _op11,
    "op12_spelling": _op12,
    "op13_whitening": _op13,
}

"""From raw documents to packed training sequences. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, packing, pii, simhash, toxicity
from touchline.llm.common import new_path, read, tokenizer_path, unused

#: Words of a shingle.
WORDS = 5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity of REJECT or more go; those of null or empty texts stay, whatever their ids."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    name = unused(docs, "_severity")
    return toxicity.with_severity(docs, model, name=name).where(F.col(name) < toxicity.REJECT).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, which chains of a five-word shingle similarity of 0.8 or more make, one document stays: that of the smallest id. Texts without words aren't copies of each other."""
    return simhash.one_of_each(docs, words=WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none and stay, and so does everything where there are no benchmark items."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the text, n_chars follows; every document stays."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token ids in sequences of 2048, a row for each piece; null and empty texts are one id, and rows of null or repeated ids are packed like any others."""
    return packing.op9_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack),
]

#: SQL can't express the trained model, the fingerprints or the packing; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Token-count rollups that signed deltas maintain."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, encoder, new_path, tokenizer_path

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def counted(docs: DataFrame, path: str, version: str, text_col: str = "text") -> DataFrame:
    """docs' id, source and lang with n_tokens and n_chars of the whole text, by the tokenizer at path. A null text counts 0."""

    def run(batches):
        encode = encoder(path)
        for b in batches:
            text = [t.as_py() or "" for t in b.column(3)]
            cols = [b.column(0), b.column(1), b.column(2), pa.array([version] * len(text)), pa.array([len(encode(t)) for t in text], type=pa.int64()), pa.array([len(t) for t in text], type=pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *KEYS, "n_tokens", "n_chars"])

    cols = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string")]
    return batched(docs).select(*cols).mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")


def inserts(rows: DataFrame) -> DataFrame:
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose counts, source or language changed: out with the old, in with the new."""
    return deletes(old).unionByName(inserts(new))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*KEYS, *[(F.lit(sign) * x).cast("long").alias(n) for n, x in (("n_docs", F.lit(1)), ("n_tokens", F.col("n_tokens")), ("n_chars", F.col("n_chars")))])


class Rollup:
    """Totals by source, language and tokenizer version: the sum of committed batches of signed deltas.

    commit(id, deltas) aggregates the deltas first (partial sums before the shuffle, so a source with a third of the rows is
    no hot key) and writes them as folder batch=<id>. The committer's _SUCCESS file makes the batch count; a repeated id
    that succeeded is left alone, and one that broke off is written anew; one writer at a time may commit an id. A compaction remembers the ids that it holds: they
    stay committed. Null sources and languages are groups of their own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "rollup")

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        return hadoop, hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, fs = self._fs()
        at = hadoop.Path(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _done(self, batch: str) -> bool:
        hadoop, fs = self._fs()
        return fs.exists(hadoop.Path(f"{self.path}/batch={batch}/_SUCCESS"))

    def held(self) -> set[str]:
        """Ids of the batches that a finished compaction holds."""
        return {b for c in self._names(f"{self.path}/_in") if self._done(c) for b in self._names(f"{self.path}/_in/{c}")}

    def committed(self) -> list[str]:
        """Ids of the batches whose folders count."""
        found = [n.removeprefix("batch=") for n in self._names(self.path) if n.startswith("batch=")]
        held = self.held()
        return sorted(b for b in found if b not in held and self._done(b))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Whether the batch was new."""
        if self._done(batch) or batch in self.held():
            return False
        deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def _sum(self, batches: list[str]) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/batch={b}" for b in batches]) if batches else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """Groups whose documents were all deleted are left out."""
        return self._sum(self.committed())

    def compact(self, name: str) -> bool:
        """Writes the totals so far as one batch in place of those that it holds; whether the name was new.

        What it holds is noted before, and counts from when the batch is done: a compaction that breaks off at any time counts nothing twice.
        """
        hadoop, fs = self._fs()
        old, held = self.committed(), self.held()
        if name in held or self._done(name):
            return False
        fs.delete(hadoop.Path(f"{self.path}/_in/{name}"), True)
        for b in held.union(old):
            fs.mkdirs(hadoop.Path(f"{self.path}/_in/{name}/{b}"))
        self.commit(name, self._sum(old))
        for b in old:
            fs.delete(hadoop.Path(f"{self.path}/batch={b}"), True)
        return True


def declared(docs: DataFrame, version: str) -> DataFrame:
    """counted()'s columns as the rows themselves declare them, without a look at their texts: n_chars as they say (null: 0), tokens not counted yet."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.lit(0).cast("long").alias("n_tokens"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"))


def op5_token_counts(docs: DataFrame, path: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """Documents, tokens and characters by source, language and tokenizer: documents arrive with the counts that they declare, and are revised once their texts are counted.

    Null texts count 0; null sources and languages are groups; rows of null or repeated ids count each; an empty table gives no rows; extra columns are ignored.
    """
    rollup = Rollup(docs.sparkSession)
    arrived = declared(docs, version)
    rollup.commit("arrivals", inserts(arrived))
    rollup.commit("counts", revisions(arrived, counted(docs, path or tokenizer_path(), version)))
    rollup.commit("arrivals", inserts(arrived))  # a repeated delivery changes nothing
    return rollup.totals()

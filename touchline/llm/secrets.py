"""Secret scans with DataFrame functions only, over a ledger of content-addressed blobs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, unused

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, group whose length counts, least length). The first three are fixed; the others are added spans.
RULES = [
    ("assign", ASSIGN, 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
BASE = ("assign", "access", "hex")
#: Changes with RULES: a blob is scanned once for each version.
VERSION = "rules-1"
SPAN = "array<struct<s:int,k:int,e:int>>"


def spans(text: Column, k: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches of the pattern, as (start, kind number, end) in code points; those whose group is too short are dropped.

    The pieces between the matches (split) and the matches (regexp_extract_all) alternate, so that their lengths give the places.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    sizes = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    parts = F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(found), F.lit(0))).alias("p"), found.alias("f"), sizes.alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.char_length(x["p"])
        e = s + F.char_length(x["f"])
        hit = F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(F.char_length(x["g"]) >= least, F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


#: A cheap test that every text with a match passes, and for `assign` a second one.
HINTS = {
    "assign": r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ",
}
KEYWORD = r"(?i)(?:passw|secret|token|api_?key)"


def hinted(text: Column, name: str) -> Column:
    return text.rlike(HINTS[name]) & text.rlike(KEYWORD) if name == "assign" else text.rlike(HINTS[name])


def findings(text: Column) -> Column:
    """Every rule's spans in one array, by start, then kind as listed."""
    out = [F.when(hinted(text, name), spans(text, k, pattern, group, least)).otherwise(F.array().cast(SPAN)) for k, (name, pattern, group, least) in enumerate(RULES)]
    return F.array_sort(F.concat(*out))


def blob(text: Column) -> Column:
    """A text's address; null texts count as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


class Ledger:
    """Findings by (blob, rule version) in a Parquet folder. A blob is a text's SHA-256; null texts count as empty.

    scan() looks only at pairs that the ledger lacks, and appends them as one new batch folder; a batch that was
    interrupted leaves no _SUCCESS file and isn't read, so that a repeated scan is safe. One scan may write at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, version: str = VERSION):
        self.spark, self.path, self.version = spark, path or new_path(spark, "ledger"), version

    def _batches(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.toString() for p in done if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def table(self) -> DataFrame | None:
        """(blob, version, spans) of all batches; None if there is none."""
        b = self._batches()
        return self.spark.read.schema(f"blob string, version string, spans {SPAN}").parquet(*b) if b else None

    def scan(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Scans what docs holds unseen, and returns the whole ledger."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        hint = functools.reduce(lambda a, b: a | b, [hinted(F.col("text"), n) for n in HINTS])
        blobs = docs.select(text.alias("text")).select(blob(F.col("text")).alias("blob"), F.when(hint, F.col("text")).alias("text"))
        known = self.table()
        if known is not None:
            blobs = blobs.join(known.where(F.col("version") == self.version).select("blob").distinct(), "blob", "left_anti")
        # equal texts meet by their address only: one of each is scanned, and texts without a hint aren't moved
        scanned = blobs.dropDuplicates(["blob"]).select("blob", F.lit(self.version).alias("version"), F.when(F.col("text").isNotNull(), findings(F.col("text"))).otherwise(F.array().cast(SPAN)).alias("spans"))
        n = len(self._batches())
        scanned.write.mode("overwrite").parquet(f"{self.path}/batch-{n:08d}")
        return self.table()

    def report(self, paths: DataFrame, blob_col: str = "blob") -> DataFrame:
        """paths (rows that name a blob by its address) with a column `spans`, by this ledger's rule version: every path that holds a blob gets its findings."""
        b, s = unused(paths, "_blob"), unused(paths, "_spans")
        seen = self.table().where((F.col("version") == self.version) & (F.size("spans") > 0)).select(F.col("blob").alias(b), F.col("spans").alias(s))
        return paths.join(seen, F.col(blob_col) == F.col(b), "left").withColumn("spans", F.coalesce(s, F.array().cast(SPAN))).drop(b, s)


def digest(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op10_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's row per document. Null texts count as empty and hold nothing; rows of null or repeated ids are returned each; extra columns are ignored."""
    ledger = Ledger(docs.sparkSession, path)
    ledger.scan(docs)
    names = [r[0] for r in RULES]
    out = ledger.report(docs.select("doc_id", blob(F.col("text")).alias("blob")))
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    kinds = F.transform("spans", lambda x: x["k"])
    count = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return out.select("doc_id", *count, F.sha2(digest(base, names), 256).alias("base_sha256"), digest(F.col("spans"), names).alias("spans"))

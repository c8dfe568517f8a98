"""Benchmark decontamination with DataFrame functions only: hashed n-gram windows, verified, then spans or documents removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, sized, small, unused

#: Words after A-Z are lower-cased: ASCII letters and digits, and whatever isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() serves where it changes no other character; translate(), slower, elsewhere."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    same = (F.octet_length(text) == F.char_length(text)) | (other == F.lower(other))
    return F.when(same, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, h, gram, items): each distinct window of `size` item words (a shorter item is one window; one without words has none) and the ids of its items."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    gram = w.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(
        "item", F.slice("w", F.col("at") + 1, size).alias("gram")
    )
    return (
        gram.groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .select(F.size("gram").alias("len"), F.xxhash64("gram").alias("h"), "gram", "items")
    )


#: Distinct window hashes, 16 bytes each in the broadcast set, and their bytes, up to which all are broadcast.
HASHES, HASH_BYTES = 2_000_000, 64 << 20


def candidates(docs: DataFrame, h: DataFrame, lens: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, row, at, n, key, gram): word windows of docs whose hash is among h's, and for each row of docs one with key null and its word count as `at`.

    `row` hashes the text. The hashes are broadcast as a plain set if their counted size allows, and each window's words are taken for hits only. Beyond that,
    windows are shuffled by their hash without any words, and the documents with hits are cut into words once more.
    """
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), words(text).alias("w"))
    at = base.select("*", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at"))
    at = at.select("*", F.explode(F.array(*[F.lit(n) for n in lens])).alias("n")) if len(lens) > 1 else at.withColumn("n", F.lit(lens[0]))
    gram = F.slice("w", F.col("at") + 1, F.col("n"))
    at = at.withColumn("key", F.when(F.col("at") + F.col("n") <= F.size("w"), F.xxhash64(gram)))
    end = (F.col("at") == F.size("w")) & (F.col("n") == lens[0])
    cols = ["id", "row", "at", "n", F.col("h").alias("key")]
    if small(h, HASHES, HASH_BYTES):
        found = at.join(F.broadcast(h), F.col("key") == F.col("h"), "left").where(F.col("h").isNotNull() | end)
        return found.select(*cols, F.when(F.col("h").isNotNull(), gram).alias("gram"))
    ends = base.select("id", "row", F.size("w").alias("at"), F.lit(lens[0]).alias("n"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<string>").alias("gram"))
    found = cut(at.where("key is not null").drop("w").join(h, F.col("key") == F.col("h")).select(*cols).distinct(), "hits")
    per = found.groupBy("id", "row").agg(F.collect_list(F.struct("at", "n", "key")).alias("hits"))
    i, r = F.col("p.id"), F.col("p.row")
    held = base.dropDuplicates(["id", "row"]).alias("b").join(per.alias("p"), F.col("b.id").eqNullSafe(i) & (F.col("b.row") == r))
    again = held.select("b.id", "b.row", "b.w", F.explode("p.hits").alias("x")).select("id", "row", "x.*", F.slice("w", F.col("x.at") + 1, F.col("x.n")).alias("gram"))
    return ends.unionByName(again)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, at, len, items): a row for each verified occurrence, and for each row of docs one with items null and its word count as `at`.

    Every token window's hash is looked up (see candidates()); a hit counts if the words are equal, too.
    """
    grams = cut(windows(benchmark, size), "windows")
    lens = [r[0] for r in grams.select("len").distinct().orderBy("len").limit(size).collect()]  # at most `size` numbers
    at = candidates(docs, grams.select("h").distinct(), lens or [size], id_col, text_col)
    same = (F.col("key") == F.col("h")) & (F.col("n") == F.col("len")) & (at["gram"] == grams["gram"])
    found = at.join(sized(grams), same, "left").where(F.col("key").isNull() | F.col("items").isNotNull())
    return found.select("id", "row", "at", "len", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_words, spans, n_hit, items) for each row of docs: spans are the maximal hit runs of words, [start, end).

    Null and empty texts have no words. Items of no word have no window, and null item ids are left out of `items`. Rows that repeat id and text are worked on as one and returned each.
    """
    h = hits(docs, benchmark, size, id_col, text_col)
    key = ["id", "row"]
    per = h.groupBy(*key).agg(
        F.max(F.when(F.col("items").isNull(), F.col("at"))).cast("long").alias("n_words"),
        F.count(F.when(F.col("items").isNull(), 1)).cast("int").alias("times"),
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct(F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e"))))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    span = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))

    def merge(acc, x):
        """Joins x to the last run if it begins in it or right after it."""
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]),
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["e"]).alias("e"))))
                      ).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate("runs", F.array().cast(span), merge)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    out = per.withColumn("spans", spans).select(*key, "n_words", "spans", n_hit.alias("n_hit"), "items", "times")
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, share: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of which more than `share` of the words lie in benchmark windows; all its columns stay."""
    gone, row = unused(docs, "_id"), unused(docs, "_row")
    bad = decontaminate(docs, benchmark, size, id_col, text_col).where(F.col("n_hit") > F.col("n_words") * share).select(
        F.col("id").alias(gone), F.col("row").alias(row)
    ).distinct()
    return docs.join(
        sized(bad), F.col(id_col).eqNullSafe(F.col(gone)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(row)), "left_anti"
    )


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document. A null or empty text has no words and no hits; rows of null or repeated ids are returned each; extra columns are ignored.

    Without benchmark items (an empty table, or none with words) nothing is hit.
    """
    d = decontaminate(docs, benchmark)
    return d.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

"""A uniform shuffle of rows into shards of exact size: how many rows go from each partition to each shard is drawn first, by the hypergeometric law."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, cut, sized, unused

#: Partitions whose counts are drawn in one task; rows of a shard that are put in order in one task, about.
DRAWN, CELL = 1000, 100_000
_LONG = (1 << 33) - 1


def communication(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, n) -> (part, upto): of the partition's rows, upto[s] in all go to shards 0..s. Rows add up to n, columns to shard sizes that differ by one at most.

    Drawn in two steps of the same law, of blocks of partitions first, then within each block; draws depend on the seed and the counts only.
    """

    def rows(sizes: np.ndarray, columns: np.ndarray, *name: int) -> np.ndarray:
        draw, left, out = np.random.default_rng([seed, *name]), columns.copy(), []
        for n in sizes:
            out.append(draw.multivariate_hypergeometric(left, int(n), method="marginals"))
            left -= out[-1]
        return np.array(out, dtype=np.int64).reshape(-1, shards)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        total = int(pdf["n"].sum())
        sizes = total // shards + (np.arange(shards) < total % shards)
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "columns": list(rows(pdf["n"].to_numpy(), sizes, 0))})

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        got = rows(pdf["n"].to_numpy(), np.array(pdf["columns"].iloc[0], dtype=np.int64), 1, int(pdf["block"].iloc[0]))
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "upto": list(got.cumsum(axis=1))})

    counts = counts.withColumn("block", F.floor(F.col("part") / DRAWN))
    # a row for each DRAWN partitions
    above = counts.groupBy("block").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(blocks, "block long, columns array<long>")
    return counts.join(sized(above), "block").groupBy("block").applyInPandas(parts, "part long, upto array<long>")


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 in each shard): any order of all rows is as likely as any other. Shards' sizes differ by one at most.

    The rows are written once with their partition and place, so that lost executors change nothing. Each partition permutes its own places and deals them to shards as communication() says; each shard's rows
    then get random keys, which part them into cells and order each cell. Repeated rows and null ids are rows like any other; an empty table has no rows; names that clash get underscores.
    """
    at, part, n, upto, place, key, cell, before = (unused(rows, x) for x in ("_at", "_part", "_n", "_upto", "_place", "_key", "_cell", "_before"))
    shard, slot = unused(rows, "shard"), unused(rows, "slot")
    mid = F.monotonically_increasing_id()
    dealt = cut(rows.withColumn(part, F.spark_partition_id().cast("long")).withColumn(at, mid.bitwiseAND(F.lit(_LONG))), "places")
    counts = cut(dealt.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")), "counts")
    plan = cut(communication(counts, shards, seed), "plan").join(counts, "part")
    plan = plan.select(F.col("part").alias(part), F.col("n").alias(n), F.col("upto").alias(upto))

    held: dict[int, np.ndarray] = {}

    @F.pandas_udf("long")
    def permuted(part: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        out = np.empty(len(at), dtype=np.int64)
        for p in part.unique():
            if p not in held:
                held.clear()  # one partition's permutation at a time
                held[p] = np.random.default_rng([seed, 2, int(p)]).permutation(int(n[part == p].iloc[0]))
            pick = (part == p).to_numpy()
            out[pick] = held[p][at[pick].to_numpy()]
        return pd.Series(out)

    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cells = 1 << max(0, -(-total // (shards * CELL)) - 1).bit_length()
    out = batched(dealt, 10_000).join(sized(plan), part).withColumn(place, permuted(part, at, n))
    out = out.withColumn(shard, F.expr(f"size(filter(`{upto}`, x -> x <= `{place}`))"))
    out = out.withColumn(key, F.xxhash64(F.lit(seed), F.col(part), F.col(place))).withColumn(cell, F.pmod(key, F.lit(cells)))
    out = cut(out.drop(n, upto, at), "dealt")
    # places of the cells in their shard: a few rows a shard
    sizes = out.groupBy(shard, cell).agg(F.count("*").alias(n))
    sizes = sizes.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    order = F.row_number().over(Window.partitionBy(shard, cell).orderBy(key, part, place)) - 1
    out = out.withColumn(slot, order).join(sized(sizes), [shard, cell]).withColumn(slot, (F.col(slot) + F.col(before)).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(shard), F.col(slot))


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 42) -> None:
    """shuffled() rows as Parquet folders shard=0, shard=1, ..., sorted by slot within each file; a shard is written by as many tasks as it has cells of slots."""
    out = shuffled(rows, shards, seed)
    out.repartition("shard", F.floor(F.col("slot") / CELL)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def op13_sharding(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """The contract's row per document, under the law `rows`: shards' counts are at most one apart. Null texts are empty; repeated rows are dealt apart like any others."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = shuffled(rows, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

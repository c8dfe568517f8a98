"""Shared pieces: work tables in the shared folder, tokenizer, components."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.tables import cut, new_path, shared_dir  # noqa: F401

#: A side is broadcast only if it has at most so many rows and bytes, as counted.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Edges of one node that meet in one task at most, beyond what is broadcast.
HUB = 100_000


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def batched(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, with Arrow batches of at most so many rows from now on in its session: whole texts are long, and a batch is held several times."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def width(col: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            return F.coalesce(F.greatest(F.size(col), F.lit(0)), F.lit(0)) * 8 + 16
        return F.coalesce(F.aggregate(col, F.lit(16), lambda a, x: a + width(x, kind.elementType).cast("int")), F.lit(16))
    if isinstance(kind, T.StructType):
        out = F.lit(8)
        for f in kind.fields:
            out = out + width(col[f.name], f.dataType)
        return out
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes, counted here."""
    each = F.lit(16).cast("long")
    for f in df.schema.fields:
        each = each + width(F.col(f"`{f.name}`"), f.dataType)
    n, b = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and b <= size


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small(), else as it is: then Spark shuffles both sides."""
    return F.broadcast(df) if small(df, rows, size) else df


def _with_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with low's m of their u. low (u, m, c) counts each u's edges: with few edges it is broadcast; else hubs are, so that no hub's edges meet in one task."""
    if n <= BROADCAST_ROWS:
        return edges.join(F.broadcast(low.drop("c")), "u")
    hubs = cut(low.where(F.col("c") > HUB).drop("c"), "hubs")
    if hubs.isEmpty() or not small(hubs):
        return edges.join(low.drop("c"), "u")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.drop("c"), "u")
    return rest.unionByName(edges.join(F.broadcast(hubs), "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (id, component_id), component_id being the smallest id reachable.

    Alternating large-star and small-star rounds; each is a group-by with partial minima and a join (see _with_least()), so that
    no node's neighbours ever meet in one row or task. Nodes without edges aren't returned.
    """
    e = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    n, seen = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = _with_least(both, low, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        least = _with_least(large, low, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(least.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        n, seen = now[0], now
    star = e.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    return star.unionByName(star.select(F.col("component_id").alias("id"), "component_id").distinct())


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b of items 0..n-1 as (item, smallest item of its component), items that are their own left out: n - 1 edges at most."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        while (root[root] != root).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = root[a[live]], root[b[live]]
    item = np.flatnonzero(root != np.arange(n))
    return item, root[item]


#: The text that the tokenizer file lists as a special token.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(path: str):
    """encode(text) -> uint32 ids, as `tokenizers` gives them for the byte-level BPE file at path with add_special_tokens=False.

    A byte-level BPE file holds every token's bytes and the merge ranks in id order, so that
    tiktoken's engine gives the same ids several times as fast; texts that hold the special token go to `tokenizers` itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    code = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in code]
    byte = {chr(b): b for b in code} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t != SPECIAL}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text).astype("<u4", copy=False)

    return encode


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

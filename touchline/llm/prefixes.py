"""Prefix trie of conversations: every node belongs to its smallest member, so that a conversation owns the end of its path, and one group-by of prefixes gives each node's figures."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HUB, batched, cut, sized, small

#: Turns of a conversation that are summed in one task at most; characters of the joined ids of one row.
CHUNK, CHARS = 10_000, 1 << 16
#: A conversation starts like the one of the next lower multiple of BASE, by up to HEADS - 1 turns.
BASE, HEADS = 100, 6
_LONG = (1 << 33) - 1


# ---- turns in their order ----


def turns(convs: DataFrame) -> DataFrame:
    """(conv_id, part, pos, a, b, n): each turn by two hashes of its role and text, and the code points of its text; pos counts from 0 in the conversation, `part` is a stretch of its turns.

    Turns go by `turn`, null first; ties by role, then by the text's hash. Rows without a conv_id are left out. Sorted in ranges, so that the turns of one long conversation are
    dealt to several tasks; each task counts its stretch, and the stretches' sizes give the places.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.char_length(text).cast("long").alias("n"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "a"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role")
    rows = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LONG))), "turns")
    own = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.join(own, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "a", "b", "n")


def heads_wanted(conv_id: Column, heads: int = HEADS) -> Column:
    """Turns that a conversation takes from its base: crc32 of the decimal conv_id, modulo heads."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % heads).cast("int")


def rebuilt(convs: DataFrame, base: int = BASE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, d, a, b, n), d from 1: the first h turns of the base conversation, then the own ones after the first h."""
    own = cut(turns(convs), "places")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("rows")).withColumn("h", heads_wanted(F.col("conv_id"), heads))
    # a base's first turns: heads - 1 rows at most
    first = own.where((F.col("pos") < heads - 1) & (F.col("conv_id") % base == 0))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n"))).alias("first"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % base).join(first, "base", "left")
    sizes = sizes.withColumn("first", F.when(F.col("first").isNull() | (F.col("h") == 0), F.expr("slice(first, 1, 0)")).otherwise(F.expr("slice(first, 1, greatest(h, 1))")))
    sizes = sizes.withColumn("k", F.coalesce(F.size("first"), F.lit(0)).cast("long"))
    sizes = cut(sizes.withColumn("k", F.greatest("k", F.lit(0))).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("rows") - F.col("h"))), "conversations")
    given = sizes.where("k > 0").select("conv_id", F.explode("first").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("d"), "t.a", "t.b", "t.n")
    # joined by stretches, so that no conversation's turns all meet
    parts = own.groupBy("conv_id", "part").agg(F.count("*").alias("_n")).drop("_n").join(sizes.select("conv_id", "h", "k"), "conv_id")
    rest = own.join(parts, ["conv_id", "part"]).where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("d"), "a", "b", "n")
    return sizes.select("conv_id", "length"), given.unionByName(rest)


# ---- nodes ----


def paths(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, d, length, n, upto, k1, k2): the nodes of each conversation's path from the root on; upto sums n down to here, (k1, k2) hashes the turns down to here.

    A path's running sums are made in chunks of CHUNK turns. Each turn's hash covers its depth, so that their exact sums stand for the sequence.
    """
    rows = rows.select("conv_id", "d", F.floor(F.col("d") / CHUNK).alias("chunk"), "n", F.xxhash64("d", "a", "b").cast("decimal(38,0)").alias("x"), F.xxhash64("b", "d", "a").cast("decimal(38,0)").alias("y"))
    rows = cut(rows, "depths")
    add = {"n": "n", "x": "x", "y": "y"}
    chunks = rows.groupBy("conv_id", "chunk").agg(*[F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(f"all_{c}") for c in add])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"before_{c}") for c in add]).join(sizes, "conv_id")
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("d")
    upto = [(F.col(f"before_{c}") + F.sum(c).over(so_far)).cast("long" if c == "n" else "decimal(38,0)").alias(f"upto_{c}") for c in add]
    rows = rows.join(chunks, ["conv_id", "chunk"]).select("conv_id", "chunk", "d", "length", "n", *upto)
    zero = F.lit(0).cast("decimal(38,0)")
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("d"), "length", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto_n"), zero.alias("upto_x"), zero.alias("upto_y"))
    both = rows.unionByName(root)
    return both.select("conv_id", "chunk", "d", "length", "n", F.col("upto_n").alias("upto"), F.xxhash64("d", "upto_x", "upto_y").alias("k1"), F.xxhash64("upto_y", "upto_x", "d").alias("k2"))


def with_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with their node's columns. Nodes of many members are broadcast, if not all are, so that none of them has its rows in one task."""
    key = ["k1", "k2"]
    if small(nodes):
        return rows.join(F.broadcast(nodes), key)
    hubs = cut(nodes.where(F.col("members") > HUB), "hubs")
    if hubs.isEmpty() or not small(hubs):
        return rows.join(nodes, key)
    rest = rows.join(F.broadcast(hubs.select(*key)), key, "left_anti").join(nodes, key)
    return rest.unionByName(rows.join(F.broadcast(hubs), key))


def ends_hash(ends: DataFrame) -> DataFrame:
    """(k1, k2, conv_id) -> (k1, k2, ends_sha256) of the decimal conv_ids, ascending and comma-joined.

    Ids are sorted in ranges and joined to texts of up to CHARS where they lie; a node's texts, few of them, run through the hash in turn.
    """

    def join(batches):
        key, first, held, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([first]), pa.array([",".join(held)])], names=["k1", "k2", "first", "ids"])

        for b in batches:
            out: list[list] = [[], [], [], []]
            for k1, k2, c in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "conv_id"))):
                if (k1, k2) != key or size >= CHARS:
                    if held:
                        for col, v in zip(out, (*key, first, ",".join(held))):
                            col.append(v)
                    key, first, held, size = (k1, k2), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], names=["k1", "k2", "first", "ids"])
        if held:
            yield row()

    def digest(batches):
        key, sha = None, None
        for b in batches:
            out: list[list] = [[], [], []]
            for k1, k2, ids in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    sha.update(b",")
                else:
                    if sha:
                        for col, v in zip(out, (*key, sha.hexdigest())):
                            col.append(v)
                    key, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            if out[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:2]], pa.array(out[2], pa.string())], names=["k1", "k2", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    order = ["k1", "k2", "conv_id"]
    texts = batched(ends).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "k1 long, k2 long, first long, ids string")
    texts = texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return texts.select("k1", "k2", "ids").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of the conversations (conv_id, length) with turns (conv_id, d, a, b, n), one row each; see op12_prefixes() for the columns.

    A node's smallest member owns it. Who owns a node owns all nodes after it on its own path, so that a path has one depth `o` from which on it is owned, and its owner and depth name a
    node. The nodes below a node are met once by each member's path and counted once by their owners': what a subtree saves is the sum, over the node's members, of the characters from here to `o`.
    """
    path = cut(paths(sizes, rows), "paths")
    nodes = path.groupBy("k1", "k2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("members"), F.sum((F.col("d") == F.col("length")).cast("long")).alias("ends"))
    met = with_nodes(path, cut(nodes, "nodes"))
    mine = F.col("owner") == F.col("conv_id")
    leaf = mine & (F.col("d") == F.col("length")) & (F.col("members") == F.col("ends"))
    own = met.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("d"))).alias("o"), F.coalesce(F.sum(F.when(~mine, F.col("n"))), F.lit(0)).alias("shared"),
        F.max(F.when(~mine, F.struct("d", "owner")))["owner"].alias("above"), F.max(leaf.cast("long")).alias("leaf"),
    )
    # by chunks, as paths are long
    stretches = path.groupBy("conv_id", "chunk").agg(F.count("*").alias("_n")).drop("_n").join(own, "conv_id")
    each = path.join(stretches, ["conv_id", "chunk"])
    mine = F.col("o") <= F.col("d")
    parent = F.when(mine & (F.col("d") > 0), F.when(F.col("d") > F.col("o"), F.col("conv_id")).otherwise(F.col("above")))
    below = (F.col("d") + 1 <= F.col("length")) & (F.col("o") <= F.col("d") + 1)
    out = each.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(F.coalesce(below, F.lit(False)).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("shared") - (F.col("upto") - F.col("n")))).alias("saved_tokens"),
    )
    ends = ends_hash(path.where("d = length").select("k1", "k2", "conv_id"))
    return out.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("k1", "k2")


def op12_prefixes(convs: DataFrame) -> DataFrame:
    """The contract's row per node of the rebuilt conversations' trie.

    Null roles and texts are empty; rows without a conv_id belong to no conversation; equal turns of one conversation (repeated rows) follow each other. No conversations: no nodes. Extra columns are ignored.
    """
    return prefix_trie(*rebuilt(convs))

"""How far the sources of a language are from each other, by exact sums over their terms: common terms in dense tiles, rare ones by corrections of posting pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batched, cut, sized

#: Bytes of a term as they count (A-Z lower-cased); a space in place of all others.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text split at once; different terms that a task counts before it passes them on.
PART, ENTRIES = 1 << 22, 250_000
#: Documents of its language that a term needs; parts that a group's terms are counted in; terms listed per group.
DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Groups of one block, postings of one tile held in a task at most (about), cells computed at once.
BLOCK, POSTINGS, CELLS = 512, 200_000, 1_000_000


# ---- counts ----


def terms(text: bytes):
    """The text's terms in turn, as lists: runs of letters A-Z, a-z and of all that isn't ASCII."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            # no term is cut: the next byte that belongs to none ends the part
            rest = text[end : end + PART].translate(TERM).find(b" ")
            while rest < 0 and end + PART < len(text):
                end += PART
                rest = text[end : end + PART].translate(TERM).find(b" ")
            end = len(text) if rest < 0 else end + rest
        yield text[at:end].translate(TERM).split()
        at = end


def counted(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed within a task as far as ENTRIES go. Nulls are read as ''."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            for (lang, source), (n, seen) in held.items():
                k = len(n)
                cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string())]
                cols += [pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                own: set[bytes] = set()
                for words in terms(text.as_py()):
                    n.update(words)
                    own.update(words)
                seen.update(own)
                size += len(n)
                if size >= ENTRIES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text")
    return batched(docs).select(*cols).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kinds)), exact."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + kinds).cast("decimal(20,0)")) + 1


def tables(docs: DataFrame, at_least: int = DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (lang, term, tid, source, n, total, kinds) of the terms in at_least documents of their language, and groups (lang, source, g, size, total, all_total, v, zero).

    tid numbers a term; `total` of a posting is the term's count in its language, `kinds` the groups that have it. Groups without terms are there, too: g numbers them within the language,
    v counts the language's kept terms, and zero is the share of a term that the group hasn't.
    """
    # one shuffle: all three steps are dealt by language and term
    per = counted(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    per = per.withColumn("row", F.monotonically_increasing_id())
    per = per.withColumn("docs", F.sum("docs").over(own)).withColumn("total", F.sum("n").over(own)).withColumn("kinds", F.count("*").over(own)).withColumn("tid", F.min("row").over(own))
    postings = cut(per.where(F.col("docs") >= at_least).withColumn("first", F.col("row") == F.col("tid")).drop("row", "docs"), "postings")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = postings.groupBy("lang").agg(F.sum("n").alias("all_total"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "all_total", "v"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("lang")))
    return postings, cut(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(1))), "groups")


# ---- pairs of sources ----


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of int64 shares: below 2^63."""
    d = p - q
    return d * d // q


def dense(zero: np.ndarray, term: np.ndarray, g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over these common terms of gap(p of the row's group, p of the column's group), less what they'd give were they in no group."""
    out = np.zeros((len(zero),) * 2, dtype=np.int64)
    if not len(term):
        return out
    at = np.concatenate(([0], np.cumsum(term[1:] != term[:-1])))
    n = int(at[-1]) + 1
    step = max(1, CELLS // len(zero) ** 2)
    for k in range(0, n, step):
        a, b = np.searchsorted(at, [k, k + step])
        tile = np.tile(zero, (min(step, n - k), 1))
        tile[at[a:b] - k, g[a:b]] = p[a:b]
        out += gap(tile[:, :, None], tile[:, None, :]).sum(axis=0)
    return out - n * gap(zero[:, None], zero[None, :])


def sparse(zero: np.ndarray, term: np.ndarray, g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """As dense(), for rare terms sorted by term: each posting against groups that haven't its term, in one step for all of a group's equal shares, then a correction for each pair of postings of a term."""
    out = np.zeros((len(zero),) * 2, dtype=np.int64)
    if not len(term):
        return out
    (ug, up), n = np.unique(np.stack([g, p]), axis=1, return_counts=True)
    step = max(1, CELLS // len(zero))
    for k in range(0, len(ug), step):
        a, b, c = ug[k : k + step], up[k : k + step, None], n[k : k + step, None]
        z = zero[a][:, None]
        np.add.at(out, a, c * (gap(b, zero[None, :]) - gap(z, zero[None, :])))
        np.add.at(out.T, a, c * (gap(zero[None, :], b) - gap(zero[None, :], z)))
    for shift in range(1, len(term)):
        i = np.flatnonzero(term[shift:] == term[:-shift])
        if not len(i):
            break
        for k in range(0, len(i), CELLS):
            a, b = i[k : k + CELLS], i[k : k + CELLS] + shift
            for u, v in ((a, b), (b, a)):
                pu, pv, zu, zv = p[u], p[v], zero[g[u]], zero[g[v]]
                np.add.at(out, (g[u], g[v]), gap(pu, pv) - gap(pu, zv) - gap(zu, pv) + gap(zu, zv))
    # a posting met its own group above as if that hadn't the term
    np.fill_diagonal(out, 0)
    return out


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value): for each two groups of a language, the sum over all its kept terms of gap(share in g, share in h).

    A term in no group of a pair adds the pair's gap of zeros, v times in all; what present terms add beyond is summed by tiles of two blocks of groups: of terms in at least half
    of the language's groups by dense arrays, of others by posting pairs, which are fewer than the dense cells. Each tile is dealt to tasks by its terms; their sums add up exactly.
    """
    salts = postings.groupBy("lang").agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias("salts"))
    stats = groups.join(salts, "lang", "left").na.fill(1, ["salts"]).withColumn("block", (F.col("g") / BLOCK).cast("int"))
    stats = stats.withColumn("other", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / BLOCK).cast("int"))))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    named = groups.join(salts, "lang").select("lang", "source", "g", "size", "v", "salts", F.col("total").alias("group_total"))
    rows = postings.join(sized(named), ["lang", "source"]).withColumn("block", (F.col("g") / BLOCK).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / BLOCK).cast("int"))))
    rows = rows.select(
        "lang", lo, hi, F.pmod(F.xxhash64("tid"), "salts").cast("int").alias("salt"), F.when(2 * F.col("kinds") >= F.col("size"), 1).otherwise(2).alias("kind"),
        "tid", F.col("g").cast("long").alias("g"), share(F.col("n"), F.col("group_total"), F.col("v")).alias("p"),
    )
    # each tile has all its groups in front; the first task of a tile adds the zeros of all terms
    front = stats.select(
        "lang", lo, hi, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "v", F.col("g").cast("long").alias("g"), F.col("zero").alias("p")
    ).withColumn("tid", F.when(F.col("salt") == 0, F.col("v")).otherwise(F.lit(0)))
    keys = ["lang", "lo", "hi", "salt"]

    def run(batches):
        def flush(key, held):
            kind, tid, g, p = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("kind", "tid", "g", "p"))
            n = int(np.searchsorted(kind, 1))
            ids, zero = g[:n], p[:n]
            at = np.searchsorted(ids, g)
            out = int(tid[0]) * gap(zero[:, None], zero[None, :])
            for which, f in ((1, dense), (2, sparse)):
                a, b = np.searchsorted(kind, [which, which + 1])
                out += f(zero, tid[a:b], at[a:b], p[a:b])
            block = ids // BLOCK
            want = (block[:, None] != block[None, :]) if key[1] != key[2] else ~np.eye(n, dtype=bool)
            i, j = np.nonzero(want & ~np.eye(n, dtype=bool))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i), pa.string()), pa.array(ids[i]), pa.array(ids[j]), pa.array(out[i, j])], names=["lang", "g", "h", "value"])

        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            tags = list(zip(*(b.column(c).to_pylist() for c in keys)))
            edges = [0, *[k for k in range(1, len(tags)) if tags[k] != tags[k - 1]], len(tags)]
            for a, z in zip(edges, edges[1:]):
                if tags[a] != key:
                    if held:
                        yield flush(key, held)
                    key, held = tags[a], []
                held.append(b.slice(a, z - a))
        if held:
            yield flush(key, held)

    cols = [*keys, "kind", "tid", "g", "p"]
    both = front.select(cols).unionByName(rows.select(cols)).repartition(*keys).sortWithinPartitions(*keys, "kind", "tid", "g")
    parts = both.mapInArrow(run, "lang string, g long, h long, value long")
    return parts.groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def divergence(docs: DataFrame, top: int = TOP, at_least: int = DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` compares a source with each other source of its language, `term` lists the `top` terms that tell it from the language as a whole.

    Nulls are read as ''; so a null source and an empty one are one group. Repeated documents count each. An empty table gives no rows; extra columns are ignored.
    """
    postings, groups = tables(docs, at_least, lang_col, source_col, text_col)
    names = groups.select("lang", "g", "source")
    pairs = pair_sums(postings, groups).join(sized(names), ["lang", "g"])
    pairs = pairs.join(sized(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    known = groups.select("lang", "source", F.col("total").alias("group_total"), "all_total", "v")
    found = postings.join(sized(known), ["lang", "source"])
    p, q = share(F.col("n"), F.col("group_total"), F.col("v")), share(F.col("total"), F.col("all_total"), F.col("v"))
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    found = found.select("lang", "source", "part", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    # Spark keeps the first ranks of each task before it deals the rows by group
    return pairs.select("*", rank).unionByName(found.select("*", rank).where(F.col("rank") <= top))


def op11_divergence(docs: DataFrame) -> DataFrame:
    """The contract's rows; see divergence()."""
    return divergence(docs)

"""Source divergence, the prefix trie and sharding against plain versions: the given tables by their SQL, random and awkward rows here."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from touchline.llm import divergence, prefixes, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,table", [("op11_divergence", "documents"), ("op12_prefixes", "conversations")])
def test_sql(spark, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- divergence ----


def plain_divergence(rows, top=200):
    n, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang, source].update(words)
        docs[lang].update(set(words))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= 3)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in sources if o != s}}
            parts["term"] = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if n[lang, s][t] and p[s][t] > q[t]}
            for part, items in parts.items():
                order = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def corpus(sources, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("the a Of über naïve É 中文 x1y don't end".split() + [f"r{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(9)])
    rows = [(rng.choice(["en", "de"]), f"s{int(rng.random() ** 2 * sources)}", rng.choice([" ", "\n", "-"]).join(word() for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [(None, None, "one two"), ("", "", "ONE two"), (None, "", "one Two"), ("fr", "alone", "one of a kind"), ("fr", "other", None), ("fr", "other", ""), ("it", None, None)]
    return rows + [("en", "s0", "copy of a line")] * 40


@pytest.mark.parametrize("block,postings", [(512, 200_000), (3, 40), (5, 200_000)])
def test_divergence_by_blocks_and_salts(spark, monkeypatch, block, postings):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "CELLS", 500)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    rows = corpus(11, block)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, g int, total long, term string").repartition(5)
    got = sorted(map(tuple, divergence.op11_divergence(df).collect()))
    assert got == plain_divergence(rows)
    assert divergence.op11_divergence(df.limit(0)).count() == 0


def test_large_shares_are_exact(spark):
    """One source is one term a million times: the gaps reach 10^17."""
    rows = [("en", "a", "big " * 400_000)] * 3 + [("en", "b", "small big rare")] * 3 + [("en", "c", "rare")] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.op11_divergence(df).collect())) == plain_divergence(rows)


def test_long_texts_split_between_terms(monkeypatch):
    text = " ".join(f"wörd{'abc'[k % 3] * (k % 17)}" for k in range(400)).encode() + b"x" * 90
    whole = [t for part in divergence.terms(text) for t in part]
    monkeypatch.setattr(divergence, "PART", 7)
    assert [t for part in divergence.terms(text) for t in part] == whole and len(whole) == 400


# ---- prefixes ----


def plain_trie(rows, base=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(turns.get(c - c % base, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in who if len(built[c]) == len(node))
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in {*rng.sample(range(450), 60), 100, 200}:
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "hello é", "中文", "bye", ""])))
    rows += [(c, t, "user", "the same") for c in range(500, 540) for t in range(5)]
    return rows + [(None, 1, "user", "x"), (1007, None, None, None), (1008, None, "user", None), (1008, 0, None, "x"), (1009, 3, "a", "bc"), (1010, 3, "ab", "c")]


@pytest.mark.parametrize("chunk,chars,hub", [(10_000, 1 << 16, 100_000), (2, 5, 3)])
def test_prefixes(spark, monkeypatch, chunk, chars, hub):
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    monkeypatch.setattr(prefixes, "CHARS", chars)
    monkeypatch.setattr(prefixes, "HUB", hub)
    if hub == 3:  # only hubs are broadcast
        sizes = iter([False, True] * 9)
        monkeypatch.setattr(prefixes, "small", lambda df: next(sizes))
    rows = talks(chunk)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, part string").repartition(6)
    assert sorted(map(tuple, prefixes.op12_prefixes(df).collect()), key=repr) == plain_trie(rows)
    assert prefixes.op12_prefixes(df.limit(0)).count() == 0


def test_one_long_conversation_and_repeated_turns(spark):
    rows = [(5, t // 2, "user", f"turn {t // 2}") for t in range(700)] + [(6, t, "user", "x" * 3000) for t in range(3)] + [(0, t, "user", "x" * 3000) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixes.op12_prefixes(df).collect()), key=repr) == plain_trie(rows)


# ---- sharding ----


def test_shards_are_exact_and_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 3)
    monkeypatch.setattr(sharding, "DRAWN", 2)
    rows = [(k % 90 or None, None if k % 7 == 0 else f"té{k % 50}", "a", 1, 2) for k in range(403)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, _at int").repartition(7)
    got = sharding.op13_sharding(df).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} == {25, 26}
    # names that clash are kept
    out = sharding.shuffled(df, shards=4)
    assert out.columns == [*df.columns, "_shard", "_slot"] and out.count() == 403
    assert sharding.op13_sharding(df.limit(0)).count() == 0
    assert sharding.op13_sharding(df.limit(3)).select("shard").distinct().count() == 3


def test_every_row_is_as_likely_anywhere(spark):
    """Chances of (partition, shard) and (place, slot) over many seeds, of partitions of unlike sizes."""
    df = spark.range(0, 60, 1, 1).union(spark.range(60, 80, 1, 1)).selectExpr("id")
    df = spark.createDataFrame(df.collect(), "id long").coalesce(1).repartitionByRange(3, "id")
    seen, first = np.zeros((80, 4)), np.zeros(80)
    for seed in range(24):
        for r in sharding.shuffled(df, shards=4, seed=seed).collect():
            seen[r.id, r.shard] += 1
            first[r.id] += r.slot
    assert (seen.sum(axis=0) == 24 * 20).all()
    assert ((seen - 6) ** 2 / 6).sum() < 80 * 3 + 4.5 * (2 * 80 * 3) ** 0.5
    assert abs(first / 24 - 9.5).max() < 4.5 * (399 / 12 / 24) ** 0.5


def test_the_matrix_adds_up(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWN", 3)
    sizes = [5, 0, 17, 400, 1, 1, 30, 8]
    counts = spark.createDataFrame(list(enumerate(sizes)), "part long, n long")
    got = {r.part: np.diff([0, *r.upto]) for r in sharding.communication(counts, 5, 1).collect()}
    assert [got[p].sum() for p in range(8)] == sizes
    assert sorted(sum(got.values()).tolist()) == [92, 92, 92, 93, 93]


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=8)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(r.n for r in back.groupBy("shard").agg({"slot": "count"}).withColumnRenamed("count(slot)", "n").collect()) == [25] * 8
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))

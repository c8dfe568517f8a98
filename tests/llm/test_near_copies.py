"""The near-copy stage against exact Jaccard similarities of five-word shingles."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from touchline.llm import simhash

from . import brute

MORE = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def stage(spark, df):
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, MORE).select("doc_id").collect())


def family(rng, size, members, least, most):
    """A text and versions of it with replaced words."""
    base = [f"w{k}" for k in rng.integers(0, 5000, size)]
    for _ in range(members):
        w = list(base)
        for k in rng.integers(0, size, rng.integers(least, most)):
            w[k] = f"x{rng.integers(0, 10**9)}"
        yield " ".join(w)


@pytest.mark.parametrize("cell", [3, 4096])
def test_pairs_at_0_8_are_linked_and_no_others(spark, monkeypatch, cell):
    """With small cells, nodes are split by bits and by hashes, and components are compared in parts."""
    monkeypatch.setattr(simhash, "SETS", 7)
    monkeypatch.setattr(simhash, "similar_turns", lambda n, f=simhash.similar_turns: f(54))
    monkeypatch.setattr(simhash, "CELL", cell)
    rng, texts = np.random.default_rng(3), []
    for size in (30, 120, 400):
        for _ in range(6):
            texts += family(rng, size, 8, 0, max(2, size // 30))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert stage(spark, frame(spark, rows)) == brute.one_of_each(rows)


def test_recall_of_pairs_that_are_just_similar_enough():
    """Fingerprints of pairs at a similarity of 0.8 to 0.82 are found by the turns in at least 98 of 100 cases; unlike ones hardly ever."""
    rng = np.random.default_rng(1)
    turns = simhash.similar_turns(10**6)
    count = 1 + max(t.word for t in turns) + simhash.FAR
    near = far = 0
    for _ in range(400):
        n = int(rng.integers(20, 400))
        own = rng.integers(0, 1 << 63, (3, n), dtype=np.uint64)
        shared = -(-8 * n // 9)
        a, b = own[0], np.concatenate([own[0][:shared], own[1][shared:]])
        for other in (b, own[2]):
            x, y = (simhash.wide(np.unique(z), count) for z in (a, other))
            d = [int(v) for v in x ^ y]
            ring = lambda t: (d[t.word] << t.at | d[t.word] >> 64 - t.at) & (1 << 64) - 1
            meet = any(all((ring(t) >> 64 - k).bit_count() <= t.allow[k] for k in range(1, 65)) for t in turns)
            found = meet and sum(x.bit_count() for x in d[-simhash.FAR :]) <= simhash.slack(64 * simhash.FAR) and sum(x.bit_count() for x in d) <= simhash.slack(64 * count)
            near += found and other is b
            far += found and other is not b
    assert near >= 0.98 * 400 and far == 0


def test_the_table(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    assert stage(spark, docs) == brute.one_of_each([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_documents_below_0_8_and_wordless_ones_stay(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    for changed in range(1, 40):
        w = list(base)
        for k in range(changed):
            w[10 * k] = "x"
        if not brute.similar(brute.shingle_set(" ".join(base)), brute.shingle_set(" ".join(w))):
            break
    rows = [(0, ""), (1, None), (2, "a b c d e f"), (3, " \t"), (4, " ".join(base)), (5, " ".join(w)), (6, "A B c d e f"), (None, "a b c d e f")]
    assert brute.one_of_each(rows[:-1]) == [0, 1, 2, 3, 4, 5]
    assert stage(spark, frame(spark, rows)) == [0, 1, 2, 3, 4, 5]


def test_rows_of_the_same_id(spark):
    """One row of a group stays, also of rows that repeat id and text; a row of another text under the same id is no copy."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (None, "p q r"), (None, "p q r"), (None, None), (None, None)]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, rows), MORE).collect()
    assert sorted(((r.doc_id or -1), r.text or "") for r in got) == [(-1, ""), (-1, ""), (-1, "p q r"), (1, "a b c d e f"), (2, "u v w x y z")]


def test_trie_join_within_nodes_that_bits_split(spark, monkeypatch):
    """links() with nodes of over CELL fingerprints gives the components of all pairs within the budget."""
    monkeypatch.setattr(simhash, "CELL", 4)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(12)]))
    fps = np.concatenate([fps, (fps[:100] >> np.uint64(20)) | (np.uint64(0xABC) << np.uint64(52))])  # many share their first block
    fps = np.unique(fps)
    nodes = [int(x) - (1 << 64) if x >= 1 << 63 else int(x) for x in fps.tolist()]
    df = spark.createDataFrame([(x, [x]) for x in nodes], "node long, words array<long>")
    edges = [(r.u, r.v) for r in simhash.links(df, simhash.exact_turns(4)).collect()]
    pairs = [(a, b) for (x, a), (y, b) in combinations(zip(fps.tolist(), nodes), 2) if (x ^ y).bit_count() <= 4]
    assert brute.components(nodes, edges) == brute.components(nodes, pairs)


def test_groups_that_only_resemble_each_other(spark, monkeypatch):
    """Families of one base at 0.6 to 0.8 of each other meet as one candidate component far beyond SETS; the links within and between them are those of brute force."""
    monkeypatch.setattr(simhash, "SETS", 9)
    rng, rows = np.random.default_rng(11), []
    base = [f"w{k}" for k in range(300)]
    for f in range(14):
        own = list(base)
        for k in rng.integers(0, 300, 9 + f % 3):
            own[k] = f"f{f}_{k}"
        for m in range(25 if f < 3 else 6):
            w = list(own)
            for k in rng.integers(0, 300, m % 3):
                w[k] = f"m{f}_{m}_{k}"
            rows.append((len(rows), " ".join(w)))
    seen = []
    plain = simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda sets, comp: seen.append(comp.groupBy("component_id").count().agg({"count": "max"}).first()[0]) or plain(sets, comp))
    kept = brute.one_of_each(rows)
    assert stage(spark, frame(spark, rows)) == kept and seen[0] > 90 and 2 < len(kept) < 60

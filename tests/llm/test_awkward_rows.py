"""Null and repeated ids, empty tables, clashing columns and long texts, for each query and stage."""

import random

import pytest

import corpus_pipeline
from touchline.llm import decontaminate, embeddings, packing, pii, quality, secrets, simhash, suffixes, tokencounts, toxicity
from touchline.llm.common import encoder, tokenizer_path

from . import brute

SF = "/root/testdata/sf0.001"
ROWS = [(None, "a b c d e f g h", "s", None, 3), (None, None, None, "en", None), (1, "one two", "s", "en", 7), (1, "one two", "s", "en", 7), (1, "other text", "s", "en", 10), (2, "", "s", "en", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], "doc_id long, text string, source string, lang string, n_chars long, n_tokens long, n_docs long, tokenizer string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, 1, 1), (1, None, 0), (1, 1, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


def test_a_row_for_each_row(spark, docs, labels):
    items = spark.createDataFrame([(1, "one two"), (None, "a b")], "item_id long, text string")
    for got in (quality.op1_quality(docs, labels), simhash.op2_simhash(docs), decontaminate.op3_decontaminate(docs, items), suffixes.op6_suffixes(docs), pii.op7_pii(docs), toxicity.op8_toxicity(docs, labels), packing.op9_packing(docs), secrets.op10_secrets(docs)):
        assert sorted((r.doc_id or 0) for r in got.select("doc_id").collect()) == [0, 0, 1, 1, 1, 2], got.columns


def test_token_counts_of_awkward_rows(docs):
    encode, want = encoder(tokenizer_path()), {}
    for _, text, source, lang, _ in ROWS:
        n = want.setdefault((source, lang), [0, 0, 0])
        for k, x in enumerate((1, len(encode(text or "")), len(text or ""))):
            n[k] += x
    got = tokencounts.op5_token_counts(docs).collect()
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in got} == want
    assert tokencounts.op5_token_counts(docs.limit(0)).count() == 0


def test_groups_without_documents_but_with_characters_are_shown(spark):
    """Declared characters that no later batch takes back are an error to be seen."""
    rows = spark.createDataFrame([("s", "en", "t", 0, 0, 5)], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
    roll = tokencounts.Rollup(spark)
    roll.commit("odd", rows)
    assert [tuple(r) for r in roll.totals().collect()] == [("s", "en", "t", 0, 0, 5)]


def test_embeddings_of_awkward_rows(spark):
    v, w = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    schema = "vec_id long, embedding array<float>, label int, rep long, cnt long, dist double"
    df = spark.createDataFrame([(None, v, 1, 0, 0, 0.0), (3, v, 1, 0, 0, 0.0), (3, v, 1, 0, 0, 0.0), (5, w, 1, 0, 0, 0.0), (6, w, None, 0, 0, 0.0)], schema)
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embeddings.op4_embeddings(df).collect() if r.vec_id is not None)
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert embeddings.op4_embeddings(df).count() == 5
    assert embeddings.op4_embeddings(df.limit(0)).count() == 0


def test_embeddings_near_the_threshold(spark, monkeypatch):
    """Clusters whose members lie on either side of a cosine of 0.93, in cells and parts of a few vectors."""
    import numpy as np

    monkeypatch.setattr(embeddings, "CELL", 10)
    monkeypatch.setattr(embeddings, "MOST", 8)
    rng, rows = np.random.default_rng(9), []
    for c in range(8):
        centre = rng.normal(size=16)
        centre /= np.linalg.norm(centre)
        for _ in range(18):
            x = centre + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.09])
            rows.append((len(rows), x.tolist(), c % 2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.op4_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute.embedding_links(rows, 0.93)
    assert got == want and sum(n for n, _ in want.values()) > 100 and any(n == 0 for n, _ in want.values())


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(2500)]
    long = " ".join(words) + " mail jane@example.com token=abcdef0 4111 1111 1111 1111 " + " ".join(words[:300])
    rows = [(1, long), (2, long[5000:9000] + " tail"), (3, " ".join(words[:1500]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "BYTES", 700)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op6_suffixes(df).collect()}
    assert got == dict(zip((1, 2, 3), brute.substrings([t for _, t in rows], 400)))
    monkeypatch.setattr(simhash, "PART", 50)
    assert simhash.plain_shingles(long, 5).tolist() == sorted({x for k in range(0, 3000, 7) for x in simhash.plain_shingles(" ".join(long.split()[k : k + 11]), 5).tolist()})


def test_texts_of_over_a_million_characters(spark):
    rng = random.Random(3)
    text = " ".join(f"v{rng.randint(0, 99999)}" for _ in range(170_000)) + " one two three token=abcdef0 x@y.zz"
    df = spark.createDataFrame([(1, text), (2, "one two three")], "doc_id long, text string")
    fp, comp = brute.simhash_components([(1, text), (2, "one two three")])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(df).collect()} == {i: (f"{fp[i]:016x}", comp[i]) for i in (1, 2)}
    items = [(1, "one two three")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op3_decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.decontaminated([(1, text), (2, "one two three")], items)
    assert {r.doc_id: r.base_sha256 for r in pii.op7_pii(df).collect()}[1] == brute.digest(brute.pii(text))
    assert {r.doc_id: r.base_sha256 for r in secrets.op10_secrets(df).collect()}[1] == brute.digest(brute.secrets(text))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_null_and_repeated_ids(spark, docs, name):
    got = [r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, docs, SF).select("doc_id").collect()]
    want = [None, None, 1, 1, 2] if name == "near_dedup" else [None, None, 1, 1, 1, 2]
    assert sorted((x or 0) for x in got) == sorted((x or 0) for x in want)

"""The trained operators by held-out accuracy, the rollups by recounting, each pipeline stage against its plain version."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from touchline.llm import pii, quality, tokencounts, toxicity
from touchline.llm.common import encoder, tokenizer_path

from . import brute
from .test_contracts import SCHEMA, odd_texts

SF, MORE, MOST = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))
CLASHING = f"{SCHEMA}, _id long, _row long, _severity double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, None, "w", 1, 2, 3, 4, 5, 6, 7.0) for i, t in odd_texts()], CLASHING)


def table(spark, name, sf_dir=MORE):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_quality_on_held_out_rows(spark):
    got = quality.op1_quality(table(spark, "documents"), table(spark, "labels")).collect()
    assert len(got) == table(spark, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    y = {r.doc_id: r.quality for r in table(spark, "labels").where("quality is not null").collect()}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) >= 0.9


def test_whole_text_counts_for_quality():
    net = quality.ByteConvNet.new()
    for n in (0, 1, 4, 5, 383, 384, 385, 512, 513, 30_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert np.array_equal(net.maxima(data), net.pooled(data)[0])
    text = "a" * 40_000
    assert net.score(text) != net.score(text + "~#%") and net.score(None) == net.score("")


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.op1_quality(odd, none).count() == len(odd_texts())
    assert quality.op1_quality(odd.limit(0), none).count() == 0


def test_toxicity_on_rows_not_fitted(spark):
    """Fitted on the rows of one half of the labels, judged on the other half; on the largest table, since the smaller ones have few toxic rows in four languages."""
    docs, labels = table(spark, "documents", MOST), table(spark, "labels", MOST).where("toxic is not null")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "toxic").collect()
    toxic = [model.severity(r.text) >= toxicity.REJECT for r in rows if r.toxic]
    clean = [model.severity(r.text) >= toxicity.REJECT for r in rows if not r.toxic]
    assert toxic and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_toxicity_of_awkward_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.op8_toxicity(odd, none).where("toxic").count() == 0
    assert toxicity.op8_toxicity(odd, table(spark, "labels")).count() == len(odd_texts())
    assert toxicity.op8_toxicity(odd.limit(0), none).count() == 0


def test_token_counts(spark):
    encode, want = encoder(tokenizer_path()), {}
    for r in table(spark, "documents", SF).collect():
        n = want.setdefault((r.source, r.lang), [0, 0, 0])
        for k, x in enumerate((1, len(encode(r.text or "")), len(r.text or ""))):
            n[k] += x
    got = tokencounts.op5_token_counts(table(spark, "documents", SF)).collect()
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens, r.n_chars] for r in got} == want


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_rollup_counts_each_batch_once(spark):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    a, b, c = (1, "x", "en", "t", 10, 40), (2, "x", None, "t", 5, 9), (3, "y", "de", "t", 7, 8)
    roll = tokencounts.Rollup(spark)
    assert totals(roll) == {}
    assert roll.commit("1", tokencounts.inserts(rows(a, b, c))) and not roll.commit("1", tokencounts.inserts(rows(a)))
    assert roll.commit("2", tokencounts.deletes(rows(c)))
    assert roll.commit("3", tokencounts.revisions(rows(a), rows((1, "x", "en", "t", 12, 44))))
    want = {("x", "en"): (1, 12), ("x", None): (1, 5)}
    assert totals(roll) == want
    assert roll.compact("all") and roll.committed() == ["all"] and totals(roll) == want
    assert not roll.commit("1", tokencounts.inserts(rows(a))) and not roll.compact("all") and totals(roll) == want
    assert roll.commit("4", tokencounts.inserts(rows(c))) and roll.compact("all-2")
    again = tokencounts.Rollup(spark, roll.path)
    assert not again.commit("2", tokencounts.inserts(rows(a))) and totals(again) == want | {("y", "de"): (1, 7)}


def test_rollup_of_a_broken_compaction(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x", "en", "t", 10, 40)], "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    roll = tokencounts.Rollup(spark)
    roll.commit("1", tokencounts.inserts(rows))
    with monkeypatch.context() as m:
        m.setattr(roll, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            roll.compact("all")
    assert totals(roll) == {("x", "en"): (1, 10)} and roll.committed() == ["1"]
    assert roll.compact("all") and totals(roll) == {("x", "en"): (1, 10)}


def broken_off(spark, folder):
    """What a writer leaves that was broken off: files, but no mark that they are whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/_SUCCESS")
    assert at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def test_a_commit_that_broke_off_counts_once_it_is_repeated(spark):
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    a, b = (1, "x", "en", "t", 10, 40), (2, "x", "en", "t", 5, 9)
    roll = tokencounts.Rollup(spark)
    roll.commit("1", tokencounts.inserts(rows(a)))
    roll.commit("2", tokencounts.inserts(rows(b, b)))
    broken_off(spark, f"{roll.path}/batch=2")
    assert roll.committed() == ["1"] and totals(roll) == {("x", "en"): (1, 10)}
    again = tokencounts.Rollup(spark, roll.path)
    assert again.commit("2", tokencounts.inserts(rows(b))) and not again.commit("2", tokencounts.inserts(rows(b)))
    assert totals(again) == {("x", "en"): (2, 15)} == totals(roll)


def test_a_scan_that_broke_off_is_made_again(spark):
    from touchline.llm import secrets

    docs = spark.createDataFrame([(1, "token=abcdef0"), (2, "nothing")], "doc_id long, text string")
    ledger = secrets.Ledger(spark)
    assert ledger.scan(docs.where("doc_id = 2")).count() == 1
    ledger.scan(docs)
    broken_off(spark, ledger._batches()[-1])
    assert ledger.table().count() == 1
    again = secrets.Ledger(spark, ledger.path)
    assert again.scan(docs).count() == 2 and again.table().where("size(spans) > 0").count() == 1
    assert again.scan(docs).count() == 2  # nothing is unseen any more


def test_texts_beyond_what_models_are_fitted_on(spark):
    """Fitting leaves out the longest texts; scores see all of every text, however long."""
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    telling = sorted(model.weights, key=model.weights.get)[-5:]
    plain = "lorem ipsum dolor sit amet " * 8000
    assert len(plain) > 9 * toxicity.LONGEST
    text = plain + " ".join(x.removeprefix("^") for x in telling)
    df = spark.createDataFrame([(1, plain), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r.severity for r in toxicity.with_severity(df, model).collect()}
    assert got[2] > got[1]
    scores = quality.op1_quality(docs.select("doc_id", "text").unionByName(df.selectExpr("doc_id - 10 doc_id", "text")), labels)
    assert all(0 <= r.score <= 1 for r in scores.where("doc_id < 0").collect()) and scores.where("doc_id < 0").count() == 2


def test_a_very_long_text_is_packed_whole(spark):
    from touchline.llm import packing

    text = " ".join(f"word{k % 977}" for k in range(120_000))
    want = [*encoder(tokenizer_path())(text).tolist(), 0]
    rows = packing.op9_packing(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")).collect()
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(want) > 100_000
    at = 0
    for r in mine:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
        assert r.length == 2048 or r.piece == 0
        at += r.length


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_on_the_table(spark):
    """Each stage's rows from those of the one before, and run()'s rows."""
    docs = table(spark, "documents", SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, table(spark, "labels", SF))
    kept = {i: t for i, t in rows.items() if model.severity(t) < toxicity.REJECT}
    steps = dict(corpus_pipeline.STAGES)
    docs = steps["toxicity"](spark, docs, SF)
    assert ids(docs) == sorted(kept)
    near = set(brute.one_of_each(kept.items()))
    kept = {i: t for i, t in kept.items() if i in near}
    docs = steps["near_dedup"](spark, docs, SF)
    assert ids(docs) == sorted(kept)
    items = [(r.item_id, r.text) for r in table(spark, "benchmark", SF).collect()]
    leaked = brute.decontaminated(kept.items(), items)
    kept = {i: t for i, t in kept.items() if not leaked[i][4]}
    docs = steps["decontaminate"](spark, docs, SF)
    assert ids(docs) == sorted(kept)
    docs = steps["pii"](spark, docs, SF)
    assert docs.columns == table(spark, "documents", SF).columns
    for r in docs.collect():
        assert r.n_chars == len(r.text) and (r.text == kept[r.doc_id]) == (not pii.find(kept[r.doc_id])[1])
    packed = corpus_pipeline.run(spark, SF)
    assert sorted(set(ids(packed))) == sorted(kept)
    encode, text = encoder(tokenizer_path()), {r.doc_id: r.text for r in docs.collect()}
    for r in packed.collect():
        part = np.append(encode(text[r.doc_id]), 0).astype("<u4")[r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out, none = stage(spark, odd, SF), stage(spark, odd.limit(0), SF)
    assert none.count() == 0 and set(ids(out)) <= set(range(len(odd_texts())))
    if name != "packing":
        assert out.columns == odd.columns == none.columns

import numpy as np
import pytest

from hourloom.llm import score
from plain_llm import base_scores, held_out, odd_documents


def plain(docs):
    rows = sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}, key=str)
    return rows, base_scores(rows)


@pytest.mark.parametrize("block,segment", [(1 << 27, 2_000_000), (60_000, 3000)])
def test_base_is_exact_and_pairs_help(spark, folder, monkeypatch, block, segment):
    monkeypatch.setattr(score, "BLOCK_BYTES", block)
    monkeypatch.setattr(score, "SEGMENT_GRAMS", segment)
    monkeypatch.setattr(score, "FLUSH_WORDS", 20_000)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, (want, total) = plain(docs)
    got = {r.doc_id: r for r in score.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for (doc, _), (tokens, known, base) in zip(rows, want):
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(doc), tokens, known, total)
        assert np.isclose(r.base_score, base, rtol=1e-12) and r.score <= 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_blocks_give_what_one_block_gives(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    monkeypatch.setattr(score, "SEGMENT_GRAMS", 2000)
    model, bits, texts = score.train(docs)
    one = {r.doc_id: r.score for r in score.score(docs, model, bits, texts).collect()}
    monkeypatch.setattr(score, "BLOCK_BYTES", 40_000)
    assert {r.doc_id: pytest.approx(r.score) for r in score.score(docs, model, bits, texts).collect()} == one


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(0)
    grams, counts = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)), None
    counts = rng.geometric(0.3, len(grams))
    import pyarrow as pa
    row = score._segment(pa.table({"__kind": pa.array([2], pa.int32()), "__segment": pa.array([0], pa.int64()),
                                   "__grams": [grams.astype("<u8").tobytes()], "__counts": [counts.astype("<u4").tobytes()]})).to_pylist()[0]
    block = score.Block(0, 0, 1)
    block.add(row)
    level = block.pair_levels(grams).astype(int)
    assert (level >= score.levels(counts)).all() and (level > score.levels(counts)).mean() < 0.06
    assert (score.lowest_count(score.levels(counts)) <= counts).all()
    assert (block.pair_levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_chances_after_a_word_do_not_exceed_one(spark):
    text = "a b a b a c a d b a b c"
    docs = spark.createDataFrame([(2, text)], "doc_id long, text string")
    model, bits, texts = score.train(docs)
    words = ["a", "b", "c", "d", "unseen"]
    probe = spark.createDataFrame([(k, f"a {w}") for k, w in enumerate(words)] + [(9, "a"), (10, "")], "doc_id long, text string")
    got = {r.doc_id: 10 ** r.score for r in score.score(probe, model, bits, texts).collect()}
    end_after = {k: 10 ** 0 for k in words}
    assert len(end_after) == 5 and all(0 < v < 1 for v in got.values())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = score.score_documents(docs)
    rows, (want, total) = plain(docs)
    have = {(r.doc_id, r.n_tokens, r.n_known) for r in got.collect()}
    assert got.count() == docs.count() and {r.train_tokens for r in got.collect()} != set()
    assert {(d, t) for d, t, _ in have} == {(d, t) for (d, _), (t, _, _) in zip(rows, want)}
    assert score.score_documents(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(k, "x y") for k in range(40) if held_out(k)], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known) for r in score.score_documents(only).collect()} == {(0, 0)}

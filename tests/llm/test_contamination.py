import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import decontaminate
from plain_llm import contamination, odd_documents, windows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=40), min_size=1, max_size=8), st.text("ab ", max_size=300))
def test_matcher_finds_all_occurrences(strings, text):
    strings = sorted({(" " + s + " ").encode() for s in strings})
    for low, high in ((3, 12), (12, 32), (32, 99)):
        if own := [s for s in strings if low <= len(s) < high]:
            found = sorted(decontaminate.Matcher(own).search(text.encode()))
            assert found == sorted((p, i) for i, s in enumerate(own) for p in range(len(text)) if text.encode().startswith(s, p))


def test_long_text_with_planted_windows():
    rng = np.random.default_rng(0)
    words = [f"w{k}".encode() for k in rng.integers(0, 500, 50_000)]
    rows = [(str(k), b" " + b" ".join(words[a:a + 10]) + b" ") for k, a in enumerate(rng.integers(0, 49_000, 200).tolist())]
    hit, items = decontaminate.Windows(rows).find([[b"x"], words, []])[1]
    assert len(items) == 200 and hit.sum() >= 1000


@pytest.mark.parametrize("block", [1 << 24, 1500])
def test_against_plain_search(spark, folder, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    if block < 1 << 20:
        items = items.filter("item_id < 4")
    found = windows(items.select("item_id", "text").collect())
    got = decontaminate.mark_contamination(docs, items, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["__n_words"], r["__n_hit"], r["__items"]) == contamination(r.text, found)
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in got if not r["__n_hit"]}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(
        [(1, "The QUICK brown-fox, jumps over the lazy dog and runs away"), (1, "x"), (2, "12345"), (None, "hund und"),
         (3, None), (4, "!!"), (10, "é\x1fz"), (2, "12345")], "item_id long, text string")
    found = windows(items.collect())
    got = decontaminate.mark_contamination(docs, items, docs.columns).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["__n_words"], r["__n_hit"], r["__items"]) == contamination(r.text, found)
    assert sum(r["__n_hit"] > 0 for r in got) >= 5
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.clean_documents(docs.limit(0), items).count() == 0


def test_a_window_that_all_items_share_fills_no_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40_000)
    sizes, plain = [], decontaminate.Windows.__init__

    def counted(self, rows):
        sizes.append(sum(len(i) + len(w) + 100 for i, w in rows))
        plain(self, rows)

    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    items = spark.range(2000).selectExpr("id as item_id", "'one window of ten words that all of the items share' as text")
    docs = spark.createDataFrame([(1, "Here: one window of ten words that all of the items share!"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: (r["__n_hit"], len(r["__items"])) for r in decontaminate.mark_contamination(docs, items, ["doc_id"]).collect()}
    assert got == {1: (11, 2000), 2: (0, 0)}
    assert len(sizes) > 5 and max(sizes) < 60_000

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hourloom.llm import mix
from plain_llm import WORD, odd_documents


def targets(sizes):
    """Weights 3, 1, 2 over sorted sources, NULL last; caps at twice the size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / max(1e-9, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


@pytest.mark.parametrize("bits", [4, 512])
def test_targets_and_budgets(spark, folder, monkeypatch, bits):
    monkeypatch.setattr(mix, "RANGE_ROWS", bits)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mix.mix(docs).toPandas()
    assert len(got) == docs.count()
    assert (got["__size"] == [len(WORD.findall(t)) for t in got.text]).all()
    want = targets(got.groupby("source")["__size"].sum().to_dict())
    for source, rows in got.groupby("source"):
        assert np.isclose(rows["__target"].iloc[0], want[source])
        whole, sums = int(want[source] // rows["__size"].sum()), {0}
        for size in rows["__size"]:
            sums |= {s + size for s in sums}
        rest = round(want[source] - whole * rows["__size"].sum())
        best = whole * rows["__size"].sum() + max(s for s in sums if s <= rest)
        assert (rows["__size"] * rows["__copies"]).sum() == best
        assert rows["__copies"].max() <= 2
    again = mix.mix(docs.repartition(5)).toPandas()
    assert dict(zip(again.doc_id, again["__copies"])) == dict(zip(got.doc_id, got["__copies"]))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 5), max_size=8), st.integers(0, 400))
def test_budget_is_fitted_exactly(lengths, budget):
    length, count = np.array(list(lengths), int), np.array(list(lengths.values()), int)
    taken = mix.fit_budget(length, count, budget)
    assert (taken >= 0).all() and (taken <= count).all()
    words = int((taken * length).sum())
    assert words == (best_sum(lengths, lengths.values(), budget) if 0 < budget < int((length * count).sum()) else
                     min(max(budget, 0), int((length * count).sum())))


def test_no_budget_is_missed_that_can_be_met():
    rng = np.random.default_rng(11)
    for _ in range(1500):
        n = rng.integers(1, 7)
        length = rng.choice(np.arange(1, rng.choice([30, 700, 4000])), n, replace=False)
        count = rng.integers(1, 6, n)
        budget = int((length * count).sum() * rng.random())
        taken = mix.fit_budget(length, count, budget)
        assert (taken >= 0).all() and (taken <= count).all()
        assert int((taken * length).sum()) == (best_sum(length.tolist(), count.tolist(), budget) if budget else 0)


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {t for s in sums for k in range(c + 1) if (t := s + k * n) <= budget}
    return max(sums)


@pytest.mark.parametrize("lengths, counts, budget, words", [
    ([60_000, 50_000], [1, 1], 55_000, 50_000),
    ([100, 500_000], [1000, 1], 540_000, 540_000),
    ([20_000, 20_001, 20_002], [1, 1, 1], 40_001, 40_001),
    ([10, 30_000], [1000, 1], 35_000, 35_000),
    ([100, 50_000_000], [1_000_000, 1], 54_000_000, 54_000_000)])
def test_long_documents_are_fitted(lengths, counts, budget, words):
    taken = mix.fit_budget(np.array(lengths), np.array(counts), budget)
    assert (taken >= 0).all() and (taken <= counts).all() and int((taken * lengths).sum()) == words


@pytest.mark.parametrize("kept", [64 << 20, 1 << 14])
@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(mix.FITTED_WORDS + 1, 300_000) | st.integers(1, 2_000), st.integers(1, 3), min_size=1, max_size=5),
       st.floats(0.01, 0.99))
def test_lengths_over_the_window_against_brute_force(kept, lengths, share):
    length, count = np.array(list(lengths), int), np.array(list(lengths.values()), int)
    budget, old = int((length * count).sum() * share), mix.KEPT_BYTES
    mix.KEPT_BYTES = kept
    try:
        taken = mix.fit_budget(length, count, budget)
    finally:
        mix.KEPT_BYTES = old
    assert (taken >= 0).all() and (taken <= count).all()
    words, best = int((taken * length).sum()), best_sum(lengths, lengths.values(), budget)
    assert words <= budget
    assert words == best


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mix.mix(docs).toPandas()
    assert len(got) == docs.count() and got["__size"].isna().sum() == 0
    assert list(mix.mixed_documents(docs).columns) == docs.columns
    assert mix.mixed_documents(docs).count() == got["__copies"].sum()
    assert mix.mix(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("*", "text as __size", "1 as __h", "source as __null", "doc_id as __row", "2 as __copies")
    assert mix.mix(clashing).agg({"__copies": "sum"}).first()[0] == got["__copies"].sum()
    assert mix.mixed_documents(clashing).columns == clashing.columns
    silent = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert {r["__target"] for r in mix.mix(silent).collect()} == {0.0}

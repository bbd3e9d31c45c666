import numpy as np
import pandas as pd
import pytest

from hourloom.llm import components as parts
from hourloom.llm import embeddings, simhash
from plain_llm import components, odd_documents
from plain_llm import simhash as plain


def near(n, seed, spread):
    """Fingerprints in clusters of a few differing bits."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    out = centres[rng.integers(0, 6, n)]
    for _ in range(spread):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


@pytest.mark.parametrize("n,m", [(1, 1), (63, 64), (300, 130)])
def test_bit_sliced_pairs(n, m):
    left, right = near(n, 1, 2), near(m, 1, 3)
    found = {(i, j) for a, b in simhash.near_pairs(left, right, np.arange(64)) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(n) for j in range(m) if np.bitwise_count(left[i] ^ right[j]) <= 4}


@pytest.mark.parametrize("distinct", [1, 10**5, 10**8, 10**10, 10**13])
def test_tables_miss_no_pair_within_the_radius(distinct):
    cut = simhash.tables(distinct)
    rng = np.random.default_rng(5)
    for _ in range(300):
        differ = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not any(differ & set(range(p, p + w)) for p, w in blocks) for blocks in cut)


@pytest.mark.parametrize("bucket,tile", [(2048, 4096), (8, 20)])
def test_documents_against_plain_version(spark, folder, monkeypatch, bucket, tile):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "TILE", tile)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(want)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = plain({(r.doc_id, r.text) for r in rows if r.doc_id is not None} - {(4, None)} | {(4, "")})
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 2
    again = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    assert simhash.without_near_duplicates(again).count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_taken_away_one_by_one(spark):
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(rng.choice([f"w{k}" for k in range(400)], 60)) for _ in range(4))
    rows = [(5, a, 0), (5, b, 1), (3, b.upper(), 2), (7, a.upper(), 3), (None, c, 4), (None, c.upper(), 5), (None, c, 6),
            (None, a, 7), (8, d, 8), (8, d.upper(), 9), (8, d, 10), (None, "", 11), (None, None, 12), (9, "", 13), (9, " ", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(4)
    kept = [(r.doc_id, (r.text or "").strip().lower()) for r in simhash.without_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (None, c), (8, d), (None, ""), (9, "")], key=str)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + rng.integers(200, 260, (30, 2)).tolist()
    got = parts.components(spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"])), "a", "b").collect()
    want = components(260, pairs)
    linked = {n for a, b in pairs for n in (a, b) if a != b}
    assert {r["__node"]: r["__root"] for r in got} == {n: want[n] for n in linked} and len(got) == len(linked)


def plain_vectors(rows, least=0.93):
    """{key: (links, component)} of (key, vector, label) rows with different keys."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, pairs = len(rows), []
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                    pairs.append((i, j))
    links = np.bincount(np.array(pairs, int).reshape(-1), minlength=n) if pairs else np.zeros(n, int)
    return {rows[i][0]: (links[i], min(r for r in (rows[j][0] for j in range(n)) if r == rows[c][0]))
            for i, c in enumerate(components(n, pairs))}


@pytest.mark.parametrize("dims,tile", [(20, 2048), (20, 15), (5, 2048)])
def test_vectors_against_plain_version(spark, monkeypatch, dims, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    rows = [(k, (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0, 0.1, 0.3])).astype(np.float32).tolist(),
             int(rng.integers(2))) for k in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == plain_vectors(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.01], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [1.0, 0.0], 2), (13, [1e-30, 0.0], 1), (14, [1.0, 0.0], 1), (15, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id as a", "label as links")
    got = embeddings.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    twice = spark.createDataFrame([(1, [1.0], 1), (1, [1.0], 1), (None, [1.0], 1), (None, None, None)],
                                  "vec_id long, embedding array<float>, label int")
    assert sorted((r.n_links, r.component_id) for r in embeddings.near_duplicates(twice).collect() if r.component_id) == [(2, 1)] * 3
    assert embeddings.near_duplicates(df.limit(0)).count() == 0

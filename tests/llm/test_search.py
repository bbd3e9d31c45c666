import math
import re
from collections import Counter

import duckdb
import pytest

from check_queries import canonical
from hourloom.llm import queries, search
from plain_llm import lowered, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items):
    """(item, rank, key, score) of (key, text) rows."""
    counts = [(k, Counter(TERM.findall(lowered(t)))) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for name, text in items:
        scored = []
        for k, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                        for w, q in Counter(TERM.findall(lowered(text))).items() if w in c)
            if score > 0:
                scored.append((-score, k is not None, k or 0))
        out += [(name, r + 1, k if there else None, -s) for r, (s, there, k) in enumerate(sorted(scored)[:20])]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("known, block, terms", [(1 << 25, 8192, 16_384), (0, 7, 20), (1 << 25, 40, 3)])
def test_against_plain_search(spark, folder, monkeypatch, known, block, terms):
    monkeypatch.setattr(search, "KNOWN_BYTES", known)
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "BUNDLE_TERMS", terms)
    monkeypatch.setattr(search, "SLICE_BYTES", 50)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet").limit(20 if terms > 20 else 5)
    if terms < 20_000:
        items = items.union(items.limit(1))
    got = rows(search.search(docs, items))
    want = plain_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert got == sorted(want, key=str)


def test_odd_rows_and_ties(spark):
    docs = odd_documents(spark)
    copies = docs.limit(1).crossJoin(spark.range(40)).drop("doc_id").withColumnRenamed("id", "doc_id").select(docs.columns)
    docs = docs.union(copies).union(copies.limit(3))
    items = spark.createDataFrame([(1, "The QUICK brown-fox fox"), (None, "hund und"), (3, None), (4, "!!"), (5, "É nothing"),
                                   (6, "word1 word4 word4"), (6, "quick")], "item_id long, text string")
    items = items.selectExpr("*", "item_id as score", "text as doc_id", "item_id as __item", "text as __term")
    want = plain_search(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert rows(search.search(docs, items)) == sorted(want, key=str)
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    mine = canonical(queries.QUERIES["op11_search"](spark, folder).toPandas())
    assert mine == canonical(con.sql(queries.ORACLE["op11_search"]).df())

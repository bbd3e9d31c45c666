import duckdb
import pytest

from hourloom.llm import queries, shards
from plain_llm import odd_documents


@pytest.mark.parametrize("limit", [500, 20_000])
def test_shards_fit_and_hold_every_row(spark, folder, limit):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = shards.assign_shards(docs, limit=limit).toPandas()
    assert len(out) == docs.count()
    size = out.assign(b=out.text.str.encode("utf8").str.len()).groupby("shard").agg(
        b=("b", "sum"), n=("b", "size"), said=("shard_bytes", "first"), rows=("shard_rows", "first"), big=("oversized", "first"))
    assert (size.b == size.said).all() and (size.n == size.rows).all()
    assert ((size.b <= limit) | (size.n == 1)).all() and (size.big == (size.b > limit)).all()
    # Only what had to be was split: a shard and its sister together are over the limit.
    inside = out.drop_duplicates("shard").shard.str.split("-", expand=True).astype(int)
    path = {(d, p) for d, p in inside.itertuples(index=False)}
    assert not any((d, p ^ 1) in path and size.b[f"{d}-{p}"] + size.b[f"{d}-{p ^ 1}"] <= limit for d, p in path if d)


def test_same_rows_as_sql_with_a_small_limit(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sql = shards.SHARDS_SQL.replace(f"greatest(1, least({shards.SHARD_BYTES}, (select sum(size) from d) // 64))", "9000")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = db.sql(sql).df().sort_values("doc_id").reset_index(drop=True)
    got = shards.assign_shards(docs, limit=9000).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in ("shard", "shard_depth", "shard_bytes", "shard_rows", "oversized"):
        assert (got[c] == want[c]).all()


def test_deep_directories(spark, monkeypatch):
    monkeypatch.setattr(shards, "SPARE_BITS", 0)
    monkeypatch.setattr(shards, "STEP_BITS", 1)
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('x', 100) as text")
    out = shards.assign_shards(docs, limit=250).toPandas()
    assert len(out) == 300 and (out.shard_bytes <= 250).all()


def test_one_key_is_split_by_text_and_repeated_rows_by_number(spark):
    rows = spark.range(900).selectExpr("7L as doc_id", "repeat(cast(id as string), 40) as text", "1 as __h", "id as __at")
    rows = rows.union(spark.range(300).selectExpr("8L", "repeat('y', 90)", "1", "-1L")).union(
        spark.range(5).selectExpr("9L", "repeat('z', 3000)", "1", "id"))
    out = shards.assign_shards(rows, limit=1000)
    assert out.columns[:4] == rows.columns
    got = out.toPandas()
    size = got.assign(b=got.text.str.len()).groupby("shard").agg(
        b=("b", "sum"), n=("b", "size"), said=("shard_bytes", "first"), rows=("shard_rows", "first"), big=("oversized", "first"))
    assert len(got) == 1205 and (size.b == size.said).all() and (size.n == size.rows).all()
    assert ((size.b <= 1000) | (size.n == 1)).all() and size.big.sum() == 5
    assert (got["__h"] == 1).all() and sorted(got["__at"])[-1] == 899


def test_the_query_splits(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = queries.QUERIES["op3_shards"](spark, folder).select("shard", "shard_depth").distinct().toPandas()
    assert len(found) >= 30 and found.shard_depth.max() >= found.shard_depth.min() + 2
    assert shards.fine_limit(docs.limit(0)) == 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = shards.assign_shards(docs, limit=60)
    assert out.count() == docs.count()
    assert out.filter("shard is null").count() == 0
    assert {r.oversized for r in out.filter("doc_id in (2, 7)").collect()} == {True}  # a repeated row, a long text
    assert shards.assign_shards(docs.limit(0)).count() == 0


def test_files(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shards.write_shards(shards.assign_shards(docs, limit=50_000), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()


def test_query_and_sql_are_registered():
    assert set(queries.ORACLE) == {"op2_contamination", "op3_shards", "op11_search", "op13_prefix_trie"}
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_contamination", "op3_shards"])
def test_queries_equal_their_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = db.sql(queries.ORACLE[name]).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.astype(str).equals(want.astype(str))

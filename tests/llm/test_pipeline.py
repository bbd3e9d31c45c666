import corpus_pipeline as pipeline
import __spark_entry__ as entry
from hourloom.llm import mix, shards
from hourloom.llm.common import table
from plain_llm import contamination, odd_documents, simhash, windows


def test_stages_one_by_one_against_plain_versions(spark, folder):
    docs = table(spark, folder, "documents")
    columns, now = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    named = dict(pipeline.STAGES)
    assert list(named) == ["language", "near_duplicates", "decontamination", "mix", "shards"]

    docs = named["language"](spark, docs, folder)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(now)  # all are in a known language

    docs = named["near_duplicates"](spark, docs, folder)
    want = {c for _, c in simhash(list(now.items())).values()}
    assert docs.columns == columns and sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)

    docs = named["decontamination"](spark, docs, folder)
    found = windows(table(spark, folder, "benchmark").select("item_id", "text").collect())
    want = {d for d in want if not contamination(now[d], found)[1]}
    assert docs.columns == columns and sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want)

    before, docs = docs, named["mix"](spark, docs, folder)
    copies = {r.doc_id: r["__copies"] for r in mix.mix(before).collect()}
    got = [r.doc_id for r in docs.collect()]
    assert docs.columns == columns and sorted(got) == sorted(d for d, n in copies.items() for _ in range(n))

    out = named["shards"](spark, docs, folder)
    assert out.columns[:5] == columns and out.count() == len(got)
    assert out.groupBy("shard").agg({"shard_bytes": "max"}).filter(f"`max(shard_bytes)` > {shards.SHARD_BYTES}").isEmpty()


def test_run_and_registration(spark, folder):
    assert entry.queries()["pipeline"] is pipeline.run
    assert pipeline.run(spark, folder).count() > 0


def test_stages_on_odd_rows(spark, folder):
    for rows in (odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars", "size", "shard"),
                 odd_documents(spark).limit(0)):
        docs = rows
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, folder)
            docs.count()

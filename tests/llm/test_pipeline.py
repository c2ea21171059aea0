"""The pipeline: each stage on its own input, held against plain Python."""

import re

import corpus_pipeline
from ingestctl.llm import catalog, quality
from ingestctl.scratch import materialise
from tests.llm.test_decontaminate import plain_search
from tests.llm.test_packing import check_places
from tests.llm.test_secrets import plain_base
from tests.llm.test_simhash import plain_components, plain_fingerprint

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DIR), "test-stage")
        results.append(docs)
    good, distinct, clean, masked, packed = results
    assert all(r.columns == columns for r in results[:4])

    every = spark.read.parquet(f"{DIR}/documents.parquet")
    scored = quality.score_quality(every, spark.read.parquet(f"{DIR}/labels.parquet"))
    kept = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(texts) == kept

    prints = [(i, plain_fingerprint(t)) for i, t in sorted(texts.items())]
    texts = {r["doc_id"]: r["text"] for r in distinct.collect()}
    assert set(texts) == {c for _, c in plain_components(prints)}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    bad = {i for i, *_ in plain_search(list(texts.items()), items)}
    assert bad
    before = {i: t for i, t in texts.items() if i not in bad}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == before

    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert set(after) == set(before)
    for doc, text in before.items():
        assert not plain_base(after[doc][0]) and len(after[doc][0]) == after[doc][1]
        if not re.search(r"[0-9]", text):
            assert after[doc][0] == text

    pieces = packed.collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    check_places(pieces)


def test_run_writes_all_stages(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns[-2:] == ["sequence_id", "offset"] and got.count() > 0


def test_registered_once_each():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)

"""The pipeline against its operators run one by one, and the registered queries."""

import hashlib

import corpus_pipeline
from migrata.llm import bpe, decontaminate, lines, quality, queries, simhash
from migrata.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stored(stage(spark, now, SF), "test")
        assert now.dtypes == docs.dtypes, name
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        if name == "quality":
            assert ids == {r["doc_id"] for r in quality.classify(before, labels).where("predicted = 1").collect()}
        elif name == "lines":
            assert ids == {r["doc_id"] for r in before.collect()} and lines.report(before).where("n_gone > 0").count() > 0
        elif name == "near_duplicates":
            assert ids == {r["component_id"] for r in simhash.near_duplicates(before).collect()} and now.count() == len(ids)
        else:
            assert decontaminate.report(before, items).where("contaminated").count() > 0
            assert decontaminate.report(now, items).where("contaminated").count() == 0
            clean = {r["doc_id"] for r in decontaminate.report(before, items).where("not contaminated").collect()}
            assert clean <= ids
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(last) == ids
    enc = bpe.codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS), corpus_pipeline.public_tokenizers.PATTERN).encoding
    for r in now.collect():
        assert bpe.unpacked(last[r["doc_id"]]["ids"]) == enc.encode_ordinary(r["text"])
        assert last[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))

"""The corpus pipeline on the smallest tables, stage by stage against plain rules."""

import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.dtypes == start.dtypes, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert kept["toxicity"].keys() <= kept["quality"].keys() and kept["jaccard"].keys() <= kept["toxicity"].keys()
    assert kept["suffixes"].keys() == kept["jaccard"].keys() == kept["packing"].keys()
    good = [k for k, r in labels.items() if r["quality"] == 1]
    assert sum(k in kept["quality"] for k in good) >= 0.98 * len(good)
    seen = set()
    for k in sorted(kept["suffixes"]):
        b = kept["suffixes"][k]["text"].encode()
        assert len(kept["suffixes"][k]["text"]) == kept["suffixes"][k]["n_chars"]
        strings = {b[i : i + 53] for i in range(len(b) - 52)}  # narrowing to whole characters may leave up to three bytes
        assert not strings & seen
        seen |= strings
    assert corpus_pipeline.ORACLE_SQL is None

"""Each stage on its own input, and the whole run."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provenant.llm import queries
from tests.llm.test_operators import awkward, near_brute, within

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append((name, docs.count()))
        if name != "mixing":
            assert docs.columns == columns
        if name == "exact dedup":
            assert docs.selectExpr("count(DISTINCT translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))").first()[0] == docs.count()
        if name == "decontamination":
            items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(within(i, (r["text"] or "").lower().split(), int(0.2 * len(i))) for r in docs.collect() for i in items)
        if name == "mixing":
            copies = collections.Counter(r["doc_id"] for r in docs.collect())
            assert max(copies.values()) <= 2
    counts = [n for _, n in seen[:4]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100, seen


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = {(r["doc_id"], r["copy_no"]): size(r["text"]) for r in out.collect()}
    assert len(rows) == out.count() > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_with_awkward_rows(spark, name):
    """Nulls, empty and long texts, repeated rows, an empty table, and columns whose names clash with what the stages use."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = awkward(spark).withColumns({c: F.lit("mine") for c in ("tid", "found", "row", "copy_no", "__hash", "score")})
    out = stage(spark, docs, SF)
    extra = ["copy_no_"] if name == "mixing" else []
    assert out.columns == docs.columns + extra
    rows = out.collect()
    assert {r["found"] for r in rows} <= {"mine"} and {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
    if name in ("toxicity", "decontamination"):
        assert len(rows) == docs.count()
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == out.columns and none.count() == 0


def test_toxic_documents_go(spark):
    """At sf0.1, where there are labels enough to learn from: the stage drops what op6 scores, which is most of what is marked and little else."""
    top = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, top).collect()}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, top).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{top}/labels.parquet").collect() if r["doc_id"] in scores}
    toxic, clean = ({i for i, t in marks.items() if t == k} for k in (1, 0))
    assert len(toxic - kept) >= 0.85 * len(toxic) and len(clean & kept) >= 0.99 * len(clean)


def test_near_copies_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF).collect()}
    assert left == {row[0] for row in near_brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if row[3]} and len(left) < docs.count()

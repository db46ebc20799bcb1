"""The pipeline's stages on the driver's smallest tables, each against a plain version of itself."""

import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def outputs(spark):
    """What the stages of ``run`` keep, and what it returns."""
    from scanloom.storage import saved

    out = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(corpus_pipeline, "saved", lambda df, name: out.append(saved(df, name)) or out[-1])
        last = saved(corpus_pipeline.run(spark, SF), "packed")
    assert len(out) == len(corpus_pipeline.STAGES) - 1
    return [*out, last]


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(spark, outputs):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(x.columns == columns for x in outputs[:-1])


def test_clean_documents_stay(spark, outputs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert outputs[0].count() == docs.where(F.col("text").rlike("[a-zA-Z]")).count()


def test_one_of_each_group(outputs):
    want = {c for _, c in brute.similar(rows(outputs[0])).values()}
    assert {i for i, _ in rows(outputs[1])} == want


def test_repeats_are_cut(outputs):
    want, got = brute.repeats(rows(outputs[1])), dict(rows(outputs[2]))
    assert set(got) == set(want)
    for i, t in rows(outputs[1]):
        if not want[i][1]:
            assert got[i] == t
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[2].collect())
    assert sum(len(t.encode()) for t in got.values()) == pytest.approx(sum(n - gone for n, gone, _, _ in want.values()), abs=4 * len(got))


def test_contaminated_documents_go(spark, outputs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, x in brute.contaminated(rows(outputs[2]), items).items() if not x[-1]}
    assert {i for i, _ in rows(outputs[3])} == want


def test_every_token_is_packed(outputs):
    pieces = outputs[4].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows(outputs[3])}
    assert all(r["n"] == r["total"] for r in pieces)
    lengths = [r["n"] for r in outputs[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(lengths) <= 2048 and np.mean([n == 2048 for n in lengths]) > 0.7

"""run() against plain Python for the stages that plain Python can tell, and
the queries with SQL against DuckDB."""

import hashlib

import pytest

pytest.importorskip("wayfare.llm")

import corpus_pipeline as P  # noqa: E402
from wayfare.llm import toxicity  # noqa: E402
from wayfare.llm.queries import TOXIC_AT  # noqa: E402

from test_operators import classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in toxicity.score(docs, model).where(f"score < {TOXIC_AT}").collect())
    last = {t: i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[t] == i]
    near = classes(rows)
    rows = [(i, t) for i, t in rows if near[i][2]]
    clean = [i for i, t in rows if not any(
        b.text.encode() in (t or "").encode() for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    texts = dict(rows)
    assert set(got) <= set(clean) and len(clean) - len(got) <= 2  # passages cut short are caught, too
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in got.items())


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in P.STAGES[1:-1]:
        assert step(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, step in P.STAGES:
        assert step(spark, empty, SF).count() == 0

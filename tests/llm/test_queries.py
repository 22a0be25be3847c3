"""The registered queries: SQL where there is some, and the pipeline's stages."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from peerlens.llm.oracle import ORACLES
from peerlens.llm.queries import QUERIES
from peerlens.session import parquet

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test data not available")
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(ORACLES[name])
    columns = [c[0] for c in res.description]
    want = sorted(res.fetchall(), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()), key=str)
    assert got == want


def test_pipeline_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("test data not available")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup",
                                                      "decontamination", "packing"]
    docs = parquet(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {r[0] for r in docs.select("doc_id").collect()}
    assert 0.5 * docs.count() < len(ids) < docs.count()
    for r in out:
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0

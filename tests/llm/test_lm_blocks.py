"""op2: what blocks and buckets send each other, and the disk it takes."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerlens.llm import lm
from peerlens.session import ensure_checkpoint_dir


def _bytes(spark) -> int:
    """Shuffle files and stored tables."""
    local = Path(spark.sparkContext.getConf().get("spark.local.dir", "/tmp"))
    tables = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    files = [*local.glob("blockmgr-*/*/shuffle_*"), *tables.rglob("*.parquet")]
    return sum(f.stat().st_size for f in files)


def _corpus(spark, n_docs: int = 400, n_words: int = 500):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, n_words), 20_000)), k % 7 != 2)
            for k in range(n_docs)]
    return spark.createDataFrame(rows, "doc_id long, text string, train boolean")


def test_disk_of_a_text(spark):
    docs = _corpus(spark).repartition(4)
    before = _bytes(spark)
    scored = lm.score(docs, train=F.col("train"))
    n = scored.agg(F.sum("n_tokens")).first()[0]
    assert n == 400 * 501
    assert (_bytes(spark) - before) / n < 11


@pytest.mark.parametrize("block,bucket", [(1, 1 << 10), (1 << 20, 1 << 10), (1 << 20, 8 << 20)])
def test_blocks_and_buckets_do_not_matter(spark, block, bucket, monkeypatch):
    docs = _corpus(spark, 30, 200).unionByName(_corpus(spark, 3, 200))
    docs = docs.unionByName(spark.createDataFrame([(None, None, True), (99, "", None)], docs.schema))
    want = sorted(map(tuple, lm.score(docs.coalesce(1), train=F.col("train")).collect()), key=str)
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    got = sorted(map(tuple, lm.score(docs.coalesce(1), train=F.col("train")).collect()), key=str)
    assert len(got) == 35 and [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:])


@pytest.mark.parametrize("values", [
    np.array([], np.int64), np.zeros(9, np.int64), np.array([0, -3, 0, 7, 2**62]),
    np.array([0.0, -1.5, 1e-300, 0.0]), np.arange(5, dtype=np.int32)])
def test_packed_numbers(values):
    back = lm.unpack(lm.pack(values), values.dtype)
    assert back.dtype == values.dtype and back.tolist() == values.tolist()
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert lm.unpack_keys(lm.pack_keys(keys)).tolist() == keys.tolist()

"""Twin searches answered from a stream of requests (foreachBatch sink)."""

from __future__ import annotations

import uuid

from peerlens.dims import FOOTBALL
from peerlens.schemas import FOOTBALL_SPEC, TWIN_QUERY
from peerlens.session import shared_path
from peerlens.streaming import answer_requests


def test_stream_of_requests(spark, players):
    req_dir = shared_path(spark, "requests")
    spark.createDataFrame([("Rodri", None, None, False, 5), ("bukayo saka", None, None, False, 2)],
                          TWIN_QUERY) \
        .write.parquet(req_dir)
    schema = "reference string, max_age int, selected_leagues array<string>, " \
             "strict_position boolean, top_n int"
    stream = spark.readStream.schema(schema).parquet(req_dir)
    sink = shared_path(spark, "answers")
    q = answer_requests(stream, players, FOOTBALL, FOOTBALL_SPEC, sink,
                        shared_path(spark, f"ckpt-{uuid.uuid4().hex[:6]}"))
    q.awaitTermination(300)
    out = spark.read.parquet(sink)
    got = {(r.ref_key, r.rank): (r.player_name, r.similarity_score) for r in out.collect()}
    assert got[("Rodri", 1)] == ("Aurélien Tchouaméni", 50.70)
    assert got[("Bukayo Saka", 2)] == ("Bryan Mbeumo", 65.66)
    assert out.count() == 4 + 2

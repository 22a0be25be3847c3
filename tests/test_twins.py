"""Statistical twins: goldens on the scouting fixture and API behaviour."""

from __future__ import annotations

import pytest

from peerlens.dims import FOOTBALL
from peerlens.operators.twins import find_similar, twins, unmatched
from peerlens.schemas import FOOTBALL_SPEC as SPEC


def _names(df):
    return [(r.player_name, r.similarity_score) for r in df.orderBy("rank").collect()]


def test_rodri_golden(players):
    got = _names(find_similar(players, FOOTBALL, SPEC, "Rodri"))
    assert got == [("Aurélien Tchouaméni", 50.70), ("Declan Rice", 46.15),
                   ("Martín Zubimendi", 33.98), ("João Palhinha", 5.86)]


def test_saka_golden_case_insensitive(players):
    got = _names(find_similar(players, FOOTBALL, SPEC, "bukayo SAKA"))
    assert got == [("Michael Olise", 69.36), ("Bryan Mbeumo", 65.66), ("Nico Williams", 63.05),
                   ("Kylian Mbappé", 54.21), ("Antoine Semenyo", 52.25)]


def test_filters_after_normalisation(players):
    got = _names(find_similar(players, FOOTBALL, SPEC, "Erling Haaland", max_age=23,
                              selected_leagues=["Premier League"]))
    assert got == [("Rasmus Højlund", 33.95), ("Joshua Zirkzee", 15.96)]


def test_strict_changes_pool_not_features(players):
    strict = _names(find_similar(players, FOOTBALL, SPEC, "Riccardo Calafiori", strict_position=True))
    assert strict == [("Destiny Udogie", 31.66), ("Alphonso Davies", 28.48)]
    cohort = _names(find_similar(players, FOOTBALL, SPEC, "Riccardo Calafiori", max_age=25))
    assert cohort[0] == ("Destiny Udogie", 81.98)


def test_bounds_self_exclusion_and_top_n(players):
    r = find_similar(players, FOOTBALL, SPEC, "Bukayo Saka", top_n=3).collect()
    assert len(r) == 3
    assert all(0.0 <= x.similarity_score <= 100.0 for x in r)
    assert all(x.player_name != "Bukayo Saka" for x in r)
    assert [x.metrics for x in r][0][:2] == ["take_on_success_pct", "progressive_carries_per90"]


def test_unknown_reference(spark, players):
    with pytest.raises(ValueError):
        find_similar(players, FOOTBALL, SPEC, "Nobody Known", require_match=True)
    q = spark.createDataFrame([("Nobody Known",), ("rodri",)], "reference string")
    assert [r.reference for r in unmatched(players, q, SPEC).collect()] == ["Nobody Known"]


def test_batch_equals_single(spark, players):
    q = players.select("player_name").withColumnRenamed("player_name", "reference")
    batch = twins(players, FOOTBALL, SPEC, q, pair_budget=50)   # forces several blocks
    one = {(r.player_name, r.similarity_score) for r in batch.where("ref_key = 'Rodri'").collect()}
    assert one == set(_names(find_similar(players, FOOTBALL, SPEC, "Rodri")))
    # every query gets min(5, pool size - 1) rows
    assert batch.count() == sum(n * min(5, n - 1) for n in (8, 11, 7, 5, 5, 3, 7, 6))


def test_vector_twins_unit_weights(spark):
    from peerlens.operators.vectors import vector_twins
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [3.0, 1.0], 0), (4, [5.0, 5.0], 1),
            (5, [5.0, 6.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    out = {(r.ref_key, r.rank): r.cand_key for r in
           vector_twins(df, "id", "v", "label", top_n=2).collect()}
    assert out[(1, 1)] == 2 and out[(3, 1)] == 2 and out[(4, 1)] == 5


def _grid_case(spark):
    """Parts of sf0.001 plus 60 exact copies of one part (a hot duplicate
    vector), with per-row age / league filters on some queries."""
    from pyspark.sql import functions as F
    from peerlens.plans import registry as R
    from conftest import SMALL_SF
    p = R.profile(spark, SMALL_SF)
    one = p.orderBy(R.SPEC.key).limit(1)
    copies = one.crossJoin(spark.range(1, 61).withColumnRenamed("id", "_i")).select(
        *[(F.col(R.SPEC.key) * 1000 + F.col("_i")).cast(p.schema[R.SPEC.key].dataType)
          .alias(c) if c == R.SPEC.key else
          F.concat(F.col(c), F.lit("#"), F.col("_i").cast("string")).alias(c) if c == R.SPEC.name
          else F.col(c) for c in p.columns])
    prof = p.unionByName(copies)
    leagues = [r[0] for r in prof.select(R.SPEC.league).distinct().limit(2).collect()]
    q = prof.select(
        F.col(R.SPEC.name).alias("reference"),
        F.when(F.col(R.SPEC.key) % 7 == 0, F.col(R.SPEC.age) + 5).cast("int").alias("max_age"),
        F.when(F.col(R.SPEC.key) % 5 == 0, F.array(*[F.lit(x) for x in leagues]))
         .alias("selected_leagues"),
        (F.col(R.SPEC.key) % 3 == 0).alias("strict_position"),
        (F.col(R.SPEC.key) % 4 + 2).cast("int").alias("top_n"))
    return R, prof, q


@pytest.mark.parametrize("ex,ct,mb", [(8, 2, 512), (8, 1, 4), (16, 4, 27)])
def test_grid_search_equals_exhaustive(spark, ex, ct, mb):
    """Gridded pools (neighbourhood, radius box and pool-scan stages, the
    duplicate collapse) give exactly the exhaustive top-k."""
    R, prof, q = _grid_case(spark)
    cols = ["query_id", R.SPEC.key, "similarity_score", "rank"]
    ref = {tuple(r) for r in twins(prof, R.DIMS, R.SPEC, q, strict_position=None)
           .select(*cols).collect()}
    diag = {}
    got = {tuple(r) for r in twins(prof, R.DIMS, R.SPEC, q, strict_position=None,
                                   exhaustive_pool=ex, cell_target=ct, max_box_cells=mb,
                                   diagnostics=diag).select(*cols).collect()}
    assert got == ref
    stages = {r[0] for r in diag["resolution"].select("_stage").distinct().collect()}
    assert 1 in stages and len(stages) >= 2
    if (ex, ct, mb) == (8, 2, 512):
        assert stages == {1, 2, 3, 4}     # near, box, coarse box, pool scan


def test_vector_twins_sample_pass_is_exact(spark):
    """The sample-threshold pass (forced with a tiny label bound) keeps the
    exhaustive top-k."""
    from conftest import SMALL_SF
    from peerlens.operators.vectors import vector_twins
    from peerlens.session import parquet
    emb = parquet(spark, SMALL_SF, "embeddings")
    full = {tuple(r) for r in vector_twins(emb, "vec_id", "embedding", "label").collect()}
    pruned = {tuple(r) for r in vector_twins(emb, "vec_id", "embedding", "label",
                                             exhaustive_label=4, sample=4).collect()}
    assert pruned == full and len(full) > 0

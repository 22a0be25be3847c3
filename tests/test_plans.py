"""Physical-plan assertions: the plans we want at scale."""

from __future__ import annotations

from peerlens.plans import registry as R

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_twins_plan(spark):
    df = R.q_twins_batch(spark, SF)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "WindowGroupLimit" in p
    assert "SinglePartition" not in p.split("Subquery")[0]


def _stored_plans(monkeypatch, *modules) -> list[str]:
    """The plans of the tables that operators of ``modules`` store."""
    from peerlens.session import stored
    plans: list[str] = []

    def kept(df, name):
        plans.append(_plan(df))
        return stored(df, name)
    for m in modules:
        monkeypatch.setattr(m, "stored", kept)
    return plans


def test_percentile_plan_has_no_global_window(spark, monkeypatch):
    from peerlens.operators import normalize
    written = _stored_plans(monkeypatch, normalize)
    df = R.q_percentile_rank(spark, SF)
    df.collect()
    p = _plan(df)
    # the histogram is range-partitioned where it is written
    assert any("rangepartitioning" in w.lower() for w in written)
    assert not any("Exchange SinglePartition" in w for w in written)
    for line in p.splitlines():
        if "Window" in line:
            assert "partitionBy" not in line or "[]" not in line.split("partitionBy")[0]
    assert "Exchange SinglePartition" not in p.replace("Subquery", "")


def test_basket_plan_has_equi_joins_only(spark, monkeypatch):
    from peerlens.operators import baskets as B
    # the registered query reads a stored result: check the plans of the descent
    from peerlens.operators import cells, descent
    written = _stored_plans(monkeypatch, cells, descent)
    df = B.best_baskets(R.market_table(spark, SF), R.scenarios(spark), R.SPEC, R.BSPEC)
    df.collect()
    p = "\n".join([*written, _plan(df)])
    assert len(written) > 4
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_grid_twins_plan_keyed_by_cells(spark):
    """Gridded pools: every pair join is keyed by (pool, cells, block) or
    (pool, block); the duplicate collapse limits rows before its shuffle."""
    from pyspark.sql import functions as F
    from peerlens.operators import twins as T
    p = R.profile(spark, SF)
    q = p.select(F.col(R.SPEC.name).alias("reference"), F.lit(5).alias("top_n"))
    df = T.twins(p, R.DIMS, R.SPEC, q, exhaustive_pool=16, cell_target=8)
    df.collect()
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
    assert "hashpartitioning(pool" in plan and "t1" in plan and "block" in plan


def test_skyline_plan_keyed(spark):
    from peerlens.operators import baskets as B
    df = B.skyline(R.market_table(spark, SF), R.SPEC, R.BSPEC, group=4)
    df.collect()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_pruning_and_pushdown(spark):
    df = R.q_market_enrich(spark, SF)
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double," in p

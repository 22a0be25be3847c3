"""Registered queries on the driver's tables: one per operator of the survey.

Every query reads the whole given tables (or data Spark derives from
them); the only fixed inputs are parameters (a twin query, scenario
rows) — never row subsets.  Column names are aliased to match the SQL
oracles in ``peerlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import baskets as B
from peerlens.operators import (checks, evaluate, market, normalize, reports, rules, states, tags,
                                twin_index, twins)
from peerlens.plans.part_profile import (MARKET_DEFAULT, MARKET_SINCE, PART_BASKET, PART_METRICS, PART_SPEC,
                                         PARTS, part_market, part_profile, part_secondary)
from peerlens.schemas import SCENARIO
from peerlens.session import materialize, parquet, shared_path
from peerlens.sources import read_table, write_counted, write_table

SPEC, DIMS, BSPEC = PART_SPEC, PARTS, PART_BASKET

# ---------------------------------------------------------------------------
# Fixed query parameters (not row subsets): twin searches and scenarios.
# ---------------------------------------------------------------------------
TWIN_REF = "brand#3/HOT GEAR/3"            # a part of a mapped brand
UNMAPPED_REF = "BRAND#25/small gizmo/4"     # a part of an unmapped brand
FILTER_AGE, FILTER_LINES = 25, ("hot", "red", "small")
SCENARIOS = [
    ("s1", 60.0, 120.0, 2, 15.0, 50.0, 60.0, 1.5),
    ("s2", 95.0, 180.0, 2, 24.0, 40.0, 50.0, 1.2),
    ("s3", 40.0, 90.0, 2, 8.5, 45.0, 55.0, 1.6),
    ("s4", 90.0, 200.0, 3, 6.0, 75.0, 90.0, 2.4),
    ("s5", 5.0, 10.0, 3, 2.0, 100.0, 140.0, 4.0),
    ("s6", 150.0, 300.0, 3, 5.0, 70.0, 80.0, 2.0),
    # within reach of a market priced from all lines
    ("s7", 110.0, 260.0, 2, 20.0, 46.0, 70.0, 1.2),
    ("s8", 155.0, 340.0, 3, 4.0, 62.0, 100.0, 1.7),
    ("s9", 95.0, 220.0, 2, 30.0, 42.0, 60.0, 1.6),
    # every item alone passes the bounds, no basket does
    ("s10", 150.0, 330.0, 3, 4.0, 60.0, 115.0, 2.6),
]
PAIR_SCENARIO, TRIPLE_SCENARIO = "s7", "s8"
EVAL_K = 3
EXACT_NAME = "Brand#3/hot gear/3"
MIN_LINES = 30
# Rules of the market: a name and the condition of a bad row.
MARKET_RULES = [
    ("age above 45", "p_size > 45"),
    ("few lines", "n_lines < 20"),
    ("negative fee", "fee < 0"),
    ("negative wage", "wage < 0"),
    ("no metric", "qty_avg IS NULL"),
    ("no position", "p_brand IS NULL"),
]
TARGET_CLUB = "Manchester United"


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return part_profile(spark, sf)


def _profile_once(spark: SparkSession, sf: str) -> DataFrame:
    """The profile (a full lineitem aggregation) materialised once for a
    query that reads it in several branches (reliable checkpoint)."""
    return materialize(profile(spark, sf))


def market_table(spark: SparkSession, sf: str, p: DataFrame | None = None,
                 since: str | None = None) -> DataFrame:
    p = p if p is not None else profile(spark, sf)
    return market.enrich_market(p, part_market(parquet(spark, sf, "lineitem"), since),
                                SPEC.key, BSPEC, MARKET_DEFAULT)


def scenarios(spark: SparkSession, only: str | None = None) -> DataFrame:
    rows = [r for r in SCENARIOS if only is None or r[0] == only]
    return spark.createDataFrame(rows, SCENARIO)


def _one_query(spark, ref, **kw) -> DataFrame:
    row = (ref, kw.get("max_age"), kw.get("leagues"), kw.get("strict", False), kw.get("top_n", 5))
    return spark.createDataFrame([row], "reference string, max_age int, "
                                 "selected_leagues array<string>, strict_position boolean, top_n int")


def _twin_cols(df: DataFrame) -> DataFrame:
    return df.select(F.col("ref_key"), F.col("cohort"), F.col(SPEC.key).alias("cand_key"),
                     "similarity_score", "rank")


def _all_twins(spark, sf, top_n=5, p=None, display=True) -> DataFrame:
    p = p if p is not None else profile(spark, sf)
    q = p.select(F.col(SPEC.name).alias("reference"), F.lit(top_n).alias("top_n"))
    return twins.twins(p, DIMS, SPEC, q, strict_position=False, top_n_bound=top_n, display=display)


def _rank1_pairs(spark, sf, p=None) -> DataFrame:
    tw = _all_twins(spark, sf, top_n=1, p=p, display=False)
    return tw.select(F.col(SPEC.key).alias("cand_key"), F.col("ref_key").alias("bench_key"),
                     "similarity_score")


# ------------------------------------------------------------------ queries
def q_profile_build(spark, sf):
    return profile(spark, sf)


def q_sink_roundtrip(spark, sf):
    cust = parquet(spark, sf, "customer")
    path = shared_path(spark, "customer_csv")
    write_table(cust, path, fmt="csv")
    return read_table(spark, path, cust.schema, fmt="csv")


def q_cohort_lookup(spark, sf):
    part = parquet(spark, sf, "part")
    dim = F.broadcast(DIMS.position_cohort_df(spark))   # literal: size bounded
    j = part.join(dim, part["p_brand"] == dim["position"], "left")
    return j.select("p_partkey", "p_brand",
                    F.coalesce(F.col("cohort"), F.lit(DIMS.default_cohort)).alias("cohort"),
                    F.col("cohort").isNotNull().alias("mapped"))


def q_lookup_ci(spark, sf):
    cust = parquet(spark, sf, "customer")
    q = cust.select(F.upper("c_name").alias("reference"))
    return twins.resolve(cust, q, twins.ProfileSpec(key="c_custkey", name="c_name")).select(
        "reference", "c_custkey", "c_name")


def q_unmatched_queries(spark, sf):
    cust = parquet(spark, sf, "customer")
    supp = parquet(spark, sf, "supplier")
    q = (cust.select(F.upper("c_name").alias("reference"))
         .unionByName(supp.select(F.col("s_name").alias("reference"))))
    return twins.unmatched(cust, q, twins.ProfileSpec(key="c_custkey", name="c_name")
                           ).select("reference")


def q_min_volume(spark, sf):
    return normalize.volume_counts(profile(spark, sf), SPEC.minutes, MIN_LINES)


def q_written_counts(spark, sf):
    """The counts of a sink's own job: no second scan of what was written."""
    path = shared_path(spark, "qualified")
    got = write_counted(profile(spark, sf), path, {
        "rows_qualified": F.col(SPEC.minutes) >= MIN_LINES,
        "rows_unmapped": ~F.col(SPEC.position).isin([b for b, _ in DIMS.position_cohort])},
        partition_by=[SPEC.position])
    back = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_read_back"))
    return back.select(*[F.lit(n).cast("long").alias(c) for c, n in got.items()], "rows_read_back")


def q_lookup_exact(spark, sf):
    """P5: names are equal only with the same case."""
    p = profile(spark, sf)
    both = [twins.lookup(p, SPEC, name, case_insensitive=False)
            for name in (EXACT_NAME, EXACT_NAME.upper())]
    return both[0].unionByName(both[1]).select(SPEC.key, SPEC.name)


def q_percentile_merged(spark, sf):
    """W1/W2 from stored histograms: those of two arrivals, merged."""
    cust = parquet(spark, sf, "customer")
    late = F.col("c_nationkey") > 12
    parts = [materialize(states.histogram_state(cust.where(c), [], "c_acctbal"))
             for c in (~late, late)]
    return states.percentiles_of(states.merge_histograms([], *parts), [])


def _moment_parts(spark, sf):
    """(profile with its cohorts, the moment states of two arrivals of parts)."""
    p = normalize.with_cohort(_profile_once(spark, sf), DIMS, SPEC)
    late = F.col(SPEC.age) > 25
    return p, [materialize(states.moment_state(p.where(c), ["cohort"], PART_METRICS))
               for c in (~late, late)]


def _moments_out(state):
    return state.select("cohort", "feature", "n", F.round("mean", 6).alias("mean"),
                        F.round(states.std_pop(), 6).alias("sd"))


def q_moments_merged(spark, sf):
    """A1 from stored states: those of two arrivals, merged."""
    _, parts = _moment_parts(spark, sf)
    return _moments_out(states.merge_moments(["cohort"], *parts))


def q_moments_removed(spark, sf):
    """U1 the other way: the whole state without the rows of unmapped positions."""
    p, parts = _moment_parts(spark, sf)
    gone = states.moment_state(p.where(~F.col("mapped")), ["cohort"], PART_METRICS)
    return _moments_out(states.remove_rows(states.merge_moments(["cohort"], *parts), gone, ["cohort"]))


def q_market_quarantine(spark, sf):
    """C17: rows that break rules; the part with the smallest key is planted again
    with a fault for each rule."""
    mk = materialize(market_table(spark, sf))
    one = mk.orderBy(SPEC.key).limit(1)
    faults = {SPEC.age: "CAST(99 AS INT)", SPEC.minutes: "CAST(1 AS INT)", BSPEC.fee: "-1D",
              BSPEC.wage: "-1D", BSPEC.prog: "CAST(NULL AS DOUBLE)",
              SPEC.position: "CAST(NULL AS STRING)"}
    planted = None
    for i, (column, fault) in enumerate(faults.items()):
        row = one.withColumn(column, F.expr(fault).cast(mk.schema[column].dataType)).withColumn(
            SPEC.key, F.lit(-1 - i).cast(mk.schema[SPEC.key].dataType))
        planted = row if planted is None else planted.unionByName(row)
    got = rules.apply_rules(mk.unionByName(planted), MARKET_RULES)
    fired = F.create_map(*[x for n, c in got.counts.items() for x in (F.lit(n), F.lit(c))])
    return got.bad.withColumn("rule", F.explode("rules")).select(
        SPEC.key, "rule", fired[F.col("rule")].cast("long").alias("rows_of_rule"),
        F.lit(got.rejected).cast("long").alias("rows_rejected"),
        F.lit(got.rows).cast("long").alias("rows_read"))


def q_percentile_rank(spark, sf):
    cust = parquet(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return normalize.percentile_rank(cust, ["c_acctbal"])


def q_percentile_ties(spark, sf):
    li = parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return normalize.percentile_rank(li, ["l_quantity"])


def q_minmax_scale(spark, sf):
    p = profile(spark, sf).select(SPEC.key, *PART_METRICS)
    s = normalize.minmax_scale(p, PART_METRICS)
    return s.select(SPEC.key, *[f"{m}_scaled" for m in PART_METRICS])


def q_feature_table(spark, sf):
    p = profile(spark, sf).select(SPEC.key, *PART_METRICS)
    out = normalize.feature_table(p, PART_METRICS, SPEC.minutes, 30, key=SPEC.key)
    return out.select(SPEC.key, *[f"{m}_percentile" for m in PART_METRICS],
                      *[f"{m}_scaled" for m in PART_METRICS])


def q_zscore_cohort(spark, sf):
    return normalize.zscore_cohort(profile(spark, sf), DIMS, SPEC)


def q_peer_percentile(spark, sf):
    base = normalize.with_cohort(profile(spark, sf), DIMS, SPEC)
    pool = normalize.with_slots(base.where("mapped"), DIMS)
    probes = normalize.with_slots(base, DIMS)
    pp = normalize.peer_percentiles(pool, probes, DIMS, [SPEC.key])
    return pp.select(SPEC.key, "cohort", "ord", "pct")


def q_radar_long(spark, sf):
    p = _profile_once(spark, sf)
    pairs = _rank1_pairs(spark, sf, p).select("cand_key", "bench_key")
    return reports.radar_long(pairs, p, DIMS, SPEC)


def q_radar_unknown(spark, sf):
    """A benchmark that does not exist has the percentile 50.0 everywhere."""
    p = _profile_once(spark, sf)
    pairs = p.select(F.col(SPEC.key).alias("cand_key"), (-1 - F.col(SPEC.key)).alias("bench_key"))
    return reports.radar_long(pairs, p, DIMS, SPEC).select(
        "cand_key", "bench_key", "cohort", "ord", "cand_pct", "bench_pct")


def q_twins_single(spark, sf):
    p = profile(spark, sf)
    return _twin_cols(twins.twins(p, DIMS, SPEC, _one_query(spark, TWIN_REF), few_queries=True))


def q_twins_strict(spark, sf):
    p = profile(spark, sf)
    return _twin_cols(twins.twins(p, DIMS, SPEC, _one_query(spark, TWIN_REF, strict=True),
                                  strict_position=True, few_queries=True))


def q_twins_filtered(spark, sf):
    p = profile(spark, sf)
    q = _one_query(spark, TWIN_REF, max_age=FILTER_AGE, leagues=list(FILTER_LINES), top_n=8)
    return _twin_cols(twins.twins(p, DIMS, SPEC, q, few_queries=True))


def q_twins_display(spark, sf):
    p = profile(spark, sf)
    return twins.twins_display(twins.twins(p, DIMS, SPEC, _one_query(spark, TWIN_REF),
                                           few_queries=True), DIMS, SPEC)


def q_pool_union(spark, sf):
    p = profile(spark, sf)
    return _twin_cols(twins.twins(p, DIMS, SPEC, _one_query(spark, UNMAPPED_REF), few_queries=True))


def q_twins_batch(spark, sf):
    return _twin_cols(_all_twins(spark, sf, display=False))


def q_twins_indexed(spark, sf):
    """C1 from a stored index: one pool is read per search."""
    index = twin_index.build(profile(spark, sf), DIMS, SPEC)
    asked = [("single", TWIN_REF, {}), ("strict", TWIN_REF, {"strict_position": True}),
             ("filtered", TWIN_REF, {"max_age": FILTER_AGE, "selected_leagues": list(FILTER_LINES),
                                     "top_n": 8}), ("unmapped", UNMAPPED_REF, {})]
    out = None
    for name, ref, how in asked:
        one = _twin_cols(index.search(spark, ref, require_match=False, **how)).withColumn("search", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def q_twins_embeddings(spark, sf):
    from peerlens.operators.vectors import vector_twins
    emb = parquet(spark, sf, "embeddings")
    return vector_twins(emb, key="vec_id", vector="embedding", cohort="label", top_n=5)


def q_market_enrich(spark, sf):
    return market_table(spark, sf, since=MARKET_SINCE).select(
        SPEC.key, BSPEC.fee, BSPEC.wage, BSPEC.contract, BSPEC.resale)


def q_composite_value(spark, sf):
    return market.with_composite_value(market_table(spark, sf), BSPEC).select(
        SPEC.key, "composite_value")


def q_skyline(spark, sf):
    return B.skyline(market_table(spark, sf), SPEC, BSPEC).select(
        F.col("key").alias(SPEC.key), F.col("pos").alias(SPEC.position))


def _basket_out(best: DataFrame) -> DataFrame:
    return best.select("scenario_id", "status", "k",
                       F.array_join(F.col("keys").cast("array<string>"), ",").alias("members"),
                       F.round(F.col("total_value"), 6).alias("total_value"),
                       F.round(F.col("total_fee"), 6).alias("total_fee"),
                       F.round(F.col("total_wage"), 6).alias("total_wage"))


def _market_once(spark, sf) -> DataFrame:
    """Market rows materialised once (reliable checkpoint): the basket
    solver and the member join both read them."""
    return materialize(market_table(spark, sf))


def _best(spark, sf, only=None, mk=None):
    mk = mk if mk is not None else market_table(spark, sf)
    return B.best_baskets(mk, scenarios(spark, only), SPEC, BSPEC)


def q_basket_pairs(spark, sf):
    return _basket_out(_best(spark, sf, PAIR_SCENARIO))


def q_basket_triples(spark, sf):
    return _basket_out(_best(spark, sf, TRIPLE_SCENARIO))


def q_basket_scenarios(spark, sf):
    return _basket_out(_best(spark, sf))


def q_basket_infeasible(spark, sf):
    return _best(spark, sf).where(F.col("status") == "infeasible").select("scenario_id", "status")


def q_basket_kpis(spark, sf):
    mk = _market_once(spark, sf)
    k = B.basket_kpis(_best(spark, sf, mk=mk), mk, scenarios(spark), SPEC, BSPEC)
    return k.select("scenario_id", "n_players",
                    *[F.round(F.col(c), 6).alias(c) for c in k.columns
                      if c not in ("scenario_id", "n_players")])


def q_basket_display(spark, sf):
    mk = _market_once(spark, sf)
    mem = B.basket_members(_best(spark, sf, mk=mk), mk, SPEC)
    return mem.select(
        "scenario_id", F.col(SPEC.key).alias("Target"), F.col(SPEC.position).alias("Pos"),
        F.col(SPEC.team).alias("Club"), F.col(SPEC.league).alias("League"),
        F.col(SPEC.age).alias("Age"), F.col(BSPEC.fee).alias("Fee"),
        F.col(BSPEC.wage).alias("Wage"), F.col(BSPEC.prog).alias("Prog"),
        F.col(BSPEC.defence).alias("Def"), F.col(BSPEC.resale).alias("Resale"))


def q_boardroom_summary(spark, sf):
    mk = _market_once(spark, sf)
    b = reports.boardroom_summary(_best(spark, sf, mk=mk), mk, scenarios(spark), SPEC, BSPEC,
                                  TARGET_CLUB)
    return b.select("scenario_id", "financial_json", "memo")


def q_boardroom_players(spark, sf):
    """The member records of the summary, a row each."""
    mk = _market_once(spark, sf)
    b = reports.boardroom_summary(_best(spark, sf, mk=mk), mk, scenarios(spark), SPEC, BSPEC,
                                  TARGET_CLUB)
    return b.select("scenario_id", F.posexplode("players").alias("slot", "p")).select(
        "scenario_id", (F.col("slot") + 1).alias("slot"), "p.*")


def _tagged(spark, sf, p=None):
    p = p if p is not None else profile(spark, sf)
    return tags.with_tags(p, DIMS, SPEC, part_secondary(parquet(spark, sf, "part")))


def q_tag_sets(spark, sf):
    return _tagged(spark, sf).select(SPEC.key, F.array_join("tags", "|").alias("tags"))


def q_compat_pairs(spark, sf):
    p = _profile_once(spark, sf)
    tw = _all_twins(spark, sf, top_n=EVAL_K, p=p, display=False).select("ref_key", SPEC.key, "rank")
    f = tags.compat_flags(tw, _tagged(spark, sf, p), SPEC)
    return f.select("ref_key", F.col(SPEC.key).alias("cand_key"), "rank", "compatible")


def q_compat_counts(spark, sf):
    return tags.compat_counts(_tagged(spark, sf), SPEC).select(SPEC.key, "n_compat")


def q_recommender_eval(spark, sf):
    p = _profile_once(spark, sf)
    ev = evaluate.evaluate(p, DIMS, SPEC, EVAL_K, part_secondary(parquet(spark, sf, "part")))
    return ev.select("k", "evaluated", "total", F.round("precision_pct", 6).alias("precision_pct"),
                     F.round("mrr", 6).alias("mrr"), "verdict")


def _payloads(spark, sf):
    p = _profile_once(spark, sf)
    return reports.scout_payload(_rank1_pairs(spark, sf, p), p, DIMS, SPEC)


def q_payload_json(spark, sf):
    pl = _payloads(spark, sf)
    return pl.select("cand_key", "bench_key",
                     F.col("payload.candidate.name").alias("cand_name"),
                     F.col("payload.benchmark.name").alias("bench_name"),
                     F.col("payload.candidate.age").alias("cand_age"),
                     F.col("payload.similarity_score_pct").alias("similarity_score_pct"),
                     F.to_json(F.col("payload.candidate.metrics")).alias("cand_metrics"),
                     F.to_json(F.col("payload.benchmark.metrics")).alias("bench_metrics"))


def q_payload_fields(spark, sf):
    """Every scalar field of the payload."""
    sides = [F.col(f"payload.{side}.{f}").alias(f"{side}_{f}")
             for side, fields in (("candidate", ("name", "team", "league", "position", "primary_role",
                                                 "age", "minutes_played")),
                                  ("benchmark", ("name", "team", "position", "primary_role", "age")))
             for f in fields]
    return _payloads(spark, sf).select("cand_key", "bench_key", *sides,
                                       F.col("payload.similarity_score_pct").alias("score"))


def q_dossier_text(spark, sf):
    return reports.dossier_text(_payloads(spark, sf), TARGET_CLUB)


def q_catalog_options(spark, sf):
    return reports.catalog_options(profile(spark, sf), SPEC)


def q_unit_drilldown(spark, sf):
    return reports.unit_drilldown(profile(spark, sf), DIMS, SPEC)


def q_invariants(spark, sf):
    p = _profile_once(spark, sf)
    mk = materialize(market_table(spark, sf, p))
    sc = scenarios(spark)
    best = B.best_baskets(mk, sc, SPEC, BSPEC)
    mem = B.basket_members(best, mk, SPEC)
    tw = _all_twins(spark, sf, p=p)
    return checks.violations(tw, best, mem, sc, p, SPEC, BSPEC, PART_METRICS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

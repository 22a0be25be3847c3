"""DuckDB SQL oracles for the registered queries (same column names).

The SQL is written independently in plain ANSI/DuckDB form (window
functions, joins, brute-force enumeration) from the same fixed parameters
as ``registry``; it shares no execution code with the Spark operators.
"""

from __future__ import annotations

from peerlens.operators.reports import BOARD_MEMO, DOSSIER, template_parts
from peerlens.plans import registry as R
from peerlens.plans.part_profile import (MARKET_DEFAULT, MARKET_SINCE, PART_METRICS,
                                         PART_TYPE_SECONDARY, PARTS)

D = PARTS


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def s(x: str) -> str:
    return "'" + str(x).replace("'", "''") + "'"


PROFILE = f"""
li AS (
  SELECT l_partkey, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT)) AS qty_sum,
         max(l_quantity) AS qty_max,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc_pts,
         sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax_pts,
         count_if(l_returnflag = 'R') AS n_ret, count_if(l_linestatus = 'O') AS n_open
  FROM lineitem GROUP BY l_partkey),
prof AS (
  SELECT p_partkey, concat_ws('/', p_brand, p_name, CAST(p_partkey AS VARCHAR)) AS p_label,
         p_brand, split_part(p_name, ' ', 1) AS p_line, split_part(p_name, ' ', 2) AS p_kind,
         p_type, p_size, p_retailprice, CAST(coalesce(li.n_lines, 0) AS INTEGER) AS n_lines,
         CASE WHEN li.n_lines > 0 THEN CAST(qty_sum AS DOUBLE) / (li.n_lines * {d(1)}) END AS qty_avg,
         qty_max,
         CASE WHEN li.n_lines > 0 THEN CAST(price_cents AS DOUBLE) / (li.n_lines * {d(100000)}) END AS price_avg_k,
         CASE WHEN li.n_lines > 0 THEN CAST(disc_pts AS DOUBLE) / (li.n_lines * {d(100)}) END AS disc_avg,
         CASE WHEN li.n_lines > 0 THEN CAST(tax_pts AS DOUBLE) / (li.n_lines * {d(100)}) END AS tax_avg,
         CASE WHEN li.n_lines > 0 THEN CAST(n_ret AS DOUBLE) / (li.n_lines * {d(1)}) END AS ret_share,
         CASE WHEN li.n_lines > 0 THEN CAST(n_open AS DOUBLE) / (li.n_lines * {d(1)}) END AS open_share
  FROM part LEFT JOIN li ON p_partkey = li.l_partkey)"""

def _market(window: str = "") -> str:
    """CTEs of the market; ``window`` is a condition on lineitem."""
    return f"""
mk AS (
  SELECT l_partkey AS mkey,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * {d(100000)}) AS fee,
         CAST(sum(CAST(l_quantity AS BIGINT) * 5) AS DOUBLE) / count(*) AS wage,
         CAST(count(*) AS INTEGER) AS contract_years,
         {d(1)} + CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (count(*) * {d(50)}) AS resale
  FROM lineitem {window} GROUP BY l_partkey),
market AS (
  SELECT prof.*, coalesce(fee, {d(MARKET_DEFAULT[0])}) AS fee,
         coalesce(wage, {d(MARKET_DEFAULT[1])}) AS wage,
         CAST(coalesce(contract_years, {MARKET_DEFAULT[2]}) AS INTEGER) AS contract_years,
         coalesce(resale, {d(MARKET_DEFAULT[3])}) AS resale
  FROM prof LEFT JOIN mk ON prof.p_partkey = mk.mkey),
valued AS (
  SELECT market.*, {d(0.30)} * qty_avg + {d(0.25)} * n_lines
         + {d(0.25)} * (ret_share + open_share) * {d(5.0)} + {d(0.20)} * (resale * {d(4.0)}) AS composite_value
  FROM market)"""


MARKET = _market()
RECENT = _market(f"WHERE l_shipdate >= TIMESTAMP '{MARKET_SINCE} 00:00:00'")


def _case_idx(col: str, items: list, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items))
    return f"CASE {col} {whens} ELSE {default} END"


def _cohort_cte() -> str:
    vals = ", ".join(f"({s(p)}, {D.cohort_ids[c]})" for p, c in D.position_cohort)
    default = D.cohort_ids[D.default_cohort]
    names = _case_idx("cidx", [s(c) for c in D.cohorts])
    slots = []
    for j in range(D.n_slots):
        items = [f"CAST({fs[j][0]} AS DOUBLE)" if j < len(fs) else d(0) for _, fs in D.role_metrics]
        slots.append(f"{_case_idx('cidx', items, d(0))} AS x{j + 1}")
    m = _case_idx("cidx", [str(len(fs)) for _, fs in D.role_metrics], "0")
    valid = " AND ".join(f"x{j + 1} IS NOT NULL" for j in range(D.n_slots))
    return f"""
cmap(pos, idx) AS (VALUES {vals}),
b1 AS (SELECT prof.*, cmap.idx IS NOT NULL AS mapped, coalesce(cmap.idx, {default}) AS cidx
       FROM prof LEFT JOIN cmap ON prof.p_brand = cmap.pos),
b2 AS (SELECT b1.*, {names} AS cohort, {', '.join(slots)}, {m} AS m FROM b1),
vb AS (SELECT * FROM b2 WHERE {valid})"""


def _weight(j: int, col: str = "cidx") -> str:
    items = [d(fs[j][1]) if j < len(fs) else d(0) for _, fs in D.role_metrics]
    return _case_idx(col, items, d(0))


def twins_sql(queries_sql: str, strict: bool = False) -> str:
    """CTEs ending in ``tw``: (query_id, ref_key, cohort, cand_key, similarity_score, rank).

    ``queries_sql`` selects (query_id, reference, max_age, leagues, top_n)."""
    n = D.n_slots
    pool_expr = "'p|' || p_brand" if strict else "'c|' || cohort"
    cand_where = "" if strict else "WHERE mapped"
    mom_cols = ", ".join(f"avg(x{j}) AS mu{j}, stddev_pop(x{j}) AS sd{j}" for j in range(1, n + 1))
    own = "TRUE" if strict else "qs.mapped"
    ks = []
    for j in range(1, n + 1):
        mu = f"coalesce(mu{j}, qx{j})"
        sd = f"coalesce(sd{j}, {d(0)})"
        nn = f"CAST(coalesce(mn, 0) AS DOUBLE)"
        n1 = f"({nn} + {d(1)})"
        dd = f"(qx{j} - {mu})"
        amu = f"({mu} + {dd} / {n1})"
        asd = f"sqrt(greatest({nn} * {sd} * {sd} + {dd} * (qx{j} - {amu}), {d(0)}) / {n1})"
        smu = f"(CASE WHEN {own} THEN mu{j} ELSE {amu} END)"
        ssd = f"(CASE WHEN {own} THEN sd{j} ELSE {asd} END)"
        sc = (f"(CASE WHEN {ssd} IS NULL OR {ssd} <= {d(1e-12)} * greatest(abs({smu}), {d(1)}) "
              f"THEN {d(1)} ELSE {ssd} END)")
        ks.append(f"{_weight(j - 1, 'qs.cidx')} / ({sc} * {sc}) AS k{j}")
    d2 = " + ".join(f"k{j} * (c.x{j} - q.qx{j}) * (c.x{j} - q.qx{j})" for j in range(1, n + 1))
    qx = ", ".join(f"v.x{j} AS qx{j}" for j in range(1, n + 1))
    return f"""{_cohort_cte()},
cand AS (SELECT {pool_expr} AS pool, * FROM vb {cand_where}),
mom AS (SELECT pool, count(*) AS mn, {mom_cols} FROM cand GROUP BY pool),
qin AS ({queries_sql}),
qs AS (SELECT qin.*, v.p_partkey AS ref_key, v.cohort, v.cidx, v.mapped, v.m, v.p_brand,
              {qx} FROM qin JOIN vb v ON lower(v.p_label) = lower(qin.reference)),
qp AS (SELECT qs.*, {pool_expr.replace('cohort', 'qs.cohort').replace('p_brand', 'qs.p_brand')} AS pool FROM qs),
qk AS (SELECT qs.*, {', '.join(ks)}
       FROM qp qs LEFT JOIN mom USING (pool)),
pairs AS (
  SELECT q.query_id, q.ref_key, q.cohort, q.top_n, c.p_partkey AS cand_key,
         round_even(exp(-({d(1)} / ({d(4)} * CAST(q.m AS DOUBLE))) * ({d2})) * {d(100)} * {d(100)}, 0)
           / {d(100)} AS similarity_score
  FROM qk q JOIN cand c ON c.pool = q.pool AND c.p_partkey <> q.ref_key
  WHERE (q.max_age IS NULL OR c.p_size <= q.max_age)
    AND (q.leagues IS NULL OR len(q.leagues) = 0 OR list_contains(q.leagues, c.p_line))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
                      ORDER BY similarity_score DESC, cand_key ASC) AS rank FROM pairs),
tw AS (SELECT query_id, ref_key, cohort, cand_key, similarity_score, CAST(rank AS INTEGER) AS rank
       FROM ranked WHERE rank <= top_n)"""


def _one(ref: str, max_age=None, leagues=None, top_n=5) -> str:
    la = "NULL" if max_age is None else str(max_age)
    ll = "CAST(NULL AS VARCHAR[])" if leagues is None else "[" + ", ".join(s(x) for x in leagues) + "]"
    return f"SELECT 1 AS query_id, {s(ref)} AS reference, {la} AS max_age, {ll} AS leagues, {top_n} AS top_n"


ALL_Q = ("SELECT p_partkey AS query_id, p_label AS reference, NULL AS max_age, "
         "CAST(NULL AS VARCHAR[]) AS leagues, {k} AS top_n FROM prof")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


def _tw_out() -> str:
    return "SELECT ref_key, cohort, cand_key, similarity_score, rank FROM tw"


def _percentile(table: str, keys: str, col: str) -> str:
    return f"""
WITH h AS (SELECT {col} AS v, count(*) AS c FROM {table} WHERE {col} IS NOT NULL GROUP BY 1),
r AS (SELECT v, c, sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(c) OVER () AS n FROM h)
SELECT {keys}, {col}, round_even(((cum - (c - 1) / {d(2)}) / n * {d(100)}) * {d(10)}, 0) / {d(10)}
       AS {col}_percentile
FROM {table} LEFT JOIN r ON {col} = r.v"""


def _scen_values(only: str | None = None) -> str:
    rows = [r for r in R.SCENARIOS if only is None or r[0] == only]
    vals = ", ".join(
        f"({s(r[0])}, {d(r[1])}, {d(r[2])}, {r[3]}, {d(r[4])}, {d(r[5])}, {d(r[6])}, {d(r[7])})"
        for r in rows)
    return (f"scen(scenario_id, fee_budget_m, wage_ceiling_k_pw, k, max_avg_age, "
            f"min_prog_passes, min_defensive_actions, min_creation_threat) AS (VALUES {vals})")


TOL = d(1e-6)


def baskets_sql(only: str | None = None) -> str:
    """CTEs ending in ``best``: brute force over all feasible combinations.

    Single-item bounds (exact necessary conditions) keep it small."""
    return f"""{MARKET},
{_scen_values(only)},
it AS (SELECT p_partkey AS key, p_brand AS pos, fee, wage, CAST(p_size AS DOUBLE) AS age,
              qty_avg AS prog, CAST(n_lines AS DOUBLE) AS dfn, ret_share + open_share AS cre,
              composite_value AS value
       FROM valued WHERE p_brand IS NOT NULL AND qty_avg IS NOT NULL AND ret_share IS NOT NULL),
g AS (SELECT min(fee) AS gfee, min(wage) AS gwage, min(age) AS gage, max(prog) AS gprog,
             max(dfn) AS gdfn, max(cre) AS gcre FROM it),
fi AS (SELECT sc.*, it.* FROM scen sc, it, g
       WHERE it.fee + (sc.k - 1) * g.gfee <= sc.fee_budget_m + {TOL}
         AND it.wage + (sc.k - 1) * g.gwage <= sc.wage_ceiling_k_pw + {TOL}
         AND (it.age - sc.max_avg_age) + (sc.k - 1) * (g.gage - sc.max_avg_age) <= {TOL}
         AND it.prog + (sc.k - 1) * g.gprog >= sc.min_prog_passes - {TOL}
         AND it.dfn + (sc.k - 1) * g.gdfn >= sc.min_defensive_actions - {TOL}
         AND it.cre + (sc.k - 1) * g.gcre >= sc.min_creation_threat - {TOL}),
bk2 AS (SELECT a.scenario_id, list_sort([a.key, b.key]) AS keys, a.value + b.value AS tv,
              a.fee + b.fee AS tf, a.wage + b.wage AS tw_
       FROM fi a JOIN fi b ON a.scenario_id = b.scenario_id AND a.pos < b.pos
       WHERE a.k = 2
         AND a.fee + b.fee <= a.fee_budget_m + {TOL} AND a.wage + b.wage <= a.wage_ceiling_k_pw + {TOL}
         AND (a.age - a.max_avg_age) + (b.age - a.max_avg_age) <= {TOL}
         AND a.prog + b.prog >= a.min_prog_passes - {TOL} AND a.dfn + b.dfn >= a.min_defensive_actions - {TOL}
         AND a.cre + b.cre >= a.min_creation_threat - {TOL}),
bk3 AS (SELECT a.scenario_id, list_sort([a.key, b.key, c.key]) AS keys,
              a.value + b.value + c.value AS tv, a.fee + b.fee + c.fee AS tf,
              a.wage + b.wage + c.wage AS tw_
       FROM fi a JOIN fi b ON a.scenario_id = b.scenario_id AND a.pos < b.pos
                 JOIN fi c ON a.scenario_id = c.scenario_id AND b.pos < c.pos, g
       WHERE a.k = 3
         AND a.fee + b.fee + g.gfee <= a.fee_budget_m + {TOL}
         AND a.wage + b.wage + g.gwage <= a.wage_ceiling_k_pw + {TOL}
         AND a.fee + b.fee + c.fee <= a.fee_budget_m + {TOL}
         AND a.wage + b.wage + c.wage <= a.wage_ceiling_k_pw + {TOL}
         AND (a.age - a.max_avg_age) + (b.age - a.max_avg_age) + (c.age - a.max_avg_age) <= {TOL}
         AND a.prog + b.prog + c.prog >= a.min_prog_passes - {TOL}
         AND a.dfn + b.dfn + c.dfn >= a.min_defensive_actions - {TOL}
         AND a.cre + b.cre + c.cre >= a.min_creation_threat - {TOL}),
allb AS (SELECT * FROM bk2 UNION ALL SELECT * FROM bk3),
rb AS (SELECT *, row_number() OVER (PARTITION BY scenario_id
         ORDER BY round_even(tv * {d(1e9)}, 0) / {d(1e9)} DESC, keys ASC) AS rn FROM allb),
best AS (SELECT sc.scenario_id, CASE WHEN rb.keys IS NULL THEN 'infeasible' ELSE 'optimal' END AS status,
                CAST(sc.k AS INTEGER) AS k, rb.keys, rb.tv AS total_value, rb.tf AS total_fee,
                rb.tw_ AS total_wage
         FROM scen sc LEFT JOIN (SELECT * FROM rb WHERE rn = 1) rb USING (scenario_id)),
members AS (SELECT b.scenario_id, unnest(b.keys) AS mkey FROM best b WHERE status = 'optimal'),
mem AS (SELECT m.scenario_id, v.* FROM members m JOIN valued v ON v.p_partkey = m.mkey)"""


def _basket_out() -> str:
    return ("SELECT scenario_id, status, k, array_to_string(keys, ',') AS members, "
            "round(total_value, 6) AS total_value, round(total_fee, 6) AS total_fee, "
            "round(total_wage, 6) AS total_wage FROM best")


def _tags_cte() -> str:
    fam = " ".join(f"WHEN {s(r)} THEN {s(f)}" for r, f in D.role_family)
    sec = " ".join(f"WHEN {s(t)} THEN {s(f)}" for t, f in PART_TYPE_SECONDARY)
    return f"""
tg AS (SELECT p_partkey, p_brand, list_sort(list_distinct(list_filter(
         [coalesce(CASE p_kind {fam} END, p_kind), CASE p_type {sec} END], lambda x: x IS NOT NULL))) AS tags
       FROM prof)"""


def _compat_counts_sql() -> str:
    return f"""
cc AS (SELECT a.p_partkey, count(b.p_partkey) AS n_compat
       FROM tg a LEFT JOIN tg b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
                 AND list_has_any(a.tags, b.tags)
       GROUP BY a.p_partkey)"""


def _payload_pairs() -> str:
    return f"""{twins_sql(ALL_Q.format(k=1))},
pr AS (SELECT cand_key, ref_key AS bench_key, similarity_score FROM tw)"""


def _metrics_json(prefix: str) -> str:
    """JSON object of the candidate cohort's features for row alias ``prefix``."""
    cases = []
    for i, (_, fs) in enumerate(D.role_metrics):
        parts = ", ".join(f"{s(f)}: CAST({prefix}.{f} AS DOUBLE)" for f, _, _ in fs)
        cases.append(f"WHEN {i} THEN to_json({{{parts}}})")
    return "CASE cb.cidx " + " ".join(cases) + " END"


def _filled(template: str, values: dict[str, str]) -> str:
    """SQL that concatenates a template's texts and values."""
    parts = [[s(text)] * bool(text) + ([values[field]] if field else [])
             for text, field in template_parts(template)]
    return "concat(" + ", ".join(p for part in parts for p in part) + ")"


def oracle_sql() -> dict[str, str]:
    pb = PROFILE
    n = D.n_slots
    q: dict[str, str] = {}
    cols = ("p_partkey, p_label, p_brand, p_line, p_kind, p_type, p_size, p_retailprice, n_lines, "
            "qty_avg, qty_max, price_avg_k, disc_avg, tax_avg, ret_share, open_share")
    q["profile_build"] = f"{with_(pb)} SELECT {cols} FROM prof"
    q["sink_roundtrip"] = "SELECT * FROM customer"
    vals = ", ".join(f"({s(p)}, {s(c)})" for p, c in D.position_cohort)
    q["cohort_lookup"] = (f"WITH dim(position, cohort) AS (VALUES {vals}) "
                          f"SELECT p_partkey, p_brand, coalesce(cohort, {s(D.default_cohort)}) AS cohort, "
                          f"cohort IS NOT NULL AS mapped FROM part LEFT JOIN dim ON p_brand = position")
    q["lookup_ci"] = ("SELECT upper(a.c_name) AS reference, b.c_custkey, b.c_name FROM customer a "
                      "JOIN customer b ON lower(upper(a.c_name)) = lower(b.c_name)")
    q["unmatched_queries"] = (
        "SELECT reference FROM (SELECT upper(c_name) AS reference FROM customer UNION ALL "
        "SELECT s_name FROM supplier) x WHERE NOT EXISTS (SELECT 1 FROM customer c "
        "WHERE lower(c.c_name) = lower(x.reference))")
    q["min_volume"] = (f"{with_(pb)} SELECT count(*) AS rows_loaded, "
                       f"count_if(n_lines >= 30) AS rows_qualified FROM prof")
    q["percentile_rank"] = _percentile("customer", "c_custkey", "c_acctbal")
    q["percentile_ties"] = _percentile("lineitem", "l_orderkey, l_linenumber", "l_quantity")
    mm = ", ".join(f"min(CAST({m} AS DOUBLE)) AS mn_{m}, max(CAST({m} AS DOUBLE)) AS mx_{m}"
                   for m in PART_METRICS)
    sc = ", ".join(f"CASE WHEN mx_{m} - mn_{m} < {d(10 * 2.220446049250313e-16)} THEN {d(0)} "
                   f"ELSE (CAST({m} AS DOUBLE) - mn_{m}) / (mx_{m} - mn_{m}) END AS {m}_scaled"
                   for m in PART_METRICS)
    q["minmax_scale"] = f"{with_(pb, f'st AS (SELECT {mm} FROM prof)')} SELECT p_partkey, {sc} FROM prof, st"
    zs = []
    for j in range(1, n + 1):
        sd = f"(CASE WHEN sd{j} IS NULL OR sd{j} <= {d(1e-12)} * greatest(abs(mu{j}), {d(1)}) THEN {d(1)} ELSE sd{j} END)"
        zs.append(f"CASE WHEN mn IS NOT NULL AND x{j} IS NOT NULL AND "
                  + " AND ".join(f"x{i} IS NOT NULL" for i in range(1, n + 1))
                  + f" THEN round_even((sqrt({_weight(j - 1)}) * (x{j} - mu{j}) / {sd}) * {d(1e4)}, 0) / {d(1e4)} END AS z{j}")
    mom = ", ".join(f"avg(x{j}) AS mu{j}, stddev_pop(x{j}) AS sd{j}" for j in range(1, n + 1))
    q["zscore_cohort"] = (f"{with_(pb, _cohort_cte(), f'zm AS (SELECT cohort AS zc, count(*) AS mn, {mom} FROM vb WHERE mapped GROUP BY cohort)')} "
                          f"SELECT p_partkey, cohort, mapped, {', '.join(zs)} FROM b2 LEFT JOIN zm ON b2.cohort = zm.zc")
    # Strictly-below share in the cohort pool of mapped rows
    unp = " UNION ALL ".join(f"SELECT p_partkey, cohort, mapped, {j} AS ord, x{j} AS v FROM vb WHERE m >= {j}"
                             for j in range(1, n + 1))
    q["peer_percentile"] = f"""{with_(pb, _cohort_cte(), f'lg AS ({unp})')}
SELECT a.p_partkey, a.cohort, CAST(a.ord AS INTEGER) AS ord,
       CASE WHEN (SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = a.cohort AND b.ord = a.ord) > 0 THEN
       round_even(CAST((SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = a.cohort AND b.ord = a.ord AND b.v < a.v) AS DOUBLE)
         / (SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = a.cohort AND b.ord = a.ord) * {d(100)} * {d(10)}, 0) / {d(10)} END AS pct
FROM lg a"""
    labels = []
    for i, (_, fs) in enumerate(D.role_metrics):
        labels.append(f"WHEN {i} THEN [{', '.join(s(f[2]) for f in fs)}]")
    radar_unp_c = " UNION ALL ".join(
        f"SELECT pr.cand_key, pr.bench_key, cb.cohort, cb.cidx, {j} AS ord, "
        f"{_case_idx('cb.cidx', [f'CAST(cr.{fs[j-1][0]} AS DOUBLE)' if j <= len(fs) else 'NULL' for _, fs in D.role_metrics])} AS cv, "
        f"{_case_idx('cb.cidx', [f'CAST(br.{fs[j-1][0]} AS DOUBLE)' if j <= len(fs) else 'NULL' for _, fs in D.role_metrics])} AS bv "
        f"FROM pr JOIN b2 cb ON cb.p_partkey = pr.cand_key JOIN prof cr ON cr.p_partkey = pr.cand_key "
        f"JOIN prof br ON br.p_partkey = pr.bench_key WHERE cb.m >= {j}"
        for j in range(1, n + 1))
    q["radar_long"] = f"""{with_(pb, _payload_pairs(), f'lg AS ({unp})', f'rl AS ({radar_unp_c})')}
SELECT cand_key, bench_key, cohort, CAST(ord AS INTEGER) AS ord,
       (CASE cidx {' '.join(labels)} END)[ord] AS label,
       round_even(CAST((SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = rl.cohort AND b.ord = rl.ord AND b.v < rl.cv) AS DOUBLE)
         / (SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = rl.cohort AND b.ord = rl.ord) * {d(100)} * {d(10)}, 0) / {d(10)} AS cand_pct,
       coalesce(round_even(CAST((SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = rl.cohort AND b.ord = rl.ord AND b.v < rl.bv) AS DOUBLE)
         / (SELECT count(*) FROM lg b WHERE b.mapped AND b.cohort = rl.cohort AND b.ord = rl.ord) * {d(100)} * {d(10)}, 0) / {d(10)}, {d(50)}) AS bench_pct
FROM rl"""
    q["twins_single"] = f"{with_(pb, twins_sql(_one(R.TWIN_REF)))} {_tw_out()}"
    q["twins_strict"] = f"{with_(pb, twins_sql(_one(R.TWIN_REF), strict=True))} {_tw_out()}"
    q["twins_filtered"] = (f"{with_(pb, twins_sql(_one(R.TWIN_REF, R.FILTER_AGE, list(R.FILTER_LINES), 8)))} "
                           f"{_tw_out()}")
    disp = ", ".join(
        f"{_case_idx('q.cidx', [s(fs[j][0]) if j < len(fs) else 'NULL' for _, fs in D.role_metrics])} AS \"Metric {j + 1}\", "
        f"c.x{j + 1} AS \"Value {j + 1}\"" for j in range(3))
    q["twins_display"] = f"""{with_(pb, twins_sql(_one(R.TWIN_REF)))}
SELECT {s(R.TWIN_REF)} AS "Reference", c.p_label AS "Player", c.p_type AS "Club", c.p_line AS "League",
       c.p_brand AS "Pos", c.p_kind AS "Tactical Role", c.p_size AS "Age",
       tw.similarity_score AS "Similarity (%)", tw.rank AS "Rank", {disp}
FROM tw JOIN vb c ON c.p_partkey = tw.cand_key JOIN qs q ON q.ref_key = tw.ref_key"""
    q["pool_union"] = f"{with_(pb, twins_sql(_one(R.UNMAPPED_REF)))} {_tw_out()}"
    q["twins_batch"] = f"{with_(pb, twins_sql(ALL_Q.format(k=5)))} {_tw_out()}"
    q["twins_embeddings"] = f"""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL),
lg AS (SELECT label, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v),
mo AS (SELECT label, d, avg(x) AS mu, stddev_pop(x) AS sd FROM lg GROUP BY label, d),
ks AS (SELECT label, list(1.0 / (s * s) ORDER BY d) AS kvec FROM (
         SELECT label, d, CASE WHEN sd IS NULL OR sd <= {d(1e-12)} * greatest(abs(mu), {d(1)}) THEN {d(1)} ELSE sd END AS s
         FROM mo) GROUP BY label),
pairs AS (
  SELECT q.vec_id AS ref_key, q.label AS cohort, c.vec_id AS cand_key,
         round_even(exp(-({d(1)} / ({d(4)} * CAST(len(q.vec) AS DOUBLE))) *
           list_reduce(list_transform(list_zip(c.vec, q.vec, ks.kvec), lambda e: e[3] * (e[1] - e[2]) * (e[1] - e[2])),
                       lambda acc, y: acc + y, {d(0)})) * {d(100)} * {d(100)}, 0) / {d(100)} AS similarity_score
  FROM v q JOIN ks ON ks.label = q.label JOIN v c ON c.label = q.label AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_key ORDER BY similarity_score DESC, cand_key) AS rank FROM pairs)
SELECT ref_key, cohort, cand_key, similarity_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""
    q["market_enrich"] = f"{with_(pb, RECENT)} SELECT p_partkey, fee, wage, contract_years, resale FROM market"
    q["composite_value"] = f"{with_(pb, MARKET)} SELECT p_partkey, composite_value FROM valued"
    q["skyline"] = f"""{with_(pb, MARKET, '''it AS (SELECT p_partkey AS key, p_brand AS pos, fee, wage, CAST(p_size AS DOUBLE) AS age,
  qty_avg AS prog, CAST(n_lines AS DOUBLE) AS dfn, ret_share + open_share AS cre, composite_value AS value
  FROM valued WHERE p_brand IS NOT NULL AND qty_avg IS NOT NULL AND ret_share IS NOT NULL)''')}
SELECT key AS p_partkey, pos AS p_brand FROM it j WHERE NOT EXISTS (
  SELECT 1 FROM it i WHERE i.pos = j.pos AND i.key <> j.key AND i.fee <= j.fee AND i.wage <= j.wage
    AND i.age <= j.age AND i.prog >= j.prog AND i.dfn >= j.dfn AND i.cre >= j.cre
    AND (i.value > j.value OR (i.value = j.value AND i.key < j.key)))"""
    q["basket_pairs"] = f"{with_(pb, baskets_sql(R.PAIR_SCENARIO))} {_basket_out()}"
    q["basket_triples"] = f"{with_(pb, baskets_sql(R.TRIPLE_SCENARIO))} {_basket_out()}"
    q["basket_scenarios"] = f"{with_(pb, baskets_sql())} {_basket_out()}"
    q["basket_infeasible"] = (f"{with_(pb, baskets_sql())} SELECT scenario_id, status FROM best "
                              f"WHERE status = 'infeasible'")
    q["basket_kpis"] = f"""{with_(pb, baskets_sql())}
SELECT m.scenario_id, count(*) AS n_players, round(sum(fee), 6) AS spent_fee, round(sum(wage), 6) AS spent_wages,
  round(sum(qty_avg), 6) AS combined_prog, round(sum(CAST(n_lines AS DOUBLE)), 6) AS combined_def,
  round(avg(CAST(p_size AS DOUBLE)), 6) AS portfolio_age,
  round(any_value(sc.fee_budget_m) - sum(fee), 6) AS fee_saved,
  round(any_value(sc.wage_ceiling_k_pw) - sum(wage), 6) AS wage_saved,
  round(sum(qty_avg) - any_value(sc.min_prog_passes), 6) AS prog_surplus,
  round(sum(CAST(n_lines AS DOUBLE)) - any_value(sc.min_defensive_actions), 6) AS def_surplus,
  round(any_value(sc.max_avg_age) - avg(CAST(p_size AS DOUBLE)), 6) AS age_under_cap
FROM mem m JOIN scen sc USING (scenario_id) GROUP BY m.scenario_id"""
    q["basket_display"] = f"""{with_(pb, baskets_sql())}
SELECT scenario_id, p_partkey AS "Target", p_brand AS "Pos", p_type AS "Club", p_line AS "League",
       p_size AS "Age", fee AS "Fee", wage AS "Wage", qty_avg AS "Prog", n_lines AS "Def", resale AS "Resale"
FROM mem"""
    q["tag_sets"] = f"{with_(pb, _tags_cte())} SELECT p_partkey, array_to_string(tags, '|') AS tags FROM tg"
    q["compat_counts"] = f"{with_(pb, _tags_cte(), _compat_counts_sql())} SELECT p_partkey, n_compat FROM cc"
    q["compat_pairs"] = f"""{with_(pb, twins_sql(ALL_Q.format(k=R.EVAL_K)), _tags_cte())}
SELECT tw.ref_key, tw.cand_key, tw.rank, list_has_any(a.tags, b.tags) AS compatible
FROM tw JOIN tg a ON a.p_partkey = tw.ref_key JOIN tg b ON b.p_partkey = tw.cand_key"""
    k = R.EVAL_K
    q["recommender_eval"] = f"""{with_(pb, twins_sql(ALL_Q.format(k=k)), _tags_cte(), _compat_counts_sql())},
fl AS (SELECT tw.ref_key, tw.rank, list_has_any(a.tags, b.tags) AS hit, cc.n_compat,
              least({k}, cc.n_compat) AS eval_k
       FROM tw JOIN tg a ON a.p_partkey = tw.ref_key JOIN tg b ON b.p_partkey = tw.cand_key
               JOIN cc ON cc.p_partkey = tw.ref_key WHERE cc.n_compat > 0),
pq AS (SELECT ref_key, CAST(count_if(hit AND rank <= eval_k) AS DOUBLE) / any_value(eval_k) AS prec,
              coalesce({d(1)} / min(CASE WHEN hit AND rank <= eval_k THEN rank END), {d(0)}) AS rr
       FROM fl GROUP BY ref_key)
SELECT {k} AS k, count(*) AS evaluated, (SELECT count(*) FROM part) AS total,
       round(avg(prec) * {d(100)}, 6) AS precision_pct, round(avg(rr), 6) AS mrr,
       CASE WHEN avg(prec) * {d(100)} >= {d(70)} THEN 'PASS' ELSE 'NEEDS TUNING' END AS verdict
FROM pq"""
    q["payload_json"] = f"""{with_(pb, _payload_pairs())}
SELECT pr.cand_key, pr.bench_key, cr.p_label AS cand_name, br.p_label AS bench_name,
       CAST(cr.p_size AS INTEGER) AS cand_age, pr.similarity_score AS similarity_score_pct,
       {_metrics_json('cr')} AS cand_metrics, {_metrics_json('br')} AS bench_metrics
FROM pr JOIN b2 cb ON cb.p_partkey = pr.cand_key JOIN prof cr ON cr.p_partkey = pr.cand_key
        JOIN prof br ON br.p_partkey = pr.bench_key"""
    club = R.TARGET_CLUB
    note = _filled(DOSSIER, {
        "club": s(club), "name": "c.p_label", "team": "c.p_type", "age": "CAST(c.p_size AS VARCHAR)",
        "position": "c.p_brand", "role": "c.p_kind", "other": "b.p_label", "other_team": "b.p_type",
        "score": "CAST(pr.similarity_score AS VARCHAR)"})
    q["dossier_text"] = f"""{with_(pb, _payload_pairs())}
SELECT pr.cand_key, pr.bench_key, {note} AS dossier
FROM pr JOIN prof c ON c.p_partkey = pr.cand_key JOIN prof b ON b.p_partkey = pr.bench_key"""
    q["catalog_options"] = f"""{with_(pb)}
SELECT DISTINCT kind, option FROM (
  SELECT 'league' AS kind, p_line AS option FROM prof UNION ALL
  SELECT 'position', p_brand FROM prof UNION ALL SELECT 'name', p_label FROM prof) WHERE option IS NOT NULL"""
    uvals = ", ".join(f"({s(u)}, {s(p)})" for u, ps in D.position_unit for p in ps)
    q["unit_drilldown"] = (f"{with_(pb, f'un(unit, position) AS (VALUES {uvals})')} SELECT unit, position, "
                           f"p_label AS player FROM prof JOIN un ON p_brand = position")

    QQ = "'" * 4  # SQL literal holding one quote
    f1 = lambda x: f"printf('%.1f', round_even(({x}) * {d(10)}, 0) / {d(10)})"
    r1 = lambda x: f"round_even(({x}) * {d(10)}, 0) / {d(10)}"
    fin = (f"to_json({{'budget_available_eur_m': budget, 'total_spent_eur_m': {r1('spent')}, "
           f"'cash_reserve_preserved_eur_m': {r1('budget - spent')}, 'wage_budget_k_pw': wage_budget, "
           f"'committed_wages_k_pw': {r1('wages')}, 'wage_savings_k_pw': {r1('wage_budget - wages')}, "
           f"'average_portfolio_age': {r1('avg_age')}, 'combined_prog_passes_per90': {r1('prog')}, "
           f"'combined_defensive_actions_per90': {r1('dfn')}}})")
    listed = (f"('[' || array_to_string(list_transform(names, lambda x: {QQ} || x || {QQ}), ', ')"
              " || ']')")
    memo = _filled(BOARD_MEMO, {
        "club": s(club), "spent": f1("spent"), "budget": f1("budget"), "left": f1("budget - spent"),
        "wages": f1("wages"), "room": f1("wage_budget - wages"), "prog": f1("prog"),
        "defence": f1("dfn"), "age": f1("avg_age"), "names": listed})
    q["boardroom_summary"] = f"""{with_(pb, baskets_sql())},
agg AS (SELECT m.scenario_id, any_value(sc.fee_budget_m) AS budget, any_value(sc.wage_ceiling_k_pw) AS wage_budget,
               sum(fee) AS spent, sum(wage) AS wages, avg(CAST(p_size AS DOUBLE)) AS avg_age,
               sum(qty_avg) AS prog, sum(n_lines) AS dfn, list(p_label ORDER BY p_partkey) AS names
        FROM mem m JOIN scen sc USING (scenario_id) GROUP BY m.scenario_id)
SELECT scenario_id, {fin} AS financial_json, {memo} AS memo FROM agg"""
    pct = ", ".join(
        f"round_even(((rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / {d(2)})"
        f" / count({m}) OVER () * {d(100)}) * {d(10)}, 0) / {d(10)} AS {m}_percentile"
        for m in PART_METRICS)
    mm2 = ", ".join(f"min(CAST({m} AS DOUBLE)) AS mn_{m}, max(CAST({m} AS DOUBLE)) AS mx_{m}"
                    for m in PART_METRICS)
    q["feature_table"] = (f"{with_(pb, 'kept AS (SELECT * FROM prof WHERE n_lines >= 30)', f'st AS (SELECT {mm2} FROM kept)')} "
                          f"SELECT p_partkey, {pct}, {sc} FROM kept, st")
    q["invariants"] = f"""{with_(pb, twins_sql(ALL_Q.format(k=5)), baskets_sql())},
tv AS (SELECT count_if(similarity_score < 0 OR similarity_score > 100) AS score_out_of_bounds,
              count_if(ref_key = cand_key) AS self_matches, count_if(rank > 5) AS over_top_n,
              CAST(0 AS BIGINT) AS age_violations, CAST(0 AS BIGINT) AS league_violations FROM tw),
per AS (SELECT m.scenario_id, count(*) AS n, count(DISTINCT p_brand) AS npos, sum(fee) AS fee,
               sum(wage) AS wage, avg(CAST(p_size AS DOUBLE)) AS age, sum(qty_avg) AS prog,
               sum(n_lines) AS dfn, sum(ret_share + open_share) AS cre FROM mem m GROUP BY m.scenario_id),
bv AS (SELECT count_if(per.fee > sc.fee_budget_m + {TOL}) AS over_fee_budget,
              count_if(per.wage > sc.wage_ceiling_k_pw + {TOL}) AS over_wage_ceiling,
              count_if(per.age > sc.max_avg_age + {TOL}) AS over_age_cap,
              count_if(per.prog < sc.min_prog_passes - {TOL}) AS under_prog_floor,
              count_if(per.dfn < sc.min_defensive_actions - {TOL}) AS under_defence_floor,
              count_if(per.cre < sc.min_creation_threat - {TOL}) AS under_creation_floor,
              count_if(per.n <> sc.k) AS wrong_basket_size, count_if(per.npos <> per.n) AS duplicate_positions
       FROM per JOIN scen sc USING (scenario_id)),
iv AS (SELECT count(*) - count(DISTINCT p_partkey) AS duplicate_keys, count_if(p_brand IS NULL) AS null_positions,
              count_if({' OR '.join(f'{m} IS NULL' for m in PART_METRICS)}) AS null_metric_rows FROM prof)
SELECT * FROM tv, bv, iv"""

    q["twins_indexed"] = " UNION ALL ".join(
        f"SELECT *, {s(name)} AS search FROM ({q[of]})" for name, of in
        (("single", "twins_single"), ("strict", "twins_strict"), ("filtered", "twins_filtered"),
         ("unmapped", "pool_union")))

    mapped = ", ".join(s(b) for b, _ in D.position_cohort)
    q["written_counts"] = f"""{with_(pb)}
SELECT count(*) AS rows_written, count_if(n_lines >= {R.MIN_LINES}) AS rows_qualified,
  count_if(p_brand NOT IN ({mapped})) AS rows_unmapped, count(*) AS rows_read_back FROM prof"""
    q["lookup_exact"] = (f"{with_(pb)} SELECT p_partkey, p_label FROM prof "
                         f"WHERE p_label IN ({s(R.EXACT_NAME)}, {s(R.EXACT_NAME.upper())})")
    q["percentile_merged"] = f"""
WITH h AS (SELECT c_acctbal AS value, count(*) AS c FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1),
r AS (SELECT value, c, sum(c) OVER (ORDER BY value) AS cum, sum(c) OVER () AS n FROM h)
SELECT value, CAST(n AS BIGINT) AS n,
  round_even(((cum - (c - 1) / {d(2)}) / n * {d(100)}) * {d(10)}, 0) / {d(10)} AS average_pct,
  round_even(((cum - c) / n * {d(100)}) * {d(10)}, 0) / {d(10)} AS strict_pct FROM r"""

    def moments(where: str) -> str:
        rows = " UNION ALL ".join(f"SELECT cohort, mapped, {s(m)} AS feature, CAST({m} AS DOUBLE) AS x FROM b2"
                                  for m in PART_METRICS)
        return f"""{with_(pb, _cohort_cte(), f'lm AS ({rows})')}
SELECT cohort, feature, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd
FROM lm WHERE x IS NOT NULL {where} GROUP BY cohort, feature"""
    q["moments_merged"] = moments("")
    q["moments_removed"] = moments("AND mapped")
    cases = ", ".join(f"CASE WHEN {bad} THEN {s(name)} END" for name, bad in R.MARKET_RULES)
    one = "SELECT * FROM market ORDER BY p_partkey LIMIT 1"
    faults = ["99 AS p_size", "1 AS n_lines", "-1 AS fee", "-1 AS wage", "NULL AS qty_avg", "NULL AS p_brand"]
    planted = " UNION ALL BY NAME ".join(
        f"SELECT * REPLACE ({-1 - i} AS p_partkey, {f}) FROM ({one})" for i, f in enumerate(faults))
    q["market_quarantine"] = f"""{with_(pb, MARKET)},
al AS (SELECT * FROM market UNION ALL BY NAME {planted}),
br AS (SELECT p_partkey, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM al)
SELECT p_partkey, rule, count(*) OVER (PARTITION BY rule) AS rows_of_rule,
  (SELECT count(DISTINCT p_partkey) FROM br) AS rows_rejected, (SELECT count(*) FROM al) AS rows_read FROM br"""
    q["radar_unknown"] = f"""SELECT p_partkey AS cand_key, -1 - p_partkey AS bench_key, cohort, ord, pct AS cand_pct,
  {d(50)} AS bench_pct FROM ({q['peer_percentile']})"""
    q["boardroom_players"] = f"""{with_(pb, baskets_sql())}
SELECT scenario_id, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY p_partkey) AS INTEGER) AS slot,
  p_label AS player_name, p_brand AS position, p_type AS team, p_line AS league, p_size AS age,
  fee AS market_value_eur_m, wage AS wage_gbp_k_pw, qty_avg AS progressive_passes_per90,
  n_lines AS tackles_interceptions_per90, resale AS resale_potential_multiplier FROM mem"""
    q["payload_fields"] = f"""{with_(pb, _payload_pairs())}
SELECT pr.cand_key, pr.bench_key, c.p_label AS candidate_name, c.p_type AS candidate_team,
  c.p_line AS candidate_league, c.p_brand AS candidate_position, c.p_kind AS candidate_primary_role,
  CAST(c.p_size AS INTEGER) AS candidate_age, c.n_lines AS candidate_minutes_played,
  b.p_label AS benchmark_name, b.p_type AS benchmark_team, b.p_brand AS benchmark_position,
  b.p_kind AS benchmark_primary_role, CAST(b.p_size AS INTEGER) AS benchmark_age,
  pr.similarity_score AS score
FROM pr JOIN prof c ON c.p_partkey = pr.cand_key JOIN prof b ON b.p_partkey = pr.bench_key"""
    return q

"""Statistical twins: cohort-normalised, role-weighted Gaussian similarity.

For a query q and candidate c of the same pool,

    d2    = sum_j w_j * ((x_cj - x_qj) / s_j)^2      (s_j = pool std, 1 if ~0)
    score = rint(exp(-d2 / (4 m)) * 100 * 100) / 100 (m = cohort feature count)

which is the squared Euclidean distance of the weighted z-scores (the
means cancel).  All queries are answered by one plan:

* pool moments are one ``groupBy(pool)`` (one row per cohort/position);
* no pool is scored pair by pair, nor pairs in a join: pools are cut into
  equi-depth cells, every query is answered in its nearest cell and goes on
  only to cells within the radius of its k-th best score (``_cell_top``);
  tasks score a block of a cell's queries with array operations (``near``);
* cells hold at most ``CELL_ROWS`` candidates and blocks a bounded number of
  queries, so a hot cohort or cell is spread over many tasks; exact duplicate
  vectors collapse first;
* callers that set the grid's options get the search on a grid of the heaviest
  features as rows of joins keyed by ``(pool, cell, block)`` (``_grid_top``);
* ``row_number() <= k`` plans a ``WindowGroupLimit``.

Normalisation happens before any age / league filter (filters only remove
candidates after scoring), and a query whose position has no cohort is
scored with the default cohort's features against that cohort's members,
its own row added to the moments.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from peerlens.dims import Dimensions
from peerlens.operators.cells import equi_depth, first_split
from peerlens.operators.near import BLOCK_QUERIES, group_top, matrix
from peerlens.operators.normalize import cohort_moments, guarded_scale, with_cohort, with_slots
from peerlens.schemas import ProfileSpec
from peerlens.session import materialize as _materialize

DEFAULT_PAIR_BUDGET = 2_000_000
MAX_BROADCAST_QUERIES = 10_000
MIN_BLOCK_PAIRS = 50_000


def prepare(profile: DataFrame, dims: Dimensions, spec: ProfileSpec) -> DataFrame:
    """Profile + cohort, mapped flag, metric slots, m, valid."""
    return with_slots(with_cohort(profile, dims, spec), dims)


def normalize_queries(queries: DataFrame) -> DataFrame:
    """Fill optional query columns with their defaults (C1 signature)."""
    cols = set(queries.columns)
    q = queries
    if "max_age" not in cols:
        q = q.withColumn("max_age", F.lit(None).cast("int"))
    if "selected_leagues" not in cols:
        q = q.withColumn("selected_leagues", F.lit(None).cast("array<string>"))
    if "strict_position" not in cols:
        q = q.withColumn("strict_position", F.lit(False))
    if "top_n" not in cols:
        q = q.withColumn("top_n", F.lit(DEFAULT_TOP_N))
    q = q.withColumn("strict_position", F.coalesce(F.col("strict_position"), F.lit(False)))
    if "query_id" not in cols:
        leagues = F.coalesce(F.array_join(F.array_sort(F.col("selected_leagues")), "\u0001"),
                             F.lit(""))
        q = q.withColumn("query_id", F.xxhash64(
            F.lower(F.col("reference")), F.col("max_age"), leagues,
            F.col("strict_position"), F.col("top_n")))
    return q


DEFAULT_TOP_N = 5
PARAMETERS = ("reference", "max_age", "selected_leagues", "strict_position", "top_n")


def _identity() -> Column:
    """128 bits over a request's parameters (the name without regard to case)."""
    leagues = F.array_sort(F.col("selected_leagues"))
    values = [F.lower(F.col("reference")), F.col("max_age"), leagues, F.col("strict_position"),
              F.col("top_n")]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit("b"), *values).alias("b"))


def resolve(base: DataFrame, queries: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Match query strings to profile rows, case-insensitively."""
    q = normalize_queries(queries)
    b = base.select(F.lower(F.col(spec.name)).alias("_lname"), *base.columns)
    return q.join(b, F.lower(q["reference"]) == b["_lname"], "inner").drop("_lname")


def unmatched(profile: DataFrame, queries: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Queries whose reference matches no profile row (P6 in batch form)."""
    names = profile.select(F.lower(F.col(spec.name)).alias("_lname"))
    q = normalize_queries(queries)
    return q.join(names, F.lower(q["reference"]) == names["_lname"], "left_anti")


def lookup(profile: DataFrame, spec: ProfileSpec, name: str,
           case_insensitive: bool = True) -> DataFrame:
    """Rows whose name equals ``name`` (lower-cased on both sides by
    default).  Keys are unique by contract, so at most one row matches;
    ``checks.input_violations`` reports duplicates."""
    col = F.col(spec.name)
    cond = (F.lower(col) == F.lower(F.lit(name))) if case_insensitive else (col == F.lit(name))
    return profile.where(cond)


def _adjusted_moments(dims: Dimensions) -> list[Column]:
    """Moments of (pool + the query's own row), from the pool's n/mu/sd.

    Chan's update: n' = n+1, d = x-mu, mu' = mu + d/n',
    M2' = n sd^2 + d (x - mu').  An empty pool gives mu' = x, sd' = 0."""
    out = []
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    n1 = n + F.lit(1.0)
    for j in range(1, dims.n_slots + 1):
        x = F.col(f"x{j}")
        mu = F.coalesce(F.col(f"mu{j}"), x)
        sd = F.coalesce(F.col(f"sd{j}"), F.lit(0.0))
        d = x - mu
        mu1 = mu + d / n1
        m2 = n * sd * sd + d * (x - mu1)
        out += [mu1.alias(f"amu{j}"), F.sqrt(F.greatest(m2, F.lit(0.0)) / n1).alias(f"asd{j}")]
    return out


def twins(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, queries: DataFrame, *,
          strict_position: bool | None = False, **options) -> DataFrame:
    """Top-k statistical twins for every row of ``queries``.

    Requests with the same parameters are answered once and the answer goes
    to each of them, so a request table may repeat rows; ``query_id`` may be
    of any type.  See ``distinct_twins`` for the parameters."""
    asked = normalize_queries(queries)
    if strict_position is not None:
        asked = asked.withColumn("strict_position", F.lit(bool(strict_position)))
    if options.get("top_n_bound") is None:
        options["top_n_bound"] = int(asked.agg(F.max("top_n")).first()[0] or 0)
    asked = asked.withColumn("_request", _identity())
    # grouped by the parameters themselves: hashed, while ``first`` of texts would sort
    once = asked.select("_request", F.lower("reference").alias("reference"), "max_age",
                        F.array_sort("selected_leagues").alias("selected_leagues"),
                        "strict_position", "top_n").distinct()
    found = distinct_twins(profile, dims, spec, once.withColumnRenamed("_request", "query_id"),
                           strict_position=strict_position, **options)
    columns = found.columns
    found = found.drop("reference", "max_age", "selected_leagues", "strict_position", "top_n")
    return (found.withColumnRenamed("query_id", "_request")
            .join(asked.select("_request", "query_id", *PARAMETERS), "_request").select(*columns))


def distinct_twins(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, queries: DataFrame, *,
          strict_position: bool | None = False, pair_budget: int = DEFAULT_PAIR_BUDGET,
          carry: list[str] | None = None, prepared: DataFrame | None = None,
          sample: int = 64, few_queries: bool = False,
          materialize: bool = True, exhaustive_pool: int | None = None,
          cell_target: int | None = None, max_box_cells: int | None = None,
          top_n_bound: int | None = None, diagnostics: dict | None = None,
          cell_rows: int | None = None, display: bool = True) -> DataFrame:
    """Top-k statistical twins for queries with distinct ``query_id``.

    ``queries`` needs a ``reference`` column (matched case-insensitively to
    ``spec.name``) and may carry ``max_age``, ``selected_leagues``,
    ``strict_position``, ``top_n`` and ``query_id``.  ``strict_position``
    given as a bool applies to all queries (one pool copy); None honours
    the per-row column.  ``few_queries=True`` declares a query table of
    bounded size (at most ``MAX_BROADCAST_QUERIES`` rows, e.g. built from a
    Python list): it is broadcast against the pools and scored in one scan.
    ``top_n_bound`` is the largest ``top_n``, looked up if not given: as a
    literal it cuts the pairs of a query before they are sorted.  Without
    ``display`` the candidates' display columns and metrics are left out, and
    so is the join that looks them up.
    Output: one row per (query, candidate) with the candidate's display
    columns, ``similarity_score`` and ``rank``."""
    if few_queries and queries.limit(MAX_BROADCAST_QUERIES + 1).count() > MAX_BROADCAST_QUERIES:
        few_queries = False       # size checked: larger query tables take the grid path
    if top_n_bound is None and "top_n" not in queries.columns:
        top_n_bound = DEFAULT_TOP_N
    if top_n_bound is None:
        top_n_bound = int(queries.agg(F.max("top_n")).first()[0] or 0)
    best = (F.col("rank") <= F.lit(top_n_bound)) & (F.col("rank") <= F.col("top_n"))
    base = prepared if prepared is not None else prepare(profile, dims, spec)
    if materialize and not few_queries:
        # The all-pairs plan reads the prepared rows in many branches
        # (queries, pools, moments, block counts, sample, attributes):
        # materialise them once (reliable checkpoint, shared folder) instead
        # of re-running the profile lineage per branch.
        base = _materialize(base)
    carry = [c for c in (carry if carry is not None else spec.display()) if c != spec.key]
    nslot = dims.n_slots
    xs = [f"x{j}" for j in range(1, nslot + 1)]

    q = resolve(base, queries, spec).where("valid")
    if strict_position is not None:
        q = q.withColumn("strict_position", F.lit(bool(strict_position)))
    q = q.withColumn("pool", F.when(F.col("strict_position"),
                                    F.concat(F.lit("p|"), F.col(spec.position)))
                               .otherwise(F.concat(F.lit("c|"), F.col("cohort"))))

    # Candidate pools: cohort pools hold mapped rows, position pools all rows.
    valid = base.where("valid")
    cand_cols = list(dict.fromkeys([spec.key, spec.age, spec.league, "cohort_idx", *xs]))
    pools = []
    if strict_position is not True:
        pools.append(valid.where("mapped").select(
            F.concat(F.lit("c|"), F.col("cohort")).alias("pool"), *cand_cols))
    if strict_position is not False:
        pools.append(valid.select(
            F.concat(F.lit("p|"), F.col(spec.position)).alias("pool"), *cand_cols))
    cand = pools[0] if len(pools) == 1 else pools[0].unionByName(pools[1])

    # A1: one row per pool.
    cand_for_moments = cand.withColumn("valid", F.lit(True))
    moments = cohort_moments(cand_for_moments, dims, "pool")

    # Query-side scale factors c_j = w_j / s_j^2 (adjusted for unmapped queries).
    q = q.join(moments, "pool", "left")
    own_row = F.col("strict_position") | F.col("mapped")
    q = q.select("*", *_adjusted_moments(dims))
    # staged projections: each intermediate is a column, so Catalyst does not
    # inline (and duplicate) the moment expressions into one huge method.
    q = q.select("*", *[c for j in range(1, nslot + 1) for c in (
        F.when(own_row, F.col(f"mu{j}")).otherwise(F.col(f"amu{j}")).alias(f"smu{j}"),
        F.when(own_row, F.col(f"sd{j}")).otherwise(F.col(f"asd{j}")).alias(f"ssd{j}"))])
    q = q.select("*", *[guarded_scale(F.col(f"ssd{j}"), F.col(f"smu{j}")).alias(f"s{j}")
                        for j in range(1, nslot + 1)])
    factors = [(dims.slot(F.col("cohort_idx"), j - 1, "weight")
                / (F.col(f"s{j}") * F.col(f"s{j}"))).alias(f"k{j}")
               for j in range(1, nslot + 1)]
    q = q.select(
        "query_id", "reference", F.col(spec.key).alias("ref_key"),
        F.col(spec.name).alias("ref_name") if spec.name != spec.key else F.col(spec.name).alias("ref_name"),
        "cohort", "cohort_idx", "strict_position", "pool", "max_age", "selected_leagues", "top_n", "m",
        *[F.col(x).alias(f"q{x}") for x in xs], *factors)
    if materialize and not few_queries:
        q = _materialize(q)       # read for the search and for the descriptive columns

    qdesc = q.groupBy("query_id").agg(
        F.min("reference").alias("reference"),
        *[F.first(c).alias(c) for c in ("ref_key", "ref_name", "cohort", "cohort_idx",
                                        "strict_position", "max_age", "selected_leagues",
                                        "top_n")])
    attrs = base.select(spec.key, *carry, *xs[:3]).dropDuplicates([spec.key])

    def finish(top: DataFrame) -> DataFrame:
        # descriptive columns joined back for the k winners only
        out = top.join(qdesc, "query_id")
        if display:
            out = out.join(attrs, spec.key)
        return out.select(
            "query_id", "reference", "ref_key", "ref_name", "cohort", "cohort_idx",
            "strict_position", "max_age", "selected_leagues", "top_n",
            spec.key, *(carry if display else []), "similarity_score", "rank",
            *(xs[:3] if display else []))

    if few_queries:
        # Bounded query literal: broadcast it, score each pool row once, and
        # let WindowGroupLimit keep k rows per query in every task before
        # the (tiny) shuffle by query.
        qb = F.broadcast(q.select(
            "pool", "query_id", "top_n", "max_age", "selected_leagues", "m",
            F.col("ref_key").alias("_rk"), *[f"q{x}" for x in xs],
            *[f"k{j}" for j in range(1, nslot + 1)]))
        core = cand.select("pool", F.col(spec.key).alias("_ck"), F.col(spec.age).alias("_cage"),
                           F.col(spec.league).alias("_clg"), *xs)
        pairs = core.join(qb, "pool").where(F.col("_ck") != F.col("_rk")).where(
            (F.col("max_age").isNull() | (F.col("_cage") <= F.col("max_age")))
            & (F.col("selected_leagues").isNull() | (F.size("selected_leagues") == 0)
               | F.array_contains(F.col("selected_leagues"), F.col("_clg"))))
        w1 = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(),
                                                    F.col("_ck").asc())
        top = (pairs.select("query_id", "top_n", "_ck", _score(nslot).alias("similarity_score"))
               .withColumn("rank", F.row_number().over(w1)).where(best)
               .select("query_id", F.col("_ck").alias(spec.key), "similarity_score", "rank"))
        return finish(top)

    if exhaustive_pool is None and cell_target is None and max_box_cells is None:
        return finish(_cell_top(q, cand, moments, spec, nslot, kmax=top_n_bound,
                                cell_rows=cell_rows, pair_budget=pair_budget))
    top = _grid_top(base.sparkSession, q, cand, moments, dims, spec, nslot,
                    pair_budget=pair_budget, sample=sample,
                    exhaustive_pool=exhaustive_pool or EXHAUSTIVE_POOL,
                    cell_target=cell_target or CELL_TARGET,
                    max_box_cells=max_box_cells or MAX_BOX_CELLS,
                    kmax=top_n_bound, diagnostics=diagnostics)
    return finish(top)


# ----------------------------------------------------------------- cells
CELL_ROWS = 131_072         # candidates per equi-depth cell of a pool, at most
MOST_QUERIES = 65_536       # queries that a task meets with a cell, at most


class Boxes:
    """The boxes of the cells of every pool that has more than one."""

    def __init__(self, rows: list, nslot: int):
        pools: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r["pool"], r["cell"])):
            pools.setdefault(r["pool"], []).append(r)
        self.pools = {p: (np.array([r["cell"] for r in held], object),
                          np.array([[r[f"lo_x{j}"] for j in range(1, nslot + 1)] for r in held], float),
                          np.array([[r[f"hi_x{j}"] for j in range(1, nslot + 1)] for r in held], float))
                      for p, held in pools.items()}

    def near(self, asked: pa.Table | pa.RecordBatch):
        """(rows, the cells' names, their gaps) for the queries of each such pool."""
        pools = asked.column("pool").to_pandas()
        qx, k = matrix(asked, "qx"), matrix(asked, "k")
        for pool, rows in pools.groupby(pools).indices.items():
            if pool in self.pools:
                cells, low, high = self.pools[pool]
                for i in range(0, len(rows), 4096):
                    at = rows[i:i + 4096]
                    gap = np.zeros((len(at), len(cells)))
                    for j in range(qx.shape[1]):
                        x = qx[at, j, None]
                        side = np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0)
                        gap += k[at, j, None] * side * side
                    # the sum may round above a pair's; no number: no bound
                    yield at, cells, np.where(np.isnan(gap), 0.0, gap * (1.0 - 1e-9))

    def home(self, asked: pa.RecordBatch) -> pa.RecordBatch:
        """``asked`` with the nearest cell of every query."""
        out = np.full(asked.num_rows, "", object)
        for at, cells, gap in self.near(asked):
            out[at] = cells[gap.argmin(1)]
        return asked.append_column("cell", pa.array(out, pa.string()))

    def onward(self, asked: pa.Table, r2: np.ndarray) -> pa.Array:
        """The cells within ``r2`` of every query, but for its own."""
        own = asked.column("cell").to_pandas().to_numpy(object)
        whose, where = [np.zeros(0, int)], [np.zeros(0, object)]
        for at, cells, gap in self.near(asked):
            a, b = np.nonzero((gap <= r2[at, None]) & (cells[None, :] != own[at, None]))
            whose.append(at[a])
            where.append(cells[b])
        whose, where = np.concatenate(whose), np.concatenate(where)
        by = np.argsort(whose, kind="stable")
        ends = np.searchsorted(whose[by], np.arange(asked.num_rows + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(where[by], pa.string()))


def _cell_top(q: DataFrame, cand: DataFrame, moments: DataFrame, spec: ProfileSpec, nslot: int, *,
              kmax: int, cell_rows: int | None, pair_budget: int) -> DataFrame:
    """Exact top-k for every query from equi-depth cells of the pools.

    Every query is answered in its nearest cell; the k-th best score there
    gives a radius (none with fewer than k rows), and the query goes on to
    those other cells only whose box lies within it.  Rows of equal slots, age
    and league collapse to the k + 1 smallest keys, each at most k times."""
    xs = [f"x{j}" for j in range(1, nslot + 1)]
    cs = [f"c{j}" for j in range(1, nslot + 1)]
    spark, size = cand.sparkSession, cell_rows or CELL_ROWS
    alike = ["pool", *xs, "_cage", "_clg"]
    geo = moments.select("pool", *[guarded_scale(F.col(f"sd{j}"), F.col(f"mu{j}")).alias(f"gs{j}")
                                   for j in range(1, nslot + 1)])
    core = (cand.select("pool", F.col(spec.key).alias("_ck"), F.col(spec.age).alias("_cage"),
                        F.col(spec.league).alias("_clg"), *xs)
            .where(F.col("_ck").isNotNull() & F.col("pool").isNotNull())
            .withColumn("_d", F.dense_rank().over(Window.partitionBy(*alike).orderBy("_ck")))
            .where(F.col("_d") <= F.lit(int(kmax) + 1))
            .withColumn("_r", F.row_number().over(Window.partitionBy(*alike, "_ck").orderBy("_ck")))
            .where(F.col("_r") <= F.lit(int(kmax))).drop("_d", "_r"))
    core = _materialize(core)
    sides = []
    for j in range(1, nslot + 1):
        z = F.col(f"x{j}") / F.col(f"gs{j}")
        sides.append(F.when(F.abs(z) < F.lit(float("inf")), z).otherwise(F.lit(0.0)).alias(f"c{j}"))
    sized = core.join(geo, "pool").select(*core.columns, *sides)
    split = first_split(sized, "pool", cs, "_ck", size)
    placed = equi_depth(sized.withColumn("cell", split), ["pool"], cs, "_ck", size).drop(*cs)
    boxes = _materialize(placed.groupBy("pool", "cell").agg(
        *[e for x in xs for e in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))]))
    several = boxes.groupBy("pool").count().where(F.col("count") > 1).select("pool")
    # a row for about half of ``size`` candidates: pools of one cell are not among them
    known = Boxes(boxes.join(several, "pool").collect(), nslot)
    cands = placed.select("pool", "cell", "_ck", "_cage", "_clg", F.array(*xs).alias("x"))

    asked = q.where(F.col("ref_key").isNotNull() & (F.col("top_n") >= F.lit(1))).select(
        F.monotonically_increasing_id().alias("_q"), "query_id", "pool",
        F.col("ref_key").alias("_rk"),
        F.least(F.col("top_n"), F.lit(int(kmax))).cast("int").alias("top_n"),
        F.col("max_age").cast("double").alias("max_age"), "selected_leagues", "m",
        F.array(*[F.col(f"q{x}") for x in xs]).alias("qx"),
        F.array(*[F.col(f"k{j}") for j in range(1, nslot + 1)]).alias("k"))
    keys, wanted = ["pool", "cell"], ["_q", "query_id", "top_n", "_ck", "similarity_score"]
    if not known.pools:
        asked = _materialize(asked.join(boxes.select("pool", "cell"), "pool"))
    else:
        asked = _materialize(_mapped(asked, known))
    # as many tasks as keep the cores busy, and a cell sent to few of them
    busy = asked.count() // (3 * spark.sparkContext.defaultParallelism)
    block = max(1, min(MOST_QUERIES, max(BLOCK_QUERIES, busy), pair_budget // 30))
    at = asked.withColumn("r2", F.lit(None).cast("double"))
    if not known.pools:
        found = (group_top(cands, at.drop("query_id"), keys, block)
                 .join(asked.select("_q", "query_id", "top_n"), "_q").select(wanted))
    else:
        shared = spark.sparkContext.broadcast(known)
        cands = _materialize(cands)
        first = _materialize(group_top(cands, at, keys, block,
                                       onward=lambda asked, r2: shared.value.onward(asked, r2)))
        on = first.where(F.size("to") > 0).select(
            "_q", "query_id", "pool", "_rk", "top_n", "max_age", "selected_leagues", "m", "qx", "k", "r2",
            F.explode("to").alias("cell"))
        more = group_top(cands, on.drop("query_id"), keys, block)
        found = first.select("_q", "query_id", "top_n", F.inline("found")).select(wanted).unionByName(
            more.join(first.where(F.size("to") > 0).select("_q", "query_id", "top_n"), "_q").select(wanted))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col("_ck").asc())
    return (found.withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") <= F.lit(int(kmax))) & (F.col("rank") <= F.col("top_n")))
            .select("query_id", F.col("_ck").alias(spec.key), "similarity_score", "rank"))


def _mapped(asked: DataFrame, boxes: Boxes) -> DataFrame:
    """``asked`` with the nearest cell of every query."""
    shared = asked.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield shared.value.home(batch)

    return asked.mapInArrow(run, StructType([*asked.schema.fields, StructField("cell", StringType())]))


# ------------------------------------------------------------------ grid
GRID_DIMS = 3               # features a pool is gridded on (its heaviest)
EXHAUSTIVE_POOL = 4096      # pools up to this size are one cell
CELL_TARGET = 256           # mean candidates per cell of a gridded pool
MAX_BOX_CELLS = 512         # radius boxes above this go to the coarse grid
COARSE = 4                  # coarse cell = COARSE^D grid cells


def _grid_slot_table(dims: Dimensions) -> Column:
    """Per cohort, the 0-based slots of its GRID_DIMS heaviest features."""
    rows = []
    for _, fs in dims.role_metrics:
        order = sorted(range(len(fs)), key=lambda j: (-fs[j][1], j))[:GRID_DIMS]
        order += [order[-1]] * (GRID_DIMS - len(order))
        rows.append(F.array(*[F.lit(j) for j in order]))
    return F.array(*rows)


def _pick(prefix: str, nslot: int, idx: Column) -> Column:
    return F.array(*[F.col(f"{prefix}{j}") for j in range(1, nslot + 1)])[idx]


def _grid_top(spark, q: DataFrame, cand: DataFrame, moments: DataFrame, dims: Dimensions,
              spec: ProfileSpec, nslot: int, *, pair_budget: int, sample: int,
              exhaustive_pool: int, cell_target: int, max_box_cells: int, kmax: int,
              diagnostics: dict | None = None) -> DataFrame:
    """Exact top-k for every query without scoring all pairs of a pool.

    Each pool is gridded on the z-scores of its cohort's GRID_DIMS heaviest
    features (cell side ``h`` from the pool size; a pool of at most
    ``exhaustive_pool`` rows is one cell).  A candidate outside a box of
    cells differs from the query by more than the box margin in one grid
    feature, which alone bounds its distance from below.

    1. sample: every query is scored against a hash sample of ~``sample``
       rows of its pool; the k-th best sampled score is a lower bound of
       the true k-th best (ties kept), so lower scores are dropped early.
    2. neighbourhood: the query's cell and its 3^D neighbours (+ the
       sample) give a k-th best score t; every true twin scores >= t, i.e.
       lies within the radius R(t).  If the R-box around the query stays in
       the searched cells, this top-k is exact.
    3. box: other queries search all cells of their R-box (at most
       ``max_box_cells``), or else the same box on a COARSE-times coarser
       grid (nested cells, so it covers the fine box); the rest (no k
       candidates, or huge boxes) scan their whole pool.  Every step is
       exact, so is the union.

    Every join is keyed by (pool, cell, block); blocks split a (cell, query
    set) so one task scores at most ``pair_budget`` pairs.  In gridded
    pools, exact duplicate vectors collapse to the k+1 smallest keys per
    (vector, age, league), so a hot duplicate value is not a hot cell."""
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    xs = [f"x{j}" for j in range(1, nslot + 1)]
    best = (F.col("rank") <= F.lit(kmax)) & (F.col("rank") <= F.col("top_n"))
    gslots = _grid_slot_table(dims)
    D = GRID_DIMS
    gkeys = [f"t{d}" for d in range(1, D + 1)]

    geo = moments.select(
        "pool", "n",
        *[F.col(f"mu{j}").alias(f"gm{j}") for j in range(1, nslot + 1)],
        *[guarded_scale(F.col(f"sd{j}"), F.col(f"mu{j}")).alias(f"gs{j}")
          for j in range(1, nslot + 1)],
        F.when(F.col("n") > F.lit(exhaustive_pool),
               F.lit(6.0) / F.ceil(F.pow(F.col("n").cast("double") / F.lit(float(cell_target)),
                                         F.lit(1.0 / D)))).alias("_h"))
    gridded = geo.agg(F.max(F.col("_h").isNotNull().cast("int"))).first()[0] == 1

    def cells(prefix: str, out: str) -> list[Column]:
        """z-scores (pool moments) of the grid features and their cells."""
        cols = []
        for d in range(D):
            sl = gslots[F.col("cohort_idx")][d]
            z = (_pick(prefix, nslot, sl) - _pick("gm", nslot, sl)) / _pick("gs", nslot, sl)
            cols.append(z.alias(f"{out}z{d + 1}"))
        return cols

    def cell_ids(zprefix: str, out: str) -> list[Column]:
        return [F.when(F.col("_h").isNull(), F.lit(0)).otherwise(
                    F.floor(F.col(f"{zprefix}z{d}") / F.col("_h"))).cast("long").alias(f"{out}{d}")
                for d in range(1, D + 1)]

    # candidates: key, filter columns, slots, grid cells
    core = cand.select("pool", F.col(spec.key).alias("_ck"), F.col(spec.age).alias("_cage"),
                       F.col(spec.league).alias("_clg"), "cohort_idx", *xs)
    if gridded:
        core = (core.join(geo, "pool").select(*core.columns, "_h", *cells("x", "c"))
                .select("*", *cell_ids("c", "g")))
    else:   # every pool is one cell
        core = core.select("*", *[F.lit(0).cast("long").alias(f"g{d}") for d in range(1, D + 1)])
    if gridded:
        wd = Window.partitionBy("pool", *xs, "_cage", "_clg").orderBy("_ck")
        core = (core.withColumn("_dr", F.row_number().over(wd))
                .where(F.col("_dr") <= F.lit(int(kmax) + 1)).drop("_dr"))

    # queries: cells and the squared scale f_d of each grid feature
    qcols = ["pool", "query_id", "top_n", "max_age", "selected_leagues", "m", "_rk",
             *[f"q{x}" for x in xs], *[f"k{j}" for j in range(1, nslot + 1)]]
    qg = q.select(*[c for c in qcols if c != "_rk"], F.col("ref_key").alias("_rk"), "cohort_idx")
    if gridded:
        qg = qg.join(geo.drop("n"), "pool")
    fcols = []
    for d in range(D):
        sl = gslots[F.col("cohort_idx")][d]
        s = _pick("gs", nslot, sl)
        fcols.append((_pick("k", nslot, sl) * s * s).alias(f"f{d + 1}"))
    if gridded:
        qg = qg.select("*", *cells("qx", "q"), *fcols).select("*", *cell_ids("q", "qg"))
        qkeep = [*qcols, "_h", *[f"qz{d}" for d in range(1, D + 1)],
                 *[f"qg{d}" for d in range(1, D + 1)], *[f"f{d}" for d in range(1, D + 1)]]
    else:
        qg = qg.select("*", *[F.lit(0).cast("long").alias(f"qg{d}") for d in range(1, D + 1)])
        qkeep = [*qcols, *[f"qg{d}" for d in range(1, D + 1)]]
    qg = qg.select(*qkeep)

    cside = core.select("pool", "_ck", "_cage", "_clg", *xs,
                        *[F.col(f"g{d}") for d in range(1, D + 1)])

    def blocked(qside: DataFrame, cands: DataFrame, keys: list[str],
                thr: DataFrame | None = None) -> DataFrame:
        """Scored, filtered pairs of queries and candidates with equal keys;
        (keys, block) groups hold at most ~pair_budget pairs.  ``thr``
        (query_id, _thr) is joined after the blocks are sized, so the query
        side read for the sizes does not carry the threshold's lineage."""
        nq = qside.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq"))
        nc = cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("nc"))
        st = nq.join(nc, keys).withColumn("np", F.col("nq").cast("double") * F.col("nc"))
        total = st.agg(F.sum("np")).scalar()
        budget = F.greatest(F.lit(50_000.0),
                            F.least(F.lit(float(pair_budget)), total / F.lit(4.0 * nparts)))
        bl = st.select(*keys, F.least(F.col("nq"), F.greatest(
            F.lit(1), F.ceil(F.col("np") / budget))).cast("int").alias("nb"))
        qb = (qside.join(bl, keys)
              .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("nb")).cast("int"))
              .drop("nb"))
        if thr is not None:
            qb = qb.join(thr, "query_id", "left").fillna({"_thr": -1.0})
        qb = qb.repartition(nparts, *keys, "block")
        cb = (cands.join(bl, keys)
              .select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block"))
              .drop("nb").repartition(nparts, *keys, "block"))
        pairs = qb.join(cb, [*keys, "block"]).where(F.col("_ck") != F.col("_rk")).where(
            (F.col("max_age").isNull() | (F.col("_cage") <= F.col("max_age")))
            & (F.col("selected_leagues").isNull() | (F.size("selected_leagues") == 0)
               | F.array_contains(F.col("selected_leagues"), F.col("_clg"))))
        return pairs.withColumn("similarity_score", _score(nslot))

    def local_top(pairs: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
        # partitioned like the join (keys, block): WindowGroupLimit, no shuffle
        w = Window.partitionBy(*keys, "block", "query_id").orderBy(
            F.col("similarity_score").desc(), F.col("_ck").asc())
        return (pairs.select(*keys, "block", "query_id", "top_n", "_ck", "similarity_score",
                             *extra)
                .withColumn("rank", F.row_number().over(w)).where(best))

    def per_query_top(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(),
                                                  F.col("_ck").asc())
        return (rows.select("query_id", "top_n", "_ck", "similarity_score")
                .withColumn("rank", F.row_number().over(w)).where(best))

    # 1. sample threshold (and, in gridded pools, sampled rows outside the
    #    query's neighbourhood join the neighbourhood search)
    smp = (cside.join(geo.select("pool", "n"), "pool")
           .where(F.pmod(F.xxhash64("_ck"), F.col("n")) < F.lit(sample)).drop("n"))
    sp = local_top(blocked(qg, smp, ["pool"]), ["pool"],
                   [*[f"g{d}" for d in range(1, D + 1)], *[f"qg{d}" for d in range(1, D + 1)]])
    # keyed by pool alone, a query lies in one (pool, block): sp is per query
    thr = (sp.groupBy("query_id")
           .agg(F.min("similarity_score").alias("_t"), F.count(F.lit(1)).alias("_n"),
                F.first("top_n").alias("_k"))
           .select("query_id", F.when(F.col("_n") >= F.col("_k"), F.col("_t"))
                   .otherwise(F.lit(-1.0)).alias("_thr")))
    if gridded:
        thr = _materialize(thr)

    # 2. neighbourhood search
    offsets = [F.struct(*[F.lit(o[d]).alias(f"o{d + 1}") for d in range(D)])
               for o in itertools.product((-1, 0, 1), repeat=D)]
    zero = F.array(F.struct(*[F.lit(0).alias(f"o{d + 1}") for d in range(D)]))
    if gridded:
        qa = (qg.select("*", F.explode(F.when(F.col("_h").isNull(), zero)
                                       .otherwise(F.array(*offsets))).alias("_o"))
              .select("*", *[(F.col(f"qg{d}") + F.col(f"_o.o{d}")).alias(f"t{d}")
                             for d in range(1, D + 1)]).drop("_o"))
        ca = cside.select("*", *[F.col(f"g{d}").alias(f"t{d}") for d in range(1, D + 1)])
        akeys = ["pool", *gkeys]
    else:   # the neighbourhood is the pool
        qa, ca, akeys = qg, cside, ["pool"]
    # (coalesce: a null-tolerant predicate, so Catalyst does not infer and
    #  push isnotnull() copies of the whole score expression below the join)
    near = local_top(blocked(qa, ca, akeys, thr)
                     .where(F.coalesce(F.col("similarity_score"), F.lit(-1.0)) >= F.col("_thr")),
                     akeys)
    if not gridded:   # one (pool, block) per query: near is the answer
        return near.select("query_id", F.col("_ck").alias(spec.key), "similarity_score", "rank")

    outside = F.lit(False)
    for d in range(1, D + 1):
        outside = outside | (F.abs(F.col(f"g{d}") - F.col(f"qg{d}")) > F.lit(1))
    sampled_out = sp.where(outside)
    topa = _materialize(per_query_top(
        near.select("query_id", "top_n", "_ck", "similarity_score")
        .unionByName(sampled_out.select("query_id", "top_n", "_ck", "similarity_score"))))

    # resolution: radius of the k-th best score, box of cells it spans
    ka = topa.groupBy("query_id").agg(F.min("similarity_score").alias("_ta"),
                                      F.count(F.lit(1)).alias("_na"))
    qr = (qg.join(thr, "query_id", "left").fillna({"_thr": -1.0})
          .join(ka, "query_id", "left"))
    nsc = F.rint(F.col("_ta") * F.lit(100.0))
    ok = (F.coalesce(F.col("_na"), F.lit(0)) >= F.col("top_n")) & (nsc >= F.lit(1.0))
    r2 = (F.lit(-4.0) * F.col("m").cast("double") * F.log((nsc - F.lit(0.5)) / F.lit(1e4))
          * F.lit(1.0 + 1e-9) + F.lit(1e-9))
    qr = qr.select("*", ok.alias("_ok"), F.when(ok, r2).alias("_r2"),
                   # a k-th best of a subset also bounds the later searches
                   F.greatest(F.col("_thr"), F.when(
                       F.coalesce(F.col("_na"), F.lit(0)) >= F.col("top_n"), F.col("_ta"))
                       .otherwise(F.lit(-1.0))).alias("_thr2"))
    bounds = []
    for d in range(1, D + 1):
        hw = F.sqrt(F.col("_r2") / F.col(f"f{d}"))
        bounds += [F.floor((F.col(f"qz{d}") - hw) / F.col("_h")).cast("long").alias(f"lo{d}"),
                   F.floor((F.col(f"qz{d}") + hw) / F.col("_h")).cast("long").alias(f"hi{d}")]
    qr = qr.select("*", *bounds)
    inside = F.col("_ok")
    ncell = F.lit(1.0)
    for d in range(1, D + 1):
        inside = inside & (F.col(f"lo{d}") >= F.col(f"qg{d}") - 1) & (
            F.col(f"hi{d}") <= F.col(f"qg{d}") + 1)
        ncell = ncell * (F.col(f"hi{d}") - F.col(f"lo{d}") + 1).cast("double")
    cncell = F.lit(1.0)
    for d in range(1, D + 1):
        cncell = cncell * (F.floor(F.col(f"hi{d}") / F.lit(COARSE))
                           - F.floor(F.col(f"lo{d}") / F.lit(COARSE)) + 1).cast("double")
    qr = qr.withColumn("_stage", F.when(F.col("_h").isNull() | F.coalesce(inside, F.lit(False)),
                                        F.lit(1))
                       .when(F.col("_ok") & (ncell <= F.lit(float(max_box_cells))), F.lit(2))
                       .when(F.col("_ok") & (cncell <= F.lit(float(max_box_cells))), F.lit(3))
                       .otherwise(F.lit(4)))
    qr = _materialize(qr)
    if diagnostics is not None:   # per-query stage (1 near, 2 box, 3 coarse box, 4 scan)
        diagnostics["resolution"] = qr.select("query_id", "pool", "_stage")

    done_a = topa.join(qr.where(F.col("_stage") == 1).select("query_id"), "query_id", "left_semi")

    # 3a. box search
    qb = qr.where(F.col("_stage") == 2)
    for d in range(1, D + 1):
        qb = qb.select("*", F.explode(F.sequence(F.col(f"lo{d}"), F.col(f"hi{d}"))).alias(f"t{d}"))
    qb = qb.select(*qkeep, F.col("_thr2").alias("_thr"), *gkeys)
    box = per_query_top(local_top(
        blocked(qb, ca, akeys)
        .where(F.coalesce(F.col("similarity_score"), F.lit(-1.0)) >= F.col("_thr")), akeys))

    # 3b. the same box on a COARSE-times coarser grid (COARSE^D fewer cells)
    qk = qr.where(F.col("_stage") == 3)
    for d in range(1, D + 1):
        qk = qk.select("*", F.explode(F.sequence(
            F.floor(F.col(f"lo{d}") / F.lit(COARSE)).cast("long"),
            F.floor(F.col(f"hi{d}") / F.lit(COARSE)).cast("long"))).alias(f"t{d}"))
    qk = qk.select(*qkeep, F.col("_thr2").alias("_thr"), *gkeys)
    ck = cside.select("*", *[F.floor(F.col(f"g{d}") / F.lit(COARSE)).cast("long").alias(f"t{d}")
                             for d in range(1, D + 1)])
    coarse = per_query_top(local_top(
        blocked(qk, ck, akeys)
        .where(F.coalesce(F.col("similarity_score"), F.lit(-1.0)) >= F.col("_thr")), akeys))

    # 3c. whole-pool scan for the rest (no radius, or a huge coarse box)
    qc = qr.where(F.col("_stage") == 4).select(*qkeep, F.col("_thr2").alias("_thr"))
    scan = local_top(
        blocked(qc, cside, ["pool"])
        .where(F.coalesce(F.col("similarity_score"), F.lit(-1.0)) >= F.col("_thr")), ["pool"])

    cols = ["query_id", "top_n", "_ck", "similarity_score", "rank"]
    return (done_a.select(*cols).unionByName(box.select(*cols))
            .unionByName(coarse.select(*cols)).unionByName(scan.select(*cols))
            .select("query_id", F.col("_ck").alias(spec.key), "similarity_score", "rank"))



def _score(nslot: int) -> Column:
    """rint(exp(-d2 / (4 m)) * 100 * 100) / 100 with d2 = sum k_j (x_j - qx_j)^2."""
    d2 = None
    for j in range(1, nslot + 1):
        diff = F.col(f"x{j}") - F.col(f"qx{j}")
        term = F.col(f"k{j}") * diff * diff
        d2 = term if d2 is None else d2 + term
    gamma = F.lit(1.0) / (F.lit(4.0) * F.col("m").cast("double"))
    sim = F.exp(-gamma * d2) * F.lit(100.0)
    return F.rint(sim * F.lit(100.0)) / F.lit(100.0)


def with_metric_names(df: DataFrame, dims: Dimensions) -> DataFrame:
    """Add the cohort's ordered feature list (``metrics``) to twins output."""
    return df.withColumn("metrics", dims.feature_array(F.col("cohort_idx")))


def twins_display(twins_df: DataFrame, dims: Dimensions, spec: ProfileSpec) -> DataFrame:
    """Renamed display table with the first three active metrics."""
    coh = F.col("cohort_idx")
    return twins_df.select(
        F.col("reference").alias("Reference"),
        F.col(spec.name).alias("Player"), F.col(spec.team).alias("Club"),
        F.col(spec.league).alias("League"), F.col(spec.position).alias("Pos"),
        F.col(spec.role).alias("Tactical Role"), F.col(spec.age).alias("Age"),
        F.col("similarity_score").alias("Similarity (%)"), F.col("rank").alias("Rank"),
        *[c for j in range(3) for c in (
            dims.slot(coh, j, "feature").alias(f"Metric {j + 1}"),
            F.col(f"x{j + 1}").alias(f"Value {j + 1}"))])


def find_similar(profile: DataFrame, dims: Dimensions, spec: ProfileSpec, reference: str,
                 max_age: int | None = None, selected_leagues: list[str] | None = None,
                 strict_position: bool = False, top_n: int = 5,
                 require_match: bool = False) -> DataFrame:
    """Single-query convenience (C1).  ``require_match`` runs one tiny
    action and raises ValueError when the reference is unknown."""
    spark = profile.sparkSession
    q = spark.createDataFrame(
        [(reference, max_age, selected_leagues, bool(strict_position), int(top_n))],
        "reference string, max_age int, selected_leagues array<string>, "
        "strict_position boolean, top_n int")
    if require_match and unmatched(profile, q, spec).limit(1).count() > 0:
        raise ValueError(f"no profile row is named {reference!r}")
    return with_metric_names(
        twins(profile, dims, spec, q, strict_position=strict_position, few_queries=True), dims)

"""Best baskets by descent through trees of boxes.

Every limit of a scenario becomes a cost that must not pass a budget (floors
count negative), so a set of items is bounded by a box: its least costs and its
highest value.  ``basket_index`` cuts the items of every position into
equi-depth cells, drops items that another one of their cell dominates, and
builds over each cell a tree whose nodes are boxes and whose leaves are items.
The index is stored once and answers any number of scenarios.

``descend`` answers them all in one descent.  Its labels are tuples of nodes of
increasing positions, one for each member.  A label lives while the boxes' sums
keep all budgets and its highest value reaches the scenario's best known basket;
it starts with the positions' trees, a position at a time, the open slots at the
most favourable costs of the whole market.  A round replaces the nodes of every
label by their children, one member at a time, so labels die before they
multiply.  Every node carries two of its items, the most valuable and the
cheapest: where those of a label keep the budgets they are a basket, and its
value prunes the next round.  At the leaves the labels are baskets; a scenario
without one is infeasible, and boxes far from the items prove it.

A label is a row, so a scenario's labels are spread over the cluster like any
rows and no task sees all of them.  Two costs that work against each other in
the data (wages and passes, say) also bound a box by their scaled sum, which
proves what either alone cannot.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators.cells import equi_depth
from peerlens.session import stored

COSTS = {"fee": 1, "wage": 1, "age": 1, "prog": -1, "dfn": -1, "cre": -1}
CELL = 1 << 15          # items over which a task builds a tree
FANOUT = 8              # children of a node, a power of two
STRONG = 256            # items that the others of a cell are compared with, twice
CONFLICT = -0.3         # correlation below which two costs are also bounded together
TOL, VTOL = 1e-6, 1e-7  # of budgets, and of values when bounding
EQUAL = 1e-8            # values closer than this are not told apart by dominance


class BasketIndex(NamedTuple):
    """``edges``: a row per child (its parent, box and two items; a leaf is its
    own child); ``roots``: the trees of the positions; ``least``: the lowest
    costs; ``sums``: the pairs of costs bounded together, with their scales."""

    edges: DataFrame
    roots: DataFrame
    least: dict[str, float]
    sums: list[tuple[str, str, float, float]]
    depth: int

    def bounds(self) -> list[str]:
        return [*COSTS, *[f"{a}_{b}" for a, b, _, _ in self.sums]]


def _undominated(costs: np.ndarray, value: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows that no strong row dominates: no cost above, and a higher value or
    the same value and an earlier place (rows are in key order)."""
    strong = np.unique(np.concatenate([np.argsort(-value, kind="stable")[:STRONG],
                                       np.argsort(total, kind="stable")[:STRONG]]))
    keep = np.ones(len(value), bool)
    for i in range(0, len(value), 1024):
        row = slice(i, i + 1024)
        no_worse = (costs[strong][None] <= costs[row][:, None]).all(2)
        better = value[strong][None] > value[row, None] + EQUAL
        same = ((value[strong][None] == value[row, None])
                & (strong[None] < np.arange(len(value))[row, None]))
        keep[row] = ~(no_worse & (better | same)).any(1)
    return np.flatnonzero(keep)


def _parts(rows: np.ndarray, points: np.ndarray, n: int) -> list[np.ndarray]:
    """``rows`` cut into ``n`` parts (a power of two) at medians of the widest dimension."""
    if n == 1 or len(rows) == 1:
        return [rows]
    x = points[rows]
    by = rows[np.argsort(x[:, np.argmax(np.ptp(x, axis=0))], kind="stable")]
    return [p for half in (by[:len(by) // 2], by[len(by) // 2:]) for p in _parts(half, points, n // 2)]


def _tree(root: str, costs: np.ndarray, bounds: np.ndarray, value: np.ndarray, points: np.ndarray,
          prune: bool) -> dict[str, list]:
    """Columns of the nodes over a cell's items (in key order)."""
    total = points[:, :-1].sum(1)
    out: dict[str, list] = {c: [] for c in ("parent", "id", "level", "item", "leaf", "box", "top",
                                            "best", "cheap")}
    rows = _undominated(costs, value, total) if prune else np.arange(len(value))
    todo = [(None, root, 0, rows)]
    while todo:
        parent, name, level, rows = todo.pop()
        one = len(rows) == 1
        links = [parent] + [name] * one         # a leaf stays itself in later rounds
        best, cheap = rows[np.argmax(value[rows])], rows[np.argmin(total[rows])]
        for link in links:
            for c, x in (("parent", link), ("id", name), ("level", level), ("leaf", one),
                         ("item", int(rows[0]) if one else None), ("box", bounds[rows].min(0)),
                         ("top", value[rows].max()), ("best", int(best)), ("cheap", int(cheap))):
                out[c].append(x)
        if not one:
            todo += [(name, f"{name}.{k}", level + 1, p)
                     for k, p in enumerate(_parts(rows, points, FANOUT))]
    return out


def basket_index(items: DataFrame, prune: bool = True) -> BasketIndex:
    """The stored trees over ``items`` (key, pos, the six attributes, value)."""
    spark = items.sparkSession
    names = list(COSTS)
    costs = items.select("key", "pos", "value", *[(F.col(c) * F.lit(float(s))).alias(c)
                                                  for c, s in COSTS.items()])
    costs = stored(costs, "basket-costs")
    pairs = list(combinations(names, 2))
    stats = costs.agg(*[F.min(c).alias(f"lo_{c}") for c in names],
                      *[F.stddev_pop(c).alias(f"sd_{c}") for c in [*names, "value"]],
                      *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs]).first()
    scale = {c: stats[f"sd_{c}"] or 1.0 for c in [*names, "value"]}
    sums = [(a, b, scale[a], scale[b]) for a, b in pairs
            if (stats[f"cov_{a}_{b}"] or 0.0) / (scale[a] * scale[b]) < CONFLICT]
    bounds = [*names, *[f"{a}_{b}" for a, b, _, _ in sums]]
    cells = equi_depth(costs, ["pos"], [*names, "value"], "key", CELL)
    dealt = cells.withColumn("root", F.concat_ws("\x1f", F.col("pos").cast("string"), "cell"))

    key_type, pos_type = (items.schema[c].dataType.simpleString() for c in ("key", "pos"))
    item = ["key", *names, "value"]
    columns = (["parent", "id", "pos", "level", "leaf", *bounds, "top"]
               + [f"{w}_{c}" for w in ("best", "cheap") for c in [*names, "value"]] + ["key"])
    schema = ", ".join(f"`{c}` " + {"parent": "string", "id": "string", "level": "int", "leaf": "boolean",
                                    "pos": pos_type, "key": key_type}.get(c, "double") for c in columns)

    def grow(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        x = np.stack([part.column(c).to_numpy() for c in names], 1)
        value = part.column("value").to_numpy()
        both = [x[:, names.index(a)] / sa + x[:, names.index(b)] / sb for a, b, sa, sb in sums]
        points = np.concatenate([x, value[:, None]], 1) / np.array([scale[c] for c in [*names, "value"]])
        t = _tree(part.column("root")[0].as_py(), x, np.column_stack([x, *both]), value, points, prune)
        n, box = len(t["id"]), np.array(t["box"])
        data = {"parent": pa.array(t["parent"], pa.string()), "id": pa.array(t["id"], pa.string()),
                "pos": part.column("pos").combine_chunks().take(pa.array(np.zeros(n, np.int64))),
                "level": pa.array(t["level"], pa.int32()), "leaf": pa.array(t["leaf"], pa.bool_()),
                "top": pa.array(t["top"], pa.float64()),
                "key": part.column("key").combine_chunks().take(pa.array(t["item"], pa.int64()))}
        data |= {c: pa.array(box[:, k]) for k, c in enumerate(bounds)}
        for which in ("best", "cheap"):
            at = np.array(t[which])
            data |= {f"{which}_{c}": pa.array(x[at, k]) for k, c in enumerate(names)}
            data[f"{which}_value"] = pa.array(value[at])
        return pa.table({c: data[c] for c in columns})

    nodes = stored(dealt.select("root", "pos", *item).groupBy("root")
                   .applyInArrow(grow, schema), "basket-index")
    depth = nodes.agg(F.max("level")).first()[0] or 0
    return BasketIndex(nodes.where(F.col("parent").isNotNull()), nodes.where(F.col("parent").isNull()),
                       {c: stats[f"lo_{c}"] or 0.0 for c in names}, sums, depth)


def _budgets(scenarios: DataFrame, index: BasketIndex) -> DataFrame:
    """(sid, k, a budget per bound, the best known value) of the scenarios."""
    k = F.col("target_signings_count").cast("int")
    limits = {"fee": F.col("fee_budget_m"), "wage": F.col("wage_ceiling_k_pw"),
              "age": F.col("max_avg_age") * k, "prog": -F.col("min_prog_passes"),
              "dfn": -F.col("min_defensive_actions"), "cre": -F.col("min_creation_threat")}
    limits = {c: e.cast("double") + F.lit(TOL) for c, e in limits.items()}
    both = [(limits[a] / F.lit(sa) + limits[b] / F.lit(sb) + F.lit(VTOL)).alias(f"b_{a}_{b}")
            for a, b, sa, sb in index.sums]
    return scenarios.select(F.col("scenario_id").cast("string").alias("sid"), k.alias("k"),
                            *[e.alias(f"b_{c}") for c, e in limits.items()], *both,
                            F.lit(float("-inf")).alias("known"))


# Conditions over many columns are SQL text: one call to the JVM each.
NO_VALUE = "double('-Infinity')"
FOUND = [f"{w}_{c}" for w in ("best", "cheap") for c in [*COSTS, "value"]]


def _sum(name: str, members: range) -> str:
    return " + ".join(f"{name}_{j}" for j in members)


def _alive(bounds: list[str], members: int) -> str:
    """All budgets are kept by the boxes and the value may reach the best known."""
    return " AND ".join([f"{_sum('top', range(members))} >= known - {VTOL}D"]
                        + [f"{_sum(c, range(members))} <= b_{c}" for c in bounds])


def _start(budgets: DataFrame, index: BasketIndex, members: int) -> DataFrame:
    """Labels of the positions' trees.  Smaller baskets have empty first slots."""
    bounds = index.bounds()
    least = index.least | {f"{a}_{b}": index.least[a] / sa + index.least[b] / sb
                           for a, b, sa, sb in index.sums}
    labels = budgets.repartition("sid")
    pos = index.roots.schema["pos"].dataType.simpleString()
    for j in range(members):
        # for the sizes that fill this slot; a row per position, or per CELL of its items
        side = index.roots.selectExpr(f"explode(sequence({members - j}, {members})) AS k",
                                      f"id AS id_{j}", f"pos AS pos_{j}",
                                      *[f"{c} AS {c}_{j}" for c in (*bounds, "top")])
        later = f"pos_{j - 1} IS NULL OR pos_{j - 1} < pos_{j}" if j else "TRUE"
        grown = labels.join(F.broadcast(side), "k").where(later)
        pad = labels.where(f"k < {members - j}").selectExpr(
            "*", f"'' AS id_{j}", f"CAST(NULL AS {pos}) AS pos_{j}",
            *[f"0D AS {c}_{j}" for c in (*bounds, "top")])
        labels = grown.unionByName(pad).where(" AND ".join(
            f"{_sum(c, range(j + 1))} + least(k, {members - 1 - j}) * double('{least[c]!r}') <= b_{c}"
            for c in bounds))
    return labels.drop(*[f"pos_{j}" for j in range(members)])


def _down(labels: DataFrame, edges: DataFrame, index: BasketIndex, members: int) -> DataFrame:
    """Labels of the children, with the sums of their nodes' two items."""
    bounds = index.bounds()
    box = [*bounds, "top"]
    own = {f"{b}_{j}" for b in ["id", *box] for j in range(members)}
    kept = [c for c in labels.columns if c not in own and not c.startswith("sum_")]
    for j in range(members):
        side = edges.selectExpr(f"parent AS id_{j}", "id AS to", *[f"{c} AS to_{c}" for c in box + FOUND])
        others = [i for i in range(members) if i != j]
        # the boxes of this member's children, those of the others as they are
        labels = labels.join(side, f"id_{j}").selectExpr(
            *kept, *[f"id_{i}" for i in others], f"to AS id_{j}",
            *[f"{c}_{i}" for c in box for i in others], *[f"to_{c} AS {c}_{j}" for c in box],
            *[f"{f'sum_{c} + ' if j else ''}to_{c} AS sum_{c}" for c in FOUND]
        ).where(_alive(bounds, members))
    return labels


def _sure() -> str:
    """The value of the better of a label's two baskets."""
    def value(which: str) -> str:
        fits = " AND ".join(f"sum_{which}_{c} <= b_{c}" for c in COSTS)
        return f"IF({fits}, sum_{which}_value, {NO_VALUE})"
    return f"greatest({value('best')}, {value('cheap')})"


@contextmanager
def _as_written(spark: SparkSession) -> Iterator[None]:
    """Filters stay where they stand: the optimizer would derive further ones
    from every renamed sum, twice as many with each join."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def descend(index: BasketIndex, scenarios: DataFrame, members: int) -> DataFrame:
    """Leaf labels of every scenario with baskets of at most ``members``: all that
    reach its best value, and few others.  ``sure`` is a label's value, minus
    infinity if it is no basket."""
    spark, bounds = index.edges.sparkSession, index.bounds()
    columns = ["parent", "id", *bounds, "top", *FOUND]
    # an empty slot stays empty
    none = spark.range(1).selectExpr(*[f"{chr(39) * 2 if c in ('parent', 'id') else '0D'} AS {c}"
                                       for c in columns])
    edges = index.edges.select(columns).unionByName(none)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _as_written(spark):
        labels = _start(_budgets(scenarios, index), index, members)
        labels = stored(labels.selectExpr("*", f"{NO_VALUE} AS sure"), "basket-labels")
        for _ in range(max(1, index.depth)):
            known = labels.groupBy("sid").agg(F.greatest(F.max("sure"), F.max("known")).alias("now"))
            labels = (labels.join(known, "sid").drop("sure", "known").withColumnRenamed("now", "known")
                      .where(_alive(bounds, members))
                      .repartition(spread, "sid", *[f"id_{j}" for j in range(members)]))
            labels = _down(labels, edges, index, members)
            kept = [c for c in labels.columns if not c.startswith("sum_")]
            labels = stored(labels.selectExpr(*kept, f"{_sure()} AS sure"), "basket-labels")
        return labels


def best_labels(index: BasketIndex, labels: DataFrame, members: int) -> DataFrame:
    """(sid, keys, total_value, total_fee, total_wage) of every scenario's best
    basket: the highest value, to nine digits, then the smallest sorted keys."""
    baskets = labels.where(f"sure > {NO_VALUE}").selectExpr(
        "sid", "rint(sure * 1e9D) AS value_r",
        f"array({', '.join(f'id_{j}' for j in range(members))}) AS ids", "sure AS total_value",
        f"{_sum('fee', range(members))} AS total_fee", f"{_sum('wage', range(members))} AS total_wage")
    top = baskets.groupBy("sid").agg(F.max("value_r").alias("value_r"))
    tied = stored(baskets.join(top, ["sid", "value_r"]), "basket-best")
    leaves = index.edges.where("leaf AND parent = id").select("id", "key")
    named = (tied.withColumn("id", F.explode("ids")).where("id != ''").join(leaves, "id")
             .groupBy("sid", "ids").agg(F.sort_array(F.collect_list("key")).alias("keys"),
                                        *[F.first(c).alias(c) for c in
                                          ("total_value", "total_fee", "total_wage")]))
    # of equal values the smallest keys
    return named.groupBy("sid").agg(F.min(F.struct("keys", "total_value", "total_fee", "total_wage"))
                                    .alias("b")).select("sid", "b.*")

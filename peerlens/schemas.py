"""Fixed schemas and column-role specs.

Operators never hard-code column names: a ``ProfileSpec`` names the key,
position, league, ... columns of the profile table, a ``BasketSpec`` names
the money / workload columns used by the basket operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ProfileSpec:
    key: str = "player_name"          # unique entity key
    name: str = "player_name"         # matched case-insensitively by lookups
    position: str = "position"
    league: str = "league"
    role: str = "primary_role"
    team: str = "team"
    age: str = "age"
    minutes: str = "minutes_played"

    def display(self) -> list[str]:
        cols = [self.key, self.name, self.team, self.league, self.position,
                self.role, self.age]
        out: list[str] = []
        for c in cols:
            if c not in out:
                out.append(c)
        return out


@dataclass(frozen=True)
class BasketSpec:
    """Columns of the market table used by value / basket operators."""
    fee: str = "market_value_eur_m"
    wage: str = "wage_gbp_k_pw"
    prog: str = "progressive_passes_per90"
    defence: str = "tackles_interceptions_per90"
    creation_a: str = "xag_per90"
    creation_b: str = "npxg_per90"
    resale: str = "resale_potential_multiplier"
    contract: str = "contract_years_left"


FOOTBALL_SPEC = ProfileSpec()
FOOTBALL_BASKET = BasketSpec()

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

SCOUTING_METRICS = [
    "psxg_net_per90", "cross_stop_pct", "def_actions_outside_pen_per90",
    "pass_launch_pct", "progressive_passes_per90",
    "progressive_pass_distance_per90", "progressive_carries_per90",
    "passes_into_final_third_per90", "passes_under_pressure_per90",
    "pass_completion_pct", "tackles_interceptions_per90",
    "aerial_duels_won_pct", "npxg_per90", "xag_per90",
    "touches_att_pen_per90", "take_on_success_pct",
]

SCOUTING_MASTER = T.StructType(
    [T.StructField(c, _S) for c in
     ("player_name", "team", "league", "position", "primary_role")]
    + [T.StructField("age", _I), T.StructField("minutes_played", _I)]
    + [T.StructField(c, _D) for c in SCOUTING_METRICS]
)

MARKET_COLUMNS = [
    T.StructField("market_value_eur_m", _D),
    T.StructField("wage_gbp_k_pw", _D),
    T.StructField("contract_years_left", _I),
    T.StructField("resale_potential_multiplier", _D),
]

TRANSFER_MARKET = T.StructType(list(SCOUTING_MASTER.fields) + MARKET_COLUMNS)

DEFENDER_METRICS = [
    "progressive_passes_per90", "progressive_pass_distance_per90",
    "progressive_carries_per90", "passes_into_final_third_per90",
    "pass_completion_pct_medium", "pass_completion_pct_long",
    "passes_under_pressure_per90", "aerial_duels_won_pct",
]

SCOUTING_DEFENDERS = T.StructType(
    [T.StructField(c, _S) for c in ("player_name", "team", "league")]
    + [T.StructField("age", _I), T.StructField("minutes_played", _I)]
    + [T.StructField(c, _D) for c in DEFENDER_METRICS]
    + [T.StructField("tackles_per90", _D), T.StructField("interceptions_per90", _D)]
)

SCENARIO = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("fee_budget_m", _D),
    T.StructField("wage_ceiling_k_pw", _D),
    T.StructField("target_signings_count", _I),
    T.StructField("max_avg_age", _D),
    T.StructField("min_prog_passes", _D),
    T.StructField("min_defensive_actions", _D),
    T.StructField("min_creation_threat", _D),
])

TWIN_QUERY = T.StructType([
    T.StructField("reference", _S),
    T.StructField("max_age", _I),
    T.StructField("selected_leagues", T.ArrayType(_S)),
    T.StructField("strict_position", T.BooleanType()),
    T.StructField("top_n", _I),
])

# Function defaults of the basket question (fixed values).
SCENARIO_DEFAULTS = dict(
    fee_budget_m=95.0, wage_ceiling_k_pw=180.0, target_signings_count=2,
    max_avg_age=24.0, min_prog_passes=10.0, min_defensive_actions=5.0,
    min_creation_threat=0.60,
)

"""The opt-in stochastic tier for statistics of a match: missing cells drawn from hashes of keys, by position.

A cell's draw depends on the row's key, the column and a seed alone, so it is the
same on any cluster and in any order. Observed cells are never drawn; counts that
are known from events take precedence over draws. ``generated`` lists, for each
row, the columns that were drawn. Everything is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import clip, clip_round, safe_div
from statloom.operators.impute import binomial, normal, poisson, uniform

# The ranges a count is drawn from evenly, and how probable each range is by position group.
GOALS = ((0, 0), (1, 1), (2, 2), (3, 5))
FEW = ((0, 0), (1, 3), (4, 7))
FOULS = ((0, 0), (1, 2), (3, 5))
DRAWS: dict[str, tuple[tuple[tuple[int, int], ...], dict[str, tuple[float, ...]]]] = {
    "goals": (GOALS, {"GK": (0.997, 0.003, 0.0, 0.0), "DEF": (0.93, 0.06, 0.009, 0.001), "MID": (0.82, 0.14, 0.035, 0.005), "FW": (0.65, 0.25, 0.08, 0.02), "UNK": (0.75, 0.18, 0.05, 0.02)}),
    "assists": (GOALS, {"GK": (0.995, 0.005, 0.0, 0.0), "DEF": (0.90, 0.085, 0.014, 0.001), "MID": (0.76, 0.18, 0.05, 0.01), "FW": (0.78, 0.16, 0.05, 0.01), "UNK": (0.80, 0.15, 0.04, 0.01)}),
    "shots": (GOALS, {"GK": (0.995, 0.005, 0.0, 0.0), "DEF": (0.62, 0.25, 0.10, 0.03), "MID": (0.38, 0.31, 0.21, 0.10), "FW": (0.18, 0.32, 0.29, 0.21), "UNK": (0.40, 0.30, 0.20, 0.10)}),
    "crosses_attempted": (FEW, {"GK": (0.995, 0.005, 0.0), "DEF": (0.62, 0.27, 0.11), "MID": (0.58, 0.30, 0.12), "FW": (0.64, 0.25, 0.11), "UNK": (0.70, 0.20, 0.10)}),
    "dribbles": (FEW, {"GK": (0.98, 0.02, 0.0), "DEF": (0.68, 0.25, 0.07), "MID": (0.45, 0.34, 0.21), "FW": (0.32, 0.38, 0.30), "UNK": (0.50, 0.30, 0.20)}),
    "offsides": (FEW, {"GK": (1.0, 0.0, 0.0), "DEF": (0.96, 0.035, 0.005), "MID": (0.86, 0.11, 0.03), "FW": (0.68, 0.23, 0.09), "UNK": (0.80, 0.15, 0.05)}),
    "interceptions": (FEW, {"GK": (0.88, 0.11, 0.01), "DEF": (0.35, 0.43, 0.22), "MID": (0.43, 0.41, 0.16), "FW": (0.68, 0.27, 0.05), "UNK": (0.50, 0.35, 0.15)}),
    "clearances": (FEW, {"GK": (0.75, 0.22, 0.03), "DEF": (0.28, 0.47, 0.25), "MID": (0.62, 0.31, 0.07), "FW": (0.82, 0.16, 0.02), "UNK": (0.60, 0.30, 0.10)}),
    "tackles": (FEW, {"GK": (0.94, 0.055, 0.005), "DEF": (0.24, 0.48, 0.28), "MID": (0.30, 0.48, 0.22), "FW": (0.58, 0.34, 0.08), "UNK": (0.40, 0.40, 0.20)}),
    "fouls_committed": (FOULS, {"GK": (0.82, 0.17, 0.01), "DEF": (0.24, 0.52, 0.24), "MID": (0.28, 0.52, 0.20), "FW": (0.34, 0.50, 0.16), "UNK": (0.30, 0.50, 0.20)}),
    "fouls_suffered": (FOULS, {"GK": (0.90, 0.095, 0.005), "DEF": (0.42, 0.45, 0.13), "MID": (0.32, 0.50, 0.18), "FW": (0.22, 0.52, 0.26), "UNK": (0.30, 0.50, 0.20)}),
    "passes_attempted": (((5, 19), (20, 50), (51, 95)), {"GK": (0.10, 0.60, 0.30), "DEF": (0.06, 0.60, 0.34), "MID": (0.03, 0.60, 0.37), "FW": (0.15, 0.60, 0.25), "UNK": (0.10, 0.60, 0.30)}),
}
MINUTES = ((1, 15), (15, 45), (45, 90), (90, 120)), {"UNK": (0.05, 0.10, 0.75, 0.10)}
# Fixed values, by position group: accuracy of passes, factor of cards, metres a minute, top speed.
ACCURACY = {"GK": 0.72, "DEF": 0.84, "MID": 0.82, "FW": 0.76, "UNK": 0.79}
CARDS = {"GK": 0.55, "DEF": 1.25, "MID": 1.05, "FW": 0.75, "UNK": 1.0}
METRES = {"GK": 70, "DEF": 105, "MID": 120, "FW": 110, "UNK": 108}
SPEED = {"GK": 30.5, "DEF": 32.0, "MID": 33.0, "FW": 34.5, "UNK": 32.5}


def by_group(group: Column, values: dict[str, float]) -> Column:
    out = F.lit(float(values["UNK"]))
    for g, v in values.items():
        out = F.when(group == g, float(v)).otherwise(out)
    return out


def draw(group: Column, ranges: tuple, chances: dict[str, tuple[float, ...]], seed: int, *keys: Column) -> Column:
    """A whole number: the range by the group's chances, the number evenly within it."""
    u, within = uniform(seed, *keys), uniform(seed + 1, *keys)
    pick = [(low + F.floor(within * (high - low + 1))).cast("long") for low, high in ranges]

    def own(p: tuple[float, ...]) -> Column:
        out = pick[-1]
        for i in reversed(range(len(ranges) - 1)):
            out = F.when(u < sum(p[: i + 1]), pick[i]).otherwise(out)
        return out

    out = own(chances["UNK"])
    for g, p in chances.items():
        out = F.when(group == g, own(p)).otherwise(out) if g != "UNK" else out
    return out


def minutes(group: Column, seed: int, *keys: Column) -> Column:
    """Minutes from four ranges; keepers and defenders play 70 to 95 at least."""
    m = draw(group, *MINUTES, seed, *keys)
    floor = (70 + F.floor(uniform(seed + 2, *keys) * 26)).cast("long")
    return F.when(group.isin("GK", "DEF"), F.greatest(m, floor)).otherwise(m)


def distance(played: Column, group: Column, age: Column) -> Column:
    """Metres: minutes by the position's pace and a factor of age, within bounds that depend on the minutes."""
    factor = clip(1 - F.abs(age - 27) * 0.006, 0.82, 1.06)
    d = played * by_group(group, METRES) * factor
    return clip_round(F.when(played < 45, clip(d, 1000, 6000)).otherwise(clip(d, 5000, 13000)), 600, 13000)


def top_speed(group: Column, age: Column, weight: Column, seed: int, *keys: Column) -> Column:
    raw = by_group(group, SPEED) - 0.1 * (age - 20) - 0.05 * (weight - 75) + normal(seed, F.lit(0.0), F.lit(0.9), *keys)
    return clip_round(raw, 25, 36, whole=False)


def touches(*actions: str) -> Column:
    """1.4 times the passes and all other actions, half to even."""
    return F.rint(sum((F.coalesce(a, F.lit(0)) for a in actions), F.coalesce("passes_attempted", F.lit(0)) * 1.4)).cast("long")


def observed_counts(goals: DataFrame) -> DataFrame:
    """(player_id, match_id, observed_goals, observed_assists) of goal events; NULL where none is known."""
    g = goals.filter(F.lower("event_type") == "goal")
    made = g.groupBy("player_id", "match_id").agg(F.count(F.lit(1)).alias("observed_goals"))
    given = g.filter("assist_player_id is not null").groupBy(F.col("assist_player_id").alias("player_id"), "match_id").agg(F.count(F.lit(1)).alias("observed_assists"))
    return made.join(given, ["player_id", "match_id"], "full").filter("player_id is not null and match_id is not null")


def generate_match_stats(df: DataFrame, key: str = "row_id", seed: int = 20260504) -> DataFrame:
    """``df`` (statistics with position_group, age, weight_kg, observed_goals, observed_assists) with its missing cells drawn.

    Later draws depend on earlier values, drawn or observed: shots are at least the
    goals, shots on target at most the shots, and so on. Unknown positions are UNK, ages 26, weights 75.
    """
    k, kinds = F.col(key), dict(df.dtypes)
    group = F.when(F.col("position_group").isin(*ACCURACY), F.col("position_group")).otherwise("UNK")
    age, weight = F.coalesce("age", F.lit(26)), F.coalesce("weight_kg", F.lit(75.0))
    out = df.withColumn("generated", F.array().cast("array<string>"))
    at = 0

    def put(c: str, value: Column) -> None:
        nonlocal out
        kind = kinds[c]
        gap = F.col(c).isNull() | F.isnan(c) if kind == "double" else F.col(c).isNull()
        out = out.withColumns({"generated": F.when(gap, F.array_append("generated", F.lit(c))).otherwise(F.col("generated")), c: F.when(gap, value.cast(kind)).otherwise(F.col(c))})

    def counted(c: str) -> Column:
        nonlocal at
        at += 100
        return draw(group, *DRAWS[c], seed + at, k)

    def some(n: Column, p: float, most: int) -> Column:
        nonlocal at
        at += 100
        return binomial(seed + at, n, p, most, k)

    put("minutes_played", minutes(group, seed, k))
    put("goals", F.coalesce("observed_goals", counted("goals")))
    put("assists", F.coalesce("observed_assists", counted("assists")))
    put("shots", F.greatest(counted("shots"), F.col("goals")))
    put("shots_on_target", F.least(F.col("shots"), F.greatest(F.col("goals"), some(F.col("shots"), 0.38, 12))))
    rest = F.greatest(F.col("shots") - F.col("shots_on_target"), F.lit(0))
    put("shots_blocked", F.least(rest, some(rest, 0.22, 12)))
    put("shots_off_target", F.greatest(F.col("shots") - F.col("shots_on_target") - F.col("shots_blocked"), F.lit(0)))
    put("passes_attempted", counted("passes_attempted"))
    at += 100
    share = clip(normal(seed + at, by_group(group, ACCURACY), F.lit(0.07), k), 0.45, 0.97)
    put("passes_completed", F.least(F.col("passes_attempted"), F.rint(F.col("passes_attempted") * share).cast("long")))
    put("pass_accuracy", F.round(F.coalesce(safe_div(F.greatest("passes_completed", F.lit(0)), F.greatest("passes_attempted", F.lit(0))), F.lit(0.0)), 4))
    put("crosses_attempted", counted("crosses_attempted"))
    put("crosses_completed", F.least(F.col("crosses_attempted"), some(F.col("crosses_attempted"), 0.28, 8)))
    for c in ("dribbles", "offsides", "interceptions", "clearances", "tackles"):
        put(c, counted(c))
    put("tackles_won", F.least(F.col("tackles"), some(F.col("tackles"), 0.58, 8)))
    put("tackles_lost", F.greatest(F.col("tackles") - F.col("tackles_won"), F.lit(0)))
    put("fouls_committed", counted("fouls_committed"))
    put("fouls_suffered", counted("fouls_suffered"))
    at += 100
    chance = clip(F.col("fouls_committed") / 4 * 0.18 * by_group(group, CARDS), 0.01, 0.60)
    put("yellow_cards", (uniform(seed + at, k) < chance).cast("int") + (uniform(seed + at + 1, k) < 0.01).cast("int"))
    put("red_cards", (uniform(seed + at + 2, k) < F.when(group == "DEF", 0.013).otherwise(0.007)).cast("int"))
    put("distance_covered", distance(F.greatest("minutes_played", F.lit(1)), group, age))
    put("top_speed", top_speed(group, age, weight, seed + at + 3, k))
    put("touches", touches("shots", "dribbles", "tackles", "interceptions", "clearances", "crosses_attempted"))
    return out


def generate_keeper_stats(df: DataFrame, conceded: Column, *keys: Column, seed: int = 20260507) -> DataFrame:
    """``df`` with saves, penalty_saves and punches of keepers drawn from the goals conceded."""
    u = uniform(seed + 2, *keys)
    few, many = 1 + F.floor(uniform(seed + 3, *keys) * 2), 3 + F.floor(uniform(seed + 3, *keys) * 3)
    return df.withColumns({
        "saves": poisson(uniform(seed, *keys), clip(conceded + 2.2, 0.8, 8.0), 30).cast("long"),
        "penalty_saves": (uniform(seed + 1, *keys) < 0.05).cast("long"),
        "punches": F.when(u < 0.70, 0).when(u < 0.95, few).otherwise(many).cast("long"),
    })

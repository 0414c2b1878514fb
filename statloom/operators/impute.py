"""Rule-based imputation with a change log, and an opt-in stochastic tier.

Observed values are never overwritten. The stochastic tier draws from hashes of
keys, so a cell's draw is the same on any cluster; it is marked as generated.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import finite, is_missing, null_if_missing
from statloom.functions.text import clip, country_region, safe_div, season_start_year, slug
from statloom.session import durable, release, salted_join


def hard_normalise(df: DataFrame, counts: list[str]) -> DataFrame:
    """Negative counts and impossible pairs to NULL, accuracies above one as per cent. Rules follow one another."""
    out = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in counts if c in df.columns})
    if "pass_accuracy" in df.columns:
        a = finite(F.col("pass_accuracy"))
        a = F.when(a > 1, a / 100).otherwise(a)
        out = out.withColumn("pass_accuracy", F.when(a.between(0, 1), a))
    for part, whole in (("passes_completed", "passes_attempted"), ("shots_on_target", "shots"), ("tackles_won", "tackles")):
        if part in df.columns and whole in df.columns:
            bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
            out = out.withColumns({part: F.when(~bad, F.col(part)), whole: F.when(~bad, F.col(whole))})
    return out


def formula_fills() -> dict[str, tuple[Column, str]]:
    """Column: (its formula, the reason that is logged)."""
    touches = ("passes_attempted", "shots", "dribbles", "tackles", "interceptions", "clearances")
    known = F.coalesce(*[F.col(c) for c in touches])
    return {
        "shots_off_target": (F.greatest(F.col("shots") - F.col("shots_on_target") - F.coalesce("shots_blocked", F.lit(0)), F.when(F.col("shots").isNotNull() & F.col("shots_on_target").isNotNull(), 0)), "shots less those on target and blocked"),
        "pass_accuracy": (F.round(safe_div(F.col("passes_completed"), F.col("passes_attempted")), 4), "completed by attempted"),
        "tackles_lost": (F.when(F.col("tackles") >= F.col("tackles_won"), F.col("tackles") - F.col("tackles_won")), "tackles less those won"),
        "touches": (F.when(known.isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in touches[1:]), F.coalesce(touches[0], F.lit(0)))), "sum of known actions"),
    }


def fill_missing(df: DataFrame, fills: dict[str, tuple[Column, str]]) -> DataFrame:
    """Missing cells filled by formula, with ``<column>_reason`` where one was."""
    out = df
    for c, (value, reason) in fills.items():
        kind = dict(df.dtypes)[c]
        gap = F.col(c).isNull() | F.isnan(c) if kind == "double" else F.col(c).isNull()
        filled = gap & value.isNotNull()
        out = out.withColumns({f"{c}_reason": F.when(filled, reason), c: F.when(filled, value.cast(kind)).otherwise(F.col(c))})
    return out


def change_log(filled: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, value, reason): one row for each filled cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"), F.col(f"{c}_reason").alias("reason")) for c in columns])
    return filled.select(key, F.explode(cells).alias("x")).filter("x.reason is not null").select(key, "x.*")


def per90_cascade(df: DataFrame, column: str, levels: list[list[str]], minutes: str = "minutes_played", context: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """``df`` with ``<column>_cascade``: the cell, else the median rate per 90 of the first level that has one, times minutes.

    levels: grouping columns from the narrowest to the widest ([] is all rows);
    ``context`` has, for those that ``df`` lacks, what adds them. Medians are
    exact. Those of all levels but the narrowest come from counts of equal rates,
    which are materialised: a row for each different rate of a group, however many
    rows have it. Only rows with a gap look medians up.
    """
    name = f"{column}_cascade"
    known, gaps = df.filter(F.col(column).isNotNull()), df.filter(F.col(column).isNull())
    r = safe_div(F.col(column) * 90, F.when(F.col(minutes) > 0, F.col(minutes)))

    def having(x: DataFrame, needed: list[str]) -> DataFrame:
        return reduce(lambda y, c: context[c](y), [c for c in needed if c in (context or {})], x)

    def keyed(x: DataFrame, level: list[str]) -> DataFrame:
        return x.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in level])) if level else x

    def rates(needed: list[str]) -> DataFrame:
        return having(known.withColumn("_r", r).filter("_r is not null"), needed).select(*needed, "_r")

    wide = list(dict.fromkeys(c for level in levels[1:] for c in level))
    counts = durable(rates(wide).groupBy(*wide, "_r").agg(F.count(F.lit(1)).alias("_n"))) if levels[1:] else None
    if counts is not None:
        release(counts)
    gaps = having(gaps, list(dict.fromkeys(c for level in levels for c in level)))
    for i, level in enumerate(levels):
        if i:
            m = keyed(counts, level).groupBy(*level).agg(F.percentile("_r", 0.5, F.col("_n")).alias(f"_m{i}"))
        else:
            own = keyed(rates(level), level)
            m = (own.repartition(*level) if level else own).groupBy(*level).agg(F.median("_r").alias("_m0"))
        gaps = gaps.join(m, level, "left") if level else gaps.crossJoin(F.broadcast(m))  # one row
    fill = F.rint(F.coalesce(*[f"_m{i}" for i in range(len(levels))]) * F.col(minutes) / 90).cast("long")
    filled = gaps.withColumn(name, F.coalesce(column, fill)).select(*df.columns, name)
    return known.withColumn(name, F.coalesce(column, F.lit(None).cast("long"))).unionByName(filled)


def per90_medians(df: DataFrame, columns: list[str], level: list[str], minutes: str = "minutes_played") -> DataFrame:
    """Missing cells of many columns from the median rates per 90 of their group, times minutes: one aggregation and one lookup for all."""
    played = F.when(F.col(minutes) > 0, F.col(minutes))
    mid = df.groupBy(*level).agg(*[F.median(safe_div(F.col(c) * 90, played)).alias(f"_m_{c}") for c in columns])
    out = salted_join(df, mid.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in level])), level, df.columns[0], "left")
    return out.withColumns({c: F.coalesce(c, F.rint(F.col(f"_m_{c}") * F.col(minutes) / 90).cast("long")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def lower_bound(whole: Column, part: Column) -> Column:
    """The whole, at least its part; the part where the whole is missing."""
    return F.when(whole.isNull(), part).otherwise(whole)


def possession_complement(home: Column, away: Column) -> tuple[Column, Column]:
    """A missing side is one less the other; zero on both sides is missing on both."""
    none = F.coalesce((home == 0) & (away == 0), F.lit(False))
    h, a = F.when(~none, home), F.when(~none, away)
    return F.round(F.coalesce(h, 1 - a), 4), F.round(F.coalesce(a, 1 - h), 4)


def neighbour_means(df: DataFrame, partition: list[str], order: list[str], column: str) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order)
    return (F.lag(column).over(w) + F.lead(column).over(w)) / 2


# --- fills from other tables and rows


def prior_fill(df: DataFrame, key: Column, prior: DataFrame, prior_key: Column, order: list[Column], columns: dict[str, str], reason: str = "same name in the prior") -> DataFrame:
    """Missing cells from the first prior row of the same key, with ``<column>_reason``.

    columns: column of ``df`` to column of ``prior``. Rows without a key keep their gaps.
    """
    w = Window.partitionBy("_k").orderBy(*order)
    first = prior.select("*", prior_key.alias("_k")).filter("_k <> ''").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    first = first.select("_k", *[F.col(src).alias(f"_p_{c}") for c, src in columns.items()])
    out = salted_join(df.withColumn("_k", key), first, ["_k"], df.columns[0], "left")
    for c in columns:
        gap = _gap(df, c) & F.col(f"_p_{c}").isNotNull()
        out = out.withColumns({f"{c}_reason": F.when(gap, reason), c: F.when(gap, F.col(f"_p_{c}").cast(dict(df.dtypes)[c])).otherwise(F.col(c))})
    return out.drop("_k", *[f"_p_{c}" for c in columns])


def _gap(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return is_missing(F.col(c)) if kind == "string" else F.col(c).isNull() | F.isnan(c) if kind == "double" else F.col(c).isNull()


def donor_fill(df: DataFrame, key: Column, column: str, order: Column) -> DataFrame:
    """A missing cell from the last row, by ``order``, of the same key that has one; ``<column>_reason`` says so."""
    has = df.filter(~_gap(df, column) & (key != "")).groupBy(key.alias("_k")).agg(F.max_by(column, order).alias("_donor"))
    out = salted_join(df.withColumn("_k", key), has, ["_k"], df.columns[0], "left")
    gap = _gap(df, column) & F.col("_donor").isNotNull()
    return out.withColumns({f"{column}_reason": F.when(gap, "a row of the same name"), column: F.when(gap, F.col("_donor")).otherwise(F.col(column))}).drop("_k", "_donor")


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers from the column's median over all rows, rounded for whole columns; one row is broadcast."""
    mid = df.agg(*[F.median(F.when(~_gap(df, c), F.col(c))).alias(f"_m_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(mid))
    for c in columns:
        whole = dict(df.dtypes)[c] != "double"
        out = out.withColumn(c, F.when(_gap(df, c), (F.rint(f"_m_{c}") if whole else F.col(f"_m_{c}")).cast(dict(df.dtypes)[c])).otherwise(F.col(c)))
    return out.drop(*[f"_m_{c}" for c in columns])


def season_totals(df: DataFrame, prior: DataFrame, order: list[Column], fields: dict[str, str]) -> DataFrame:
    """Season statistics (player_key, position_group) filled step by step, with ``<column>_reason``.

    Lower bounds first (attempted passes from completed ones, shots from those on
    target), then the prior row of the same name, then the prior's median of the
    position or else of all, rounded. prior: player_key, position_group and the fields' sources.
    """
    out = df.withColumns({f"{c}_reason": F.lit(None).cast("string") for c in dict.fromkeys([*fields, "passes_attempted", "shots"])})
    for whole, part in (("passes_attempted", "passes_completed"), ("shots", "shots_on_target")):
        gap = F.col(whole).isNull() & F.col(part).isNotNull()
        out = out.withColumns({f"{whole}_reason": F.when(gap, "lower bound"), whole: F.coalesce(whole, part)})
    was = {c: f"{c}_reason" for c in fields}
    out = prior_fill(out.withColumnsRenamed({r: f"_{r}" for r in was.values()}), F.col("player_key"), prior, F.col("player_key"), order, fields)
    groups = prior.groupBy("position_group").agg(*[F.median(src).alias(f"_g_{c}") for c, src in fields.items()]).filter("position_group is not null")
    total = prior.agg(*[F.median(src).alias(f"_t_{c}") for c, src in fields.items()])
    out = out.join(groups, "position_group", "left").crossJoin(F.broadcast(total))  # a row a position, and one row
    for c in fields:
        value = F.rint(F.coalesce(f"_g_{c}", f"_t_{c}")).cast("long")
        gap = F.col(c).isNull() & value.isNotNull()
        out = out.withColumns({f"{c}_reason": F.coalesce(f"_{c}_reason", f"{c}_reason", F.when(gap, "median of the position")), c: F.coalesce(c, value)})
    return out.drop(*[f"_{r}" for r in was.values()], *[f"_{x}_{c}" for x in "gt" for c in fields])


def goal_rows(goals: DataFrame, players: DataFrame) -> DataFrame:
    """Goal events with their gaps filled: name of the player, event type, goal type, and the two flags from the goal type.

    players: one row a player_id.
    """
    names = players.select("player_id", F.col("player_name").alias("_name")).filter(~is_missing(F.col("_name")))
    kind = F.coalesce(null_if_missing(F.col("goal_type")), F.lit("regular"))
    x = salted_join(goals, names, ["player_id"], "row_id", "left")
    return x.withColumns({
        "player_name": F.coalesce(null_if_missing(F.col("player_name")), F.col("_name")),
        "event_type": F.coalesce(null_if_missing(F.col("event_type")), F.lit("goal")),
        "goal_type": kind,
        "is_penalty": F.coalesce("is_penalty", F.lower(kind).contains("penalty")),
        "is_own_goal": F.coalesce("is_own_goal", F.lower(kind).contains("own")),
    }).drop("_name")


def match_defaults(matches: DataFrame) -> DataFrame:
    """Matches with what is missing told from the rest: first of July of the season, the home side's stadium, the country as city."""
    has = {c: null_if_missing(F.col(c)) for c in ("date", "stadium", "city", "country", "referee")}
    return matches.withColumns({
        "date": F.coalesce(has["date"], F.concat(F.lit("01-07-"), season_start_year(F.col("season")).cast("string"))),
        "stadium": F.coalesce(has["stadium"], F.concat("home_team_id", F.lit(" Stadium"))),
        "city": F.coalesce(has["city"], has["country"], F.lit("Unknown")),
        "country": F.coalesce(has["country"], F.lit("Unknown")),
        "referee": F.coalesce(has["referee"], F.lit("Unknown")),
    })


def complete_teams(teams: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a team (its first), the country from its first match that has one, a logo address, team_slug and team_region."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("home_team_id").alias("team_id")), F.struct(F.lit(1).alias("side"), F.col("away_team_id").alias("team_id")))
    played = matches.filter(~is_missing(F.col("country"))).select("country", "row_id", F.explode(sides).alias("s")).filter("s.team_id is not null")
    lands = played.groupBy(F.col("s.team_id").alias("team_id")).agg(F.min(F.struct("s.side", "row_id", "country"))["country"].alias("_land"))
    w = Window.partitionBy("team_id").orderBy("row_id")
    first = teams.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").join(lands, "team_id", "left")
    country = F.coalesce(null_if_missing(F.col("country")), F.col("_land"), F.lit("Unknown"))
    logo = F.coalesce(null_if_missing(F.col("logo")), F.concat(F.lit("generated://team-logo/"), F.col("team_id")))
    return first.withColumns({"country": country, "logo": logo, "team_slug": slug(F.col("team_name")), "team_region": country_region(country)}).drop("_land")


# --- the stochastic tier: draws from hashes


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normal(seed: int, mean: Column, sd: Column, *keys: Column) -> Column:
    """A normal number by Box and Muller from two hashed uniforms."""
    u, v = F.greatest(uniform(seed, *keys), F.lit(1e-12)), uniform(seed + 1, *keys)
    return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def categorical(u: Column, probabilities: list[float], values: list) -> Column:
    """The value in whose share of [0, 1) the uniform lies; the last takes what is left."""
    out = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(u < float(sum(probabilities[: i + 1])), values[i]).otherwise(out)
    return out


def binomial(seed: int, n: Column, p: float, most: int, *keys: Column) -> Column:
    """Successes of n trials, n at most ``most``: one hashed uniform a trial."""
    return sum((F.when((n > i) & (uniform(seed + i, *keys) < p), 1).otherwise(0) for i in range(1, most)), F.when((n > 0) & (uniform(seed, *keys) < p), 1).otherwise(0))


def poisson(u: Column, rate: Column, most: int = 15) -> Column:
    """The inverse of the distribution function at u, at most ``most``."""
    term, total, out = F.exp(-rate), F.exp(-rate), F.lit(most)
    steps = []
    for k in range(most):
        steps.append((k, total))
        term = term * rate / (k + 1)
        total = total + term
    for k, t in reversed(steps):
        out = F.when(u < t, k).otherwise(out)
    return out


# Mean and deviation of age, height and weight, top speed and metres a minute, by position group.
PRIORS = {"GK": (29, 4, 190, 5, 84, 6, 30.5, 70), "DEF": (27, 4, 183, 6, 78, 7, 32.0, 105), "MID": (26, 4, 178, 6, 73, 7, 33.0, 120), "FW": (25, 4, 181, 6, 76, 7, 34.5, 110)}
# Chances of 0, 1, 2 and 3 goals by position group.
GOAL_CHANCES = {"GK": (0.997, 0.003, 0.0, 0.0), "DEF": (0.93, 0.06, 0.009, 0.001), "MID": (0.82, 0.14, 0.035, 0.005), "FW": (0.65, 0.25, 0.08, 0.02)}


def generate_profile(df: DataFrame, key: str, group: str, seed: int = 20260502) -> DataFrame:
    """Missing ages, heights and weights drawn from their position's distribution, marked in profile_data_source."""
    out = df
    source = F.lit(False)
    for i, (c, low, high) in enumerate((("age", 16.0, 42.0), ("height_cm", 155.0, 210.0), ("weight_kg", 50.0, 110.0))):
        mean, sd = F.lit(float(PRIORS["MID"][2 * i])), F.lit(float(PRIORS["MID"][2 * i + 1]))
        for g, p in PRIORS.items():
            mean, sd = F.when(F.col(group) == g, float(p[2 * i])).otherwise(mean), F.when(F.col(group) == g, float(p[2 * i + 1])).otherwise(sd)
        gap = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        source = source | gap
        out = out.withColumn(f"_{c}", F.when(gap, F.rint(clip(normal(seed + 10 * i, mean, sd, F.col(key)), low, high))).otherwise(F.col(c).cast("double")))
    out = out.withColumn("profile_data_source", F.when(source, "generated").otherwise("observed"))
    return out.withColumns({c: F.col(f"_{c}") for c in ("age", "height_cm", "weight_kg")}).drop("_age", "_height_cm", "_weight_kg")


def draw_goals(group: Column, seed: int, *keys: Column) -> Column:
    """Goals of a match by position; three or more are drawn evenly up to five."""
    u = uniform(seed, *keys)
    top = (3 + F.floor(uniform(seed + 1, *keys) * 3)).cast("int")
    out = F.lit(0)
    for g, (p0, p1, p2, _) in GOAL_CHANCES.items():
        own = F.when(u < p0, 0).when(u < p0 + p1, 1).when(u < p0 + p1 + p2, 2).otherwise(top)
        out = F.when(group == g, own).otherwise(out)
    return out

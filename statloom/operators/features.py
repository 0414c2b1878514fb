"""Feature columns of matches, goals, players, player-matches, player-seasons and keepers.

Each function adds its columns in a few wide projections. Rates are NULL-safe;
where the definition counts a missing number as nothing, it is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import clip, country_region, right_closed, safe_div, season_start_year
from statloom.operators.relational import both_roles
from statloom.session import even_join, salted_join


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def rate(a: Column, b: Column) -> Column:
    """a / b to six places, 0 where undefined."""
    return r6(F.coalesce(safe_div(a, b), F.lit(0.0)))


def flag(c: Column) -> Column:
    """1 or 0; a condition on a missing value is 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


# --- matches


def outcome_flags(df: DataFrame, home: str = "home_score", away: str = "away_score") -> DataFrame:
    h, a = zero(home), zero(away)
    total = h + a
    return df.withColumns({
        "total_goals": total, "goal_diff_home": h - a, "abs_goal_diff": F.abs(h - a),
        "home_win": flag(h > a), "away_win": flag(h < a), "draw": flag(h == a),
        "result_code": F.when(h > a, "H").when(h < a, "A").otherwise("D"),
        "both_teams_scored": flag((h > 0) & (a > 0)),
        "over_1_5_goals": flag(total > 1.5), "over_2_5_goals": flag(total > 2.5), "over_3_5_goals": flag(total > 3.5),
        "home_clean_sheet": flag(a == 0), "away_clean_sheet": flag(h == 0),
    })


def calendar(df: DataFrame, day: str = "day", season: str = "season") -> DataFrame:
    """Season and calendar columns; without a day the season's first year, July and Saturday."""
    y = season_start_year(F.col(season))
    dow = F.coalesce(F.weekday(day), F.lit(5))
    return df.withColumns({
        "season_start_year": y, "season_end_year": y + 1, "match_year": F.coalesce(F.year(day), y), "match_month": F.coalesce(F.month(day), F.lit(7)),
        "match_dayofweek": dow, "is_weekend": flag(dow.isin(5, 6)), "is_2004_2026_window": flag(y.between(2004, 2025)),
    })


def scope_flags(df: DataFrame) -> DataFrame:
    region = country_region(F.col("country"))
    return df.withColumns({
        "is_domestic_league": flag(F.col("data_scope").rlike("(?i)domestic")), "is_international_competition": flag(F.col("data_scope").rlike("(?i)international")),
        "is_european_competition": flag(region == "Europe"), "is_south_american_competition": flag(region == "South America"),
        "is_english_league": flag(F.col("competition").rlike("(?i)Premier League|England")),
    })


def possession_features(df: DataFrame, home: str, away: str) -> DataFrame:
    """From shares of one; a missing side counts as a half."""
    h, a = F.coalesce(home, F.lit(0.5)), F.coalesce(away, F.lit(0.5))
    return df.withColumns({"possession_diff_home": F.round(h - a, 4), "home_possession_advantage": flag(h > a), "possession_balance_index": F.round(1 - F.abs(h - a), 4)})


def team_history(matches: DataFrame) -> DataFrame:
    """Per team over all its matches, at home or away: counts and rates (points are 3 a win, 1 a draw)."""
    sides = both_roles(
        matches, [], {"team_id": "home_team_id", "goals_for": "home_score", "goals_against": "away_score"}, {"team_id": "away_team_id", "goals_for": "away_score", "goals_against": "home_score"}
    ).filter("team_id is not null")
    gf, ga = zero("goals_for"), zero("goals_against")
    per = sides.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("match_count"), F.sum((gf > ga).cast("long")).alias("wins"), F.sum((gf == ga).cast("long")).alias("draws"), F.sum(gf).alias("gf"), F.sum(ga).alias("ga")
    )
    n = F.col("match_count")
    return per.select(
        "team_id", "match_count", rate(F.col("wins"), n).alias("win_rate"), rate(3 * F.col("wins") + F.col("draws"), n).alias("points_per_match"),
        rate(F.col("gf"), n).alias("goals_for_per_match"), rate(F.col("ga"), n).alias("goals_against_per_match"), rate(F.col("gf") - F.col("ga"), n).alias("goal_diff_per_match"),
    )


# What a team without history has.
HISTORY_DEFAULTS = {"match_count": 0, "win_rate": 0.33, "points_per_match": 1.3, "goals_for_per_match": 1.2, "goals_against_per_match": 1.2, "goal_diff_per_match": 0.0}


def with_history(matches: DataFrame, history: DataFrame) -> DataFrame:
    out = matches
    for side in ("home", "away"):
        own = history.select(F.col("team_id").alias(f"{side}_team_id"), *[F.col(c).alias(f"{side}_team_{c}") for c in HISTORY_DEFAULTS])
        out = out.join(own, f"{side}_team_id", "left")
        out = out.withColumns({f"{side}_team_{c}": F.coalesce(f"{side}_team_{c}", F.lit(v)) for c, v in HISTORY_DEFAULTS.items()})
    return out


def head_to_head(matches: DataFrame) -> DataFrame:
    """(team_a, team_b, meetings) of each unordered pair; pairs with a missing team are left out."""
    return (
        matches.filter("home_team_id is not null and away_team_id is not null")
        .groupBy(F.least("home_team_id", "away_team_id").alias("team_a"), F.greatest("home_team_id", "away_team_id").alias("team_b"))
        .agg(F.count(F.lit(1)).alias("meetings"))
    )


def with_meetings(matches: DataFrame) -> DataFrame:
    """The count of the pair on every match."""
    pair = Window.partitionBy(F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id"))
    return matches.withColumn("head_to_head_match_count", F.count(F.lit(1)).over(pair))


def win_probabilities(df: DataFrame) -> DataFrame:
    """Proxies of home win, draw and away win that sum to one, and expected goals."""
    d = F.col("home_team_points_per_match") - F.col("away_team_points_per_match")
    g = F.col("home_team_goal_diff_per_match") - F.col("away_team_goal_diff_per_match")
    home = clip(0.42 + 0.13 * d + 0.08 * g + 0.06, 0.05, 0.90)
    away = clip(0.36 - 0.13 * d - 0.08 * g, 0.05, 0.90)
    draw = clip(0.22 - 0.03 * F.abs(d), 0.05, 0.45)
    total = home + away + draw
    goals = sum((F.col(f"{s}_team_goals_{k}_per_match") for s in ("home", "away") for k in ("for", "against")), F.lit(0.0))
    return df.withColumns({
        "home_win_probability_proxy": r6(home / total), "draw_probability_proxy": r6(draw / total), "away_win_probability_proxy": r6(away / total),
        "win_probability_edge_home": r6((home - away) / total), "expected_total_goals_proxy": r6(goals / 2),
    })


# --- goals


def goal_features(goals: DataFrame) -> DataFrame:
    """Event flags and minute columns of goals with event_type, goal_type, minute, is_penalty, is_own_goal."""
    kind, m = F.lower(F.coalesce("goal_type", F.lit(""))), F.coalesce("minute", F.lit(0))
    goal = flag((F.lower("event_type") == "goal") | kind.isin("regular", "penalty", "own_goal"))
    penalty, own = flag(F.col("is_penalty") | kind.contains("penalty")), flag(F.col("is_own_goal") | kind.contains("own"))
    edges = [-1, 15, 30, 45, 60, 75, 90, 130]
    labels = ["0-15", "16-30", "31-45", "46-60", "61-75", "76-90", "90+"]
    return goals.withColumns({
        "is_goal_event": goal, "is_shot_event": flag((F.lower("event_type") == "shot") | (goal == 1)), "is_header_event": flag(kind.contains("header")),
        "is_penalty_goal": penalty, "is_own_goal_event": own, "minute_normalized": r6(clip(m / 120, 0.0, 1.0)), "minute_bucket": right_closed(m, edges, labels),
        "is_first_half": flag(m.between(1, 45)), "is_second_half": flag(m.between(46, 90)), "is_extra_time": flag(m > 90), "is_late_event": flag(m >= 75),
        "event_phase_weight": F.when(m <= 45, 0.8).when(m <= 75, 1.0).otherwise(1.2),
        "goal_value_weight": F.when(own == 1, -1.0).when(penalty == 1, 0.78).otherwise(1.0), "open_play_goal_proxy": flag((goal == 1) & (penalty == 0) & (own == 0)),
    })


# The base chance of a headed goal by position group.
_HEADER_BASE = {"GK": 0.02, "DEF": 0.10, "MID": 0.08, "FW": 0.14}


def headed_goal_chance(position: Column, height: Column, age: Column, weight: Column, penalty: Column, header: Column) -> Column:
    base = F.lit(0.09)
    for k, v in _HEADER_BASE.items():
        base = F.when(position == k, v).otherwise(base)
    x = base + 0.18 * clip((height - 170) / 35, 0.0, 1.0) + 0.04 * clip(1 - F.abs(age - 27) / 22, 0.25, 1.0) + 0.03 * clip((weight - 65) / 35, 0.0, 1.0)
    return r6(F.when(penalty == 1, 0.01).when(header == 1, 0.90).otherwise(clip(x, 0.005, 0.65)))


# --- players


def player_profile(df: DataFrame, group: str = "position_group") -> DataFrame:
    """Buckets, role flags and body columns of players with age, height_cm, weight_kg and a position group."""
    age, h, w = F.col("age"), F.col("height_cm"), F.col("weight_kg")
    prime = flag(age.between(24, 29))
    return df.withColumns({
        "age_group": right_closed(age, [0, 20, 24, 29, 34, 60], ["u20", "21-24", "25-29", "30-34", "35+"]),
        "height_bucket": right_closed(h, [0, 170, 180, 190, 250], ["short", "medium", "tall", "very_tall"]),
        "weight_bucket": right_closed(w, [0, 68, 78, 88, 140], ["light", "medium", "heavy", "very_heavy"]),
        "height_m": F.round(h / 100, 4), "body_mass_index": F.round(safe_div(w, (h / 100) * (h / 100)), 4),
        **{f"is_{n}": flag(F.col(group) == g) for n, g in (("goalkeeper", "GK"), ("defender", "DEF"), ("midfielder", "MID"), ("forward", "FW"))},
        "prime_age_flag": prime, "u23_flag": flag(age <= 23), "veteran_flag": flag(age >= 32),
        "physical_profile_score": r6(clip((h - 170) / 35, 0.0, 1.0) + clip((w - 65) / 35, 0.0, 1.0) + prime),
    })


CAREER = ("minutes_played", "goals", "assists", "shots", "passes_completed", "tackles", "interceptions")


def career_totals(stats: DataFrame, key: str = "player_id") -> DataFrame:
    """Per player: match rows, totals (0 where nothing is known) and per 90 minutes."""
    per = stats.groupBy(key).agg(F.count(F.lit(1)).alias("match_rows"), F.count_distinct("match_id").alias("matches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in CAREER])
    minutes = F.col("total_minutes_played")
    return per.withColumns({f"{c}_per90": rate(F.col(f"total_{c}") * 90, minutes) for c in ("goals", "assists", "shots", "tackles")}).withColumn("goal_involvements", F.col("total_goals") + F.col("total_assists"))


# --- player-match

PER90 = (
    "goals", "assists", "shots", "shots_on_target", "shots_off_target", "shots_blocked", "passes_completed", "passes_attempted", "crosses_completed", "crosses_attempted",
    "dribbles", "offsides", "tackles", "tackles_won", "tackles_lost", "interceptions", "clearances", "fouls_committed", "fouls_suffered", "yellow_cards", "red_cards",
    "distance_covered", "touches",
)


def per90(df: DataFrame, columns: tuple[str, ...] = PER90) -> DataFrame:
    return df.withColumns({f"{c}_per90": rate(zero(c) * 90, zero("minutes_played")) for c in columns})


def efficiency(df: DataFrame) -> DataFrame:
    pairs = {
        "shot_accuracy": ("shots_on_target", "shots"), "goal_conversion_rate": ("goals", "shots"), "pass_completion_rate": ("passes_completed", "passes_attempted"),
        "cross_completion_rate": ("crosses_completed", "crosses_attempted"), "tackle_success_rate": ("tackles_won", "tackles"),
    }
    minutes = zero("minutes_played")
    defensive, attacking = zero("tackles") + zero("interceptions") + zero("clearances"), zero("shots") + zero("dribbles") + zero("crosses_attempted")
    discipline = zero("fouls_committed") + 3 * zero("yellow_cards") + 6 * zero("red_cards")
    return df.withColumns({
        **{n: rate(zero(a), zero(b)) for n, (a, b) in pairs.items()},
        "defensive_actions": defensive, "attacking_actions": attacking, "ball_actions": zero("touches") + defensive + attacking, "discipline_points": discipline,
        "distance_per_minute": rate(zero("distance_covered"), minutes), "speed_distance_index": r6(zero("top_speed") * zero("distance_covered") / 1000),
        "minutes_share_regular_time": r6(clip(minutes / 90, 0.0, 1.3333)), "starter_proxy": flag(minutes >= 45), "substitute_proxy": flag(minutes < 45), "full_match_proxy": flag(minutes >= 90),
        "goal_involvements": zero("goals") + zero("assists"), "non_shot_goal_proxy": flag((zero("goals") > zero("shots")) & (zero("goals") > 0)), "two_way_index": attacking + defensive - discipline,
    })


def match_role(df: DataFrame) -> DataFrame:
    """The team's side of the match: with home_team_id, away_team_id and scores; who isn't home counts as away."""
    home = flag(F.col("team_id") == F.col("home_team_id"))
    gf, ga = F.when(home == 1, F.col("home_score")).otherwise(F.col("away_score")), F.when(home == 1, F.col("away_score")).otherwise(F.col("home_score"))
    diff = zero(gf) - zero(ga)
    points = F.when(diff > 0, 3).when(diff == 0, 1).otherwise(0)
    return df.withColumns({
        "team_is_home": home, "opponent_team_id": F.when(home == 1, F.col("away_team_id")).otherwise(F.col("home_team_id")), "team_goals_for": zero(gf), "team_goals_against": zero(ga),
        "team_goal_diff": diff, "team_result_points": points, "team_clean_sheet": flag(zero(ga) == 0), "team_win": flag(points == 3), "team_draw": flag(points == 1), "team_loss": flag(points == 0),
    })


def role_fit(df: DataFrame, group: str = "position_group") -> DataFrame:
    """A score by role, from the columns of ``efficiency`` and ``match_role``."""
    g = F.col(group)
    score = (
        F.when(g == "GK", F.col("team_clean_sheet") + zero("minutes_played") / 120)
        .when(g == "DEF", F.col("defensive_actions") + F.col("team_clean_sheet"))
        .when(g == "MID", zero("passes_completed") / 40 + F.col("two_way_index") / 10)
        .when(g == "FW", zero("shots") + F.col("goal_involvements"))
        .otherwise(F.col("two_way_index") / 10)
    )
    return df.withColumn("role_fit_score", r6(score))


# --- player-season and keepers

SEASON = ("goals", "assists", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "interceptions", "fouls_committed", "yellow_cards", "red_cards")


def season_features(df: DataFrame) -> DataFrame:
    minutes, games = zero("minutes_played"), zero("matches_played")
    out = df.withColumns({**{f"{c}_per90": rate(zero(c) * 90, minutes) for c in SEASON}, **{f"{c}_per_match": rate(zero(c), games) for c in SEASON}})
    discipline = zero("fouls_committed") + 3 * zero("yellow_cards") + 6 * zero("red_cards")
    conversion, completion = rate(zero("goals"), zero("shots")), rate(zero("passes_completed"), zero("passes_attempted"))
    defensive = zero("tackles") + zero("interceptions")
    return out.withColumns({
        "minutes_per_match": rate(minutes, games), "availability_rate": r6(clip(games / 38, 0.0, 1.0)), "goal_involvements": zero("goals") + zero("assists"),
        "shot_accuracy": rate(zero("shots_on_target"), zero("shots")), "goal_conversion_rate": conversion, "pass_completion_rate": completion,
        "defensive_actions": defensive, "discipline_points": discipline, "discipline_per90": rate(discipline * 90, minutes),
        "scoring_index": r6(2 * F.col("goals_per90") + 0.2 * F.col("shots_per90") + conversion), "creator_index": r6(2 * F.col("assists_per90") + 0.03 * F.col("passes_completed_per90") + completion),
        "defensive_index": r6(rate(defensive * 90, minutes) + F.col("interceptions_per90")),
    })


def keeper_features(df: DataFrame) -> DataFrame:
    """Rates and indices of keeper-seasons with saves, goals_conceded, clean_sheets, penalty_saves, punches, matches, minutes."""
    n = F.greatest(zero("matches"), F.lit(1))
    minutes = F.greatest(F.when(zero("minutes") > 0, zero("minutes")).otherwise(n * 90), F.lit(1))
    saves, conceded = zero("saves"), zero("goals_conceded")
    clean, ratio = rate(zero("clean_sheets"), n), r6(saves / (conceded + 1))
    return df.withColumns({
        "saves_per_match": rate(saves, n), "goals_conceded_per_match": rate(conceded, n), "saves_per90": rate(saves * 90, minutes), "goals_conceded_per90": rate(conceded * 90, minutes),
        "clean_sheet_rate": clean, "penalty_save_rate": rate(zero("penalty_saves"), n), "punches_per_match": rate(zero("punches"), n), "save_to_conceded_ratio": ratio,
        "keeper_reliability_index": r6(2 * clean + ratio - rate(conceded, n)), "shot_stopping_index": r6(rate(saves * 90, minutes) - rate(conceded * 90, minutes)),
        "box_command_index": r6(rate(zero("punches"), n) + clean),
    })


def matrix_features(df: DataFrame) -> DataFrame:
    """The sixteen engineered columns of the reduction matrix; missing inputs stay missing, but cards are 0."""
    minutes = F.col("minutes_played")
    base = ("goals", "assists", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "interceptions", "fouls_committed")
    p90 = lambda c: safe_div(c * 90, minutes)
    cards = zero("yellow_cards") + zero("red_cards")
    return df.withColumns({
        "minutes_per_match": safe_div(minutes, F.col("matches_played")), **{f"{c}_per90": p90(F.col(c)) for c in base}, "cards_per90": p90(cards),
        "shot_accuracy": safe_div(F.col("shots_on_target"), F.col("shots")), "pass_accuracy": safe_div(F.col("passes_completed"), F.col("passes_attempted")),
        "goal_conversion": safe_div(F.col("goals"), F.col("shots")), "defensive_per90": p90(F.col("tackles") + F.col("interceptions")),
        "discipline_per90": p90(F.col("fouls_committed") + 3 * zero("yellow_cards") + 6 * zero("red_cards")),
    })


# --- context from other tables, and the complete feature tables

# What a player without a known profile counts as.
PROFILE_DEFAULTS = {"age": 26.0, "height_cm": 180.0, "weight_kg": 75.0}


def match_context(df: DataFrame, matches: DataFrame, spread: str = "row_id", also: tuple[str, ...] = ()) -> DataFrame:
    """season, competition and match_country of the row's match, Unknown without one, and the columns ``also`` as they are. matches: one row a match_id."""
    dim = matches.select("match_id", *also, F.col("season").alias("_s"), F.col("competition").alias("_c"), F.col("country").alias("_l")).filter("match_id is not null")
    out = even_join(df.drop("season", "competition", "match_country"), dim, "match_id", spread)
    return out.withColumns({"season": F.coalesce("_s", F.lit("Unknown")), "competition": F.coalesce("_c", F.lit("Unknown")), "match_country": F.coalesce("_l", F.lit("Unknown"))}).drop("_s", "_c", "_l")


def player_context(df: DataFrame, players: DataFrame, spread: str = "row_id") -> DataFrame:
    """player_age, player_height_cm, player_weight_kg, player_position_group and player_bmi, with defaults. players: one row a player_id."""
    dim = players.filter("player_id is not null").select("player_id", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_{c}") for c in PROFILE_DEFAULTS], F.col("position_group").alias("_g"))
    out = salted_join(df, dim, ["player_id"], spread, "left")
    out = out.withColumns({f"player_{c}": F.coalesce(f"_{c}", F.lit(v)) for c, v in PROFILE_DEFAULTS.items()} | {"player_position_group": F.coalesce("_g", F.lit("UNK"))})
    bmi = F.round(safe_div(F.col("player_weight_kg"), F.col("player_height_cm") / 100 * (F.col("player_height_cm") / 100)), 4)
    return out.withColumn("player_bmi", bmi).drop("_g", *[f"_{c}" for c in PROFILE_DEFAULTS])


def geography(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Countries of both teams (the match's without one), same country and region, derby. Needs is_domestic_league; teams: one row a team_id."""
    out = matches
    for side in ("home", "away"):
        dim = teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("country").alias("_l")).filter(f"{side}_team_id is not null")
        out = salted_join(out, dim, [f"{side}_team_id"], "match_id", "left").withColumn(f"{side}_team_country", F.coalesce("_l", "country")).drop("_l")
    home, away = F.col("home_team_country"), F.col("away_team_country")
    same = flag(home.eqNullSafe(away))
    region = flag(country_region(F.coalesce(home, F.lit(""))) == country_region(F.coalesce(away, F.lit(""))))
    return out.withColumns({"same_country_match": same, "same_region_match": region, "country_derby_proxy": flag((same == 1) & (F.col("is_domestic_league") == 1))})


def match_features(matches: DataFrame, teams: DataFrame, day: str = "day", home_share: str = "home_share", away_share: str = "away_share") -> DataFrame:
    """All match features. matches: one row a match with a day and shares of possession; teams: one row a team."""
    x = possession_features(outcome_flags(scope_flags(calendar(matches, day))), home_share, away_share)
    return win_probabilities(with_meetings(with_history(geography(x, teams), team_history(matches))))


def goal_event_features(goals: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """All goal features, with match and player context."""
    x = player_context(match_context(goal_features(goals), matches), players)
    chance = headed_goal_chance(F.col("player_position_group"), F.col("player_height_cm"), F.col("player_age"), F.col("player_weight_kg"), F.col("is_penalty_goal"), F.col("is_header_event"))
    return x.withColumns({
        "assist_player_id": F.coalesce("assist_player_id", F.lit("NO_ASSIST")), "headed_goal_probability_proxy": chance,
        "is_english_league_event": flag(F.col("competition").rlike("(?i)Premier League|England")), "is_south_american_event": flag(country_region(F.col("match_country")) == "South America"),
        "event_recency_weight": r6(clip((season_start_year(F.col("season")) - 2004) / 21, 0.0, 1.0)),
    })


def player_features(players: DataFrame, teams: DataFrame, stats: DataFrame, seasons: DataFrame, goals: DataFrame) -> DataFrame:
    """All player features: profile, team geography, career, seasons, goals and headers, and three profile scores."""
    dim = teams.select("team_id", F.col("country").alias("team_country")).filter("team_id is not null")
    x = salted_join(player_profile(players), dim, ["team_id"], "player_id", "left")
    x = x.withColumns({"team_country": F.coalesce("team_country", F.lit("Unknown"))})
    x = x.withColumns({"team_region": country_region(F.col("team_country")), "nationality_matches_team_country": flag(F.col("nationality") == F.col("team_country"))})
    counts = seasons.filter("season is not null").groupBy("player_id").agg(F.count_distinct("season").alias("player_seasons_count"))
    made = goals.groupBy("player_id").agg(
        F.count(F.when(F.lower("event_type") == "goal", 1)).alias("observed_goal_events"), F.count(F.when(F.lower("goal_type").contains("header"), 1)).alias("observed_header_events")
    )
    for per in (career_totals(stats), counts, made):
        x = x.join(per.filter("player_id is not null"), "player_id", "left")
    numbers = ["match_rows", "matches", "goal_involvements", *[f"total_{c}" for c in CAREER], "player_seasons_count", "observed_goal_events", "observed_header_events"]
    x = x.withColumns({c: zero(c) for c in numbers} | {f"{c}_per90": F.coalesce(f"{c}_per90", F.lit(0.0)) for c in ("goals", "assists", "shots", "tackles")})
    h, group = clip((F.coalesce("height_cm", F.lit(180.0)) - 170) / 35, 0.0, 1.0), F.col("position_group")
    base = F.lit(0.09)
    for k, v in _HEADER_BASE.items():
        base = F.when(group == k, v).otherwise(base)
    return x.withColumns({
        "headed_goal_probability_proxy": r6(clip(base + 0.18 * h + 0.04 * F.col("prime_age_flag"), 0.005, 0.65)),
        "scoring_profile_score": r6(F.col("goals_per90") + 0.15 * F.col("shots_per90") + 0.5 * F.col("is_forward")),
        "creation_profile_score": r6(F.col("assists_per90") + 0.35 * F.col("is_midfielder") + F.col("total_passes_completed") / 10000),
    })


def player_match_features(stats: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """All player-match features."""
    x = match_context(per90(efficiency(stats)), matches, also=("home_team_id", "away_team_id", "home_score", "away_score"))
    x = player_context(match_role(x), players)
    return role_fit(x.withColumn("is_english_league_match", flag(F.col("competition").rlike("(?i)Premier League|England"))), "player_position_group")


def player_season_features(seasons: DataFrame, players: DataFrame) -> DataFrame:
    """All player-season features, with player context."""
    x = player_context(season_features(seasons), players)
    return x.withColumns({
        "goal_involvements_per90": rate(F.col("goal_involvements") * 90, zero("minutes_played")), "season_start_year": season_start_year(F.col("season")), "is_peak_age_season": flag(F.col("player_age").between(24, 29)),
    })


def goalkeeper_features(keepers: DataFrame, seasons: DataFrame, players: DataFrame) -> DataFrame:
    """All keeper-season features: (player_id, season) with saves, goals_conceded, clean_sheets, penalty_saves, punches.

    Matches and minutes come from the season statistics, by default one match and 90 minutes a match.
    """
    dim = seasons.groupBy("player_id", "season").agg(F.max("matches_played").alias("matches_played_proxy"), F.max("minutes_played").alias("minutes_played_proxy"))
    x = keepers.join(dim, ["player_id", "season"], "left")
    n = F.greatest(F.coalesce("matches_played_proxy", F.lit(1)), F.lit(1))
    x = x.withColumn("matches_played_proxy", n).withColumn("minutes_played_proxy", F.greatest(F.coalesce("minutes_played_proxy", F.col("matches_played_proxy") * 90), F.lit(1)))
    x = keeper_features(x.withColumns({"matches": F.col("matches_played_proxy"), "minutes": F.col("minutes_played_proxy")})).drop("matches", "minutes")
    x = player_context(x, players, "season")
    body = clip((F.col("player_height_cm") - 180) / 25, 0.0, 1.0) + clip((F.col("player_weight_kg") - 75) / 25, 0.0, 1.0)
    return x.withColumns({"keeper_physical_index": r6(body), "prime_keeper_age_flag": flag(F.col("player_age").between(27, 34))})

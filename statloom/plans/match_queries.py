"""Feature, metric and imputation queries over the match tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import text as X
from statloom.functions.dates import parse_date
from statloom.functions.missing import null_if_missing
from statloom.operators import features, impute, metrics
from statloom.operators.relational import keep_one
from statloom.session import table


def games(spark: SparkSession, d: str) -> DataFrame:
    """One row a match: the first delivered."""
    return keep_one(table(spark, d, "matches_cleaned"), ["match_id"], [F.col("row_id")])


def players(spark: SparkSession, d: str) -> DataFrame:
    p = keep_one(table(spark, d, "players_cleaned"), ["player_id"], [F.col("row_id")])
    return p.withColumn("position_group", X.position_code(F.col("position")))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "player_match_stats_cleaned")


def _markers(c: str) -> str:
    return f"(case when {c} is null or upper(trim({c})) in ('', 'NULL', 'NAN', 'NONE', 'NA', 'NOT_AVAILABLE_IN_SOURCE', 'NO_ASSIST_OR_NOT_RECORDED', '<NA>') then null else {c} end)"


G = "games as (select * from matches_cleaned qualify row_number() over (partition by match_id order by row_id) = 1)"
P = "players as (select * from players_cleaned qualify row_number() over (partition by player_id order by row_id) = 1)"
_POS = (
    "case when {c} is null or upper(trim({c})) in ('', 'NULL', 'NAN', 'NONE', 'NA', 'NOT_AVAILABLE_IN_SOURCE', 'NO_ASSIST_OR_NOT_RECORDED', '<NA>') then 'UNK' "
    "when regexp_matches(upper({c}), 'GK|GOAL|KEEP') then 'GK' when regexp_matches(upper({c}), 'DF|DEF|BACK|CB|LB|RB') then 'DEF' "
    "when regexp_matches(upper({c}), 'MF|MID|CM|DM|AM|LM|RM') then 'MID' when regexp_matches(upper({c}), 'FW|FOR|ST|CF|LW|RW|ATT|WING') then 'FW' else 'UNK' end"
)
_H = f"""with {G},
sides as (
  select home_team_id as team_id, coalesce(home_score, 0) as gf, coalesce(away_score, 0) as ga from games where home_team_id is not null
  union all select away_team_id, coalesce(away_score, 0), coalesce(home_score, 0) from games where away_team_id is not null),
history as (
  select team_id, count(*) as match_count, round(sum(cast(gf > ga as int)) / count(*), 6) as win_rate,
    round((3 * sum(cast(gf > ga as int)) + sum(cast(gf = ga as int))) / count(*), 6) as points_per_match,
    round(sum(gf) / count(*), 6) as goals_for_per_match, round(sum(ga) / count(*), 6) as goals_against_per_match,
    round((sum(gf) - sum(ga)) / count(*), 6) as goal_diff_per_match
  from sides group by team_id)"""

def _cut(c, name: str):
    return (F.floor(c * 1e4 + 1e-6) / 1e4).alias(name)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query with its SQL."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"{_H} select * from history")
def team_history_rates(spark, d):
    return features.team_history(games(spark, d))


@query(f"with {G} select least(home_team_id, away_team_id) as team_a, greatest(home_team_id, away_team_id) as team_b, count(*) as meetings from games where home_team_id is not null and away_team_id is not null group by 1, 2")
def head_to_head_pairs(spark, d):
    return features.head_to_head(games(spark, d))


@query(f"with {G} select match_id, count(*) over (partition by least(home_team_id, away_team_id), greatest(home_team_id, away_team_id)) as head_to_head_match_count from games")
def head_to_head_counts(spark, d):
    return features.with_meetings(games(spark, d)).select("match_id", "head_to_head_match_count")


@query(f"""{_H},
j as (
  select g.match_id, coalesce(h.points_per_match, 1.3) - coalesce(a.points_per_match, 1.3) as dp, coalesce(h.goal_diff_per_match, 0) - coalesce(a.goal_diff_per_match, 0) as dg,
    coalesce(h.goals_for_per_match, 1.2) + coalesce(h.goals_against_per_match, 1.2) + coalesce(a.goals_for_per_match, 1.2) + coalesce(a.goals_against_per_match, 1.2) as s
  from games g left join history h on g.home_team_id = h.team_id left join history a on g.away_team_id = a.team_id),
k as (
  select *, greatest(least(0.42 + 0.13 * dp + 0.08 * dg + 0.06, 0.9), 0.05) as h, greatest(least(0.36 - 0.13 * dp - 0.08 * dg, 0.9), 0.05) as a,
    greatest(least(0.22 - 0.03 * abs(dp), 0.45), 0.05) as w from j)
select match_id, round(h / (h + a + w), 6) + 0.0 as home_win_probability_proxy, round(w / (h + a + w), 6) + 0.0 as draw_probability_proxy,
  round(a / (h + a + w), 6) + 0.0 as away_win_probability_proxy from k""")
def win_probability_proxy(spark, d):
    g = games(spark, d)
    x = features.win_probabilities(features.with_history(g, features.team_history(g)))
    return x.select("match_id", "home_win_probability_proxy", "draw_probability_proxy", "away_win_probability_proxy")


@query(f"""with {G}, x as (select match_id, coalesce(home_score, 0) as h, coalesce(away_score, 0) as a from games)
select match_id, h + a as total_goals, h - a as goal_diff_home, case when h > a then 'H' when h < a then 'A' else 'D' end as result_code,
  cast(h > 0 and a > 0 as int) as both_teams_scored, cast(h + a > 1.5 as int) as over_1_5_goals, cast(h + a > 2.5 as int) as over_2_5_goals,
  cast(h + a > 3.5 as int) as over_3_5_goals, cast(a = 0 as int) as home_clean_sheet, cast(h = 0 as int) as away_clean_sheet from x""")
def match_outcome_flags(spark, d):
    x = features.outcome_flags(games(spark, d))
    return x.select("match_id", "total_goals", "goal_diff_home", "result_code", "both_teams_scored", "over_1_5_goals", "over_2_5_goals", "over_3_5_goals", "home_clean_sheet", "away_clean_sheet")


_DAY = (
    "coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d-%m-%Y'), try_strptime(regexp_replace({c}, '^[A-Za-z]{{3}} ', ''), '%b %d %Y'))"
)


@query(f"""with {G}, x as (select match_id, season, cast({_DAY.format(c="date")} as date) as day from games),
y as (select *, coalesce(try_cast(nullif(regexp_extract(season, '((19|20)[0-9][0-9])', 1), '') as int), 2021) as y from x)
select match_id, y as season_start_year, y + 1 as season_end_year, coalesce(year(day), y) as match_year, coalesce(month(day), 7) as match_month,
  coalesce(isodow(day) - 1, 5) as match_dayofweek, cast(coalesce(isodow(day) - 1, 5) in (5, 6) as int) as is_weekend, cast(y between 2004 and 2025 as int) as is_2004_2026_window from y""")
def calendar_features(spark, d):
    x = features.calendar(games(spark, d).withColumn("day", parse_date(F.col("date"))))
    return x.select("match_id", "season_start_year", "season_end_year", "match_year", "match_month", "match_dayofweek", "is_weekend", "is_2004_2026_window")


@query(f"""with {G} select match_id, cast(coalesce(data_scope ilike '%domestic%', false) as int) as is_domestic_league,
  cast(coalesce(data_scope ilike '%international%', false) as int) as is_international_competition,
  cast(coalesce(regexp_matches(competition, '(?i)premier league|england'), false) as int) as is_english_league from games""")
def scope_flags(spark, d):
    return features.scope_flags(games(spark, d)).select("match_id", "is_domestic_league", "is_international_competition", "is_english_league")


_SHARE = "(case when regexp_full_match(trim(replace({c}, '%', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then (case when cast(trim(replace({c}, '%', '')) as double) > 1 then cast(trim(replace({c}, '%', '')) as double) / 100 else cast(trim(replace({c}, '%', '')) as double) end) end)"


@query(f"""with {G}, x as (select match_id, round({_SHARE.format(c="possession_home")}, 4) as h, round({_SHARE.format(c="possession_away")}, 4) as a from games),
y as (select match_id, case when not coalesce(h = 0 and a = 0, false) then h end as h, case when not coalesce(h = 0 and a = 0, false) then a end as a from x),
z as (select match_id, round(coalesce(h, 1 - a), 4) as h, round(coalesce(a, 1 - h), 4) as a from y)
select match_id, h as possession_home, a as possession_away, round(coalesce(h, 0.5) - coalesce(a, 0.5), 4) as possession_diff_home,
  cast(coalesce(h, 0.5) > coalesce(a, 0.5) as int) as home_possession_advantage, round(1 - abs(coalesce(h, 0.5) - coalesce(a, 0.5)), 4) as possession_balance_index from z""")
def possession_complement(spark, d):
    h, a = impute.possession_complement(X.pct_to_decimal(F.col("possession_home")), X.pct_to_decimal(F.col("possession_away")))
    x = features.possession_features(games(spark, d).withColumns({"h": h, "a": a}), "h", "a")
    return x.select("match_id", F.col("h").alias("possession_home"), F.col("a").alias("possession_away"), "possession_diff_home", "home_possession_advantage", "possession_balance_index")


@query("""select goal_id, row_id, cast(coalesce(lower(event_type) = 'goal', false) or coalesce(lower(goal_type), '') in ('regular', 'penalty', 'own_goal') as int) as is_goal_event,
  cast(coalesce(is_penalty, false) or coalesce(lower(goal_type), '') like '%penalty%' as int) as is_penalty_goal,
  cast(coalesce(is_own_goal, false) or coalesce(lower(goal_type), '') like '%own%' as int) as is_own_goal_event,
  round(greatest(least(coalesce(minute, 0) / 120, 1), 0), 6) as minute_normalized,
  case when coalesce(minute, 0) > -1 and coalesce(minute, 0) <= 15 then '0-15' when minute > 15 and minute <= 30 then '16-30' when minute > 30 and minute <= 45 then '31-45' when minute > 45 and minute <= 60 then '46-60'
    when minute > 60 and minute <= 75 then '61-75' when minute > 75 and minute <= 90 then '76-90' when minute > 90 and minute <= 130 then '90+' end as minute_bucket,
  cast(coalesce(minute, 0) between 1 and 45 as int) as is_first_half, cast(coalesce(minute, 0) > 90 as int) as is_extra_time,
  case when coalesce(minute, 0) <= 45 then 0.8 when minute <= 75 then 1.0 else 1.2 end :: double as event_phase_weight from goals_events_cleaned""")
def goal_event_features(spark, d):
    x = features.goal_features(table(spark, d, "goals_events_cleaned"))
    return x.select("goal_id", "row_id", "is_goal_event", "is_penalty_goal", "is_own_goal_event", "minute_normalized", "minute_bucket", "is_first_half", "is_extra_time", "event_phase_weight")


@query(f"""with {P}, g as (select g.row_id, {_POS.format(c="p.position")} as pos, coalesce(p.age, 26) as age, case when p.height_cm is null or isnan(p.height_cm) then 180 else p.height_cm end as h,
  case when p.weight_kg is null or isnan(p.weight_kg) then 75 else p.weight_kg end as w, coalesce(g.is_penalty, false) or coalesce(lower(g.goal_type), '') like '%penalty%' as pen,
  coalesce(lower(g.goal_type), '') like '%header%' as head from goals_events_cleaned g left join players p on g.player_id = p.player_id)
select row_id, round(case when pen then 0.01 when head then 0.9 else greatest(least(case pos when 'GK' then 0.02 when 'DEF' then 0.10 when 'MID' then 0.08 when 'FW' then 0.14 else 0.09 end
  + 0.18 * greatest(least((h - 170) / 35, 1), 0) + 0.04 * greatest(least(1 - abs(age - 27) / 22, 1), 0.25) + 0.03 * greatest(least((w - 65) / 35, 1), 0), 0.65), 0.005) end, 4) as headed_goal_probability_proxy from g""")
def headed_goal_proxy(spark, d):
    from statloom.functions.missing import finite

    p = players(spark, d).select("player_id", "position_group", "age", finite(F.col("height_cm")).alias("height_cm"), finite(F.col("weight_kg")).alias("weight_kg"))
    x = features.goal_features(table(spark, d, "goals_events_cleaned")).join(p, "player_id", "left")
    c = features.headed_goal_chance(F.coalesce("position_group", F.lit("UNK")), F.coalesce("height_cm", F.lit(180.0)), F.coalesce("age", F.lit(26)), F.coalesce("weight_kg", F.lit(75.0)), F.col("is_penalty_goal"), F.col("is_header_event"))
    return x.select("row_id", F.round(c, 4).alias("headed_goal_probability_proxy"))


@query(f"""with {P} select player_id, {_POS.format(c="position")} as position_group,
  case when age > 0 and age <= 20 then 'u20' when age > 20 and age <= 24 then '21-24' when age > 24 and age <= 29 then '25-29' when age > 29 and age <= 34 then '30-34' when age > 34 and age <= 60 then '35+' end as age_group,
  case when isnan(height_cm) then null when height_cm > 0 and height_cm <= 170 then 'short' when height_cm > 170 and height_cm <= 180 then 'medium' when height_cm > 180 and height_cm <= 190 then 'tall' when height_cm > 190 and height_cm <= 250 then 'very_tall' end as height_bucket,
  cast(coalesce(age between 24 and 29, false) as int) as prime_age_flag, cast(coalesce(age <= 23, false) as int) as u23_flag, cast(coalesce(age >= 32, false) as int) as veteran_flag from players""")
def player_profile_buckets(spark, d):
    return features.player_profile(players(spark, d)).select("player_id", "position_group", "age_group", "height_bucket", "prime_age_flag", "u23_flag", "veteran_flag")


@query("""with c as (select player_id, count(*) as match_rows, count(distinct match_id) as matches, cast(coalesce(sum(minutes_played), 0) as bigint) as total_minutes_played, cast(coalesce(sum(goals), 0) as bigint) as total_goals,
  cast(coalesce(sum(assists), 0) as bigint) as total_assists, cast(coalesce(sum(shots), 0) as bigint) as total_shots from player_match_stats_cleaned group by 1)
select *, round(coalesce(total_goals * 90 / nullif(total_minutes_played, 0), 0), 6) + 0.0 as goals_per90, total_goals + total_assists as goal_involvements from c""")
def career_totals_per90(spark, d):
    x = features.career_totals(stats(spark, d))
    return x.select("player_id", "match_rows", "matches", "total_minutes_played", "total_goals", "total_assists", "total_shots", F.col("goals_per90"), "goal_involvements")


_P90 = ("goals", "shots", "passes_completed", "tackles", "distance_covered", "touches")


@query("select row_id, " + ", ".join(f"round(coalesce(coalesce({c}, 0) * 90 / nullif(coalesce(minutes_played, 0), 0), 0), 6) + 0.0 as {c}_per90" for c in _P90) + " from player_match_stats_cleaned")
def per90_family(spark, d):
    x = features.per90(stats(spark, d))
    return x.select("row_id", *[F.col(f"{c}_per90") for c in _P90])


@query("""with z as (select row_id, coalesce(shots_on_target, 0) as st, coalesce(shots, 0) as s, coalesce(goals, 0) as g, coalesce(passes_completed, 0) as pc, coalesce(passes_attempted, 0) as pa, coalesce(tackles, 0) as t,
  coalesce(interceptions, 0) as i, coalesce(clearances, 0) as c, coalesce(dribbles, 0) as dr, coalesce(crosses_attempted, 0) as cr, coalesce(fouls_committed, 0) + 3 * coalesce(yellow_cards, 0) + 6 * coalesce(red_cards, 0) as dp,
  coalesce(minutes_played, 0) as m from player_match_stats_cleaned)
select row_id, round(coalesce(st / nullif(s, 0), 0), 6) + 0.0 as shot_accuracy, round(coalesce(g / nullif(s, 0), 0), 6) + 0.0 as goal_conversion_rate, round(coalesce(pc / nullif(pa, 0), 0), 6) + 0.0 as pass_completion_rate,
  t + i + c as defensive_actions, s + dr + cr as attacking_actions, dp as discipline_points, cast(m >= 45 as int) as starter_proxy, cast(m >= 90 as int) as full_match_proxy,
  cast(g > s and g > 0 as int) as non_shot_goal_proxy, s + dr + cr + t + i + c - dp as two_way_index from z""")
def efficiency_rates(spark, d):
    x = features.efficiency(stats(spark, d))
    r = ("shot_accuracy", "goal_conversion_rate", "pass_completion_rate")
    return x.select("row_id", *[F.col(c) for c in r], "defensive_actions", "attacking_actions", "discipline_points", "starter_proxy", "full_match_proxy", "non_shot_goal_proxy", "two_way_index")


_ROLE = f"""with {G}, {P}, z as (
  select s.row_id, s.team_id = g.home_team_id as home, g.home_score as hs, g.away_score as aws, g.home_team_id as ht, g.away_team_id as awt, {_POS.format(c="p.position")} as pos, coalesce(s.minutes_played, 0) as m, coalesce(s.passes_completed, 0) as pc,
    coalesce(s.tackles, 0) + coalesce(s.interceptions, 0) + coalesce(s.clearances, 0) as da, coalesce(s.shots, 0) as sh, coalesce(s.goals, 0) + coalesce(s.assists, 0) as gi,
    coalesce(s.shots, 0) + coalesce(s.dribbles, 0) + coalesce(s.crosses_attempted, 0) as aa, coalesce(s.fouls_committed, 0) + 3 * coalesce(s.yellow_cards, 0) + 6 * coalesce(s.red_cards, 0) as dp
  from player_match_stats_cleaned s left join games g on s.match_id = g.match_id left join players p on s.player_id = p.player_id),
y as (select *, coalesce(home, false) as h, coalesce(case when coalesce(home, false) then hs else aws end, 0) as gf, coalesce(case when coalesce(home, false) then aws else hs end, 0) as ga from z)"""


@query(f"""{_ROLE} select row_id, cast(h as int) as team_is_home, case when h then awt else ht end as opponent_team_id, gf - ga as team_goal_diff,
  case when gf > ga then 3 when gf = ga then 1 else 0 end as team_result_points, cast(ga = 0 as int) as team_clean_sheet,
  round(case pos when 'GK' then cast(ga = 0 as int) + m / 120.0::double when 'DEF' then da + cast(ga = 0 as int) when 'MID' then pc / 40 + (aa + da - dp) / 10 when 'FW' then sh + gi else (aa + da - dp) / 10 end, 6) + 0.0 as role_fit_score from y""")
def role_fit_case(spark, d):
    g = games(spark, d).select("match_id", "home_team_id", "away_team_id", "home_score", "away_score")
    x = stats(spark, d).join(g, "match_id", "left").join(players(spark, d).select("player_id", "position_group"), "player_id", "left")
    x = features.role_fit(features.match_role(features.efficiency(x.withColumn("position_group", F.coalesce("position_group", F.lit("UNK"))))))
    return x.select("row_id", "team_is_home", "opponent_team_id", "team_goal_diff", "team_result_points", "team_clean_sheet", F.col("role_fit_score"))


_S = "player_season_stats_cleaned"


@query(f"""with z as (select row_id, coalesce(minutes_played, 0) as m, coalesce(matches_played, 0) as n, coalesce(goals, 0) as g, coalesce(shots, 0) as s, coalesce(passes_completed, 0) as pc, coalesce(passes_attempted, 0) as pa, coalesce(tackles, 0) + coalesce(interceptions, 0) as da from {_S})
select row_id, round(coalesce(m / nullif(n, 0), 0), 6) + 0.0 as minutes_per_match, round(greatest(least(n / 38, 1), 0), 6) + 0.0 as availability_rate, round(coalesce(g * 90 / nullif(m, 0), 0), 6) + 0.0 as goals_per90,
  round(coalesce(g / nullif(n, 0), 0), 6) + 0.0 as goals_per_match, round(coalesce(pc / nullif(pa, 0), 0), 6) + 0.0 as pass_completion_rate, da as defensive_actions from z""")
def season_features(spark, d):
    x = features.season_features(table(spark, d, _S))
    r = ("minutes_per_match", "availability_rate", "goals_per90", "goals_per_match", "pass_completion_rate")
    return x.select("row_id", *[F.col(c) for c in r], "defensive_actions")


@query(f"""with {G} select s.player_id, g.season, count(distinct s.match_id) as matches_played, cast(coalesce(sum(minutes_played), 0) as bigint) as minutes_played, cast(coalesce(sum(goals), 0) as bigint) as goals,
  cast(coalesce(sum(assists), 0) as bigint) as assists, cast(coalesce(sum(shots), 0) as bigint) as shots from player_match_stats_cleaned s join games g on s.match_id = g.match_id where {_markers("g.season")} is not null group by 1, 2""")
def season_rollup(spark, d):
    g = games(spark, d).select("match_id", null_if_missing(F.col("season")).alias("season")).filter("season is not null")
    x = stats(spark, d).join(g, "match_id").groupBy("player_id", "season")
    return x.agg(F.count_distinct("match_id").alias("matches_played"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("minutes_played", "goals", "assists", "shots")])


_KEEP = f"""with {G}, {P}, z as (select s.player_id, g.season, s.match_id, s.minutes_played as m, coalesce(case when coalesce(s.team_id = g.home_team_id, false) then g.away_score else g.home_score end, 0) as ga
  from player_match_stats_cleaned s join games g on s.match_id = g.match_id join players p on s.player_id = p.player_id where {_POS.format(c="p.position")} = 'GK'),
k as (select player_id, season, count(distinct match_id) as matches, cast(coalesce(sum(m), 0) as bigint) as minutes, cast(sum(ga) as bigint) as goals_conceded, cast(sum(cast(ga = 0 as int)) as bigint) as clean_sheets from z group by 1, 2)"""


@query(f"""{_KEEP} select player_id, season, matches, minutes, goals_conceded, clean_sheets, round(clean_sheets / greatest(matches, 1), 4) as clean_sheet_rate,
  round(goals_conceded / greatest(matches, 1), 4) as goals_conceded_per_match from k""")
def keeper_rollup(spark, d):
    keepers = players(spark, d).filter("position_group = 'GK'").select("player_id")
    g = games(spark, d).select("match_id", "season", "home_team_id", "away_team_id", "home_score", "away_score")
    x = features.match_role(stats(spark, d).select("player_id", "match_id", "team_id", "minutes_played").join(keepers, "player_id").join(g, "match_id"))
    k = x.groupBy("player_id", "season").agg(
        F.count_distinct("match_id").alias("matches"), F.coalesce(F.sum("minutes_played"), F.lit(0)).alias("minutes"),
        F.sum("team_goals_against").alias("goals_conceded"), F.sum(F.col("team_clean_sheet").cast("long")).alias("clean_sheets"),
    )
    k = features.keeper_features(k.withColumns({c: F.lit(0) for c in ("saves", "penalty_saves", "punches")}))
    return k.select("player_id", "season", "matches", "minutes", "goals_conceded", "clean_sheets", F.round("clean_sheet_rate", 4).alias("clean_sheet_rate"), F.round("goals_conceded_per_match", 4).alias("goals_conceded_per_match"))


_POSS = "round(" + _SHARE.format(c="possession_{s}") + ", 4)"


@query(f"""with {G}, p as (select match_id, home_team_id, away_team_id, {_POSS.format(s="home")} as ph, {_POSS.format(s="away")} as pa from games),
z as (select s.*, case when s.team_id = p.home_team_id then ph when s.team_id = p.away_team_id then pa end as own, case when s.team_id = p.home_team_id then pa when s.team_id = p.away_team_id then ph end as opp,
  avg(case when isnan(distance_covered) then null else distance_covered end) over (partition by s.player_id) as md from player_match_stats_cleaned s left join p on s.match_id = p.match_id)
select row_id, floor((0.05::double * passes_completed + 0.07::double * dribbles) * 1e4 + 1e-6) / 1e4 as expected_threat_total,
  floor((passes_completed + dribbles + tackles_won + interceptions - fouls_committed) * 1e4 + 1e-6) / 1e4 as vaep_rating,
  floor((0.1::double * passes_attempted * coalesce(pass_accuracy, passes_completed / nullif(passes_attempted, 0))) * 1e4 + 1e-6) / 1e4 as expected_assists,
  floor((distance_covered * passes_completed / nullif(passes_attempted, 0)) * 1e4 + 1e-6) / 1e4 as progressive_pass_dist,
  floor(((tackles + interceptions + clearances) / nullif(distance_covered, 0)) * 1e4 + 1e-6) / 1e4 as defensive_action_height,
  floor((opp / nullif(tackles + interceptions + fouls_committed, 0)) * 1e4 + 1e-6) / 1e4 as pressing_intensity,
  floor((distance_covered / nullif(md, 0)) * 1e4 + 1e-6) / 1e4 as acwr_index,
  floor((15.48::double * top_speed * distance_covered / nullif(60 * minutes_played, 0)) * 1e4 + 1e-6) / 1e4 as metabolic_power,
  floor((fouls_committed + 3 * yellow_cards + 6 * red_cards) * 1e4 + 1e-6) / 1e4 as foul_severity_index,
  floor(((passes_attempted + dribbles) / nullif(own * minutes_played, 0)) * 1e4 + 1e-6) / 1e4 as possession_involvement from z""")
def metric_catalog_m1_m10(spark, d):
    g = games(spark, d).select("match_id", "home_team_id", "away_team_id", X.pct_to_decimal(F.col("possession_home")).alias("possession_home"), X.pct_to_decimal(F.col("possession_away")).alias("possession_away"))
    own = [m for m in metrics.catalog() if m.column is not None]
    x = metrics.with_possession(stats(spark, d), g)
    # cut, not rounded: quotients of few digits lie between two roundings
    return x.select("row_id", *[_cut(m.column, m.name) for m in own])


@query()
def metric_catalog_table(spark, d):
    return metrics.catalog_table(spark)


# --- imputation

_COUNTS = ["minutes_played", "goals", "assists", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "tackles_won"]
_HARD = """h1 as (select row_id, player_id, match_id, """ + ", ".join(f"case when {c} >= 0 then {c} end as {c}" for c in _COUNTS) + """, shots_off_target, shots_blocked, tackles_lost, touches, dribbles, interceptions, clearances,
  case when pass_accuracy > 1 then pass_accuracy / 100 else pass_accuracy end as acc from player_match_stats_cleaned),
hard as (select * exclude (acc, passes_completed, passes_attempted, shots, shots_on_target, tackles, tackles_won), case when acc between 0 and 1 then acc end as pass_accuracy,
  case when not coalesce(passes_completed > passes_attempted, false) then passes_completed end as passes_completed, case when not coalesce(passes_completed > passes_attempted, false) then passes_attempted end as passes_attempted,
  case when not coalesce(shots_on_target > shots, false) then shots end as shots, case when not coalesce(shots_on_target > shots, false) then shots_on_target end as shots_on_target,
  case when not coalesce(tackles_won > tackles, false) then tackles end as tackles, case when not coalesce(tackles_won > tackles, false) then tackles_won end as tackles_won from h1)"""


@query(f"with {_HARD} select row_id, minutes_played, goals, shots, shots_on_target, passes_completed, passes_attempted, tackles, tackles_won, pass_accuracy from hard")
def hard_normalise(spark, d):
    return impute.hard_normalise(stats(spark, d), _COUNTS).select("row_id", "minutes_played", "goals", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "tackles_won", "pass_accuracy")


_TOUCH = ("passes_attempted", "shots", "dribbles", "tackles", "interceptions", "clearances")
_FORMULA = f"""{_HARD}, f as (select row_id,
  case when shots_off_target is null and shots is not null and shots_on_target is not null then greatest(shots - shots_on_target - coalesce(shots_blocked, 0), 0) end as f1,
  case when pass_accuracy is null then round(passes_completed / nullif(passes_attempted, 0), 4) end as f2,
  case when tackles_lost is null and tackles >= tackles_won then tackles - tackles_won end as f3,
  case when touches is null and coalesce({", ".join(_TOUCH)}) is not null then {" + ".join(f"coalesce({c}, 0)" for c in _TOUCH)} end as f4 from hard)"""


def _filled(spark, d):
    return impute.fill_missing(impute.hard_normalise(stats(spark, d), _COUNTS), impute.formula_fills())


@query(f"""with {_FORMULA} select row_id, 'shots_off_target' as column_name, cast(f1 as double) as value, 'shots less those on target and blocked' as reason from f where f1 is not null
union all select row_id, 'pass_accuracy', f2, 'completed by attempted' from f where f2 is not null union all select row_id, 'tackles_lost', f3, 'tackles less those won' from f where f3 is not null
union all select row_id, 'touches', f4, 'sum of known actions' from f where f4 is not null""")
def formula_fill_log(spark, d):
    return impute.change_log(_filled(spark, d), "row_id", list(impute.formula_fills()))


@query(f"""with {P}, x as (select s.row_id, s.player_id, s.shots, s.minutes_played as m, {_POS.format(c="p.position")} as pos from player_match_stats_cleaned s left join players p on s.player_id = p.player_id),
r as (select *, shots * 90 / m as r from x where m > 0 and shots is not null), a as (select player_id, median(r) as v from r group by 1), b as (select pos, median(r) as v from r group by 1), c as (select median(r) as v from r)
select x.row_id, coalesce(x.shots, cast(round_even(coalesce(a.v, b.v, c.v) * x.m / 90, 0) as bigint)) as shots_cascade from x left join a on x.player_id = a.player_id left join b on x.pos = b.pos cross join c""")
def impute_cascade(spark, d):
    p = players(spark, d).select("player_id", "position_group")
    context = {"position_group": lambda x: x.join(p, "player_id", "left").withColumn("position_group", F.coalesce("position_group", F.lit("UNK")))}
    x = stats(spark, d).select("row_id", "player_id", "shots", "minutes_played")
    return impute.per90_cascade(x, "shots", [["player_id"], ["position_group"], []], context=context).select("row_id", "shots_cascade")


@query(f"select row_id, coalesce(passes_attempted, passes_completed) as passes_attempted, coalesce(shots, shots_on_target) as shots from {_S}")
def lower_bound_fill(spark, d):
    s = table(spark, d, _S)
    return s.select("row_id", impute.lower_bound(F.col("passes_attempted"), F.col("passes_completed")).alias("passes_attempted"), impute.lower_bound(F.col("shots"), F.col("shots_on_target")).alias("shots"))


@query(f"""with {G} select match_id, coalesce({_markers("stadium")}, home_team_id || ' Stadium') as stadium, coalesce({_markers("city")}, {_markers("country")}, 'Unknown') as city, coalesce({_markers("referee")}, 'Unknown') as referee from games""")
def constant_fills(spark, d):
    g = {c: null_if_missing(F.col(c)) for c in ("stadium", "city", "country", "referee")}
    return games(spark, d).select("match_id", F.coalesce(g["stadium"], F.concat("home_team_id", F.lit(" Stadium"))).alias("stadium"), F.coalesce(g["city"], g["country"], F.lit("Unknown")).alias("city"), F.coalesce(g["referee"], F.lit("Unknown")).alias("referee"))


@query()
def hashed_draws(spark, d):
    """The opt-in stochastic tier: profiles and goals drawn from hashes."""
    x = impute.generate_profile(players(spark, d), "player_id", "position_group")
    return x.select("player_id", "age", "height_cm", "weight_kg", "profile_data_source", impute.draw_goals(F.col("position_group"), 7, F.col("player_id")).alias("goals_draw"),
                    impute.binomial(11, F.lit(5), 0.38, 10, F.col("player_id")).alias("on_target_draw"), impute.poisson(impute.uniform(13, F.col("player_id")), F.lit(2.2)).alias("saves_draw"))

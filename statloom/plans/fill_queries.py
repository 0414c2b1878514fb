"""Queries of the fills, the generated tier and the remaining gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import text as X
from statloom.functions.dates import parse_date
from statloom.operators import features, generate, impute, matching, quality
from statloom.operators.relational import keep_one
from statloom.plans.match_queries import _POS, G, P, _markers, games, players, stats
from statloom.session import even_join, salted_join, table

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


_NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'))"
_M = "player_match_stats_cleaned"

# --- fills


_SEASON = {"matches_played": "match_played", "minutes_played": "minutes_played", "goals": "goals", "assists": "assists"}
_FIELDS = [*_SEASON, "passes_attempted", "shots"]


def _season_sql() -> str:
    mid = ", ".join(f"round_even(median({src}), 0) as {c}" for c, src in _SEASON.items())
    value = {c: f"coalesce(s.{c}, pr.{src}, g.{c}, t.{c})" for c, src in _SEASON.items()} | {"passes_attempted": "coalesce(s.passes_attempted, s.passes_completed)", "shots": "coalesce(s.shots, s.shots_on_target)"}
    reason = {
        c: f"case when s.{c} is not null then null when pr.{src} is not null then 'same name in the prior' when coalesce(g.{c}, t.{c}) is not null then 'median of the position' end"
        for c, src in _SEASON.items()
    } | {w: f"case when s.{w} is null and s.{p} is not null then 'lower bound' end" for w, p in (("passes_attempted", "passes_completed"), ("shots", "shots_on_target"))}
    return f"""with {P}, k as (select *, {_NORM.format(c='player_name')} as player_key, {_POS.format(c='position')} as grp from key_stats),
pr as (select * from k where player_key <> '' qualify row_number() over (partition by player_key order by record_id) = 1),
g as (select grp, {mid} from k group by grp), t as (select {mid} from k)
select s.row_id, {", ".join(f"cast({value[c]} as bigint) as {c}, {reason[c]} as {c}_reason" for c in _FIELDS)}
from player_season_stats_cleaned s left join players p on s.player_id = p.player_id
left join pr on pr.player_key = {_NORM.format(c='p.player_name')} left join g on g.grp = {_POS.format(c='p.position')} cross join t"""


@query(_season_sql())
def season_totals_fill(spark, d):
    """Lower bounds, prior of the same name, median of the position."""
    p = players(spark, d).select("player_id", X.soft_norm(F.col("player_name")).alias("player_key"), "position_group")
    k = table(spark, d, "key_stats").select("*", X.soft_norm(F.col("player_name")).alias("player_key"), X.position_code(F.col("position")).alias("position_group"))
    s = salted_join(table(spark, d, "player_season_stats_cleaned").drop("player_key"), p, ["player_id"], "row_id", "left").withColumn("position_group", F.coalesce("position_group", F.lit("UNK")))
    return impute.season_totals(s, k, [F.col("record_id")], _SEASON).select("row_id", *[x for c in _FIELDS for x in (c, f"{c}_reason")])


@query(f"""with k as (select *, {_NORM.format(c='player_name')} as player_key from key_stats qualify row_number() over (partition by {_NORM.format(c='player_name')} order by record_id) = 1)
select p.row_id, case when {_markers('p.position')} is null and k.position is not null then k.position else p.position end as position,
  case when {_markers('p.position')} is null and k.position is not null then 'same name in the prior' end as position_reason
from players_cleaned p left join k on k.player_key = {_NORM.format(c='p.player_name')} and k.player_key <> ''""")
def profile_prior_fill(spark, d):
    """Profiles only from rows of exactly the same name, no medians."""
    p, k = table(spark, d, "players_cleaned").select("row_id", "player_name", "position"), table(spark, d, "key_stats")
    return impute.prior_fill(p, X.soft_norm(F.col("player_name")), k, X.soft_norm(F.col("player_name")), [F.col("record_id")], {"position": "position"}).drop("player_name")


@query(f"""with t as (select *, {_NORM.format(c='team_name')} as k from teams_cleaned),
h as (select k, arg_max(country, row_id) as country from t where {_markers('country')} is not null and k <> '' group by k)
select t.row_id, case when {_markers('t.country')} is null and h.country is not null then h.country else t.country end as country,
  case when {_markers('t.country')} is null and h.country is not null then 'a row of the same name' end as country_reason
from t left join h on t.k = h.k""")
def country_donor_fill(spark, d):
    """The country from another row of the same name."""
    t = table(spark, d, "teams_cleaned").select("row_id", "team_name", "country")
    return impute.donor_fill(t, X.soft_norm(F.col("team_name")), "country", F.col("row_id")).drop("team_name")


_MEDIANS = ("goals", "shots", "tackles", "distance_covered", "pass_accuracy")


@query(f"with m as (select {', '.join(f'median({c}) filter (not isnan({c})) as m_{c}' if c in ('distance_covered', 'pass_accuracy') else f'median({c}) as m_{c}' for c in _MEDIANS)} from {_M}) select row_id, "
       + ", ".join(f"case when {c} is null or isnan({c}) then m_{c} else {c} end as {c}" if c in ("distance_covered", "pass_accuracy") else f"coalesce({c}, cast(round_even(m_{c}, 0) as bigint)) as {c}" for c in _MEDIANS) + f" from {_M}, m")
def median_fill(spark, d):
    return impute.median_fill(stats(spark, d).select("row_id", *_MEDIANS), list(_MEDIANS))


@query(f"""with {P}, g as (select g.*, coalesce({_markers('g.goal_type')}, 'regular') as gt, p.player_name as pn from goals_events_cleaned g left join players p on g.player_id = p.player_id)
select row_id, coalesce({_markers('player_name')}, {_markers('pn')}) as player_name, coalesce({_markers('event_type')}, 'goal') as event_type, gt as goal_type,
  coalesce(is_penalty, contains(lower(gt), 'penalty')) as is_penalty, coalesce(is_own_goal, contains(lower(gt), 'own')) as is_own_goal from g""")
def goal_row_fills(spark, d):
    """I10, I12."""
    x = impute.goal_rows(table(spark, d, "goals_events_cleaned"), players(spark, d))
    return x.select("row_id", "player_name", "event_type", "goal_type", "is_penalty", "is_own_goal")


@query(f"""with {G} select match_id, coalesce({_markers('date')}, '01-07-' || coalesce(nullif(regexp_extract(season, '((?:19|20)[0-9]{{2}})', 1), ''), '2021')) as date,
  coalesce({_markers("stadium")}, home_team_id || ' Stadium') as stadium, coalesce({_markers("city")}, {_markers("country")}, 'Unknown') as city,
  coalesce({_markers("country")}, 'Unknown') as country, coalesce({_markers("referee")}, 'Unknown') as referee from games""")
def match_defaults(spark, d):
    """I24."""
    return impute.match_defaults(games(spark, d)).select("match_id", "date", "stadium", "city", "country", "referee")


@query(f"""with s as (select home_team_id as team_id, 0 as side, row_id, country from matches_cleaned union all select away_team_id, 1, row_id, country from matches_cleaned),
l as (select team_id, country as land from s where team_id is not null and {_markers('country')} is not null qualify row_number() over (partition by team_id order by side, row_id) = 1),
t as (select * from teams_cleaned qualify row_number() over (partition by team_id order by row_id) = 1),
x as (select t.*, coalesce({_markers('t.country')}, l.land, 'Unknown') as c from t left join l on t.team_id = l.team_id)
select team_id, c as country, coalesce({_markers('logo')}, 'generated://team-logo/' || team_id) as logo,
  coalesce(nullif(regexp_replace(regexp_replace(lower(team_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as team_slug from x""")
def complete_teams(spark, d):
    """I23; the region, told by a list of countries, is tested on a fixture."""
    return impute.complete_teams(table(spark, d, "teams_cleaned"), table(spark, d, "matches_cleaned")).select("team_id", "country", "logo", "team_slug")


# --- the generated tier


def _generated(spark, d):
    p = players(spark, d).select("player_id", "position_group", "age", "weight_kg")
    x = salted_join(stats(spark, d), p, ["player_id"], "row_id", "left")
    return generate.generate_match_stats(salted_join(x, generate.observed_counts(table(spark, d, "goals_events_cleaned")), ["player_id", "match_id"], "row_id", "left"))


_OBSERVED = ("goals", "assists")


@query(f"""with g as (select * from goals_events_cleaned where lower(event_type) = 'goal'),
a as (select player_id, match_id, count(*) as n from g where player_id is not null and match_id is not null group by 1, 2),
b as (select assist_player_id as player_id, match_id, count(*) as n from g where assist_player_id is not null and match_id is not null group by 1, 2)
select s.row_id, coalesce(s.goals, a.n) as goals, coalesce(s.assists, b.n) as assists from {_M} s
left join a on s.player_id = a.player_id and s.match_id = a.match_id left join b on s.player_id = b.player_id and s.match_id = b.match_id""")
def observed_override(spark, d):
    """What events tell comes before what is drawn; without either a cell stays missing."""
    o = generate.observed_counts(table(spark, d, "goals_events_cleaned"))
    x = salted_join(stats(spark, d).select("row_id", "player_id", "match_id", *_OBSERVED), o, ["player_id", "match_id"], "row_id", "left")
    return x.select("row_id", *[F.coalesce(c, f"observed_{c}").alias(c) for c in _OBSERVED])


@query()
def generated_match_stats(spark, d):
    """I14 to I20 applied: every missing statistic drawn, with the columns that were."""
    own = ["minutes_played", *generate.DRAWS, "shots_on_target", "shots_blocked", "shots_off_target", "passes_completed", "pass_accuracy", "crosses_completed", "tackles_won", "tackles_lost", "yellow_cards", "red_cards", "distance_covered", "top_speed", "touches"]
    return _generated(spark, d).select("row_id", *own, "generated")


@query(f"""select row_id, cast(round_even(1.4 * coalesce(passes_attempted, 0) + coalesce(shots, 0) + coalesce(dribbles, 0) + coalesce(tackles, 0) + coalesce(interceptions, 0) + coalesce(clearances, 0) + coalesce(crosses_attempted, 0), 0) as bigint) as touches from {_M}""")
def touches_formula(spark, d):
    """I19."""
    return stats(spark, d).select("row_id", generate.touches("shots", "dribbles", "tackles", "interceptions", "clearances", "crosses_attempted").alias("touches"))


_PACE = "case grp " + " ".join(f"when '{g}' then {v}" for g, v in generate.METRES.items()) + " end"


@query(f"""with {P}, x as (select s.row_id, greatest(coalesce(s.minutes_played, 0), 1) as m, coalesce({_POS.format(c='p.position')}, 'UNK') as grp, coalesce(p.age, 26) as age from {_M} s left join players p on s.player_id = p.player_id),
y as (select row_id, m, m * {_PACE} * least(greatest(1 - abs(age - 27) * 0.006, 0.82), 1.06) as dist from x)
select row_id, cast(round_even(least(greatest(case when m < 45 then least(greatest(dist, 1000), 6000) else least(greatest(dist, 5000), 13000) end, 600), 13000), 0) as bigint) as metres from y""")
def distance_model(spark, d):
    """I18, the part that isn't drawn."""
    p = players(spark, d).select("player_id", "position_group", "age")
    x = salted_join(stats(spark, d).select("row_id", "player_id", "minutes_played"), p, ["player_id"], "row_id", "left")
    played = F.greatest(F.coalesce("minutes_played", F.lit(0)), F.lit(1))
    return x.select("row_id", generate.distance(played, F.coalesce("position_group", F.lit("UNK")), F.coalesce("age", F.lit(26)).cast("double")).alias("metres"))


@query()
def generated_keeper_stats(spark, d):
    """I22 applied: saves, penalty saves and punches of each keeper's match."""
    k = stats(spark, d).join(players(spark, d).filter("position_group = 'GK'").select("player_id"), "player_id")
    g = games(spark, d).select("match_id", "home_team_id", "away_team_id", "home_score", "away_score")
    x = k.select("row_id", "match_id", "team_id").join(g, "match_id")
    conceded = F.coalesce(F.when(F.coalesce(F.col("team_id") == F.col("home_team_id"), F.lit(False)), F.col("away_score")).otherwise(F.col("home_score")), F.lit(0))
    return generate.generate_keeper_stats(x, conceded, F.col("row_id")).select("row_id", conceded.alias("goals_conceded"), "saves", "penalty_saves", "punches")


# --- filters and gates


_NEED = ("referee", "stadium", "city", "country")


@query(f"""with {G}, s as (select match_id, coalesce(sum(shots), 0) + coalesce(sum(fouls_committed), 0) as n from {_M} group by 1)
select g.match_id from games g left join s on g.match_id = s.match_id where {" or ".join(f"{_markers('g.' + c)} is null" for c in _NEED)} or g.referee = '0' or g.stadium = '0' or g.city = '0' or coalesce(s.n, 0) = 0""")
def needs_enrichment(spark, d):
    """F7."""
    return quality.needs_enrichment(games(spark, d), stats(spark, d), list(_NEED), ["referee", "stadium", "city"], ["shots", "fouls_committed"]).select("match_id")


@query(f"""select row_id, player_id from players_cleaned where {_markers('nationality')} is null or {_markers('position')} is null or height_cm is null or isnan(height_cm) order by row_id limit 100""")
def incomplete_head(spark, d):
    """the limit is the feature, a batch to look up."""
    return quality.incomplete_head(table(spark, d, "players_cleaned"), ["nationality", "position", "height_cm"], ["row_id"]).select("row_id", "player_id")


_ZERO = ("shots_blocked", "crosses_completed", "crosses_attempted", "dribbles", "offsides", "tackles_won", "tackles_lost", "clearances", "fouls_suffered")


@query("select row_id, " + ", ".join(f"case when (select max(abs({c})) from {_M}) <> 0 then {c} end as {c}" for c in _ZERO) + f" from {_M}")
def nullify_fake_zeros(spark, d):
    """F9."""
    return quality.nullify_fake_zeros(stats(spark, d).select("row_id", *_ZERO), list(_ZERO))


_WHOLE = {"teams_cleaned": ("team_id", "team_name", "country", "logo"), "players_cleaned": ("player_id", "player_name", "nationality", "position", "team_id")}


@query(" union all ".join(f"select '{t}' as table_name, count(*) * {len(cs)} as cells, " + " + ".join(f"count({_markers(c)})" for c in cs) + f" as present, round(({' + '.join(f'count({_markers(c)})' for c in cs)}) / (count(*) * {len(cs)}), 6) as share from {t}" for t, cs in _WHOLE.items()))
def table_completeness(spark, d):
    """A12, A25."""
    parts = [quality.table_completeness(table(spark, d, t).select(*cs)).withColumn("table_name", F.lit(t)) for t, cs in _WHOLE.items()]
    return parts[0].unionByName(parts[1])


_COVER = ("referee", "stadium", "city", "country", "possession_home", "possession_away")


@query(f"""with n as (select count(*) as total from matches_cleaned), s as (select count(distinct match_id) as ps, count(*) filter (assists <> 0) as assists, count(*) filter (not isnan(top_speed) and top_speed <> 0) as top_speed,
  count(*) filter (not isnan(distance_covered) and distance_covered <> 0) as distance_covered from {_M})
""" + " union all ".join(f"select '{c}' as field, count({_markers(c)}) as filled, count(*) - count({_markers(c)}) as missing, round(100.0 * count({_markers(c)}) / count(*), 1) as pct from matches_cleaned" for c in _COVER)
       + " union all select 'player_stats', ps, total - ps, round(100.0 * ps / total, 1) from n, s" + "".join(f" union all select 'stat_{c}', {c}, total - {c}, null from n, s" for c in ("assists", "top_speed", "distance_covered"))
       + " union all select 'records', total + ps, greatest(0, 1500000 - total - ps), round(100.0 * (total + ps) / 1500000, 1) from n, s")
def coverage_report(spark, d):
    """A19."""
    return quality.coverage_report(table(spark, d, "matches_cleaned"), stats(spark, d), list(_COVER), ["assists", "top_speed", "distance_covered"])


@query("select player_id, season, count(*) as rows from player_season_stats_cleaned group by 1, 2 having count(*) > 1 order by player_id nulls first, season nulls first limit 20")
def duplicate_examples(spark, d):
    """The first twenty keys that more than one row has."""
    return quality.duplicate_examples(table(spark, d, "player_season_stats_cleaned"), ["player_id", "season"])


@query(f"""with x as (select count(*) as rows, {" + ".join(f"cast(count(*) - count({_markers(c)}) > 0.0025 * count(*) as int)" for c in ("team_id", "team_name", "country"))} as columns_failed,
  count(*) - (select count(*) from (select distinct team_id from teams_cleaned)) as duplicate_rows from teams_cleaned)
select *, cast(rows >= 1500 and columns_failed = 0 and duplicate_rows = 0 as int) as passed from x""")
def fast_gate(spark, d):
    """G9."""
    return quality.fast_gate(table(spark, d, "teams_cleaned").select("team_id", "team_name", "country"), ["team_id"], least=1500)


_COUNTS = ("matches_played", "minutes_played", "goals", "shots", "tackles")


@query(" union all ".join([f"select row_id, 'negative_{c}' as rule from player_season_stats_cleaned where {c} < 0" for c in _COUNTS] + ["select row_id, 'completed_above_attempted' from player_season_stats_cleaned where passes_completed > passes_attempted", "select row_id, 'on_target_above_shots' from player_season_stats_cleaned where shots_on_target > shots"]))
def season_anomaly_rules(spark, d):
    """G2, G5; that counts of fractions are found is tested on a fixture."""
    return quality.anomalies(table(spark, d, "player_season_stats_cleaned"), ["row_id"], quality.season_stats_rules(list(_COUNTS)))


_WORDS = "list_filter(string_split({c}, ' '), lambda w: w not in ('fc', 'cf', 'ac', 'sc', 'rb', 'bv', 'sl', 'de', 'as', 'us', 'ss', 'sb', 'cl', ''))"
_ALIKE = "({a} = {b} or contains({a}, {b}) or contains({b}, {a}) or len(list_intersect(" + _WORDS.format(c="{a}") + ", " + _WORDS.format(c="{b}") + ")) > 0)"


@query(f"""with {G}, t as (select team_id, team_name from teams_cleaned qualify row_number() over (partition by team_id order by row_id) = 1),
g as (select g.match_id, g.date, coalesce({_NORM.format(c='h.team_name')}, '') as h, coalesce({_NORM.format(c='a.team_name')}, '') as a from games g join t h on g.home_team_id = h.team_id join t a on g.away_team_id = a.team_id where g.date is not null),
l as (select listing_id, listed_date, coalesce({_NORM.format(c='home_name')}, '') as lh, coalesce({_NORM.format(c='away_name')}, '') as la from fixture_listings),
x as (select match_id, listing_id, case when {_ALIKE.format(a='h', b='lh')} and {_ALIKE.format(a='a', b='la')} then 2 when {_ALIKE.format(a='h', b='la')} and {_ALIKE.format(a='a', b='lh')} then 1 else 0 end as score from g join l on g.date = l.listed_date)
select match_id, arg_min(listing_id, struct_pack(s := -score, l := listing_id)) as listing_id, max(score) as score from x where score > 0 group by 1""")
def oriented_listing(spark, d):
    """Of the listings of the same date text the one that fits best, as listed (2) or the other way round (1)."""
    t = table(spark, d, "teams_cleaned")
    names = keep_one(t, ["team_id"], [F.col("row_id")]).select("team_id", "team_name")
    g = games(spark, d).filter("date is not null").select("match_id", "date", "home_team_id", "away_team_id")
    for side in ("home", "away"):
        g = g.join(names.select(F.col("team_id").alias(f"{side}_team_id"), F.coalesce("team_name", F.lit("")).alias(side)), f"{side}_team_id")
    own = table(spark, d, "fixture_listings").select("listing_id", F.col("listed_date").alias("date"), F.coalesce("home_name", F.lit("")).alias("lh"), F.coalesce("away_name", F.lit("")).alias("la"))
    x = g.join(own, "date").withColumn("score", matching.orientation(F.col("home"), F.col("away"), F.col("lh"), F.col("la"))).filter("score > 0")
    return x.groupBy("match_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "listing_id"))["listing_id"].alias("listing_id"), F.max("score").alias("score"))


# --- complete feature tables: what they take from other tables


_T = "teams as (select * from teams_cleaned qualify row_number() over (partition by team_id order by row_id) = 1)"
_PROFILE = f"""ctx as (select player_id, coalesce(cast(age as double), 26.0) as age, case when height_cm is null or isnan(height_cm) then 180.0 else height_cm end as h,
  case when weight_kg is null or isnan(weight_kg) then 75.0 else weight_kg end as w, {_POS.format(c='position')} as grp from players where player_id is not null)"""


def _teams(spark, d):
    return keep_one(table(spark, d, "teams_cleaned"), ["team_id"], [F.col("row_id")])


@query(f"""with {G}, {_T}, x as (select g.match_id, coalesce(h.country, g.country) as hc, coalesce(a.country, g.country) as ac, coalesce(data_scope ilike '%domestic%', false) as dom
  from games g left join teams h on g.home_team_id = h.team_id left join teams a on g.away_team_id = a.team_id where g.match_id is not null)
select match_id, hc as home_team_country, ac as away_team_country, cast(hc is not distinct from ac as int) as same_country_match, cast(hc is not distinct from ac and dom as int) as country_derby_proxy from x""")
def match_features(spark, d):
    """D1 as a whole, the columns that come from the teams."""
    g = games(spark, d).filter("match_id is not null").withColumns({"day": parse_date(F.col("date")), "home_share": X.pct_to_decimal(F.col("possession_home")), "away_share": X.pct_to_decimal(F.col("possession_away"))})
    return features.match_features(g, _teams(spark, d)).select("match_id", "home_team_country", "away_team_country", "same_country_match", "country_derby_proxy")


@query(f"""with {G}, {P}, {_PROFILE}, x as (select o.row_id, o.goal_type, coalesce(assist_player_id, 'NO_ASSIST') as assist_player_id, coalesce(g.season, 'Unknown') as season, coalesce(g.competition, 'Unknown') as competition, coalesce(g.country, 'Unknown') as match_country,
  coalesce(c.age, 26.0) as player_age, coalesce(c.h, 180.0) as player_height_cm, coalesce(c.w, 75.0) as player_weight_kg, coalesce(c.grp, 'UNK') as player_position_group
  from goals_events_cleaned o left join games g on o.match_id = g.match_id left join ctx c on o.player_id = c.player_id)
select * exclude (goal_type), round(round(player_weight_kg / nullif(player_height_cm / 100 * (player_height_cm / 100), 0), 4), 3) as player_bmi, cast(regexp_matches(competition, '(?i)premier league|england') as int) as is_english_league_event,
  round(greatest(least((coalesce(try_cast(nullif(regexp_extract(season, '((19|20)[0-9][0-9])', 1), '') as int), 2021) - 2004) / 21, 1), 0), 6) as event_recency_weight from x""")
def goal_features_whole(spark, d):
    """D2 as a whole, the columns that come from matches and players."""
    x = features.goal_event_features(table(spark, d, "goals_events_cleaned"), games(spark, d), players(spark, d)).withColumn("player_bmi", F.round("player_bmi", 3))
    return x.select("row_id", "assist_player_id", "season", "competition", "match_country", "player_age", "player_height_cm", "player_weight_kg", "player_position_group", "player_bmi", "is_english_league_event", "event_recency_weight")


@query(f"""with {P}, {_T}, c as (select player_id, coalesce(sum(minutes_played), 0) as m, coalesce(sum(goals), 0) as g, coalesce(sum(assists), 0) as a, coalesce(sum(shots), 0) as s, coalesce(sum(passes_completed), 0) as pc from {_M} group by 1),
q as (select player_id, count(distinct season) as seasons from player_season_stats_cleaned where season is not null group by 1),
e as (select player_id, count(*) filter (lower(event_type) = 'goal') as goals, count(*) filter (lower(goal_type) like '%header%') as headers from goals_events_cleaned group by 1),
x as (select p.player_id, coalesce(t.country, 'Unknown') as team_country, p.nationality, {_POS.format(c='p.position')} as grp, c.*, seasons, e.goals as eg, headers from players p left join teams t on p.team_id = t.team_id
  left join c on p.player_id = c.player_id left join q on p.player_id = q.player_id left join e on p.player_id = e.player_id where p.player_id is not null)
select player_id, team_country, cast(coalesce(nationality = team_country, false) as int) as nationality_matches_team_country, coalesce(seasons, 0) as player_seasons_count, coalesce(eg, 0) as observed_goal_events, coalesce(headers, 0) as observed_header_events,
  round(round(round(coalesce(g * 90 / nullif(m, 0), 0), 6) + 0.15 * round(coalesce(s * 90 / nullif(m, 0), 0), 6) + 0.5 * cast(grp = 'FW' as int), 6), 4) as scoring_profile_score,
  round(round(round(coalesce(a * 90 / nullif(m, 0), 0), 6) + 0.35 * cast(grp = 'MID' as int) + coalesce(pc, 0) / 10000, 6), 4) as creation_profile_score from x""")
def player_features_whole(spark, d):
    """D3 as a whole, the columns that come from other tables."""
    x = features.player_features(players(spark, d).filter("player_id is not null"), _teams(spark, d), stats(spark, d), table(spark, d, "player_season_stats_cleaned"), table(spark, d, "goals_events_cleaned"))
    return x.select("player_id", "team_country", "nationality_matches_team_country", "player_seasons_count", "observed_goal_events", "observed_header_events", *[F.round(c, 4).alias(c) for c in ("scoring_profile_score", "creation_profile_score")])


@query(f"""with {G}, {P}, {_PROFILE} select s.row_id, coalesce(g.season, 'Unknown') as season, coalesce(g.competition, 'Unknown') as competition, coalesce(c.grp, 'UNK') as player_position_group, coalesce(c.age, 26.0) as player_age,
  case when coalesce(s.team_id = g.home_team_id, false) then g.away_team_id else g.home_team_id end as opponent_team_id, cast(regexp_matches(coalesce(g.competition, 'Unknown'), '(?i)premier league|england') as int) as is_english_league_match
from {_M} s left join games g on s.match_id = g.match_id left join ctx c on s.player_id = c.player_id""")
def player_match_features(spark, d):
    """D4 as a whole, the columns that come from matches and players."""
    x = features.player_match_features(stats(spark, d), games(spark, d), players(spark, d))
    return x.select("row_id", "season", "competition", "player_position_group", "player_age", "opponent_team_id", "is_english_league_match")


@query(f"""with {P}, {_PROFILE} select s.row_id, coalesce(c.age, 26.0) as player_age, coalesce(c.grp, 'UNK') as player_position_group, cast(coalesce(c.age, 26.0) between 24 and 29 as int) as is_peak_age_season,
  coalesce(try_cast(nullif(regexp_extract(s.season, '((19|20)[0-9][0-9])', 1), '') as int), 2021) as season_start_year,
  round(round(coalesce((coalesce(goals, 0) + coalesce(assists, 0)) * 90 / nullif(coalesce(minutes_played, 0), 0), 0), 6), 4) + 0.0 as goal_involvements_per90 from player_season_stats_cleaned s left join ctx c on s.player_id = c.player_id""")
def player_season_features(spark, d):
    """D5 as a whole, the columns that come from players."""
    x = features.player_season_features(table(spark, d, "player_season_stats_cleaned"), players(spark, d))
    return x.select("row_id", "player_age", "player_position_group", "is_peak_age_season", "season_start_year", F.round("goal_involvements_per90", 4).alias("goal_involvements_per90"))


@query(f"""with {G}, {P}, {_PROFILE}, z as (select s.player_id, g.season, coalesce(case when coalesce(s.team_id = g.home_team_id, false) then g.away_score else g.home_score end, 0) as ga
  from {_M} s join games g on s.match_id = g.match_id join players p on s.player_id = p.player_id where {_POS.format(c='p.position')} = 'GK'),
k as (select player_id, season, sum(ga) as ga, count(*) filter (ga = 0) as cs from z group by 1, 2),
m as (select player_id, season, max(matches_played) as n, max(minutes_played) as m from player_season_stats_cleaned group by 1, 2),
x as (select k.*, greatest(coalesce(n, 1), 1) as n, m from k left join m on k.player_id = m.player_id and k.season = m.season)
select x.player_id, x.season, n as matches_played_proxy, greatest(coalesce(m, n * 90), 1) as minutes_played_proxy, round(round(ga / n, 6), 4) as goals_conceded_per_match, round(round(cs / n, 6), 4) as clean_sheet_rate,
  round(greatest(least((coalesce(c.h, 180.0) - 180) / 25, 1), 0) + greatest(least((coalesce(c.w, 75.0) - 75) / 25, 1), 0), 4) as keeper_physical_index, cast(coalesce(c.age, 26.0) between 27 and 34 as int) as prime_keeper_age_flag
from x left join ctx c on x.player_id = c.player_id""")
def goalkeeper_features(spark, d):
    """D6 as a whole with drawn saves, the columns that aren't drawn."""
    g = games(spark, d).select("match_id", "season", "home_team_id", "away_team_id", "home_score", "away_score")
    k = stats(spark, d).join(players(spark, d).filter("position_group = 'GK'").select("player_id"), "player_id").select("row_id", "player_id", "team_id", "match_id").join(g, "match_id")
    k = generate.generate_keeper_stats(features.match_role(k), F.col("team_goals_against"), F.col("row_id"))
    per = k.groupBy("player_id", "season").agg(F.sum("team_goals_against").alias("goals_conceded"), F.sum("team_clean_sheet").alias("clean_sheets"), *[F.sum(c).alias(c) for c in ("saves", "penalty_saves", "punches")])
    x = features.goalkeeper_features(per, table(spark, d, "player_season_stats_cleaned"), players(spark, d))
    return x.select("player_id", "season", "matches_played_proxy", "minutes_played_proxy", *[F.round(c, 4).alias(c) for c in ("goals_conceded_per_match", "clean_sheet_rate", "keeper_physical_index")], "prime_keeper_age_flag")


# --- exploration


_SPARSE = ("season", "referee", "stadium", "possession_home", "possession_away", "source")


@query(" union all ".join(f"select '{c}' as column_name, round(1 - count({_markers(c)}) / count(*), 6) as missing_share, cast(1 - count({_markers(c)}) / count(*) <= 0.9 as int) as kept from matches_cleaned" for c in _SPARSE)
       + " union all select 'deleted_at', round(1 - count(deleted_at) / count(*), 6), cast(1 - count(deleted_at) / count(*) <= 0.9 as int) from matches_cleaned")
def sparse_columns(spark, d):
    """Columns with more than nine tenths missing aren't kept."""
    return quality.sparse_columns(table(spark, d, "matches_cleaned").select(*_SPARSE, "deleted_at"))


@query(r"""select listing_id, try_cast(nullif(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 1), '') as int) as home, try_cast(nullif(regexp_extract(score, '([0-9]+)[^0-9]+([0-9]+)', 2), '') as int) as away from fixture_listings""")
def score_split(spark, d):
    """A score of any separator as two numbers."""
    s = X.split_score(F.col("score"))
    return table(spark, d, "fixture_listings").select("listing_id", s["home"].alias("home"), s["away"].alias("away"))


@query("select goal_type, count(*) as rows from goals_events_cleaned where goal_type is not null group by 1")
def chart_bars(spark, d):
    """K7: what a bar chart of goal types is drawn from."""
    return quality.bars(table(spark, d, "goals_events_cleaned"), "goal_type")


@query(f"""with b as (select unnest(generate_series(0, 12)) as bin), h as (select least(cast(floor(minutes_played * 13 / 130.0) as int), 12) as bin, count(*) as n from {_M} where minutes_played between 0 and 130 group by 1)
select cast(b.bin as int) as bin, b.bin * 10.0 :: double as starts, coalesce(n, 0) as rows from b left join h on b.bin = h.bin""")
def chart_histogram(spark, d):
    """K7: what a histogram of minutes is drawn from."""
    return quality.histogram(stats(spark, d), "minutes_played", 0, 130, 13)


@query("select r_regionkey, r_name from region")
def clean_table_hook(spark, d):
    """A table that needs no cleaning passes as it is."""
    from statloom.operators.relational import passthrough

    return passthrough(table(spark, d, "region"))


# --- cascades


_ACTIONS = ("passes_attempted", "passes_completed", "crosses_attempted", "dribbles", "tackles", "interceptions", "clearances", "fouls_committed", "fouls_suffered", "touches")


def _actions_sql() -> str:
    mid = ", ".join(f"median({c} * 90 / m) filter (m > 0) as {c}" for c in _ACTIONS)
    fill = ", ".join(f"coalesce(x.{c}, cast(round_even(b.{c} * x.m / 90, 0) as bigint)) as {c}" for c in _ACTIONS)
    return f"""with {P}, x as (select s.*, s.minutes_played as m, coalesce({_POS.format(c='p.position')}, 'UNK') as pos from {_M} s left join players p on s.player_id = p.player_id),
b as (select pos, {mid} from x group by pos) select x.row_id, {fill} from x left join b on x.pos = b.pos"""


@query(_actions_sql())
def action_medians_fill(spark, d):
    """Ten action columns from their position's median per 90 minutes."""
    p = players(spark, d).select("player_id", "position_group")
    x = salted_join(stats(spark, d).select("row_id", "player_id", "minutes_played", *_ACTIONS), p, ["player_id"], "row_id", "left").withColumn("position_group", F.coalesce("position_group", F.lit("UNK")))
    return impute.per90_medians(x, list(_ACTIONS), ["position_group"]).select("row_id", *_ACTIONS)


@query(f"""with {G}, {P}, x as (select s.row_id, s.player_id, s.tackles, s.minutes_played as m, g.season, {_POS.format(c='p.position')} as pos from {_M} s left join games g on s.match_id = g.match_id left join players p on s.player_id = p.player_id),
r as (select *, tackles * 90 / m as r from x where m > 0 and tackles is not null), a as (select player_id, season, median(r) as v from r group by 1, 2), b as (select season, median(r) as v from r group by 1), c as (select pos, median(r) as v from r group by 1), e as (select median(r) as v from r)
select x.row_id, coalesce(x.tackles, cast(round_even(coalesce(a.v, b.v, c.v, e.v) * x.m / 90, 0) as bigint)) as tackles_cascade
from x left join a on x.player_id = a.player_id and x.season = a.season left join b on x.season = b.season left join c on x.pos = c.pos cross join e""")
def season_cascade_fill(spark, d):
    """The player's rate of the season, then the season's, the position's and the overall median."""
    p, g = players(spark, d).select("player_id", "position_group").filter("player_id is not null"), games(spark, d).select("match_id", "season").filter("match_id is not null")
    context = {
        "season": lambda x: even_join(x, g, "match_id", "row_id"),
        "position_group": lambda x: salted_join(x, p, ["player_id"], "row_id", "left").withColumn("position_group", F.coalesce("position_group", F.lit("UNK"))),
    }
    x = stats(spark, d).select("row_id", "player_id", "match_id", "tackles", "minutes_played")
    return impute.per90_cascade(x, "tackles", [["player_id", "season"], ["season"], ["position_group"], []], context=context).select("row_id", "tackles_cascade")

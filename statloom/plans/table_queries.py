"""Relational, quality, parsing, reduction and extension queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import text as X
from statloom.functions.missing import SHORT_MARKERS, finite, is_missing, null_if_missing
from statloom.operators import matching, parse, quality, reduce, relational
from statloom.plans.match_queries import _POS, G, P, _markers, games, players, stats
from statloom.operators.features import matrix_features
from statloom.session import durable, table
from statloom.sources.sinks import nested_seasons
from statloom.streaming import merge as stream

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


# --- dedupe and merge


@query("select player_id, row_id, player_name, team_id from players_cleaned qualify row_number() over (partition by player_id order by row_id) = 1")
def keep_first_dedupe(spark, d):
    return relational.keep_one(table(spark, d, "players_cleaned"), ["player_id"], [F.col("row_id")]).select("player_id", "row_id", "player_name", "team_id")


@query("select player_id, season, row_id, goals from player_season_stats_cleaned qualify row_number() over (partition by player_id, season order by loaded_at desc nulls last, row_id desc) = 1")
def keep_last_dedupe(spark, d):
    s = table(spark, d, "player_season_stats_cleaned")
    return relational.keep_one(s, ["player_id", "season"], [F.col("loaded_at").desc_nulls_last(), F.col("row_id").desc()]).select("player_id", "season", "row_id", "goals")


_UNION = """select team_id, row_id, name, source from (
  select team_id, row_id, team_name as name, 'teams' as source, 0 as prio from teams_cleaned
  union all select home_team_id, row_id, null, 'home', 1 from matches_cleaned where home_team_id is not null
  union all select away_team_id, row_id, null, 'away', 2 from matches_cleaned where away_team_id is not null)"""


@query(_UNION + " qualify row_number() over (partition by team_id order by prio, row_id) = 1")
def priority_union_dedupe(spark, d):
    m = table(spark, d, "matches_cleaned")
    sides = [m.select(F.col(f"{s}_team_id").alias("team_id"), "row_id", F.lit(s).alias("source")).filter("team_id is not null") for s in ("home", "away")]
    t = table(spark, d, "teams_cleaned").select("team_id", "row_id", F.col("team_name").alias("name"), F.lit("teams").alias("source"))
    return relational.union_by_priority([t, *sides], ["team_id"], ["row_id"]).select("team_id", "row_id", "name", "source")


_FIRST = ", ".join(f"arg_min({c}, row_id) filter ({c} is not null) as {c}" for c in ("nationality", "position", "team_id"))
_LAST = ", ".join(f"arg_max({c}, row_id) filter ({c} is not null) as {c}" for c in ("minutes_played", "goals", "shots"))


@query(f"select player_id, {_FIRST} from players_cleaned group by 1")
def first_non_null_merge(spark, d):
    return relational.merge_non_null(table(spark, d, "players_cleaned"), ["player_id"], ["nationality", "position", "team_id"], F.col("row_id"))


@query(f"select player_id, season, {_LAST} from player_season_stats_cleaned group by 1, 2")
def last_non_null_merge(spark, d):
    return relational.merge_non_null(table(spark, d, "player_season_stats_cleaned"), ["player_id", "season"], ["minutes_played", "goals", "shots"], F.col("row_id"), last=True)


_SCORE = " + ".join(f"cast({c} is not null as int)" for c in ("nationality", "age", "position", "team_id"))


@query(f"""with s as (select *, -({_SCORE}) as s from players_cleaned)
select player_id, {", ".join(f"arg_min({c}, s * 1000000000000 + row_id) filter ({c} is not null) as {c}" for c in ("nationality", "age", "position", "team_id"))} from s group by 1""")
def best_row_merge(spark, d):
    return relational.best_row_merge(table(spark, d, "players_cleaned"), ["player_id"], ["nationality", "age", "position", "team_id"], "row_id")


_ALIAS = """x as (select distinct record_id as id, club as g, string_split(player_name, ' ')[-1] as last, len(string_split(player_name, ' ')) as n from key_stats where player_name is not null),
l as (select g, last, min(id) as target_id from x where n > 1 group by 1, 2 having count(distinct id) = 1),
a as (select distinct x.id as alias_id, l.target_id from x join l on x.g = l.g and x.last = l.last where x.n = 1 and x.id <> l.target_id)"""


@query(f"with {_ALIAS} select alias_id, target_id from a")
def alias_resolution(spark, d):
    return relational.alias_map(table(spark, d, "key_stats").filter("player_name is not null"), "record_id", "player_name", "club")


@query(f"with {_ALIAS} select coalesce(a.target_id, k.record_id) as record_id, count(*) as n from key_stats k left join a on k.record_id = a.alias_id group by 1")
def alias_rewrite(spark, d):
    k = table(spark, d, "key_stats")
    a = relational.alias_map(k.filter("player_name is not null"), "record_id", "player_name", "club")
    return relational.rewrite_ids(k.select("record_id"), "record_id", a).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {G}, b as (select player_id, season, arg_max(goals, row_id) filter (goals is not null) as goals, arg_max(shots, row_id) filter (shots is not null) as shots from player_season_stats_cleaned group by 1, 2),
a as (select s.player_id, g.season, cast(sum(goals) as bigint) as goals, cast(sum(shots) as bigint) as shots from player_match_stats_cleaned s join games g on s.match_id = g.match_id group by 1, 2)
select coalesce(b.player_id, a.player_id) as player_id, coalesce(b.season, a.season) as season, coalesce(b.goals, a.goals) as goals, coalesce(b.shots, a.shots) as shots
from b full join a on b.player_id is not distinct from a.player_id and b.season is not distinct from a.season""")
def full_outer_combine(spark, d):
    base = relational.merge_non_null(table(spark, d, "player_season_stats_cleaned"), ["player_id", "season"], ["goals", "shots"], F.col("row_id"), last=True)
    agg = stats(spark, d).join(games(spark, d).select("match_id", "season"), "match_id").groupBy("player_id", "season").agg(F.sum("goals").alias("goals"), F.sum("shots").alias("shots"))
    return relational.full_outer_combine(base, agg, ["player_id", "season"], ["goals", "shots"])


_UP = """with t as (select match_id, stadium, city, referee from matches_cleaned where match_id is not null qualify row_number() over (partition by match_id order by row_id) = 1),
s as (select match_id, stadium, city, referee from matches_cleaned where match_id is not null qualify row_number() over (partition by match_id order by row_id desc) = 1)"""
_E = "({c} is null or upper(trim({c})) in ('', 'NULL', 'NAN', 'NONE', 'NA'))"


def _upsert(spark, d):
    """The last delivery of every match offered to the first, and matches that only goals tell of."""
    m = table(spark, d, "matches_cleaned").filter("match_id is not null")
    cols = ["stadium", "city", "referee"]
    t = relational.keep_one(m, ["match_id"], [F.col("row_id")]).select("match_id", *cols)
    s = relational.keep_one(m, ["match_id"], [F.col("row_id").desc()]).select("match_id", *cols)
    told = table(spark, d, "goals_events_cleaned").filter("match_id is not null").select("match_id").distinct().join(m, "match_id", "left_anti")
    return relational.upsert_fill_only(t, s.unionByName(told.select("match_id", *[F.lit(None).cast("string").alias(c) for c in cols])), ["match_id"], cols, SHORT_MARKERS)


@query(f"{_UP} select t.match_id, " + ", ".join(f"case when {_E.format(c='t.' + c)} and not {_E.format(c='s.' + c)} then s.{c} else t.{c} end as {c}" for c in ("stadium", "city", "referee")) + " from t left join s on t.match_id = s.match_id")
def upsert_fill_only(spark, d):
    return _upsert(spark, d)[0]


@query(f"{_UP} " + " union all ".join(f"select t.match_id, '{c}' as field, t.{c} as current, s.{c} as offered from t join s on t.match_id = s.match_id where not {_E.format(c='t.' + c)} and not {_E.format(c='s.' + c)} and t.{c} <> s.{c}" for c in ("stadium", "city", "referee")))
def upsert_conflicts(spark, d):
    return _upsert(spark, d)[1]


@query("""select distinct match_id, cast(null as varchar) as stadium, cast(null as varchar) as city, cast(null as varchar) as referee
from goals_events_cleaned where match_id is not null and match_id not in (select match_id from matches_cleaned where match_id is not null)""")
def upsert_not_found(spark, d):
    return _upsert(spark, d)[2]


# --- joins and sets


@query("select distinct match_id from goals_events_cleaned g where match_id is not null and not exists (select 1 from matches_cleaned m where m.match_id = g.match_id)")
def orphans_anti(spark, d):
    return table(spark, d, "goals_events_cleaned").filter("match_id is not null").select("match_id").join(table(spark, d, "matches_cleaned").select("match_id"), "match_id", "left_anti").distinct()


@query("select row_id, match_id from goals_events_cleaned g where exists (select 1 from matches_cleaned m where m.match_id = g.match_id)")
def existing_semi(spark, d):
    return table(spark, d, "goals_events_cleaned").select("row_id", "match_id").join(table(spark, d, "matches_cleaned").select("match_id"), "match_id", "left_semi")


@query(f"with {G} select s.row_id, coalesce(g.season, 'Unknown') as season, coalesce(g.competition, 'Unknown') as competition from player_match_stats_cleaned s left join games g on s.match_id = g.match_id")
def context_left_join(spark, d):
    x = relational.lookup(stats(spark, d).select("row_id", "match_id"), table(spark, d, "matches_cleaned"), ["match_id"], ["season", "competition"], {"season": "Unknown", "competition": "Unknown"}, [F.col("row_id")])
    return x.select("row_id", "season", "competition")


@query("""with g as (select match_id, player_id, count(*) as event_goals from goals_events_cleaned where not coalesce(is_own_goal, false) and match_id is not null and player_id is not null group by 1, 2)
select s.row_id, s.goals, coalesce(g.event_goals, 0) as event_goals from player_match_stats_cleaned s left join g on s.match_id = g.match_id and s.player_id = g.player_id""")
def composite_lookup(spark, d):
    g = table(spark, d, "goals_events_cleaned").filter("not coalesce(is_own_goal, false) and match_id is not null and player_id is not null").groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("event_goals"))
    return relational.lookup(stats(spark, d).select("row_id", "match_id", "player_id", "goals"), g, ["match_id", "player_id"], ["event_goals"], {"event_goals": 0}).select("row_id", "goals", "event_goals")


@query("""with e as (select distinct match_id, minute from goals_events_cleaned where minute is not null), o as (select match_id, minute, min(row_id) as first_row from goals_events_cleaned where minute is not null group by 1, 2)
select g.row_id, o.first_row from goals_events_cleaned g join o on g.match_id = o.match_id and g.minute = o.minute""")
def minute_correlation(spark, d):
    g = table(spark, d, "goals_events_cleaned").filter("minute is not null")
    first = g.groupBy("match_id", "minute").agg(F.min("row_id").alias("first_row"))
    return g.select("row_id", "match_id", "minute").join(first, ["match_id", "minute"]).select("row_id", "first_row")


_SLOTS = "with p as (select distinct team_id, season from (select home_team_id as team_id, season from matches_cleaned union all select away_team_id, season from matches_cleaned) where team_id is not null and season is not null)"


def _pairs(spark, d):
    m = table(spark, d, "matches_cleaned")
    return m.select("season", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).filter("team_id is not null and season is not null").select("team_id", "season").distinct()


@query(f"{_SLOTS} select team_id, season, unnest(generate_series(1, 26)) as slot from p")
def roster_expand(spark, d):
    return relational.slots(_pairs(spark, d), 26)


@query(f"""{_SLOTS}, r as (select team_id, list(player_id order by player_id) as pool from (select distinct team_id, player_id from players_cleaned where team_id is not null and player_id is not null) group by 1),
x as (select p.team_id, p.season, unnest(generate_series(1, 12)) as slot, r.pool from p join r on p.team_id = r.team_id)
select team_id, season, slot, pool[1 + cast(cast('0x' || substr(md5(team_id || '|' || season || '|' || slot), 1, 12) as bigint) % len(pool) as int)] as player_id from x""")
def roster_hash_pick(spark, d):
    pool = table(spark, d, "players_cleaned").filter("team_id is not null")
    return relational.hash_pick(relational.slots(_pairs(spark, d), 12), pool, ["team_id"], "player_id", ["team_id", "season", "slot"])


@query("""with p as (select distinct team_id, season from (select home_team_id as team_id, season from matches_cleaned union all select away_team_id, season from matches_cleaned) where team_id is not null and season is not null),
r as (select team_id, list(player_id order by player_id) as pool from (select distinct team_id, player_id from players_cleaned where team_id is not null and player_id is not null) group by 1),
x as (select p.team_id, p.season, unnest(generate_series(1, 12)) as slot, r.pool from p join r on p.team_id = r.team_id),
y as (select team_id, season, slot, pool[1 + cast(cast('0x' || substr(md5(team_id || '|' || season || '|' || slot), 1, 12) as bigint) % len(pool) as int)] as player_id from x)
select * from y where not exists (select 1 from player_season_stats_cleaned z where z.player_id = y.player_id and z.season = y.season)""")
def roster_pick_new(spark, d):
    """The same without players that have statistics of the season."""
    pool = table(spark, d, "players_cleaned").filter("team_id is not null")
    taken = table(spark, d, "player_season_stats_cleaned").select("season", "player_id").filter("season is not null and player_id is not null").distinct()
    return relational.hash_pick(relational.slots(_pairs(spark, d), 12), pool, ["team_id"], "player_id", ["team_id", "season", "slot"], taken)


_NORM = "trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g'))"
_STOP = "('fc', 'cf', 'ac', 'sc', 'rb', 'bv', 'sl', 'de', 'as', 'us', 'ss', 'sb', 'cl', '')"


@query(f"""with t as (select row_id, country, unnest(list_distinct(string_split({_NORM.format(c="team_name")}, ' '))) as w from teams_cleaned where team_name is not null and country is not null)
select a.row_id as left_id, b.row_id as right_id, count(*) as shared from t a join t b on a.country = b.country and a.w = b.w where a.w not in {_STOP} group by 1, 2""")
def token_overlap_match(spark, d):
    t = table(spark, d, "teams_cleaned").filter("team_name is not null and country is not null")
    return matching.token_overlap_join(t.withColumnRenamed("row_id", "left_id"), t.withColumnRenamed("row_id", "right_id"), "country", "left_id", "team_name", "right_id", "team_name")


_LIST = " union all ".join(f"select '{k}' as k, '{v}' as v" for k, vs in matching.ALIASES.items() for v in vs)


@query(f"""with n as (select club, {_NORM.format(c="club")} as n from (select distinct club from key_stats where club is not null)), a as ({_LIST})
select club, n as expansion from n where n <> '' union select club, a.v from n, a where n <> '' and (contains(n, a.k) or contains(a.k, n))""")
def alias_contains_expand(spark, d):
    return matching.expand_aliases(table(spark, d, "key_stats").filter("club is not null").select("club").distinct(), "club", "club")


@query(f"""with a as (select record_id, club as b, {_NORM.format(c="player_name")} as n from key_stats where player_name is not null), x as (select *, string_split(n, ' ')[-1] as s, list_distinct(string_split(n, ' ')) as w from a where n <> ''),
p as (select l.record_id as l, r.record_id as r, 1 as t from x l join x r on l.b = r.b and l.n = r.n union all select l.record_id, r.record_id, 2 from x l join x r on l.b = r.b and l.s = r.s
  union all select l.record_id, r.record_id, 3 from (select record_id, b, unnest(w) as w from x) l join (select record_id, b, unnest(w) as w from x) r on l.b = r.b and l.w = r.w)
select l as record_id, min({{'t': t, 'r': r}})['r'] as other_id, min(t) as tier from p where l <> r group by 1""")
def three_tier_name_match(spark, d):
    k = table(spark, d, "key_stats").select("record_id", "club", "player_name")
    return matching.three_tier_match(k, k.withColumnRenamed("record_id", "other_id"), "club", "record_id", "player_name", "other_id", "player_name", itself=False)


@query()
def similarity_best_match(spark, d):
    """The most alike team name of the same country."""
    m = matching.most_alike(table(spark, d, "teams_cleaned"), "row_id", "team_name", "country")
    return m.select("a", "b", "ratio")


@query("select distinct player_id from player_match_stats_cleaned where player_id is not null except select player_id from players_cleaned")
def set_difference(spark, d):
    return stats(spark, d).select("player_id").filter("player_id is not null").distinct().join(table(spark, d, "players_cleaned").select("player_id"), "player_id", "left_anti")


@query("select player_id from player_match_stats_cleaned where player_id is not null intersect select player_id from players_cleaned")
def set_intersection(spark, d):
    return stats(spark, d).select("player_id").filter("player_id is not null").intersect(table(spark, d, "players_cleaned").select("player_id"))


@query("select row_id, player_id, null as season, goals from player_match_stats_cleaned union all select row_id, player_id, season, goals from player_season_stats_cleaned")
def bag_union_missing_cols(spark, d):
    return stats(spark, d).select("row_id", "player_id", "goals").unionByName(table(spark, d, "player_season_stats_cleaned").select("row_id", "player_id", "season", "goals"), allowMissingColumns=True).select("row_id", "player_id", "season", "goals")


@query("select distinct season, competition from matches_cleaned")
def distinct_pairs(spark, d):
    return table(spark, d, "matches_cleaned").select("season", "competition").distinct()


@query(f"with {G} select team_id, season, match_id, is_home from (select home_team_id as team_id, season, match_id, 1 as is_home from games union all select away_team_id, season, match_id, 0 from games)")
def role_unpivot(spark, d):
    return relational.both_roles(games(spark, d), ["season", "match_id"], {"team_id": "home_team_id"}, {"team_id": "away_team_id"}).select("team_id", "season", "match_id", "is_home")


# --- top-k and counts


@query(f"with {G}, c as (select team_id, count(*) as appearances from (select home_team_id as team_id from games union all select away_team_id from games) where team_id is not null group by 1) select team_id, appearances from c order by appearances desc, team_id limit 15")
def topk_appearances(spark, d):
    sides = relational.both_roles(games(spark, d), [], {"team_id": "home_team_id"}, {"team_id": "away_team_id"}).filter("team_id is not null")
    return sides.groupBy("team_id").agg(F.count(F.lit(1)).alias("appearances")).orderBy(F.desc("appearances"), "team_id").limit(15)


@query(f"with {G} select season, count(*) as n from games group by 1")
def value_counts_sorted(spark, d):
    return games(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n")).orderBy("season")


@query("""with x as (select distance_covered as v from player_match_stats_cleaned where distance_covered >= 0 and distance_covered < 14.4)
select cast(floor(v / 0.6) as bigint) + 1 as bin, count(*) as n from x group by 1""")
def histogram_24(spark, d):
    x = stats(spark, d).select(finite(F.col("distance_covered")).alias("v")).filter("v >= 0 and v < 14.4")
    return x.groupBy((F.floor(F.col("v") / 0.6) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {P} select {_POS.format(c='p.position')} as position_group, median(s.shots * 90 / s.minutes_played) as median_rate, count(*) as n from player_match_stats_cleaned s join players p on s.player_id = p.player_id where s.minutes_played > 0 and s.shots is not null group by 1")
def group_median_rate(spark, d):
    x = stats(spark, d).filter("minutes_played > 0 and shots is not null").join(players(spark, d).select("player_id", "position_group"), "player_id")
    return x.groupBy("position_group").agg(F.median(F.col("shots") * 90 / F.col("minutes_played")).alias("median_rate"), F.count(F.lit(1)).alias("n"))


_SUM = ("minutes_played", "goals", "shots", "passes_attempted", "tackles", "touches")


@query(" union all ".join(f"select '{c}' as column_name, count({c}) as n, round(avg({c}), 4) as mean, round(median({c}), 4) as median, cast(min({c}) as double) as low, cast(max({c}) as double) as high from player_match_stats_cleaned having count({c}) > 0" for c in _SUM))
def numeric_summary(spark, d):
    return quality.numeric_summary(stats(spark, d), list(_SUM))


# --- quality

_TEXTS = ("match_id", "season", "competition", "date", "home_team_id", "stadium", "city", "referee", "possession_home")


@query(" union all ".join(f"select '{c}' as column_name, count(*) as rows, count(*) - count({_markers(c)}) as missing, round((count(*) - count({_markers(c)})) / count(*), 6) as ratio, cast((count(*) - count({_markers(c)})) / count(*) <= 0.0025 as int) as passed from matches_cleaned" for c in _TEXTS))
def completeness_profile(spark, d):
    return quality.completeness(table(spark, d, "matches_cleaned").select(*_TEXTS))


@query(" union all ".join(f"select '{c}' as metric, count({c}) as filled, count(*) - count({c}) as missing, round(100 * (1 - round((count(*) - count({c})) / count(*), 6)), 2) as pct from player_match_stats_cleaned" for c in _SUM))
def coverage_rows(spark, d):
    return quality.coverage(stats(spark, d), list(_SUM))


@query(" union all ".join(f"select '{c}' as column_name, 'string' as type, count(*) - count({_markers(c)}) as missing, round(100 * (count(*) - count({_markers(c)})) / count(*), 2) as missing_pct, min({_markers(c)}) as example from matches_cleaned" for c in _TEXTS))
def data_dictionary(spark, d):
    return quality.data_dictionary(table(spark, d, "matches_cleaned").select(*_TEXTS))


_ZERO = ("goals", "red_cards", "offsides")


@query(" union all ".join(f"select '{c}' as column_name, count({c}) as observed, cast(coalesce(max(abs({c})) = 0, false) as int) as fake from player_match_stats_cleaned" for c in _ZERO))
def fake_zero_columns(spark, d):
    return quality.fake_zero_columns(stats(spark, d), list(_ZERO))


@query("with p as (select player_id, match_id, count(*) as n from player_match_stats_cleaned group by 1, 2) select cast(sum(n) as bigint) as rows, count(*) as distinct_keys, cast(sum(n - 1) as bigint) as duplicate_rows, count(*) filter (n > 1) as keys_repeated from p")
def duplicate_profile(spark, d):
    return quality.duplicate_profile(stats(spark, d), ["player_id", "match_id"])


_ADJ = ("goal_id", "match_id", "minute", "goal_type", "player_id")


@query("with x as (select *, " + ", ".join(f"lag({c}) over w is not distinct from {c} as s_{c}" for c in _ADJ) + ", row_number() over w > 1 as has from goals_events_cleaned window w as (partition by match_id order by row_id)) select count(*) as rows, "
       "count(*) filter (has and " + " and ".join(f"s_{c}" for c in _ADJ) + ") as exact, count(*) filter (has and " + " and ".join(f"s_{c}" for c in _ADJ[1:]) + ") as similar from x")  # fmt: skip
def adjacent_repeats(spark, d):
    return quality.adjacent_repeats(table(spark, d, "goals_events_cleaned"), ["match_id"], ["row_id"], list(_ADJ), ["goal_id"])


_RULES = {
    **{f"negative_{c}": f"{c} < 0" for c in ("minutes_played", "goals", "shots")}, "completed_above_attempted": "passes_completed > passes_attempted", "on_target_above_shots": "shots_on_target > shots",
    "parts_above_shots": "coalesce(shots_on_target, 0) + coalesce(shots_off_target, 0) + coalesce(shots_blocked, 0) > shots", "accuracy_out_of_range": "not pass_accuracy between 0 and 1",
}


@query(" union all ".join(f"select row_id, '{n}' as rule from player_match_stats_cleaned where {c}" for n, c in _RULES.items()))
def anomaly_rules(spark, d):
    return quality.anomalies(stats(spark, d), ["row_id"], quality.match_stats_rules(["minutes_played", "goals", "shots"]))


@query("""select 'matches' as table_name, count(*) as records, count(distinct match_id) as entities, 1000 :: bigint as minimum, cast(count(distinct match_id) >= 1000 as int) as passed from matches_cleaned
union all select 'players', count(*), count(distinct player_id), 85000, cast(count(distinct player_id) >= 85000 as int) from players_cleaned
union all select 'teams', count(*), count(distinct team_id), 3000, cast(count(distinct team_id) >= 3000 as int) from teams_cleaned""")
def gate_summary(spark, d):
    t = {"matches": ("matches_cleaned", "match_id"), "players": ("players_cleaned", "player_id"), "teams": ("teams_cleaned", "team_id")}
    return quality.target_gate({n: (table(spark, d, f), k) for n, (f, k) in t.items()}, {"matches": 1000, "players": 85000, "teams": 3000})


@query(f"""with {G}, e as (select match_id, count(*) as events from (select distinct goal_id, match_id from goals_events_cleaned) group by 1)
select g.match_id, coalesce(home_score, 0) + coalesce(away_score, 0) as score, e.events from games g join e on g.match_id = e.match_id where e.events <> coalesce(home_score, 0) + coalesce(away_score, 0)""")
def score_vs_events(spark, d):
    e = table(spark, d, "goals_events_cleaned").select("goal_id", "match_id").distinct().groupBy("match_id").agg(F.count(F.lit(1)).alias("events"))
    score = F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))
    return games(spark, d).select("match_id", score.alias("score")).join(e, "match_id").filter("events <> score")


@query("""with a as (select player_id, cast(coalesce(sum(goals), 0) as bigint) as stat_goals from player_match_stats_cleaned group by 1), b as (select player_id, count(distinct goal_id) as event_goals from goals_events_cleaned where not coalesce(is_own_goal, false) group by 1)
select a.player_id, stat_goals, coalesce(event_goals, 0) as event_goals from a left join b on a.player_id = b.player_id where stat_goals <> coalesce(event_goals, 0)""")
def sum_vs_count(spark, d):
    a = stats(spark, d).groupBy("player_id").agg(F.coalesce(F.sum("goals"), F.lit(0)).alias("stat_goals"))
    b = table(spark, d, "goals_events_cleaned").filter("not coalesce(is_own_goal, false)").groupBy("player_id").agg(F.count_distinct("goal_id").alias("event_goals"))
    return a.join(b, "player_id", "left").withColumn("event_goals", F.coalesce("event_goals", F.lit(0))).filter("stat_goals <> event_goals")


# --- texts


@query(f"""select row_id, 'team_' || substr(md5({_NORM.format(c="team_name")}), 1, 12) as stable_id, {_NORM.format(c="team_name")} as soft from teams_cleaned where team_name is not null and trim(team_name) <> '' and upper(trim(team_name)) not in ('NOT_AVAILABLE_IN_SOURCE', 'NO_ASSIST_OR_NOT_RECORDED')""")
def stable_ids(spark, d):
    t = table(spark, d, "teams_cleaned").filter(X.clean_text(F.col("team_name")).isNotNull())
    return t.select("row_id", X.stable_id("team", F.col("team_name")).alias("stable_id"), X.soft_norm(F.col("team_name")).alias("soft"))


@query()
def soft_norm_documents(spark, d):
    """Both normal forms of all whole texts (SQL's accent rules differ on some scripts)."""
    t = table(spark, d, "documents")
    return t.select("doc_id", X.soft_norm(F.col("text")).alias("spaced"), X.soft_norm_joined(F.col("text")).alias("joined"))


_JOINED = "trim(regexp_replace(lower(regexp_replace(strip_accents(trim({c})), '[^a-zA-Z0-9 ]', '', 'g')), '\\s+', ' ', 'g'))"


@query(f"""with x as (select record_id, {_JOINED.format(c="player_name")} as s from key_stats where player_name is not null and trim(player_name) <> '' and lower(trim(player_name)) not in ('null', 'nan')),
y as (select record_id, case when s like '% %' then string_split(s, ' ')[-1] || ' ' || substr(s, 1, 1) else s end as canonical from x) select record_id, canonical, substr(md5(canonical), 1, 12) as player_hash from y""")
def canonical_names(spark, d):
    k = table(spark, d, "key_stats").filter(X.norm_value(F.col("player_name")).isNotNull())
    return k.select("record_id", X.canonical_name(F.col("player_name")).alias("canonical"), X.player_hash(F.col("player_name")).alias("player_hash"))


_POSN = "lower(trim(position))"


@query(f"""select row_id, {_POS.format(c="position")} as code, case when position is null or trim(position) = '' then 'Unknown' when regexp_matches({_POSN}, 'keeper|portero') then 'Goalkeeper' when regexp_matches({_POSN}, 'back|defender|defence|defense') then 'Defender'
  when {_POSN} like '%midfield%' then 'Midfielder' when regexp_matches({_POSN}, 'forward|striker|winger|attack') then 'Forward' else 'Other' end as name from players_cleaned""")
def position_groups(spark, d):
    return table(spark, d, "players_cleaned").select("row_id", X.position_code(F.col("position")).alias("code"), X.position_name(F.col("position")).alias("name"))


@query("select listing_id, try_cast(nullif(regexp_extract(score, '([0-9]+)\\s*-\\s*([0-9]+)', 1), '') as int) as home, try_cast(nullif(regexp_extract(score, '([0-9]+)\\s*-\\s*([0-9]+)', 2), '') as int) as away from fixture_listings")
def parse_scores(spark, d):
    s = X.parse_score(F.col("score"))
    return table(spark, d, "fixture_listings").select("listing_id", s["home"].alias("home"), s["away"].alias("away"))


_NUM = "case when regexp_full_match(trim(replace(distance_covered, '%', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then cast(trim(replace(distance_covered, '%', '')) as double) end"


@query(f"select record_id, {_NUM} as distance from key_stats")
def numeric_coercion(spark, d):
    return table(spark, d, "key_stats").select("record_id", X.number(F.col("distance_covered")).alias("distance"))


@query("""with x as (select row_id, case when regexp_full_match(trim(replace(possession_home, '%', '')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') then cast(trim(replace(possession_home, '%', '')) as double) end as n from matches_cleaned)
select row_id, round(case when n > 1 then n / 100 else n end, 4) as share, coalesce(round(case when n > 1 then n / 100 else n end, 4), 0) as possession from x""")
def percent_to_decimal(spark, d):
    c = F.col("possession_home")
    return table(spark, d, "matches_cleaned").select("row_id", X.pct_to_decimal(c).alias("share"), X.format_possession(c).alias("possession"))


@query("""select row_id, case when regexp_full_match(date, '\\d{2}-\\d{2}-\\d{4}') then substr(date, 7, 4) || substr(date, 4, 2) || substr(date, 1, 2) end as api,
  case when regexp_full_match(date, '\\d{2}-\\d{2}-\\d{4}') then substr(date, 7, 4) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) end as iso from matches_cleaned""")
def date_swaps(spark, d):
    c = F.when(F.col("date").rlike(r"^\d{2}-\d{2}-\d{4}$"), F.col("date"))
    return table(spark, d, "matches_cleaned").select("row_id", F.when(c.isNotNull(), X.swap_date(c, "api")).alias("api"), F.when(c.isNotNull(), X.swap_date(c, "iso")).alias("iso"))


@query("""select listing_id, coalesce(nullif(regexp_replace(regexp_replace(lower(home_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as slug,
  cast(cast('0x' || substr(md5(listing_id || '|' || coalesce(site, '')), 1, 12) as bigint) % 97 as bigint) as bucket from fixture_listings where home_name is not null""")
def slugs_and_buckets(spark, d):
    f = table(spark, d, "fixture_listings").filter("home_name is not null")
    return f.select("listing_id", X.slug(F.col("home_name")).alias("slug"), X.deterministic_int(97, F.col("listing_id"), F.coalesce("site", F.lit(""))).alias("bucket"))


def _letters(c):
    return F.coalesce(F.regexp_replace(c, "[^A-Za-z]", ""), F.lit(""))


_LISTED = "l as (select listing_id, 'Ha' || coalesce(regexp_replace(home_name, '[^A-Za-z]', '', 'g'), '') as h, 'Aw' || coalesce(regexp_replace(away_name, '[^A-Za-z]', '', 'g'), '') as a, (listing_id % 7) || '-' || (listing_id % 5) as s, listing_id % 6 as v from fixture_listings)"


def _listed(spark, d):
    """Listings with plain names, a score, and which way their line is written."""
    i = F.col("listing_id")
    s = F.concat_ws("-", (i % 7).cast("string"), (i % 5).cast("string"))
    return table(spark, d, "fixture_listings").select(i, F.concat(F.lit("Ha"), _letters("home_name")).alias("h"), F.concat(F.lit("Aw"), _letters("away_name")).alias("a"), s.alias("s"), (i % 6).alias("v"))


@query(f"""with {_LISTED} select listing_id, case when v = 3 then null else h end as team_name, unnest(case v when 0 then ['Pa', 'Qu', 'Ra  Sb'] when 1 then ['Pa'] when 2 then ['Qu', 'Ra'] else []::varchar[] end) as player_name from l
union all select listing_id, a, unnest(['Xa', 'Yb']) from l where v <> 4""")
def parse_lineups(spark, d):
    v = F.col("v")
    home = F.when(v == 0, F.concat("h", F.lit(": Pa; Qu,  Ra  Sb ;"))).when(v == 1, F.concat("h", F.lit(": Pa"))).when(v == 2, F.concat("h", F.lit(":Qu,Ra"))).when(v == 3, F.lit("no colon here")).otherwise(F.concat("h", F.lit(": ; ,")))
    away = F.when(v == 4, F.lit("nobody")).otherwise(F.concat("a", F.lit(": Xa, Yb")))
    return parse.lineups(_listed(spark, d).select("listing_id", F.concat_ws(" | ", home, away).alias("t")), "listing_id", "t")


@query(f"""with {_LISTED}, t as (
  select listing_id, 0 as position, h as player_name, '45+2' as minute, 45 as minute_base, 2 as minute_added, 'regular' as goal_type from l where v in (0, 1)
  union all select listing_id, 1, h, '90', 90, null, 'penalty' from l where v in (0, 1)
  union all select listing_id, 2, a || ' B', '12', 12, null, 'own_goal' from l where v = 0
  union all select listing_id, 1, a, '7', 7, null, 'regular' from l where v = 2
  union all select listing_id, 0, h, '33', 33, null, 'regular' from l where v = 3)
select listing_id, position :: int as position, player_name, minute, minute_base :: int as minute_base, minute_added :: int as minute_added, goal_type from t""")
def parse_goals(spark, d):
    v = F.col("v")
    text = (
        F.when(v == 0, F.concat("h", F.lit(" 45+2'; 90' (P); "), "a", F.lit(" B 12' (OG); nothing")))
        .when(v == 1, F.concat("h", F.lit(" 45+2';90 (P)")))
        .when(v == 2, F.concat(F.lit("88'; "), "a", F.lit(" 7'")))  # a minute before any player
        .when(v == 3, F.concat("h", F.lit("   33'")))
        .when(v == 4, F.lit(" ; ;"))
    )
    return parse.goals(_listed(spark, d).select("listing_id", text.alias("t")), "listing_id", "t").drop("goal_id")


@query(f"""with {_LISTED}
select listing_id, 'home' as side, h as player_name, '12' as minute, 'regular' as goal_type from l where v in (0, 1, 2)
union all select listing_id, 'home', a || ' B', '40', 'penalty' from l where v = 0
union all select listing_id, 'away', a, '90+3', 'own_goal' from l where v = 0
union all select listing_id, 'away', h || '-' || a, '5', 'regular' from l where v = 1
union all select listing_id, 'away', a, '9', 'penalty' from l where v in (2, 3)""")
def parse_scorers(spark, d):
    v = F.col("v")
    text = (
        F.when(v == 0, F.concat(F.lit("["), "h", F.lit(" 12, "), "a", F.lit(" B 40 (p); "), "a", F.lit(" 90+3' (o.g.)]")))
        .when(v == 1, F.concat(F.lit("("), "h", F.lit(" 12'; "), "h", F.lit("-"), "a", F.lit(" 5)")))
        .when(v == 2, F.concat("h", F.lit(" 12, 45 (og); "), "a", F.lit(" 9(pen.)")))  # the second minute has no name
        .when(v == 3, F.concat(F.lit("-; "), "a", F.lit(" 9 (P)")))
        .when(v == 4, F.concat("h", F.lit(" 12")))  # no semicolon, no sides
        .otherwise(F.lit("; "))
    )
    return parse.scorers(_listed(spark, d).select("listing_id", text.alias("t")), "listing_id", "t")


@query("""select listing_id, 'shots' as section, 'S1' as field, coalesce(home_name, 'x') as value from fixture_listings union all select listing_id, 'shots', 'S2', coalesce(away_name, 'x') from fixture_listings
union all select listing_id, null, 'S0', '' from fixture_listings union all select listing_id, 'cards', 'S1', 'a~b' from fixture_listings""")
def parse_feed(spark, d):
    f = table(spark, d, "fixture_listings")
    text = F.concat(F.lit("S0~¬ST~shots¬S1~"), F.coalesce("home_name", F.lit("x")), F.lit("¬junk¬S2~"), F.coalesce("away_name", F.lit("x")), F.lit("¬ST~cards¬S1~a~b¬"))
    return parse.feed(f.select("listing_id", text.alias("t")), "listing_id", "t")


@query(f"""with {_LISTED} select listing_id, case when v < 4 then h end as home, case when v < 4 then a end as away,
  case v when 0 then s || ' (1-0)' when 1 then s when 2 then s || ' (0-0)' when 3 then s || ' pen. (1-1)' end as score,
  case when v = 2 then 'Park ' || h end as stadium, case when v = 2 then 'Some Town' end as city from l""")
def parse_match_lines(spark, d):
    """Lines of both grammars, with and without number, day, time, note and venue, and lines that are no match."""
    v = F.col("v")
    line = (
        F.when(v == 0, F.concat(F.lit("  (3) 20.45 "), "h", F.lit(" v "), "a", F.lit("  "), "s", F.lit(" (1-0)")))
        .when(v == 1, F.concat("h", F.lit(" (ENG) v "), "a", F.lit(" (FRA) "), "s"))
        .when(v == 2, F.concat(F.lit("(12) Sat Jun/14 18:00 "), "h", F.lit(" "), "s", F.lit(" (0-0) "), "a", F.lit(" @ Park "), "h", F.lit(", Some Town # note")))
        .when(v == 3, F.concat("h", F.lit(" "), "s", F.lit(" pen. (1-1) "), "a"))
        .when(v == 4, F.concat("h", F.lit(" against "), "a"))
        .otherwise(F.concat(F.lit("Winner "), "h", F.lit(" "), "s", F.lit(" "), "a"))
    )
    return _listed(spark, d).select("listing_id", parse.match_line(line).alias("m")).select("listing_id", "m.*")


@query(r"""select doc_id, unnest(generate_series(1, len(t))) as line_no, unnest(t) as text from (select doc_id, string_split_regex(text, '\r?\n') as t from documents where text is not null)""")
def text_lines(spark, d):
    """Every text by line."""
    from statloom.sources.readers import split_lines

    return split_lines(table(spark, d, "documents"), "doc_id", "text")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_flatten(spark, d):
    from statloom.sources.readers import flatten

    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return flatten(e).select("event_id", F.col("`props.k`").alias("k"))


@query()
def json_export(spark, d):
    """A JSON document for each match, with its goals and player rows."""
    return nested_seasons(games(spark, d), table(spark, d, "goals_events_cleaned"), stats(spark, d).filter("match_id is not null"))


@query()
def html_text_fallback(spark, d):
    """Tables, or the text, of every document that is HTML."""
    from statloom.sources.readers import html_tables

    return html_tables(table(spark, d, "documents").filter(F.lower("text").rlike("<(html|p|div|table|br)[ />]")), "doc_id", "text")


@query("select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events")
def carry_forward(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return relational.carry_forward(e, ["user_id"], ["ts", "event_id"], "v", "last_purchase").select("event_id", "last_purchase")


@query("select record_id, cast((trim(player_name) is not distinct from trim(club)) or lower(trim(player_name)) = lower(trim(club)) as int) as same from key_stats where regexp_full_match(trim(player_name), '[A-Za-z]+') and regexp_full_match(trim(club), '[A-Za-z]+')")
def equivalent_values(spark, d):
    k = table(spark, d, "key_stats").filter(F.trim("player_name").rlike("^[A-Za-z]+$") & F.trim("club").rlike("^[A-Za-z]+$"))
    return k.select("record_id", X.equivalent(F.col("player_name"), F.col("club")).cast("int").alias("same"))


# --- reduction

_MATRIX = ["minutes_played", "matches_played", "goals", "assists", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "interceptions", "fouls_committed", "yellow_cards", "red_cards"]


@query("""with s as (select s.goals, s.shots from player_season_stats_cleaned s where minutes_played is not null), m as (select median(goals) as g, median(shots) as h from s), f as (select coalesce(goals, g) as g, coalesce(shots, h) as h from s, m)
select round(avg(g), 4) as mean_goals, round(stddev_pop(g), 4) as sd_goals, round(avg(h), 4) as mean_shots, round(stddev_pop(h), 4) as sd_shots from f""")
def median_impute_moments(spark, d):
    s = table(spark, d, "player_season_stats_cleaned").dropna(subset=["minutes_played"])
    m = s.agg(F.median("goals").alias("g"), F.median("shots").alias("h"))
    f = s.crossJoin(F.broadcast(m)).select(F.coalesce("goals", "g").alias("g"), F.coalesce("shots", "h").alias("h"))  # one row
    return f.agg(*[F.round(a(c), 4).alias(f"{n}_{o}") for c, o in (("g", "goals"), ("h", "shots")) for a, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


_ENGINEERED = ["minutes_per_match", *[f"{c}_per90" for c in ("goals", "assists", "shots", "shots_on_target", "passes_completed", "passes_attempted", "tackles", "interceptions", "fouls_committed", "cards", "defensive", "discipline")], "shot_accuracy", "pass_accuracy", "goal_conversion"]


def _matrix(spark, d) -> tuple[DataFrame, list[str]]:
    """Thirteen counts, sixteen engineered columns, position and season, as centred columns of one scale."""
    p = players(spark, d).select("player_id", X.position_name(F.col("position")).alias("position"))
    s = relational.lookup(table(spark, d, "player_season_stats_cleaned").dropna(subset=["minutes_played"]), p, ["player_id"], ["position"], {})
    numeric = _MATRIX + _ENGINEERED
    x = durable(matrix_features(s).select("row_id", "position", "season", *[F.col(c).cast("double").alias(c) for c in numeric]))  # read by every statistic
    for c in ("position", "season"):
        x, names = reduce.one_hot(reduce.fill_mode(x, c), c)
        numeric = numeric + names
    return durable(reduce.standardise(x, numeric)), numeric


@query()
def standardise_onehot(spark, d):
    x, features = _matrix(spark, d)
    return x.select("row_id", *[F.round(c, 6).alias(c) for c in features])


@query()
def pca_variance(spark, d):
    x, features = _matrix(spark, d)
    return reduce.variance_table(x, reduce.principal_components(x, features))


@query()
def pca_scores(spark, d):
    x, features = _matrix(spark, d)
    return reduce.scores(x, reduce.principal_components(x, features)).select("row_id", "pc1", "pc2")


@query()
def pca_loadings(spark, d):
    x, features = _matrix(spark, d)
    return reduce.top_loadings(x, reduce.principal_components(x, features))


@query(f"""with {G}, c as (select competition, sum(coalesce(home_score, 0) + coalesce(away_score, 0)) as goals from games where competition is not null group by 1), t as (select *, sum(goals) over (order by goals desc, competition rows between unbounded preceding and current row) / sum(goals) over () as share from c)
select competition, cast(goals as bigint) as goals, round(share, 6) as cumulative, cast(share - goals / sum(goals) over () < 0.9 as int) as needed from t""")
def cumulative_share_90(spark, d):
    c = games(spark, d).filter("competition is not null").groupBy("competition").agg(F.sum(F.coalesce("home_score", F.lit(0)) + F.coalesce("away_score", F.lit(0))).alias("goals"))
    w = Window.orderBy(F.desc("goals"), "competition").rowsBetween(Window.unboundedPreceding, 0)  # one row a competition
    total = F.sum("goals").over(Window.partitionBy())
    x = c.withColumn("share", F.sum("goals").over(w) / total).withColumn("own", F.col("goals") / total)
    return x.select("competition", "goals", F.round("share", 6).alias("cumulative"), (F.col("share") - F.col("own") < 0.9).cast("int").alias("needed"))


# --- extensions


@query(f"with {G} select season, competition, count(*) as n, cast(sum(home_score) as bigint) as home_goals from games group by grouping sets ((season, competition), (season), ())")
def ext_grouping_sets(spark, d):
    g = games(spark, d).select("season", "competition", "home_score")
    return g.groupingSets([[F.col("season"), F.col("competition")], [F.col("season")], []], "season", "competition").agg(F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("home_goals"))


@query("with t as (select player_id, cast(coalesce(sum(goals), 0) as bigint) as goals from player_match_stats_cleaned where player_id is not null group by 1), p as (select team_id, min(player_id) as x from players_cleaned group by 1) select player_id, goals, rank() over (order by goals desc) as rnk from t qualify rnk <= 20")
def ext_rank(spark, d):
    t = stats(spark, d).filter("player_id is not null").groupBy("player_id").agg(F.coalesce(F.sum("goals"), F.lit(0)).alias("goals"))
    # the rank limit goes below the window, so no task ranks all players
    return t.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("goals")))).filter("rnk <= 20")


@query("""select event_type, time_bucket(interval 1 hour, ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def ext_tumbling_window(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query("select user_id, event_id, count(*) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as recent, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 4) as mean_recent from events")
def ext_sliding_window(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("recent"), F.round(F.avg("value").over(w), 4).alias("mean_recent"))


@query("select user_id, count(*) as n, max(event_id) as last_event from events group by 1")
def ext_stream_merge(spark, d):
    return stream.stream_latest(spark, f"{d}/events.parquet", ["user_id"], "event_id")


@query(f"with {G} select team_id, count(distinct other) as degree from (select home_team_id as team_id, away_team_id as other from games union all select away_team_id, home_team_id from games) where team_id is not null and other is not null group by 1")
def ext_degree_centrality(spark, d):
    edges = relational.both_roles(games(spark, d), [], {"team_id": "home_team_id", "other": "away_team_id"}, {"team_id": "away_team_id", "other": "home_team_id"})
    return edges.filter("team_id is not null and other is not null").groupBy("team_id").agg(F.count_distinct("other").alias("degree"))

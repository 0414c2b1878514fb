"""Queries of the general data problems (1, 3, 5, 6) over their whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.missing import is_missing, norm_key
from statloom.operators import mixture, orphans, profile, schema_drift
from statloom.operators.mixture import Number
from statloom.session import table

PROFILED = ["referee", "stadium", "possession_home"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.quality_findings(table(spark, d, "matches_cleaned"), PROFILED)


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of every load."""
    m = table(spark, d, "matches_cleaned")
    columns = [c for c in m.columns if c not in ("row_id", "feed_id", "load_id")]
    p = profile.load_profile(profile.inventory(m, columns, "feed_id", "load_id"))
    return p.withColumns({c: F.round(c, 6) for c in ("null_rate", "top_share", "mean_share", "mask_divergence")})


def p1_masks(spark: SparkSession, d: str) -> DataFrame:
    """The mask inventory of every column with the dominant masks."""
    m = table(spark, d, "matches_cleaned")
    columns = [c for c in m.columns if c not in ("row_id", "feed_id", "load_id")]
    return profile.mine_masks(profile.inventory(m, columns, "feed_id", "load_id")).withColumn("share", F.round("share", 6))


def p1_drift(spark: SparkSession, d: str) -> DataFrame:
    """The loads and columns whose notations differ from those of the feed, by mask divergence."""
    inv = profile.inventory(table(spark, d, "matches_cleaned"), PROFILED, "feed_id", "load_id")
    return profile.drifting_loads(profile.load_profile(inv)).withColumn("mask_divergence", F.round("mask_divergence", 6))


REFERENCES = [
    orphans.Reference("player_match_stats_cleaned", "player_id", "players_cleaned", "player_id"),
    orphans.Reference("player_match_stats_cleaned", "match_id", "matches_cleaned", "match_id"),
    orphans.Reference("goals_events_cleaned", "assist_player_id", "players_cleaned", "player_id"),
    orphans.Reference("matches_cleaned", "home_team_id", "teams_cleaned", "team_id"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = dict.fromkeys([r.table for r in REFERENCES] + [r.target for r in REFERENCES])
    return orphans.orphan_references({n: table(spark, d, n) for n in names}, REFERENCES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("at")


def p3_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The keys that are orphans as the ledger stands, with the references that are still valid."""
    names = dict.fromkeys([r.table for r in REFERENCES] + [r.target for r in REFERENCES])
    return orphans.current_orphans(orphans.ledger(orphans.change_deltas({n: table(spark, d, n) for n in names}, REFERENCES)))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


# --- problem 5: what is filled, from what, and what a column can hold

MATCH_NUMBERS = [
    Number("minutes_played", high=130, fill=True), Number("shots", fill=True), Number("shots_on_target"), Number("shots_off_target"),
    Number("shots_blocked"), Number("passes_attempted"), Number("passes_completed"), Number("touches"), Number("distance_covered"),
]
SEASON_NUMBERS = [
    Number("passes_completed", fill=True), Number("passes_attempted"), Number("minutes_played"), Number("matches_played"), Number("tackles"), Number("interceptions"),
]
PLAYER_NUMBERS = [Number("height_cm", low=140, high=220, whole=False, fill=True), Number("weight_kg", low=35, high=150), Number("age", low=10, high=60)]
POSITIONS = ["DEF", "FW", "GK", "MID"]
_STATISTICS_KEYS = ("row_id", "player_id", "match_id", "team_id", "season", "loaded_at")


def position_group(c: Column) -> Column:
    """GK, DEF, MID or FW from a full name or a code; NULL for anything else."""
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(is_missing(c) | (F.upper(F.trim(c)) == "UNK"), None).otherwise(
        F.when(first == "G", "GK").when(first == "D", "DEF").when(first == "M", "MID").when(first.isin("F", "S", "A"), "FW")
    )


def used_rows(df: DataFrame) -> DataFrame:
    """The rows of a statistics table with at least one statistic."""
    any_value = F.lit(False)
    for name, kind in df.dtypes:
        if name not in _STATISTICS_KEYS and kind in ("bigint", "int", "double"):
            any_value = any_value | F.col(name).isNotNull()
    return df.filter(any_value)


def _with_player(spark: SparkSession, d: str, stats: DataFrame, numbers: list[Number]) -> DataFrame:
    """The statistics with their player's means of the filled columns and position."""
    targets = [n for n in numbers if n.fill]
    means = mixture.group_means(stats, norm_key(F.col("player_id")), targets)
    where = (
        table(spark, d, "players_cleaned")
        .select(norm_key(F.col("player_id")).alias("k"), position_group(F.col("position")).alias("position"))
        .filter("k is not null")
        .groupBy("k")
        .agg(F.mode("position", True).alias("position"))
    )
    dim = means.join(where, "k", "left")
    return mixture.join_group(stats, norm_key(F.col("player_id")), dim, F.col("row_id")).withColumnRenamed("row_id", "row_key")


def _match_cells(spark: SparkSession, d: str) -> DataFrame:
    own = MATCH_NUMBERS + [Number("mean_minutes_played"), Number("mean_shots")]
    stats = used_rows(table(spark, d, "player_match_stats_cleaned")).select("row_id", "player_id", *[n.name for n in MATCH_NUMBERS])
    return mixture.fill_cells(_with_player(spark, d, stats, MATCH_NUMBERS), own, {"position": POSITIONS})


def _season_cells(spark: SparkSession, d: str) -> DataFrame:
    own = SEASON_NUMBERS + [Number("mean_passes_completed")]
    stats = used_rows(table(spark, d, "player_season_stats_cleaned")).select("row_id", "player_id", *[n.name for n in SEASON_NUMBERS])
    return mixture.fill_cells(_with_player(spark, d, stats, SEASON_NUMBERS), own, {"position": POSITIONS})


def _player_cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "players_cleaned")
    x = p.select(F.col("row_id").alias("row_key"), *[n.name for n in PLAYER_NUMBERS], position_group(F.col("position")).alias("position"))
    return mixture.fill_cells(x, PLAYER_NUMBERS, {"position": POSITIONS}, ["position"])


_FILLED = {"player_match_stats_cleaned": _match_cells, "player_season_stats_cleaned": _season_cells, "players_cleaned": _player_cells}


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every filled cell with its fill."""
    parts = [
        f(spark, d).select(F.lit(name).alias("table_name"), "column_name", F.col("row_key").alias("row_id"), F.round("number", 2).alias("number"), "category")
        for name, f in _FILLED.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that the operator filled, among the four columns."""
    return p5_filled(spark, d).filter(F.col("column_name") != "position").select("table_name", "column_name", "row_id")


def p5_height_table(spark: SparkSession, d: str) -> DataFrame:
    """players_cleaned with its heights filled and the fills marked."""
    cells = _player_cells(spark, d).filter("column_name = 'height_cm'")
    return mixture.fill_table(table(spark, d, "players_cleaned"), "row_id", cells, PLAYER_NUMBERS)


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "raw_files"), table(spark, d, "raw_file_lines"), table(spark, d, "field_catalog")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(schema_drift.schema_scripts(*_raw(spark, d)))


def p6_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The edit script and the projection of every file."""
    return schema_drift.schema_scripts(*_raw(spark, d))


def p6_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(*_raw(spark, d), "key_stats")


def p6_defending(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(*_raw(spark, d), "defending")


QUERIES = {
    "p1_found": p1_found, "p1_drift": p1_drift, "p1_profile": p1_profile, "p1_masks": p1_masks,
    "p3_found": p3_found, "p3_report": p3_report, "p3_ledger": p3_ledger,
    "p5_found": p5_found, "p5_filled": p5_filled, "p5_height_table": p5_height_table,
    "p6_found": p6_found, "p6_scripts": p6_scripts, "p6_key_stats": p6_key_stats, "p6_defending": p6_defending,
}

_MARKERS = "('', 'NULL', 'NAN', 'NONE', 'NA', 'NOT_AVAILABLE_IN_SOURCE', 'NO_ASSIST_OR_NOT_RECORDED', '<NA>')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


_P1 = rf"""
with cells as (
  select row_id, feed_id, load_id, 'referee' as column_name, referee as v from matches_cleaned
  union all select row_id, feed_id, load_id, 'stadium', stadium from matches_cleaned
  union all select row_id, feed_id, load_id, 'possession_home', possession_home from matches_cleaned),
x as (
  select *, v is null or upper({_strip('v')}) in {_MARKERS} as missing, {_strip('v')} as t,
    case column_name
      when 'referee' then regexp_full_match(v, '\p{{L}}[\p{{L}}\p{{M}}\-''’.]*( \p{{L}}[\p{{L}}\p{{M}}\-''’.]*){{1,3}}')
      when 'stadium' then regexp_full_match(v, '[\p{{L}}\p{{M}}0-9 .''’&\-]{{1,60}}') and regexp_matches(v, '\p{{L}}')
        and v not like ' %' and v not like '% ' and v not like '%  %'
      else regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?( ?%)?') end as ok,
    case when column_name = 'possession_home' and regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?( ?%)?')
      then cast(regexp_extract(v, '-?[0-9]+(\.[0-9]+)?') as double) end as num
  from cells),
y as (select *, case when v like '%\%%' escape '\' or num > 1 then num / 100 else num end as share from x),
l as (
  select feed_id, load_id, column_name, avg(cast(missing as int)) as null_rate,
    avg(case when share between 0 and 1 then share end) as mean_share
  from y group by all),
top as (
  select feed_id, load_id, column_name, max(n) / sum(n) as top_share from (
    select feed_id, load_id, column_name, t, count(*) as n from y where not missing group by all) group by all),
m as (
  select l.*, median(null_rate) over w as mn, median(mean_share) over w as mm
  from l window w as (partition by feed_id, column_name))
select 'pattern' as finding, column_name, cast(row_id as varchar) as ref_id from y where not missing and not ok
union all select 'range', column_name, cast(row_id as varchar) from y where share < 0 or share > 1
union all select 'null_rate', column_name, load_id from m where load_id is not null and null_rate - mn >= 0.2 - 1e-9
union all select 'distribution', column_name, load_id from m
  where load_id is not null and column_name = 'possession_home' and abs(mean_share - mm) >= 0.06 - 1e-9
union all select 'distribution', column_name, load_id from top
  where load_id is not null and column_name <> 'possession_home' and top_share >= 0.38 - 1e-9
"""

_COLUMNS = (
    "match_id season competition data_scope source date home_team_id away_team_id stadium city country referee "
    "home_score away_score possession_home possession_away loaded_at deleted_at"
).split()


def _profile_sql(columns: list[str]) -> str:
    """The masks and the profile of the loads, up to the tables masks (m), loads (p) and divergences (j)."""
    text = {"loaded_at": "strftime(loaded_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f')", "deleted_at": "strftime(deleted_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S.%f')"}
    cells = " union all ".join(
        f"select feed_id as feed, load_id as load, '{c}' as column_name, "
        + (rf"regexp_replace({text[c]}, '\.?0+$', '') as value from matches_cleaned" if c in text else f"cast({c} as varchar) as value from matches_cleaned")
        for c in columns
    )
    mask = "value"
    for i, what in enumerate((r"\p{L}[\p{L}\p{M}]*", r"\p{M}+", "[0-9]+", r"\p{N}+", r"[\x09-\x0d\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"), 1):
        mask = f"regexp_replace({mask}, '{what}', chr({i}), 'g')"
    mask = f"translate({mask}, chr(1) || chr(2) || chr(3) || chr(4) || chr(5), 'Lm9n_')"
    return rf"""
with cells as ({cells}),
x as (select *, value is null or upper({_strip('value')}) in {_MARKERS} as missing, {_strip('value')} as t from cells),
i as (
  select feed, load, column_name, value, t, missing, count(*) as n,
    case when not missing then {mask} || case when column_name = 'stadium' and length(value) > 60 then '…' else '' end end as mask,
    case when column_name = 'possession_home' and regexp_full_match(t, '-?[0-9]+(\.[0-9]+)?( ?%)?') then cast(regexp_extract(t, '-?[0-9]+(\.[0-9]+)?') as double) end as num
  from x group by feed, load, column_name, value, t, missing),
s as (select *, case when t like '%\%%' escape '\' or num > 1 then num / 100 else num end as raw from i),
v as (select feed, load, column_name, case when not missing then t end as value, missing, sum(n) as n, max(case when raw between 0 and 1 then raw end) as share from s group by all),
m as (
  select column_name, mask, sum(n) as n, sum(n) / sum(sum(n)) over (partition by column_name) as share, min(value) as exemplar
  from i where not missing group by column_name, mask),
p as (
  select feed, load, column_name, sum(n) as rows, sum(case when missing then n else 0 end) as missing, count(*) filter (not missing) as distinct_values,
    min(value) as min_value, max(value) as max_value, (min(struct_pack(k := -n, v := value)) filter (not missing)).v as top_value,
    max(n) filter (not missing) as top_n, sum(share * n) / sum(n) filter (share is not null) as mean_share
  from v group by feed, load, column_name),
g as (select feed, load, column_name, mask, sum(n) as n from i where not missing group by all),
h as (
  select *, n / sum(n) over (partition by feed, load, column_name) as a,
    sum(n) over (partition by feed, column_name, mask) / sum(n) over (partition by feed, column_name) as b from g),
j as (
  select feed, load, column_name, count(*) as masks, min(struct_pack(k := -n, v := mask)).v as top_mask,
    greatest(0.0, sum(a * log2(a / ((a + b) / 2)) / 2 + b * log2(b / ((a + b) / 2)) / 2) + (1 - sum(b)) / 2) as mask_divergence
  from h group by feed, load, column_name)
"""


_P3 = rf"""
with dims as (
  select 'players_cleaned' as target, player_id as k, loaded_at, deleted_at from players_cleaned
  union all select 'matches_cleaned', match_id, loaded_at, deleted_at from matches_cleaned
  union all select 'teams_cleaned', team_id, loaded_at, deleted_at from teams_cleaned),
e as (
  select target, lower({_strip('k')}) as k, min(loaded_at) as first_at, count(*) filter (deleted_at is null) as alive,
    max(deleted_at) as last_gone, bool_or(loaded_at is null) as always
  from dims where k is not null and upper({_strip('k')}) not in {_MARKERS} group by 1, 2),
refs as (
  select 'player_match_stats_cleaned' as table_name, 'player_id' as column_name, 'players_cleaned' as target, row_id, player_id as k, loaded_at from player_match_stats_cleaned
  union all select 'player_match_stats_cleaned', 'match_id', 'matches_cleaned', row_id, match_id, loaded_at from player_match_stats_cleaned
  union all select 'goals_events_cleaned', 'assist_player_id', 'players_cleaned', row_id, assist_player_id, loaded_at from goals_events_cleaned
  union all select 'matches_cleaned', 'home_team_id', 'teams_cleaned', row_id, home_team_id, loaded_at from matches_cleaned),
r as (select * replace (lower({_strip('k')}) as k) from refs where k is not null and upper({_strip('k')}) not in {_MARKERS}),
o as (
  select r.table_name, r.column_name, r.row_id, r.loaded_at,
    case when e.k is null then 'missing' when not e.always and e.first_at > r.loaded_at then 'late'
      when e.alive = 0 and e.last_gone <= r.loaded_at then 'deleted' end as reason
  from r left join e on r.target = e.target and r.k = e.k)
"""

_P5 = """
with m as (
  select * from player_match_stats_cleaned where coalesce(minutes_played, goals, assists, shots, shots_on_target, shots_off_target, shots_blocked,
    passes_completed, passes_attempted, pass_accuracy, crosses_completed, crosses_attempted, dribbles, offsides, tackles, tackles_won, tackles_lost,
    interceptions, clearances, fouls_committed, fouls_suffered, yellow_cards, red_cards, distance_covered, top_speed, touches) is not null),
s as (
  select * from player_season_stats_cleaned where coalesce(matches_played, minutes_played, goals, assists, shots, shots_on_target, passes_completed,
    passes_attempted, tackles, interceptions, fouls_committed, yellow_cards, red_cards) is not null)
select 'player_match_stats_cleaned' as table_name, 'minutes_played' as column_name, row_id from m
  where minutes_played is null or minutes_played < 0 or minutes_played > 130
union all select 'player_match_stats_cleaned', 'shots', row_id from m where shots is null or shots < 0
union all select 'player_season_stats_cleaned', 'passes_completed', row_id from s where passes_completed is null or passes_completed < 0
union all select 'players_cleaned', 'height_cm', row_id from players_cleaned
  where height_cm is null or isnan(height_cm) or height_cm < 140 or height_cm > 220
"""

ORACLE = {
    "p1_found": _P1,
    "p1_masks": _profile_sql(_COLUMNS) + "select column_name, mask, cast(n as bigint) as n, exemplar, round(share, 6) as share, share >= 0.002 as dominant from m",
    "p1_drift": _profile_sql(PROFILED) + "select feed, load, column_name, round(mask_divergence, 6) as mask_divergence, top_mask from j where mask_divergence >= 0.02",
    "p1_profile": _profile_sql(_COLUMNS)
    + """select p.feed, p.load, p.column_name, cast(p.rows as bigint) as rows, cast(p.missing as bigint) as missing, round(p.missing / p.rows, 6) as null_rate,
      p.distinct_values, p.min_value, p.max_value, p.top_value, round(p.top_n / nullif(p.rows - p.missing, 0), 6) as top_share, round(p.mean_share, 6) as mean_share,
      coalesce(j.masks, 0) as masks, j.top_mask, round(j.mask_divergence, 6) as mask_divergence
      from p left join j on p.feed is not distinct from j.feed and p.load is not distinct from j.load and p.column_name = j.column_name""",
    "p5_found": _P5,
    "p3_found": _P3 + "select table_name, column_name, row_id, reason from o where reason is not null",
    "p3_report": _P3
    + """select table_name, column_name, strftime(loaded_at, '%Y-%m') as month, reason, count(*) as orphans
      from o where reason is not null group by all""",
    "p3_ledger": rf"""
      with r as (
        select 'players_cleaned' as target, player_id as k, null::timestamp as gone from player_match_stats_cleaned
        union all select 'matches_cleaned', match_id, null from player_match_stats_cleaned
        union all select 'players_cleaned', assist_player_id, null from goals_events_cleaned
        union all select 'teams_cleaned', home_team_id, deleted_at from matches_cleaned),
      t as (select 'players_cleaned' as target, player_id as k, deleted_at from players_cleaned
        union all select 'matches_cleaned', match_id, deleted_at from matches_cleaned
        union all select 'teams_cleaned', team_id, deleted_at from teams_cleaned),
      e as (select target, lower({_strip('k')}) as key, count(*) filter (deleted_at is null) as live from t group by all),
      n as (select target, lower({_strip('k')}) as key, count(*) filter (gone is null) as refs from r
        where k is not null and upper({_strip('k')}) not in {_MARKERS} group by all)
      select n.target, n.key, n.refs from n left join e using (target, key) where n.refs > 0 and coalesce(live, 0) = 0""",
}

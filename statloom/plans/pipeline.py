"""The seven relational tables from heterogeneous sources: collect, union by priority, resolve, type, write, gate.

Every collector returns a dict of some of the tables as texts with missing cells
NULL; sources that are absent give none. One lazy plan a table, executed by its write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import text as X
from statloom.functions.missing import null_if_missing
from statloom.operators import parse, quality, relational
from statloom.sources import readers, sinks

# The columns of the seven tables and their keys.
SCHEMAS = {
    "matches": "match_id season competition data_scope source date home_team_id away_team_id stadium city country referee home_score away_score possession_home possession_away",
    "players": "player_id player_name nationality age height_cm weight_kg position team_id",
    "teams": "team_id team_name country logo",
    "goals": "goal_id match_id minute goal_type player_id assist_player_id event_type player_name is_penalty is_own_goal",
    "match_stats": "player_id match_id minutes_played goals assists shots shots_on_target shots_off_target shots_blocked passes_completed passes_attempted pass_accuracy crosses_completed crosses_attempted "
    "dribbles offsides tackles tackles_won tackles_lost interceptions clearances fouls_committed fouls_suffered yellow_cards red_cards distance_covered top_speed team_id touches",
    "season_stats": "player_id season matches_played minutes_played goals assists shots shots_on_target passes_completed passes_attempted tackles interceptions fouls_committed yellow_cards red_cards",
    "gk": "player_id season saves goals_conceded clean_sheets penalty_saves punches",
}
KEYS = {"matches": ["match_id"], "players": ["player_id"], "teams": ["team_id"], "goals": ["goal_id"], "match_stats": ["player_id", "match_id"], "season_stats": ["player_id", "season"], "gk": ["player_id", "season"]}
DECIMAL = {"pass_accuracy", "distance_covered", "top_speed", "height_cm", "weight_kg"}
TEXT = {"match_id", "season", "competition", "data_scope", "source", "date", "home_team_id", "away_team_id", "stadium", "city", "country", "referee", "possession_home", "possession_away", "player_id",
        "player_name", "nationality", "position", "team_id", "team_name", "logo", "goal_id", "goal_type", "assist_player_id", "event_type"}
BOOLEAN = {"is_penalty", "is_own_goal"}
# Codes of the league files, with their competition and country.
LEAGUES = {
    "B1": ("Belgian Pro League", "Belgium"), "E0": ("Premier League", "England"), "SP1": ("La Liga", "Spain"), "D1": ("Bundesliga", "Germany"), "I1": ("Serie A", "Italy"), "F1": ("Ligue 1", "France"),
    "G1": ("Super League Greece", "Greece"), "N1": ("Eredivisie", "Netherlands"), "P1": ("Primeira Liga", "Portugal"), "SC0": ("Scottish Premiership", "Scotland"), "T1": ("Super Lig", "Turkey"),
}
# What the columns of the season bundles are called in the engine.
BUNDLE_2021 = {
    "key_stats": {"match_played": "matches_played", "minutes_played": "minutes_played", "goals": "goals", "assists": "assists"},
    "attempts": {"total_attempts": "shots", "on_target": "shots_on_target"}, "defending": {"tackles": "tackles", "balls_recoverd": "interceptions"},
    "disciplinary": {"fouls_committed": "fouls_committed", "yellow": "yellow_cards", "red": "red_cards"}, "distributon": {"pass_completed": "passes_completed", "pass_attempted": "passes_attempted"},
}
KEEPERS_2021 = {"saved": "saves", "conceded": "goals_conceded", "cleansheets": "clean_sheets", "saved_penalties": "penalty_saves", "punches made": "punches"}
BUNDLE_2025 = {
    "key_stats_data": {"minutes_played": "minutes_played", "matches_appareance": "matches_played"}, "goals_data": {"goals": "goals"}, "attacking_data": {"assists": "assists"},
    "attempts_data": {"total_attempts": "shots", "attempts_on_target": "shots_on_target"}, "defending_data": {"tackles": "tackles", "balls_recovered": "interceptions"},
    "disciplinary_data": {"fouls_committed": "fouls_committed", "yellow_cards": "yellow_cards", "red_cards": "red_cards"},
    "distribution_data": {"passes_completed": "passes_completed", "passes_attempted": "passes_attempted"},
    "goalkeeping_data": {"saves": "saves", "goals_conceded": "goals_conceded", "clean_sheets": "clean_sheets", "saves_on_penalty": "penalty_saves", "punches_made": "punches"},
}
PLAYER_FILE = {"MP": "matches_played", "Min": "minutes_played", "Goals": "goals", "Assists": "assists", "Shots": "shots", "SoT": "shots_on_target", "PasTotCmp": "passes_completed", "PasTotAtt": "passes_attempted",
               "Tkl": "tackles", "Int": "interceptions", "Fls": "fouls_committed", "CrdY": "yellow_cards", "CrdR": "red_cards"}

Tables = dict[str, DataFrame]


def frame(df: DataFrame, name: str) -> DataFrame:
    """The fixed columns of a table as texts, absent ones NULL; unavailable markers NULL."""
    return df.select(*[(null_if_missing(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in SCHEMAS[name].split()])


def _have(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})


def from_master(spark: SparkSession, path: str) -> Tables:
    """Matches, teams, players, goals and line-ups of the master file, from one cached scan."""
    if not readers.exists(spark, path):
        return {}
    cols = ["season", "fecha", "local", "visitante", "marcador", "estadio", "ciudad", "pais", "arbitro_principal", "posesion_local", "posesion_visitante", "planteles", "goles"]
    m = _have(readers.read_csv(spark, path), cols)
    m = m.withColumns({"home_team_id": X.stable_id("team", F.col("local")), "away_team_id": X.stable_id("team", F.col("visitante")), "match_id": X.stable_id("match", *[F.col(c) for c in ("season", "fecha", "local", "visitante")]), "s": X.parse_score(F.col("marcador"))}).persist()
    matches = m.select("match_id", "season", F.lit("UEFA Champions League").alias("competition"), F.lit("international_club").alias("data_scope"), F.lit("completed_csv").alias("source"), F.col("fecha").alias("date"), "home_team_id", "away_team_id",
                       F.col("estadio").alias("stadium"), F.col("ciudad").alias("city"), F.col("pais").alias("country"), F.col("arbitro_principal").alias("referee"), F.col("s.home").alias("home_score"), F.col("s.away").alias("away_score"),
                       X.pct_to_decimal(F.col("posesion_local")).alias("possession_home"), X.pct_to_decimal(F.col("posesion_visitante")).alias("possession_away"))
    teams = m.select(F.explode(F.array(F.struct(F.col("home_team_id").alias("i"), F.col("local").alias("n")), F.struct(F.col("away_team_id").alias("i"), F.col("visitante").alias("n")))).alias("t")).select(F.col("t.i").alias("team_id"), F.col("t.n").alias("team_name"))
    squad = parse.lineups(m, "match_id", "planteles").select("match_id", X.stable_id("player", F.col("player_name")).alias("player_id"), "player_name", X.stable_id("team", F.col("team_name")).alias("team_id"))
    scored = parse.goals(m, "match_id", "goles")
    goals = scored.select("goal_id", "match_id", "minute", "goal_type", X.stable_id("player", F.col("player_name")).alias("player_id"), F.lit("goal").alias("event_type"), "player_name",
                          (F.col("goal_type") == "penalty").alias("is_penalty"), (F.col("goal_type") == "own_goal").alias("is_own_goal"))
    return {"matches": matches, "teams": teams, "players": squad, "match_stats": squad, "goals": goals}


def _bundle(spark: SparkSession, folder: str, files: dict[str, dict[str, str]], keys: list[str]) -> DataFrame | None:
    """The files of a bundle as one row a key: of each column the last file's value that isn't missing."""
    parts = []
    for i, (name, columns) in enumerate(files.items()):
        path = f"{folder}/{name}.csv"
        if readers.exists(spark, path):
            df = readers.read_csv(spark, path)
            if all(k in df.columns for k in keys):
                parts.append(df.select(*keys, *[null_if_missing(F.col(f"`{a}`")).alias(b) for a, b in columns.items() if a in df.columns], F.lit(i).alias("_o")))
    if not parts:
        return None
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    own = [c for c in both.columns if c not in (*keys, "_o")]
    return relational.merge_non_null(both, keys, own, F.col("_o"), last=True)


def from_bundle_2021(spark: SparkSession, folder: str) -> Tables:
    out: Tables = {}
    b = _bundle(spark, folder, BUNDLE_2021, ["player_name", "club"])
    pid, tid = X.stable_id("player", F.col("player_name")), X.stable_id("team", F.col("club"))
    if b is not None:
        out["season_stats"] = b.withColumns({"player_id": pid, "season": F.lit("2021-2022")})
        out["players"] = b.select(pid.alias("player_id"), "player_name", tid.alias("team_id"))
        out["teams"] = b.select(tid.alias("team_id"), F.col("club").alias("team_name"))
    k = _bundle(spark, folder, {"goalkeeping": KEEPERS_2021}, ["player_name", "club"])
    if k is not None:
        out["gk"] = k.withColumns({"player_id": pid, "season": F.lit("2021-2022")})
    return out


def from_bundle_2025(spark: SparkSession, folder: str) -> Tables:
    """Player files by native id; names come from players_data where there is one. Every player has a keeper row."""
    b = _bundle(spark, folder, BUNDLE_2025, ["id_player"])
    if b is None:
        return {}
    meta = f"{folder}/players_data.csv"
    if readers.exists(spark, meta):
        names = readers.read_csv(spark, meta)
        b = b.join(_have(names, ["player_name"]).select("id_player", "player_name"), "id_player", "left")
    else:
        b = b.withColumn("player_name", F.lit(None).cast("string"))
    b = b.withColumns({"player_id": F.when(F.col("player_name").isNotNull(), X.stable_id("player", F.col("player_name"))).otherwise(X.stable_id("player", F.col("id_player"))), "season": F.lit("2024-2025")})
    return {"season_stats": b, "gk": b, "players": b.select("player_id", "player_name")}


def from_player_file(spark: SparkSession, path: str, season: str = "2021-2022") -> Tables:
    """The top-league rows of a player-season file with semicolons."""
    if not readers.exists(spark, path):
        return {}
    df = readers.read_csv(spark, path, sep=";", encoding="ISO-8859-1").filter(F.col("Comp").isin([c for c, _ in LEAGUES.values()]))
    pid, tid = X.stable_id("player", F.col("Player")), X.stable_id("team", F.col("Squad"))
    stats = df.select(pid.alias("player_id"), F.lit(season).alias("season"), *[F.col(a).alias(b) for a, b in PLAYER_FILE.items() if a in df.columns])
    return {"season_stats": stats, "players": df.select(pid.alias("player_id"), F.col("Player").alias("player_name"), F.col("Nation").alias("nationality"), F.col("Age").alias("age"), F.col("Pos").alias("position"), tid.alias("team_id")),
            "teams": df.select(tid.alias("team_id"), F.col("Squad").alias("team_name"))}


def _match_rows(df: DataFrame, key: list[str], home: str, away: str, scope: Column, source: str) -> Tables:
    ids = {"home_team_id": X.stable_id("team", F.col(home)), "away_team_id": X.stable_id("team", F.col(away)), "match_id": X.stable_id("match", *[F.col(c) for c in key]), "data_scope": scope, "source": F.lit(source)}
    m = df.withColumns(ids)
    sides = F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col(home).alias("team_name"), F.col("country").alias("country")), F.struct(F.col("away_team_id").alias("team_id"), F.col(away).alias("team_name"), F.col("country").alias("country")))
    return {"matches": m, "teams": m.select(F.explode(sides).alias("t")).select("t.*")}


def from_leagues(spark: SparkSession, root: str) -> Tables:
    df = readers.read_league_files(spark, root, LEAGUES).filter("HomeTeam <> '' and AwayTeam <> ''")
    df = df.select("season", "competition", "country", "HomeTeam", "AwayTeam", X.day_first(F.col("Date")).alias("date"), F.col("FTHG").alias("home_score"), F.col("FTAG").alias("away_score"), F.col("Referee").alias("referee"))
    return _match_rows(df, ["season", "competition", "date", "HomeTeam", "AwayTeam"], "HomeTeam", "AwayTeam", F.lit("domestic_league"), "football_data")


def from_fixture_texts(spark: SparkSession, paths: str) -> Tables:
    """Matches, teams and goals of fixture texts that a path rule covers."""
    if not readers.exists(spark, paths):
        return {}
    x = parse.fixture_lines(readers.read_lines(spark, paths)).filter("competition is not null")
    s = X.parse_score_token(F.col("score"))
    x = x.withColumns({"home_score": s["home"], "away_score": s["away"]})
    out = _match_rows(x, ["season", "competition", "date", "home", "away"], "home", "away", F.col("scope"), "fixture_text")
    g = parse.scorers(out["matches"].filter("scorer_line is not null"), "match_id", "scorer_line")
    pid = X.stable_id("player", F.col("player_name"))
    out["goals"] = g.select(X.stable_id("goal", F.col("match_id"), F.col("player_name"), F.col("minute"), F.col("goal_type")).alias("goal_id"), "match_id", "minute", "goal_type", pid.alias("player_id"), F.lit("goal").alias("event_type"), "player_name",
                            (F.col("goal_type") == "penalty").alias("is_penalty"), (F.col("goal_type") == "own_goal").alias("is_own_goal"))
    out["players"] = g.select(pid.alias("player_id"), "player_name")
    return out


EVENTS = ("id string, minute int, type struct<name:string>, team struct<name:string>, player struct<name:string>, shot struct<outcome:struct<name:string>,type:struct<name:string>>")
GAMES = (
    "match_id long, match_date string, home_score int, away_score int, competition struct<competition_name:string>, season struct<season_name:string>, stadium struct<name:string>, referee struct<name:string>, "
    "home_team struct<home_team_name:string,country:struct<name:string>>, away_team struct<away_team_name:string,country:struct<name:string>>"
)


def from_event_json(spark: SparkSession, root: str, years: tuple[int, int] = (2004, 2025), most: int | None = None) -> Tables:
    """Matches and events of nested JSON: matches/<c>/<s>.json and events/<match>.json; ``most`` events in order of file and id."""
    if not readers.exists(spark, f"{root}/matches/*/*.json"):
        return {}
    g = spark.read.schema(GAMES).option("multiLine", True).json(f"{root}/matches/*/*.json")
    g = g.filter(X.season_start_year(F.col("season.season_name")).between(*years)).select(
        F.col("match_id").cast("string").alias("native"), F.col("match_date").alias("date"), F.col("season.season_name").alias("season"), F.col("competition.competition_name").alias("competition"),
        F.col("home_team.home_team_name").alias("home"), F.col("away_team.away_team_name").alias("away"), F.col("home_team.country.name").alias("country"), F.col("stadium.name").alias("stadium"), F.col("referee.name").alias("referee"), "home_score", "away_score",
        F.lit("statsbomb").alias("k"),
    )
    out = _match_rows(g, ["k", "native"], "home", "away", F.lit("international_club"), "event_feed")
    if readers.exists(spark, f"{root}/events/*.json"):
        e = spark.read.schema(EVENTS).option("multiLine", True).json(f"{root}/events/*.json").withColumn("native", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
        e = e.join(out["matches"].select("native", "match_id"), "native")
        if most is not None:
            e = e.orderBy("native", "id").limit(most)
        kind = F.lower(F.col("shot.type.name"))
        out["goals"] = e.filter("type.name in ('Shot', 'Own Goal Against')").select(
            X.stable_id("event", F.col("id")).alias("goal_id"), "match_id", "minute", F.when(F.col("type.name") != "Shot", "own_goal").when(kind == "penalty", "penalty").otherwise("regular").alias("goal_type"),
            X.stable_id("player", F.col("player.name")).alias("player_id"), F.when((F.col("shot.outcome.name") == "Goal") | (F.col("type.name") != "Shot"), "goal").otherwise("shot").alias("event_type"),
            F.col("player.name").alias("player_name"), (kind == "penalty").alias("is_penalty"), (F.col("type.name") != "Shot").alias("is_own_goal"),
        )
    return out


def from_workbook(spark: SparkSession, path: str) -> Tables:
    """Sheets teams, players, matches and goals of a workbook."""
    if not readers.exists(spark, path):
        return {}
    w = readers.read_xlsx(spark, path)
    out: Tables = {}
    tid = lambda c: X.stable_id("team", F.col(c))
    if "teams" in w:
        out["teams"] = w["teams"].select(tid("TEAM_NAME").alias("team_id"), F.col("TEAM_NAME").alias("team_name"), F.col("COUNTRY").alias("country"))
    if "players" in w:
        name = F.concat_ws(" ", "FIRST_NAME", "LAST_NAME")
        out["players"] = w["players"].select(X.stable_id("player", name).alias("player_id"), name.alias("player_name"), F.col("NATIONALITY").alias("nationality"), F.col("HEIGHT").alias("height_cm"), F.col("WEIGHT").alias("weight_kg"), F.col("POSITION").alias("position"), tid("TEAM").alias("team_id"))
    if "matches" in w:
        mid = X.stable_id("match", *[F.col(c) for c in ("SEASON", "DATE_TIME", "HOME_TEAM", "AWAY_TEAM")])
        out["matches"] = w["matches"].select(mid.alias("match_id"), F.col("SEASON").alias("season"), F.lit("workbook").alias("source"), F.col("DATE_TIME").alias("date"), tid("HOME_TEAM").alias("home_team_id"), tid("AWAY_TEAM").alias("away_team_id"), F.col("STADIUM").alias("stadium"),
                                             F.col("HOME_TEAM_SCORE").alias("home_score"), F.col("AWAY_TEAM_SCORE").alias("away_score"))
        if "goals" in w and "players" in w:
            g = w["goals"].join(w["matches"].select("MATCH_ID", mid.alias("match_id")), "MATCH_ID").join(w["players"].select(F.col("PLAYER_ID").alias("PID"), F.concat_ws(" ", "FIRST_NAME", "LAST_NAME").alias("player_name")), "PID")
            out["goals"] = g.select(X.stable_id("goal", F.col("match_id"), F.col("PID"), F.col("DURATION")).alias("goal_id"), "match_id", F.col("DURATION").alias("minute"), F.lit("regular").alias("goal_type"), X.stable_id("player", F.col("player_name")).alias("player_id"), F.lit("goal").alias("event_type"), "player_name")
    return out


def combine(spark: SparkSession, sources: list[Tables]) -> Tables:
    """The seven tables: sources united by priority, one row a key, aliases resolved, contradictions reset, typed."""
    out: Tables = {}
    for name, key in KEYS.items():
        frames = [frame(s[name], name).filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in key])) for s in sources if name in s]
        if not frames:
            out[name] = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in SCHEMAS[name].split()]))
        elif name in ("season_stats", "gk"):
            tagged = reduce(DataFrame.unionByName, [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
            columns = [c for c in SCHEMAS[name].split() if c not in key]
            # of rows of one source and key the smallest row counts, which makes the order total
            out[name] = relational.merge_non_null(tagged, key, columns, F.struct("_p", F.to_json(F.struct(*columns)).alias("_t")))
        else:
            out[name] = relational.union_by_priority(frames, key, [c for c in SCHEMAS[name].split() if c not in key])
    aliases = relational.alias_map(out["players"].filter("player_name is not null and team_id is not null"), "player_id", "player_name", "team_id").persist()
    for name in ("players", "goals", "match_stats", "season_stats", "gk"):
        out[name] = relational.keep_one(relational.rewrite_ids(out[name], "player_id", aliases), KEYS[name], [F.to_json(F.struct(*[c for c in SCHEMAS[name].split()]))])
    out["goals"] = relational.rewrite_ids(out["goals"], "assist_player_id", aliases)
    return {n: reset_contradictions(typed(df.select(*SCHEMAS[n].split()))) for n, df in out.items()}


def typed(df: DataFrame) -> DataFrame:
    whole = [c for c in df.columns if c not in DECIMAL | TEXT | BOOLEAN]
    return sinks.typed(df, whole, [c for c in df.columns if c in DECIMAL], [c for c in df.columns if c in BOOLEAN])


def reset_contradictions(df: DataFrame) -> DataFrame:
    """Possession of nothing on both sides, and parts larger than their whole, are missing."""
    out = df
    if "possession_home" in df.columns:
        none = F.coalesce((X.number(F.col("possession_home")) == 0) & (X.number(F.col("possession_away")) == 0), F.lit(False))
        out = out.withColumns({c: F.when(~none, F.col(c)) for c in ("possession_home", "possession_away")})
    for part, whole in (("passes_completed", "passes_attempted"), ("shots_on_target", "shots")):
        if part in df.columns and whole in df.columns:
            bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
            out = out.withColumns({c: F.when(~bad, F.col(c)) for c in (part, whole)})
    return out


LAYERS = {"matches": "core", "players": "core", "teams": "core", "goals": "events", "match_stats": "stats", "season_stats": "stats", "gk": "stats"}


def run(spark: SparkSession, raw: str, out: str) -> dict[str, dict[str, object]]:
    """Build and write the seven tables from the sources below ``raw``; the report of rows and gates."""
    sources = [
        from_master(spark, f"{raw}/completed.csv"), from_workbook(spark, f"{raw}/matches.xlsx"), from_leagues(spark, f"{raw}/leagues"), from_fixture_texts(spark, f"{raw}/fixtures/*/*/*.txt"),
        from_event_json(spark, f"{raw}/events"), from_bundle_2021(spark, f"{raw}/2021"), from_bundle_2025(spark, f"{raw}/2025"), from_player_file(spark, f"{raw}/players.csv"),
    ]
    report = {}
    for name, df in combine(spark, sources).items():
        sinks.write_pair(df, f"{out}/{LAYERS[name]}", name)
        written = spark.read.parquet(f"{out}/{LAYERS[name]}/{name}.parquet")
        failed = quality.completeness(written).filter("passed = 0").count()
        report[name] = {"rows": written.count(), "columns": written.columns, "columns_below_gate": failed}
    return report

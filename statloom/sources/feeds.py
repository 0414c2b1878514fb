"""Parsers of what match sites deliver: JSON by schema, HTML by its tables. Fetching is left to others.

All take a table with a key and the delivered text, so that any number of
documents is parsed where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import strip
from statloom.functions.text import number, safe_pct
from statloom.operators.relational import keep_one

SUMMARY = """
header struct<competitions: array<struct<competitors: array<struct<homeAway: string, team: struct<id: string, displayName: string>>>>>>,
gameInfo struct<officials: array<struct<displayName: string>>>,
boxscore struct<teams: array<struct<team: struct<id: string>, statistics: array<struct<name: string, displayValue: string>>>>>,
rosters array<struct<team: struct<id: string, displayName: string>, roster: array<struct<athlete: struct<displayName: string>, stats: array<struct<name: string, displayValue: string>>>>>>,
keyEvents array<struct<type: struct<text: string>, clock: struct<displayValue: string>, participants: array<struct<athlete: struct<displayName: string>>>>>
"""
# The counters of a roster and the engine's columns.
ROSTER = {
    "goals": "totalGoals", "assists": "goalAssists", "shots": "totalShots", "shots_on_target": "shotsOnTarget", "fouls_committed": "foulsCommitted", "fouls_suffered": "foulsSuffered",
    "yellow_cards": "yellowCards", "red_cards": "redCards", "saves": "saves", "shots_faced": "shotsFaced",
}


def _values(items: Column) -> Column:
    """An array of (name, displayValue) as a map; of repeated names the last counts."""
    return F.aggregate(items, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["name"]), F.create_map(x["name"], x["displayValue"])))


def _whole(values: Column, name: str) -> Column:
    return F.coalesce(number(F.try_element_at(values, F.lit(name))).cast("long"), F.lit(0))


def summaries(df: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the parsed summary, ``s``."""
    return df.select(key, F.from_json(text, SUMMARY).alias("s")).filter("s is not null")


def summary_match(parsed: DataFrame, key: str) -> DataFrame:
    """(key, referee, possession_home, possession_away)."""
    home = F.filter(F.try_element_at("s.header.competitions", F.lit(1))["competitors"], lambda c: c["homeAway"] == "home")
    hid = F.try_element_at(home, F.lit(1))["team"]["id"]

    def share(own: bool) -> Column:
        t = F.filter("s.boxscore.teams", lambda t: (t["team"]["id"] == hid) == F.lit(own))
        stats = F.filter(F.try_element_at(t, F.lit(1))["statistics"], lambda x: x["name"] == "possessionPct")
        return safe_pct(F.try_element_at(stats, F.lit(1))["displayValue"])

    return parsed.select(key, F.try_element_at("s.gameInfo.officials", F.lit(1))["displayName"].alias("referee"), share(True).alias("possession_home"), share(False).alias("possession_away"))


def summary_players(parsed: DataFrame, key: str) -> DataFrame:
    """(key, team_name, player_name, minutes_played, counters): minutes, else appearances of 90."""
    r = parsed.select(key, F.explode("s.rosters").alias("r")).select(key, F.col("r.team.displayName").alias("team_name"), F.explode("r.roster").alias("p"))
    r = r.withColumn("v", _values(F.coalesce("p.stats", F.array().cast("array<struct<name:string,displayValue:string>>"))))
    v = F.col("v")
    minutes = F.greatest(_whole(v, "minutesPlayed"), F.lit(0))
    minutes = F.when(minutes != 0, minutes).when(_whole(v, "minutes") != 0, _whole(v, "minutes")).otherwise(_whole(v, "appearances") * 90)
    return r.select(key, "team_name", F.col("p.athlete.displayName").alias("player_name"), minutes.alias("minutes_played"), *[_whole(v, n).alias(c) for c, n in ROSTER.items()])


def summary_goals(parsed: DataFrame, key: str) -> DataFrame:
    """(key, player_name, minute, is_penalty, is_own_goal) of the key events that are goals."""
    e = parsed.select(key, F.explode("s.keyEvents").alias("e")).filter(F.size("e.participants") > 0)
    kind = F.lower("e.type.text")
    return e.filter(kind.contains("goal")).select(
        key, F.col("e.participants")[0]["athlete"]["displayName"].alias("player_name"), F.replace(F.col("e.clock.displayValue"), F.lit("'"), F.lit("")).alias("minute"),
        kind.contains("penalty").alias("is_penalty"), kind.contains("own goal").alias("is_own_goal"),
    )


OFFICIAL = """array<struct<stadium: struct<countryCode: string, translations: struct<name: map<string,string>, city: map<string,string>>>, kickOffTime: struct<dateTime: string>,
referees: array<struct<role: string, person: struct<translations: struct<name: map<string,string>>>>>>>"""
_TEAM = "struct<team: struct<translations: struct<name: map<string,string>>>, players: array<struct<status: string, player: struct<translations: struct<name: map<string,string>>>>>>"
LINEUPS = f"homeTeam {_TEAM}, awayTeam {_TEAM}"


def _translated(names: Column, *languages: str) -> Column:
    return F.coalesce(*[F.try_element_at(names, F.lit(x)) for x in languages], F.try_element_at(F.map_values(names), F.lit(1)))


def official_match(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stadium, city, country, start_time, referee) of the official match JSON."""
    m = df.select(key, F.try_element_at(F.from_json(text, OFFICIAL), F.lit(1)).alias("m"))
    ref = F.try_element_at(F.filter("m.referees", lambda r: r["role"] == "REFEREE"), F.lit(1))["person"]["translations"]["name"]
    return m.select(
        key, F.try_element_at("m.stadium.translations.name", F.lit("EN")).alias("stadium"), F.try_element_at("m.stadium.translations.city", F.lit("EN")).alias("city"), F.col("m.stadium.countryCode").alias("country"),
        F.substring(F.substring_index("m.kickOffTime.dateTime", "T", -1), 1, 5).alias("start_time"), strip(_translated(ref, "ES", "EN")).alias("referee"),
    )


def official_lineups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, team_name, player_name, minutes_played): 90 for starters, else 0."""
    x = df.select(key, F.from_json(text, LINEUPS).alias("x")).select(key, F.explode(F.array("x.homeTeam", "x.awayTeam")).alias("t"))
    x = x.select(key, F.try_element_at("t.team.translations.name", F.lit("EN")).alias("team_name"), F.explode("t.players").alias("p"))
    return x.select(key, "team_name", _translated(F.col("p.player.translations.name"), "EN").alias("player_name"), F.when(F.col("p.status") == "STARTING_LINEUP", 90).otherwise(0).alias("minutes_played"))


SEASON_DUMP = ", ".join(f"{c} array<struct<player_id: string, player_name: string, season: string, stats: map<string,string>>>" for c in ("goalkeeping", "disciplinary", "attacking", "passing"))


def season_dump(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keepers, season rows, players) of a dump of four categories; of a repeated key the last category and record counts."""
    d = df.select(F.from_json(text, SEASON_DUMP).alias("d"))
    rows = None
    for i, c in enumerate(("goalkeeping", "disciplinary", "attacking", "passing")):
        part = d.select(F.posexplode(f"d.{c}").alias("pos", "r")).select(F.lit(i).alias("category"), "pos", "r.*")
        rows = part if rows is None else rows.unionByName(part)
    last = [F.col("category").desc(), F.col("pos").desc(), F.col("player_name")]
    get = lambda n: F.coalesce(number(F.try_element_at("stats", F.lit(n))).cast("long"), F.lit(0)).alias(n)
    keepers = keep_one(rows.filter("category = 0 and size(stats) > 0"), ["player_id", "season"], last).select("player_id", "season", *[get(n) for n in ("saves", "goals_conceded", "clean_sheets", "penalty_saves", "punches")])
    seasons = keep_one(rows.filter("category > 0"), ["player_id", "season"], last).select("player_id", "season", "stats")
    players = keep_one(rows, ["player_id"], [F.col("category"), F.col("pos"), F.col("player_name")]).select("player_id", "player_name")
    return keepers, seasons, players


def profile_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, birth_date, height_cm, position, nationality, birth_place) of the text of a profile page, in Spanish or English."""
    def find(pattern: str, most: int | None = None) -> Column:
        v = strip(F.regexp_extract(text, "(?i)" + pattern, 1))
        return F.when((v != "") & (F.length(v) < most if most else F.lit(True)), v)

    height = find(r"(?:Altura|Height)[^:]*:\s*([0-9,.]+)\s*m")
    return df.select(
        key, F.try_to_timestamp(find(r"(?:Nacim|birth|Edad)[^:]*:\s*(\d{2}/\d{2}/\d{4})"), F.lit("dd/MM/yyyy")).cast("date").alias("birth_date"),
        F.floor(F.replace(height, F.lit(","), F.lit(".")).try_cast("decimal(6,3)") * 100).cast("int").alias("height_cm"),
        find(r"(?:Posición|Position)[^:]*:\s*(.+?)(?:\n|$)", 40).alias("position"), find(r"(?:Nacionalidad|Nationality|Citizenship)[^:]*:\s*(.+?)(?:\n|$)", 40).alias("nationality"),
        find(r"(?:Lugar de nac|Place of birth)[^:]*:\s*(.+?)(?:\n|$)", 60).alias("birth_place"),
    )


class _Rows(HTMLParser):
    """Every table's id, class and rows of cells (data-stat, text)."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.stack: list[dict] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"id": a.get("id", ""), "class": a.get("class", ""), "rows": []})
            self.tables.append(self.stack[-1])
        elif tag == "tr" and self.stack:
            self.stack[-1]["rows"].append([])
        elif tag in ("td", "th") and self.stack:
            if not self.stack[-1]["rows"]:
                self.stack[-1]["rows"].append([])
            self.cell = [a.get("data-stat", ""), ""]
            self.stack[-1]["rows"][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.stack.pop()
        elif tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data


def page_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_no, table_id, table_class, row_no, cell_no, stat, text) of all tables, also of those in comments."""
    kind = dict(df.dtypes)[key]
    names = [key, "table_no", "table_id", "table_class", "row_no", "cell_no", "stat", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in b.itertuples(index=False):
                p = _Rows()
                p.feed(re.sub(r"<!--(.*?<table.*?)-->", r"\1", page or "", flags=re.S))
                out += [(k, i, t["id"], t["class"], j, n, c[0], " ".join(c[1].split())) for i, t in enumerate(p.tables) for j, r in enumerate(t["rows"]) for n, c in enumerate(r)]
            yield pd.DataFrame(out, columns=names)

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, table_no int, table_id string, table_class string, row_no int, cell_no int, stat string, text string")


# The cells of a summary table and the engine's columns.
SUMMARY_CELLS = {
    "minutes_played": "minutes", "goals": "goals", "assists": "assists", "shots": "shots", "shots_on_target": "shots_on_target", "yellow_cards": "cards_yellow", "red_cards": "cards_red", "fouls_committed": "fouls",
    "fouls_suffered": "fouled", "offsides": "offsides", "crosses_completed": "crosses", "tackles_won": "tackles_won", "interceptions": "interceptions",
}


def summary_tables(cells: DataFrame, key: str) -> DataFrame:
    """(key, team, player_name, counters) of the tables stats_<team>_summary; cells that aren't digits are 0."""
    c = cells.filter(F.col("table_id").rlike("^stats_.*_summary$"))
    value = lambda stat: F.max(F.when(F.col("stat") == stat, F.col("text")))
    per = c.groupBy(key, "table_no", "row_no", F.split("table_id", "_")[1].alias("team")).agg(value("player").alias("player_name"), *[value(s).alias(n) for n, s in SUMMARY_CELLS.items()])
    digits = lambda n: F.coalesce(F.when(F.col(n).rlike("^[0-9]+$"), F.col(n)).cast("long"), F.lit(0)).alias(n)
    return per.filter("player_name is not null and player_name <> 'Player'").select(key, "team", "player_name", *[digits(n) for n in SUMMARY_CELLS])


def report_tables(cells: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, line-ups) of report pages: label rows Venue, Referee and Attendance, and tables with a Player header."""
    std = cells.filter(F.col("table_class").rlike(r"\bstd\b"))
    rows = std.groupBy(key, "table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("cell_no", "text"))).alias("c"))
    label, last = F.concat_ws(" ", "c.text"), F.element_at("c.text", -1)
    meta = rows.groupBy(key).agg(*[F.max(F.when(label.contains(w), last)).alias(n) for w, n in (("Venue", "stadium"), ("Referee", "referee"), ("Attendance", "attendance"))])
    heads = rows.filter((F.col("row_no") == 0) & label.contains("Player")).select(key, "table_no")
    order = heads.groupBy(key).agg(F.sort_array(F.collect_list("table_no")).alias("order"))  # the tables of one page
    squads = rows.filter("row_no > 0 and size(c) >= 2").join(heads, [key, "table_no"]).join(order, key)
    side = F.when(F.array_position("order", F.col("table_no")) == 1, "home").otherwise("away")
    return meta, squads.select(key, side.alias("side"), F.col("c.text")[1].alias("player_name")).filter("player_name <> ''")

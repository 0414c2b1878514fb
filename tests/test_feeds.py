import json

from statloom.sources import feeds


def test_summary(spark):
    doc = {
        "header": {"competitions": [{"competitors": [{"homeAway": "home", "team": {"id": "1", "displayName": "Red"}}, {"homeAway": "away", "team": {"id": "2"}}]}]},
        "gameInfo": {"officials": [{"displayName": "Ref One"}]},
        "boxscore": {"teams": [{"team": {"id": "2"}, "statistics": [{"name": "possessionPct", "displayValue": "40.4"}]}, {"team": {"id": "1"}, "statistics": [{"name": "possessionPct", "displayValue": "59.6"}]}]},
        "rosters": [{"team": {"displayName": "Red"}, "roster": [{"athlete": {"displayName": "Ann"}, "stats": [{"name": "totalGoals", "displayValue": "2"}, {"name": "appearances", "displayValue": "1"}]}, {"athlete": {"displayName": "Bo"}}]}],
        "keyEvents": [{"type": {"text": "Penalty - Goal"}, "clock": {"displayValue": "12'"}, "participants": [{"athlete": {"displayName": "Ann"}}]}, {"type": {"text": "Goal"}, "participants": []}],
    }
    s = feeds.summaries(spark.createDataFrame([("m", json.dumps(doc)), ("x", "no json"), ("y", None)], "id string, t string"), "id", "t")
    assert tuple(feeds.summary_match(s, "id").filter("id = 'm'").first()) == ("m", "Ref One", "60%", "40%")
    assert [(r.player_name, r.minutes_played, r.goals) for r in feeds.summary_players(s, "id").orderBy("player_name").collect()] == [("Ann", 90, 2), ("Bo", 0, 0)]
    assert [tuple(r) for r in feeds.summary_goals(s, "id").collect()] == [("m", "Ann", "12", True, False)]


def test_official(spark):
    m = [{"stadium": {"countryCode": "ESP", "translations": {"name": {"EN": "Park"}, "city": {"EN": "Town"}}}, "kickOffTime": {"dateTime": "2020-01-01T20:45:00Z"}, "referees": [{"role": "VAR", "person": {}}, {"role": "REFEREE", "person": {"translations": {"name": {"FR": " R Un "}}}}]}]
    t = {"homeTeam": {"team": {"translations": {"name": {"EN": "Red"}}}, "players": [{"status": "STARTING_LINEUP", "player": {"translations": {"name": {"EN": "Ann"}}}}, {"status": "BENCH", "player": {"translations": {"name": {"DE": "Bo"}}}}]}}
    df = spark.createDataFrame([("m", json.dumps(m), json.dumps(t))], "id string, m string, t string")
    assert tuple(feeds.official_match(df, "id", "m").first()) == ("m", "Park", "Town", "ESP", "20:45", "R Un")
    assert [tuple(r) for r in feeds.official_lineups(df, "id", "t").collect()] == [("m", "Red", "Ann", 90), ("m", "Red", "Bo", 0)]


def test_season_dump_and_profile(spark):
    d = {"goalkeeping": [{"player_id": "k", "player_name": "Kim", "season": "s", "stats": {"saves": 3}}], "attacking": [{"player_id": "p", "player_name": "Pat", "season": "s", "stats": {"goals": 1}}], "passing": [{"player_id": "p", "player_name": "Pat", "season": "s", "stats": {"passes_completed": 9}}]}
    k, s, p = feeds.season_dump(spark.createDataFrame([(json.dumps(d),)], "t string"), "t")
    assert k.first().saves == 3 and [dict(r.stats) for r in s.collect()] == [{"passes_completed": "9"}] and p.count() == 2
    df = spark.createDataFrame([("a", "F. Nacim./Edad: 28/07/1987 (38)\nAltura: 1,67 m\nPosición: Extremo\nNacionalidad: España\n"), ("b", None)], "id string, t string")
    a, b = feeds.profile_text(df, "id", "t").orderBy("id").collect()
    assert (str(a.birth_date), a.height_cm, a.position, a.nationality, a.birth_place) == ("1987-07-28", 167, "Extremo", "España", None) and b.height_cm is None


def test_pages(spark):
    page = """<table class="std"><tr><td>Venue</td><td>Park</td></tr></table><table class="std"><tr><th>#</th><th>Player</th></tr><tr><td>1</td><td>Ann</td></tr></table><table class="std"><tr><th>#</th><th>Player</th></tr><tr><td>1</td><td>Bo</td></tr></table>
    <!-- <table id="stats_x1_summary"><tr><th data-stat="player">Player</th></tr><tr><th data-stat="player">Cy</th><td data-stat="goals">2</td><td data-stat="minutes">n/a</td></tr></table> -->"""
    cells = feeds.page_cells(spark.createDataFrame([("p", page), ("q", None)], "id string, h string"), "id", "h")
    assert [(r.team, r.player_name, r.goals, r.minutes_played) for r in feeds.summary_tables(cells, "id").collect()] == [("x1", "Cy", 2, 0)]
    meta, squads = feeds.report_tables(cells, "id")
    assert meta.first().stadium == "Park" and sorted((r.side, r.player_name) for r in squads.collect()) == [("away", "Bo"), ("home", "Ann")]

from statloom.operators import generate, impute, quality
from statloom.operators.relational import hash_pick, slots

KEYS = [(i, g, 20 + i % 15 if i % 4 else None, 70.0 + i % 9 if i % 5 else None) for i, g in enumerate(["GK", "DEF", "MID", "FW", None, "odd"] * 500)]
COLUMNS = [c for c in generate.DRAWS] + ["shots_on_target", "shots_blocked", "shots_off_target", "passes_completed", "crosses_completed", "tackles_won", "tackles_lost", "yellow_cards", "red_cards", "minutes_played", "touches"]


def frame(spark, fill=None):
    schema = "row_id long, position_group string, age long, weight_kg double, " + ", ".join(f"{c} long" for c in COLUMNS) + ", pass_accuracy double, distance_covered double, top_speed double, observed_goals long, observed_assists long"
    rows = [(*k, *[fill] * len(COLUMNS), *[None if fill is None else 1.0] * 3, 4 if k[0] % 50 == 0 else None, None) for k in KEYS]
    return spark.createDataFrame(rows, schema)


def test_drawn_statistics_fit_together(spark):
    got = generate.generate_match_stats(frame(spark)).collect()
    again = generate.generate_match_stats(frame(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # by key, not by partition
    for r in got:
        assert r.goals <= r.shots_on_target <= r.shots and r.shots_on_target + r.shots_blocked + r.shots_off_target == r.shots
        assert r.passes_completed <= r.passes_attempted and 5 <= r.passes_attempted <= 95 and r.crosses_completed <= r.crosses_attempted <= 7
        assert r.tackles_won + r.tackles_lost == r.tackles and 1 <= r.minutes_played <= 120 and 25 <= r.top_speed <= 36 and 600 <= r.distance_covered <= 13000
        assert len(r.generated) == len(COLUMNS) + 3 and (r.goals == 4 or r.row_id % 50)
        assert r.position_group not in ("GK", "DEF") or r.minutes_played >= 70
    free = [r for r in got if r.row_id % 50]
    forwards, keepers = ([r.goals for r in free if r.position_group == g] for g in ("FW", "GK"))
    assert 0.28 < sum(g > 0 for g in forwards) / len(forwards) < 0.42 and sum(keepers) <= 10


def test_observed_statistics_stay(spark):
    for r in generate.generate_match_stats(frame(spark, 3)).collect():
        assert r.generated == [] and all(r[c] == 3 for c in COLUMNS)


def test_keepers(spark):
    df = spark.range(4000).selectExpr("id as row_id", "id % 3 as conceded")
    got = generate.generate_keeper_stats(df, df.conceded, df.row_id).collect()
    mean = sum(r.saves for r in got) / len(got)
    assert 3.0 < mean < 3.4 and {r.penalty_saves for r in got} == {0, 1} and {r.punches for r in got} == {0, 1, 2, 3, 4, 5}


def test_counts_of_fractions(spark):
    df = spark.createDataFrame([(1, 1.5), (2, -1.0), (3, 2.0), (4, None), (5, -0.5)], "row_id long, goals double")
    got = {(r.row_id, r.rule) for r in quality.anomalies(df, ["row_id"], quality.count_rules(["goals"])).collect()}
    assert got == {(1, "fractional_goals"), (2, "negative_goals"), (5, "negative_goals"), (5, "fractional_goals")}


def test_regions_and_empty_tables(spark):
    teams = spark.createDataFrame([(1, "a", "A B!", None, None, "x"), (2, "b", None, "Spain", "l", "x"), (3, "a", "later", "Italy", None, "x")], "row_id long, team_id string, team_name string, country string, logo string, side string")
    matches = spark.createDataFrame([(5, "a", "b", "Germany"), (4, "c", "a", "France")], "row_id long, home_team_id string, away_team_id string, country string")
    got = {r.team_id: r for r in impute.complete_teams(teams, matches).collect()}
    assert (got["a"].country, got["a"].team_slug, got["a"].logo) == ("Germany", "a-b", "generated://team-logo/a") and got["b"].country == "Spain" and got["b"].team_slug == "unknown"
    assert got["a"].team_region and got["b"].team_region
    assert impute.complete_teams(teams.limit(0), matches.limit(0)).count() == 0


def test_fills_without_a_source(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, 4, "n"), (3, None, None)], "row_id long, v long, name string")
    prior = spark.createDataFrame([], "name string, v long, id long")
    got = {r.row_id: (r.v, r.v_reason) for r in impute.prior_fill(df, df.name, prior, prior.name, [prior.id], {"v": "v"}).collect()}
    assert got == {1: (None, None), 2: (4, None), 3: (None, None)}
    assert {r.row_id: r.v for r in impute.donor_fill(df, df.name, "v", df.row_id).collect()} == {1: 4, 2: 4, 3: None}
    assert {r.row_id: r.v for r in impute.median_fill(df, ["v"]).collect()} == {1: 4, 2: 4, 3: 4}
    assert {r.v for r in impute.median_fill(df.filter("v is null"), ["v"]).collect()} == {None}


def test_hash_pick(spark):
    plan = slots(spark.createDataFrame([("t", "s"), ("u", "s"), ("none", "s")], "team string, season string"), 4)
    members = spark.createDataFrame([("t", "p1"), ("t", "p1"), ("t", None), ("t", "p2"), ("u", "q")], "team string, player string")
    got = hash_pick(plan, members, ["team"], "player", ["team", "season", "slot"]).collect()
    assert len(got) == 8 and {r.player for r in got if r.team == "u"} == {"q"} and {r.player for r in got if r.team == "t"} <= {"p1", "p2"}
    taken = spark.createDataFrame([("s", "q")], "season string, player string")
    assert {r.team for r in hash_pick(plan, members, ["team"], "player", ["team", "season", "slot"], taken).collect()} == {"t"}


def test_sparse_columns_and_histogram(spark):
    df = spark.createDataFrame([(i, None if i else "x", 5.0 * i) for i in range(21)], "a long, b string, c double")
    assert quality.drop_sparse(df, also=("a",)).columns == ["c"]
    assert quality.drop_sparse(df.limit(0)).columns == ["a", "b", "c"]
    got = [(r.bin, r.rows) for r in quality.histogram(df, "c", 0, 50, 5).orderBy("bin").collect()]
    assert got == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]  # 50 is in the last
    assert [(r.b, r.rows) for r in quality.bars(df, "b").collect()] == [("x", 1)]

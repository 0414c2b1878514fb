import random

from pyspark.sql import functions as F

from statloom.functions.missing import SHORT_MARKERS
from statloom.operators import impute, matching, metrics, parse, quality, reduce, relational


def test_dedupe_does_not_depend_on_row_order(spark):
    rows = [(i % 5, i % 3, f"v{i}") for i in range(60)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(map(tuple, relational.keep_one(spark.createDataFrame(rows, "k int, o int, v string"), ["k"], [F.col("o"), F.col("v")]).collect()))
        want = want or got
        assert got == want and len(got) == 5


def test_upsert_never_overwrites(spark):
    target = spark.createDataFrame([("a", "NULL", "x"), ("b", "kept", None)], "k string, s string, t string")
    source = spark.createDataFrame([("a", "new", "y"), ("c", "z", "z")], "k string, s string, t string")
    updated, conflicts, missing = relational.upsert_fill_only(target, source, ["k"], ["s", "t"], SHORT_MARKERS)
    assert sorted(map(tuple, updated.select("k", "s", "t").collect())) == [("a", "new", "x"), ("b", "kept", None)]
    assert [tuple(r) for r in conflicts.collect()] == [("a", "t", "x", "y")]
    assert [r.k for r in missing.collect()] == ["c"]


def test_aliases(spark):
    p = spark.createDataFrame([("1", "Ann Low", "t"), ("2", "Low", "t"), ("3", "Low", "u"), ("4", "Bo Low", "v"), ("5", "Cy Low", "v"), ("6", "Low", "v")], "id string, n string, t string")
    a = relational.alias_map(p, "id", "n", "t")
    assert [tuple(r) for r in a.collect()] == [("2", "1")]
    assert sorted(r.id for r in relational.rewrite_ids(p, "id", a).collect()) == ["1", "1", "3", "4", "5", "6"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "NULL"), (2, "x"), (3, "y")], "complete int, gaps string")
    got = {r.column_name: r for r in quality.completeness(df, 0.25).collect()}
    assert got["complete"].passed == 1 and got["gaps"].passed == 0 and got["gaps"].missing == 1
    adj = spark.createDataFrame([(1, "m1", "s", 1), (2, "m2", "s", 1)], "o int, match_id string, season string, home_score int")
    r = quality.adjacent_repeats(adj, [], ["o"], ["match_id", "season", "home_score"], ["match_id"]).first()
    assert (r.exact, r.similar) == (0, 1)
    assert quality.duplicate_profile(adj, ["season"]).first().duplicate_rows == 1
    assert quality.completeness(df.limit(0)).filter("ratio > 0").count() == 0


def test_metrics(spark):
    cols = {"player_id": "p", "passes_completed": 30, "passes_attempted": 40, "pass_accuracy": None, "dribbles": 2, "tackles": 3, "tackles_won": 2, "interceptions": 1, "clearances": None,
            "fouls_committed": 1, "yellow_cards": 1, "red_cards": 0, "distance_covered": None, "top_speed": None, "minutes_played": 90, "match_possession": 0.6, "opponent_possession": 0.4}
    df = spark.range(1).select(*[F.lit(v).cast("string" if c == "player_id" else "double").alias(c) for c, v in cols.items()])
    r = metrics.with_metrics(df).first()
    assert (r.expected_threat_total, r.expected_assists, r.foul_severity_index) == (1.64, 3.0, 4.0)
    assert r.progressive_pass_dist is None and r.xg_probability is None


def test_imputation(spark):
    df = spark.createDataFrame([(1, 5, 2, 1, None, 40, 50, None, 3, 1, None, 70, 1, 1, 1)], "row_id int, shots long, shots_on_target long, shots_blocked long, shots_off_target long, passes_completed long, passes_attempted long, pass_accuracy double, tackles long, tackles_won long, tackles_lost long, touches long, dribbles long, interceptions long, clearances long")
    out = impute.fill_missing(df, impute.formula_fills())
    r = out.first()
    assert (r.shots_off_target, r.pass_accuracy, r.tackles_lost, r.touches) == (2, 0.8, 2, 70)
    assert impute.change_log(out, "row_id", list(impute.formula_fills())).count() == 3
    bad = df.withColumns({"shots": F.lit(1), "passes_completed": F.lit(60)})
    once = impute.hard_normalise(bad, ["shots"])
    assert once.first().shots is None and once.first().passes_attempted is None
    assert impute.hard_normalise(once, ["shots"]).collect() == once.collect()


def test_draws_are_repeatable_and_distributed(spark):
    x = spark.range(20000).repartition(7).select(F.col("id"), impute.normal(1, F.lit(10.0), F.lit(2.0), F.col("id")).alias("n"), impute.draw_goals(F.lit("FW"), 3, F.col("id")).alias("g"), impute.poisson(impute.uniform(5, F.col("id")), F.lit(2.2)).alias("p"))
    a = x.agg(F.avg("n"), F.stddev("n"), F.avg((F.col("g") == 0).cast("int")), F.avg("p")).first()
    assert abs(a[0] - 10) < 0.1 and abs(a[1] - 2) < 0.1 and abs(a[2] - 0.65) < 0.02 and abs(a[3] - 2.2) < 0.1
    assert sorted(x.coalesce(1).collect()) == sorted(x.collect())


def test_goal_and_feed_parsers(spark):
    df = spark.createDataFrame([("m", "Ann Low 45+2'; 90' (P); Bo 12' (OG); ???"), ("n", None), ("o", "")], "id string, t string")
    got = [(r.player_name, r.minute, r.minute_base, r.minute_added, r.goal_type) for r in parse.goals(df, "id", "t").orderBy("position").collect()]
    assert got == [("Ann Low", "45+2", 45, 2, "regular"), ("Ann Low", "90", 90, None, "penalty"), ("Bo", "12", 12, None, "own_goal")]
    s = spark.createDataFrame([("m", "[Ann Low 12, Bo 40 (p); Cy 90+1' (og)]"), ("n", "no minutes")], "id string, t string")
    assert sorted((r.side, r.player_name, r.minute, r.goal_type) for r in parse.scorers(s, "id", "t").collect()) == [("away", "Cy", "90+1", "own_goal"), ("home", "Ann Low", "12", "regular"), ("home", "Bo", "40", "penalty")]


def test_fixture_and_squad_lines(spark):
    text = ["= Cup 2016", "Sat Jun 11", "  (1) 20.45  Home FC v Away Town  2-1 (1-0)", "  [Ann 12; Bo 40]", "Winner A 1-0 Winner B", "Sun Jun/12 2017", "Red 4-3 pen. (1-1) Blue @ Park, City # note"]
    lines = spark.createDataFrame([("/x/euro/2016--france/euro.txt", i, t) for i, t in enumerate(text, 1)], "path string, line_no int, text string")
    got = [(r.season, r.date, r.home, r.away, r.score, r.stadium, r.city, r.scorer_line, r.competition) for r in parse.fixture_lines(lines).orderBy("line_no").collect()]
    assert got == [
        ("2016", "Sat Jun 11 2016", "Home FC", "Away Town", "2-1 (1-0)", None, None, "  [Ann 12; Bo 40]", "UEFA Eurocup"),
        ("2016", "Sun Jun 12 2017", "Red", "Blue", "4-3 pen. (1-1)", "Park", "City", None, "UEFA Eurocup"),
    ]
    sq = spark.createDataFrame([("p", 1, " 9, Ann Low, FW, x, b. 1990"), ("p", 2, "no")], "path string, line_no int, text string")
    assert [tuple(r) for r in parse.squad_lines(sq, F.lit(2020)).collect()] == [("p", 9, "Ann Low", "FW", 30)]


def test_matching_tiers(spark):
    a = spark.createDataFrame([("d", 1, "Ann Low"), ("d", 2, "B. Kim"), ("d", 3, "Low Cy")], "b string, l int, n string")
    b = spark.createDataFrame([("d", 7, "ann low"), ("d", 8, "Bo Kim"), ("e", 9, "Ann Low")], "b string, r int, n string")
    assert sorted(map(tuple, matching.three_tier_match(a, b, "b", "l", "n", "r", "n").collect())) == [(1, 7, 1), (2, 8, 2), (3, 7, 3)]
    p = spark.createDataFrame([(1, 1, "Liverpool", "Liverpool FC"), (1, 2, "Liverpool", "Everton")], "k int, c int, a string, b string")
    assert [r.c for r in matching.best_similar(p, "k", "a", "b", "c").collect()] == [1]


def test_components(spark):
    rows = [(float(i), 2.0 * i + (i % 3), float(i % 7)) for i in range(200)]
    df = reduce.standardise(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    c = reduce.principal_components(df, ["a", "b", "c"])
    assert abs(sum(c.ratio) - 1) < 1e-9 and c.ratio[0] > 0.6 and c.needed == 2
    assert all(v[abs(v).argmax()] > 0 for v in c.components)
    flat = reduce.standardise(spark.createDataFrame([(1.0,), (1.0,), (None,)], "a double"), ["a"])
    assert [r.a for r in flat.collect()] == [0.0] * 3


def test_most_alike_against_brute_force(spark):
    from difflib import SequenceMatcher

    names = ["Dynamo Kor", "Dinamo Kor", " Korheim Union", "Union Korheim", "Xorheim Union", "Korheim Union", "Korheim Union", "KORHEIM UNION", "Q", "", "", "axbxc", "abc", None]
    names += [f"{k} {t}" for k in ("Union", "FC", "Racing") for t in ("Balberg", "Talberg", "Migwick", "Wickmig")]
    rows = [(i, n, c) for c, at in (("A", 0), ("B", 100), (None, 200)) for i, n in enumerate(names, at) if c != "B" or i % 3]
    want = {}
    for i, n, c in rows:
        if n is not None and c is not None:
            r = [(-SequenceMatcher(None, n.lower(), t.lower()).ratio(), j) for j, t, g in rows if g == c and j != i and t is not None]
            if r and -min(r)[0] > 0.6:
                want[i] = (min(r)[1], -min(r)[0])
    df = spark.createDataFrame(rows, "row_id long, team_name string, country string")
    for tile in (400, 5):
        assert {r.a: (r.b, r.ratio) for r in matching.most_alike(df, "row_id", "team_name", "country", tile=tile).collect()} == want


def test_best_match_ignores_first_letters(spark, tmp_path):
    from statloom.plans.table_queries import QUERIES

    rows = [(1, "Dynamo Kor", "A"), (2, "Dinamo Kor", "A"), (3, " Migwick Union", "A"), (4, "Migwick Union", "A"), (5, "Dynamo Kor", "B")]
    spark.createDataFrame(rows, "row_id long, team_name string, country string").write.parquet(str(tmp_path / "teams_cleaned.parquet"))
    assert {r.a: r.b for r in QUERIES["similarity_best_match"](spark, str(tmp_path)).collect()} == {1: 2, 2: 1, 3: 4, 4: 3}

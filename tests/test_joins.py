from pyspark.sql import functions as F

from statloom.operators import features, impute
from statloom.plans.fill_queries import season_cascade_fill
from statloom.plans.match_queries import games, players, stats
from statloom.session import even_join, salted_join, table


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_salted_join_are_not_broadcast(spark):
    left = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else None) for i in range(40)], "row_id long, k string")
    right = spark.range(2).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") + 1).alias("v"))
    got = salted_join(left, right, ["k"], "row_id", "left")
    assert "Broadcast" not in planned(got)
    assert sorted(tuple(r) for r in got.select("row_id", "v").collect()) == [(i, {0: 1, 1: 2}.get(i % 3) if i % 4 else None) for i in range(40)]


def test_player_match_features_read_the_matches_once(spark, small):
    plan = planned(features.player_match_features(stats(spark, small), games(spark, small), players(spark, small)).select("row_id", "season", "opponent_team_id", "player_age"))
    assert plan.count("matches_cleaned.parquet") == 1 and "Broadcast" not in plan


def test_even_join_spreads_missing_keys(spark):
    left = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 == 0 else None) for i in range(400)], "row_id long, k string")
    right = spark.range(2).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") + 1).alias("v")).unionByName(spark.sql("select cast(null as string) as k, 9L as v"))
    got = even_join(left, right, "k", "row_id")
    assert sorted(tuple(r) for r in got.select("row_id", "v").collect()) == [(i, {0: 1, 1: 2}.get(i % 3) if i % 4 == 0 else None) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        at = even_join(left, right, "k", "row_id").filter("k is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(at) > 1


def test_goal_features_copy_no_matches(spark, small):
    x = features.goal_event_features(table(spark, small, "goals_events_cleaned"), games(spark, small), players(spark, small))
    plan = planned(x.select("row_id", "season", "player_age"))
    assert "Broadcast" not in plan and plan.count("Generate explode") == 1  # copies of the players alone


def test_season_cascade_fill_gathers_the_rates_twice_at_most(spark, small):
    plan = planned(season_cascade_fill(spark, small))
    assert plan.count("Generate explode") <= 1 and plan.count("player_match_stats_cleaned.parquet") <= 3  # known cells, gaps, rates of the narrowest level


def test_cascade_takes_what_it_lacks_from_the_context(spark):
    rows = [(0, "a", "s", 2, 90), (1, "a", "s", 4, 90), (2, "a", "t", 9, 90), (3, "b", "s", 6, 90), (4, None, "s", 1, 90), (5, "b", None, 7, 0)]
    gaps = [(10, "a", "s", None, 90), (11, "c", "s", None, 45), (12, None, "u", None, 90), (13, "a", "s", None, None), (14, None, None, None, 90)]
    df = spark.createDataFrame(rows + gaps, "row_id long, p string, s string, n long, m long")
    asked = []

    def kind(x):
        asked.append(x.columns)
        return x.withColumn("kind", F.when(F.col("p") == "a", "x"))

    out = impute.per90_cascade(df, "n", [["p", "s"], ["s"], ["kind"], []], "m", {"kind": kind})
    assert out.columns == [*df.columns, "n_cascade"] and asked
    got = {r.row_id: r.n_cascade for r in out.collect()}
    # the player's 3 of the season; the season's 3 in half a match, to even; the overall 4; no minutes
    assert [got[k] for k in (0, 5, 10, 11, 12, 13, 14)] == [2, 7, 3, 2, 4, None, 4]

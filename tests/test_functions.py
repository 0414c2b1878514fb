from pyspark.sql import functions as F

from statloom.functions import text as X
from statloom.functions.dates import parse_date
from statloom.functions.missing import is_missing


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()[0]


def test_missing_markers(spark):
    for v in (None, "", "  ", "null", "NaN", " none ", "<NA>", "Not_Available_In_Source", "\tNA\n"):
        assert one(spark, v, is_missing) is True
    assert one(spark, "Nadal", is_missing) is False


def test_units(spark):
    assert one(spark, "85.5%", X.pct_to_decimal) == 0.855
    assert one(spark, "0.855", X.pct_to_decimal) == 0.855
    assert one(spark, "64.6", X.pct_to_decimal) == 0.646
    assert one(spark, None, X.pct_to_decimal) is None
    assert one(spark, "3d", X.number) is None
    assert one(spark, "inf", X.number) is None
    assert one(spark, "10.5", lambda c: X.norm_unit(c, "distance")) == 10.5
    assert one(spark, "x", X.format_possession) == 0.0


def test_names(spark):
    assert one(spark, "Éverton  Ribéiro-Júnior", X.soft_norm) == "everton ribeiro junior"
    assert one(spark, "Ribéiro-Júnior", X.soft_norm_joined) == "ribeirojunior"
    assert one(spark, "C. Ronaldo", X.canonical_name) == one(spark, "Cristiano Ronaldo", X.canonical_name) == "ronaldo c"
    assert one(spark, "Lionel Messi", X.player_hash) != one(spark, "C. Ronaldo", X.player_hash)
    assert one(spark, None, lambda c: X.stable_id("team", c)).startswith("team_")


def test_scores_and_dates(spark):
    assert tuple(one(spark, "2 - 1", X.parse_score)) == (2, 1)
    assert one(spark, "abandoned", X.parse_score) is None
    assert tuple(one(spark, "4-3 pen. (1-1)", X.parse_score_token)) == (1, 1)
    for s in ("2016-06-11", "11-06-2016", "11/06/2016", "11.06.16", "Sat Jun 11 2016", "Sat 11 Jun 2016", "Jun 11, 2016"):
        assert str(one(spark, s, parse_date)) == "2016-06-11", s
    assert one(spark, "TBC", parse_date) is None
    assert one(spark, "9899", X.season_span) == "1998-1999"


def test_positions_and_regions(spark):
    assert [one(spark, v, X.position_code) for v in ("Goalkeeper", "Centre-Back", "mid", "ST", "?", None)] == ["GK", "DEF", "MID", "FW", "UNK", "UNK"]
    assert [one(spark, v, X.position_name) for v in ("Goalkeeper", "DEF", None)] == ["Goalkeeper", "Other", "Unknown"]
    assert one(spark, "Brasil", X.country_region) == "South America"
    assert tuple(one(spark, "Boca (ARG)", X.split_team_country)) == ("Boca", "Argentina")


def test_equivalence(spark):
    df = spark.createDataFrame([("0.85", "85%")], "a string, b string")
    assert df.select(X.equivalent(F.col("a"), F.col("b"), "pass_accuracy")).first()[0]
    assert not df.select(X.equivalent(F.col("a"), F.lit(None).cast("string"))).first()[0]
    df = spark.createDataFrame([("José", "JOSE"), ("A", "B")], "a string, b string")
    assert [r[0] for r in df.select(X.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_right_closed_bins(spark):
    f = lambda c: X.right_closed(c, [0, 20, 24], ["u20", "21-24"])
    assert [one(spark, v, f, "int") for v in (0, 1, 20, 21, 24, 25, None)] == [None, "u20", "u20", "21-24", "21-24", None, None]

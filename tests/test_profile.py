import re
import unicodedata

from statloom.operators import profile

SCHEMA = "row_id long, feed_id string, load_id string, referee string, stadium string, possession_home string, value string, mask string"


def rows(spark, cells):
    """cells: (load, referee, stadium, possession)."""
    return spark.createDataFrame([(i, "f", load, r, s, p, "clash", "clash") for i, (load, r, s, p) in enumerate(cells)], SCHEMA)


def found(df):
    return sorted(tuple(r) for r in profile.quality_findings(df, ["referee", "stadium", "possession_home"]).collect())


GOOD = [("l1", "Ann Low", "Park 2", "50%"), ("l1", "Bo De-Witt", "Field", "0.5"), ("l1", "É. O'Neil", "St. Mark's & Co", "49 %")]


def test_pattern_against_brute_force(spark):
    odd = ["Ann  Low", " Ann Low", "Ann", "A B C D E", "Ann Low\n", "Ann1 Low", "ref_1", "Low, Ann", "émile Low", "́mile Low", "李 明", "x" * 5000 + " y", "NULL", "", None, "Ann Low"]
    df = rows(spark, GOOD + [("l1", v, None, None) for v in odd])
    got = {int(r) for f, c, r in found(df) if f == "pattern" and c == "referee"}

    def letter(c):
        return unicodedata.category(c)[0] == "L"

    def good(v):
        words = v.split(" ")
        return 2 <= len(words) <= 4 and all(w and letter(w[0]) and all(letter(c) or unicodedata.category(c)[0] == "M" or c in "-'’." for c in w) for w in words)

    want = {len(GOOD) + i for i, v in enumerate(odd) if v not in (None, "", "NULL") and not good(v)}
    assert got == want


def test_stadium_and_share_forms(spark):
    stadiums = ["x" * 60, "x" * 61, "123", "A / B", "Park ", "A  B", "Pa_rk", "Św. Ana-2"]
    shares = ["-0.35", "150", "101%", "0.5 %", "50  %", "~61%", "64-36", "1", "100%", "5.", "50 "]
    df = rows(spark, [("l", None, v, None) for v in stadiums] + [("l", None, None, v) for v in shares])
    got = found(df)
    n = len(stadiums)
    assert {int(r) for f, c, r in got if (f, c) == ("pattern", "stadium")} == {1, 2, 3, 4, 5, 6}
    form = re.compile(r"-?[0-9]+(\.[0-9]+)?( ?%)?")
    assert {int(r) - n for f, c, r in got if (f, c) == ("pattern", "possession_home")} == {i for i, v in enumerate(shares) if not form.fullmatch(v)}
    assert {int(r) - n for f, c, r in got if f == "range"} == {0, 1, 2}


def test_departing_loads(spark):
    cells = []
    for load in "abcdef":
        for i in range(10):
            missing = load == "a" and i < 4
            referee = "Same One" if load == "b" and i < 5 else f"Ref {'abcdefghij'[i]}{load}"
            cells.append((load, None if missing else referee, "NULL", "70%" if load == "c" else "50%"))
    got = found(rows(spark, cells))
    assert ("null_rate", "referee", "a") in got and ("distribution", "referee", "b") in got and ("distribution", "possession_home", "c") in got
    assert len(got) == 3


def test_empty_and_all_null(spark):
    assert found(rows(spark, [])) == []
    assert found(rows(spark, [("l", None, None, None), (None, None, None, None)])) == []


def test_hot_value_and_divergence(spark):
    df = rows(spark, [("a", "Ann Low", "Park", "1")] * 50 + [("b", "12", "34", "1")] * 50)
    p = {(r.load, r.column_name): r for r in profile.load_profile(profile.inventory(df, ["referee"], "feed_id", "load_id")).collect()}
    assert p["a", "referee"].top_share == 1.0 and p["a", "referee"].distinct_values == 1
    assert 0.2 < p["a", "referee"].mask_divergence < 1

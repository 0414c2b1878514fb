from datetime import datetime

import numpy as np

from statloom.llm import linkage as L


def test_estimation_recovers_the_model():
    rng = np.random.default_rng(1)
    n, share = 20000, 0.2
    match = rng.random(n) < share
    x = [np.where(match, rng.random(n) < p, rng.random(n) < q).astype(int) for p, q in ((0.95, 0.1), (0.9, 0.2), (0.85, 0.3))]
    counts: dict = {}
    for i, t in enumerate(zip(*x)):
        t = tuple(None if rng.random() < 0.1 else int(v) for v in t)
        c = counts.setdefault(t, [0, 0])
        c[0] += 1
        c[1] += match[i]
    keys = list(counts)
    post, got, m, u = L.estimate([(k, counts[k][0]) for k in keys], [2, 2, 2])
    assert abs(got - share) < 0.02 and abs(m[0][1] - 0.95) < 0.03 and abs(u[0][1] - 0.1) < 0.03
    error = sum(abs(p - counts[k][1] / counts[k][0]) * counts[k][0] for p, k in zip(post, keys)) / n
    assert error < 0.02
    assert L.estimate([], [2])[0] == []


MATCH = "row_id long, match_id string, season string, competition string, date string, home_team_id string, away_team_id string, stadium string, home_score long, away_score long, loaded_at timestamp, m string"
TEAM = "row_id long, team_id string, team_name string, key string"
LIST = "listing_id long, listed_date string, home_name string, away_name string, score string, venue string, competition_label string, scraped_at timestamp, l string"
T = datetime(2020, 1, 1)


def run(spark, listings, extra=()):
    names = [f"{a}{b}town{c} Union" for a, b, c in zip("Bal Kor Mig Tav Rox Zin".split(), "deg fim pul nas hob gur".split(), ("berg", "heim", "wick", "stad", "holm", "dorf"))]
    teams = [(i, f"team_{i}", n, "clash") for i, n in enumerate(names)]
    rows = []
    for k, (i, j) in enumerate((i, j) for i in range(6) for j in range(6) if i != j):
        rows.append((k, f"match_{i}{j}", "2019-2020", "League First Division", f"2019-09-{k % 28 + 1:02d}", f"team_{i}", f"team_{j}", f"Park {i}", k % 4, k % 3, T, "clash"))
        rows.append((100 + k, f"match_{i}{j}", "2019-2020", None, None, f"TEAM_{i} ", f"team_{j}", None, None, None, T, "clash"))
    base = [(k, r[4], names[int(r[5][-1])], names[int(r[6][-1])], f"{r[8]}-{r[9]}", r[7], "First Division", datetime(2019, 9, k % 28 + 1), "clash") for k, r in enumerate(rows[::2])]
    df = [spark.createDataFrame(d, s) for d, s in ((rows + list(extra), MATCH), (teams, TEAM), (base + listings(names), LIST))]
    return {r.listing_id: r.match_id for r in L.link_games(*df).collect()}, rows


def test_links(spark):
    def listings(n):
        at = datetime(2019, 9, 2)
        return [
            (900, "01.09.19", n[0].upper(), n[1][:9] + ". Un.", "0:0", None, None, at, ""),
            (901, "2019-09-01", n[0] + " Reserves", n[1] + " II", "0-0", "Park 0", None, at, ""),
            (902, "2012-01-01", n[0], n[1], "9-9", "Elsewhere", None, datetime(2012, 1, 2), ""),
            (903, None, None, None, None, None, None, None, ""),
            (904, "TBC", n[0], n[1], "0-0", "Park 0", None, at, ""),
            (905, "2019-09-01", "Nobody Rovers", "Someone City", "0-0", "Park 0", None, at, ""),
        ]

    got, rows = run(spark, listings)
    assert all(got[k] == r[1] for k, r in enumerate(rows[::2]))
    assert got[900] == "match_01" and got[904] == "match_01" and not {901, 902, 903, 905} & set(got)


def test_empty(spark):
    e = [spark.createDataFrame([], s) for s in (MATCH, TEAM, LIST)]
    assert L.link_games(*e).count() == 0


def test_sides_the_wrong_way_round(spark):
    def listings(n):
        return [
            (910, "2019-09-01", n[1], n[0], "0-0", "Park 0", None, datetime(2019, 9, 2), ""),  # of match_01
            (911, "2019-09-03", n[3], n[0], "2:2", "Park 0", None, datetime(2019, 9, 4), ""),  # of match_03, 2-2
            (912, None, n[4], n[0], "0-3", "Park 0", None, datetime(2019, 9, 5), ""),  # of match_04, 3-0
            (913, "2012-01-01", n[1], n[0], "9-9", "Elsewhere", None, datetime(2012, 1, 2), ""),
        ]

    got, rows = run(spark, listings)
    assert all(got[k] == r[1] for k, r in enumerate(rows[::2]))
    assert (got[910], got[911], got[912]) == ("match_01", "match_03", "match_04") and 913 not in got

import itertools

import pytest

from statloom.operators import schema_drift as S

CATALOG = [("key_stats", f, t, "") for f, t in (("player_name", "text"), ("club", "text"), ("minutes_played", "integer"), ("matches_played", "integer"), ("goals", "integer"), ("distance_covered", "decimal"), ("sprints", "integer"))]


def run(spark, *files, seps=","):
    meta, lines = [], []
    for i, text in enumerate(files):
        sep = seps[i % len(seps)]
        meta.append((f"f{i}", "st", "key_stats" if i % 2 == 0 else "key_stats_data", f"x{i}.csv", i, sep, 0, "clash"))
        lines += [(f"f{i}", n, line, "clash") for n, line in enumerate(text, 1)]
    return (
        spark.createDataFrame(meta, "file_id string, stream_id string, family string, file_name string, file_no long, separator string, line_count long, header string"),
        spark.createDataFrame(lines, "file_id string, line_no long, line string, fields string"),
        spark.createDataFrame(CATALOG, "subject string, field_name string, field_type string, meaning string"),
    )


def changes(args):
    return sorted(tuple(r) for r in S.schema_changes(S.schema_scripts(*args)).collect())


def test_changes(spark):
    a = ["﻿Player_Name,Club,Minutes_Played,Goals", "Ann,FC A,10,1", '"Bo, B",FC B,20,NULL', "", "Player_Name,Club,Minutes_Played,Goals"]
    b = ["player_name;equipo;minutes_played;goals;sprints", "Ann;FC A;30;1.5;7", "Bo, B;FC B;40;-;8"]
    c = ["minutos|equipo|sprints|player_name", "45*|FC A|9|Ann"]
    assert changes(run(spark, a, b, c, seps=",;|")) == [
        ("f1", "equipo", "renamed"), ("f1", "goals", "retyped"), ("f1", "sprints", "added"),
        ("f2", "goals", "removed"), ("f2", "minutos", "renamed"), ("f2", "minutos", "retyped"),
    ]


def test_unknown_header_is_known_by_its_values(spark):
    a = ["player_name,xq_total", *[f"P{i},{i * 10}" for i in range(1, 9)]]
    b = ["player_name,xq_sum", *[f"P{i},{i * 10 + 3}" for i in range(1, 9)]]
    assert changes(run(spark, a, b)) == [("f1", "xq_sum", "renamed")]


def test_known_names_of_two_fields_are_never_one(spark):
    a, b = ["player_name,goals", "A,5"], ["player_name,sprints", "A,5"]
    assert changes(run(spark, a, b)) == [("f1", "goals", "removed"), ("f1", "sprints", "added")]


def test_nested_and_moved():
    n = lambda p: S.Node(p, p, known="goals" if "goals" in p else None)
    pairs = S.edit_script([n("shot.goals"), n("shot.kind")], [n("total.goals"), n("shot.kind")])
    assert sorted((a.path, b.path) for a, b in pairs) == [("shot.goals", "total.goals"), ("shot.kind", "shot.kind")]


def test_assignment_against_brute_force():
    import random

    rnd = random.Random(3)
    for n in range(1, 6):
        for _ in range(20):
            cost = [[rnd.random() for _ in range(n)] for _ in range(n)]
            got = sum(cost[i][j] for i, j in enumerate(S.assign(cost)))
            best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert got == pytest.approx(best)


def test_consistent_table(spark):
    a = ["player_name,match_played,distance_covered", "Ann,3,9.5 km", "Ann,3,9.5 km", '"Bo ""B""",7:53,x']
    b = ["matches_appareance;distance_km;odd", "4*;10,5;z", ";;"]
    args = run(spark, a, b, seps=",;")
    rows = {(r.file_id, r.line_no): r for r in S.consistent_table(*args, "key_stats").collect()}
    assert set(rows) == {("f0", 2), ("f0", 4), ("f1", 2), ("f1", 3)}
    assert (rows["f0", 2].matches_played, rows["f0", 2].distance_covered) == (3, 9.5)
    assert rows["f0", 4].player_name == 'Bo "B"' and rows["f0", 4].distance_covered is None and rows["f0", 4].unread == {"distance_covered": "x"}
    assert (rows["f1", 2].matches_played, rows["f1", 2].distance_covered, rows["f1", 2].extra) == (4, 10.5, {"odd": "z"})


def test_empty_and_null_lines(spark):
    assert changes(run(spark, [])) == []
    files, lines, catalog = run(spark, ["goals", "1"], ["goals"], ["goals", "x" * 20000])
    lines = lines.unionByName(spark.createDataFrame([("f0", 9, None, None), ("nobody", 1, "a", None)], lines.schema))
    assert changes((files, lines, catalog)) == [("f2", "goals", "retyped")]

import random

import pytest

from statloom import session
from statloom.llm import clubs as C
from statloom.llm import metric as M
from statloom.llm import names as N
from statloom.llm import roles as R
from statloom.llm import spelling as S


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


@pytest.mark.parametrize("radius", [1, 2])
def test_radius_join_against_brute_force(spark, radius):
    rnd = random.Random(radius)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(150)} | {"x" * 300, "x" * 299}
    rows = [("hot", w) for w in words] + [("cold", w) for w in sorted(words)[:10]]
    df = spark.createDataFrame([*rows, ("hot", ""), ("hot", None)], "block string, text string")
    got = sorted((r.block, r.a, r.b, r.d) for r in M.radius_join(df, radius).collect())
    want = sorted((x, a, b, lev(a, b)) for x, a in rows for y, b in rows if x == y and a != b and lev(a, b) <= radius)
    assert got == want and len(want) > 100
    left, right = rows[::2], rows[::3]
    got = sorted((r.block, r.a, r.b, r.d) for r in M.radius_join(*[spark.createDataFrame(left, "block string, text string"), radius, spark.createDataFrame(right, "block string, text string")]).collect())
    assert got == sorted((x, a, b, lev(a, b)) for x, a in left for y, b in right if x == y and lev(a, b) <= radius)


def test_a_large_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 10)
    words = [("b", f"prefix{i:03d}") for i in range(120)]
    got = {(r.a, r.b) for r in M.radius_join(spark.createDataFrame(words, "block string, text string"), 1).collect()}
    assert got == {(a, b) for _, a in words for _, b in words if a != b and lev(a, b) <= 1}


def test_anchors_follow_chains_to_their_end(spark):
    n = 40  # each goes to the next, which is commoner
    counted = spark.createDataFrame([("b", f"t{i:02d}", 4 ** min(i, 15) + i) for i in range(n)], "block string, text string, n long")
    pairs = spark.createDataFrame([("b", f"t{i:02d}", f"t{i + 1:02d}", 1) for i in range(n - 1)], "block string, a string, b string, d int")
    got = {r.text: r.anchor for r in M.follow(spark.createDataFrame([("b", f"t{i:02d}", f"t{min(i + 1, n - 1):02d}") for i in range(n)], "block string, text string, anchor string")).collect()}
    assert set(got.values()) == {"t39"}
    got = {r.text: r.anchor for r in M.anchor(counted, pairs).collect()}
    assert got["t00"] == "t15"  # from here on the next isn't commoner by enough


def test_towns(spark):
    towns = {
        "charlottenburg": 40, "charlottenlund": 38, "charlotenburg": 1, "charlotten": 2,  # two towns, a slip, and what may be short for either
        "derbi": 1, "deri": 1, "nevkastleupontine": 12, "nevkastleu": 3, "nevkastelupontine": 1,
        "northamptonville": 9, "northamptonshire": 9, "bristol": 50, "bristel": 45,
    }
    got = {r.town: r.town_id for r in C.town_anchors(spark.createDataFrame(list(towns.items()), "town string, n long")).collect()}
    assert got.pop("charlotenburg") == "charlottenburg"
    assert got.pop("nevkastleu") == got.pop("nevkastelupontine") == "nevkastleupontine"
    assert all(k == v for k, v in got.items())


def test_clubs_whose_towns_differ_late_or_little_stay_apart(spark):
    stats = [(f"{k}{i}", "Ann Low", c, None) for k, c in (("a", "Derby Town"), ("b", "Derry Town"), ("c", "Charlottenburg FC"), ("d", "Charlottenlund FC")) for i in range(2)]
    teams = [("t1", "Derby Town"), ("t2", "Derry Town"), ("t3", "Charlottenburg FC"), ("t4", "Charlottenlund FC"), ("t5", "Charlotenburg FC")]
    got = link(spark, stats, teams)
    assert [x[1:] for x in got if x[0] == "team"] == [("t3", "t5")]
    assert [x[1:] for x in got if x[0] == "player"] == [("a0", "a1"), ("b0", "b1"), ("c0", "c1"), ("d0", "d1")]


def test_short_surnames_stay_apart(spark):
    got = link(spark, [("a", "Min Kim", "Lowtownland City", "F"), ("b", "Min Lim", "Lowtownland City", "F")], [])
    assert got == []


def test_reading_clubs():
    same = ["Betzirrenona Union", "UNION BETZIRRENONA", "betzirrenona_unión e.V.", "Betzirrenona, Union Club", "Betzirrenona Union (FEN)", "Betzirrenona Union 1910", "Betzirrenona Union - Fennmar"]
    assert {S.read_club(s) for s in same} == {("betsirenona", "union", False)}
    for s in ("Dynamo Tizmornok Reserves", "Betzirren. Un. II", "FC Abcdef Women", "FC Abcdef U17"):
        assert S.read_club(s)[2]
    assert S.read_club("Zebdiphpillieu")[0] == S.read_club("Zebdifpillieu")[0]
    assert S.read_club("F.C. Paghurt")[1] == S.read_club("Football Club Paghurt")[1] == "football"
    assert S.read_club("Hidnevguf AthlÃ©tic")[1] == "athletic"


def test_roles_are_learned(spark):
    given, family = ["Santiago", "Pavel", "Jean-Pierre", "Ann", "Omar"], [f"{a}{b}ov" for a in ("Fa", "Gu", "Ko", "Mi", "Re") for b in ("rel", "dam", "tos", "vik")]
    names = [f"{g} {f}" for i, f in enumerate(family) for g in (given[i % 5],)] + [f"{f}, {given[i % 5]}" for i, f in enumerate(family[:6])]
    odd = ["Fareltos Pavel", "Guvik-Retos Omar", "Fareltos P.", "P. Fareltos", "FÃ¡reltos", "Pavel Omar Fareltos"]
    got = {r.text: (r.surname, r.given, r.letter) for r in R.name_roles(spark.createDataFrame([(n,) for n in names + odd + ["?!", "李 明"]], "text string")).collect()}
    assert got["Fareltos Pavel"] == ("fareltos", "pavel", "p") and got["Guvik-Retos Omar"] == ("guvikretos", "omar", "o")
    assert got["Fareltos P."] == got["P. Fareltos"] == ("fareltos", None, "p") and got["FÃ¡reltos"] == ("fareltos", None, None)
    assert got["Pavel Omar Fareltos"] == ("fareltos", "pavel", "p")
    assert all(got[n][1] == S.sound(S.fold(given[i % 5])) for i, n in enumerate(names[:20])) and "?!" not in got and "李 明" in got


def test_readings():
    ways = R.readings(["low", "ann"], -1, {"low": 0.1, "ann": 9.0}, {"low": 3.0, "ann": 0.4})
    assert abs(sum(w for w, _, _ in ways) - 1) < 1e-9 and max(ways)[1:] == (1, 2)
    assert R.readings(["low"], -1, {}, {}) == [(1.0, 1, 1)] and R.readings(["low", "a"], 1, {}, {}) == [(1.0, 1, 2)]
    assert max(R.readings(["low", "a"], -1, {"low": 9.0}, {"low": 0.1}))[1:] == (1, 2)  # an initial is no surname


def test_one_edit():
    assert all(S.one_edit("yusuf", w) for w in ("yusuf", "yuduf", "yusf", "yussuf", "ysuuf")) and not S.one_edit("yusuf", "yudur")


FORMS = "block string, player_name string, club string, given string, letter string, position string, n long"


def test_persons(spark):
    forms = [
        ("x", "Ann Low", "c", "ann", "a", "D", 3), ("x", "A. Low", "c", None, "a", "D", 1), ("x", "Low", "c", None, None, "D", 1), ("x", "Bo Low", "c", "bo", "b", "M", 2),
        ("x", "B Low", "c", None, "b", "", 1), ("x", "Z Low", "c", None, "z", "", 1), ("x", "Low", "c", None, None, "", 1), ("y", "Ben Orr", "c", "ben", "b", "", 1), ("y", "Benjamin Orr", "c", "beniamin", "b", "", 4),
    ]
    got = {(r.block, r.player_name, r.position): r.person_id for r in N.persons(spark.createDataFrame(forms, FORMS)).collect()}
    ann, bo = got["x", "Ann Low", "D"], got["x", "Bo Low", "M"]
    assert ann != bo and got["x", "A. Low", "D"] == got["x", "Low", "D"] == ann and got["x", "B Low", ""] == bo
    assert got["x", "Z Low", ""] not in (ann, bo, None) and got["x", "Low", ""] is None
    assert got["y", "Ben Orr", ""] == got["y", "Benjamin Orr", ""]
    assert N.persons(spark.createDataFrame([], FORMS)).count() == 0


def test_familiar_forms_are_learned(spark):
    forms = [(f"s{i}", f"x{i}", "c", g, g[0], "F", 1) for i in range(12) for g in (("roberto", "beppo") if i < 4 else ("roberto",))]
    forms += [(f"t{i}", f"y{i}", "c", g, g[0], "F", 1) for i in range(12) for g in (("roberto", "miguel") if i < 2 else ("miguel",))]  # brothers
    got = {(r.block, r.given): r["head"] for r in N.given_anchors(spark.createDataFrame(forms, FORMS))[0].collect()}
    assert all(got[f"s{i}", "beppo"] == "roberto" for i in range(4))
    assert all(got[f"t{i}", "miguel"] == "miguel" for i in range(12))


def test_familiar_forms_are_learned_in_crowds(spark, monkeypatch):
    others = [f"{a}{b}" for a in ("kor", "wim", "zul", "hag") for b in ("ulf", "ent", "yst", "orm")]  # sixteen names beside them
    forms = [(f"s{i}", f"x{i}", "c", g, g[0], "F", 1) for i in range(12) for g in (("roberto", "beppo") if i < 4 else ("roberto",))]
    forms += [(f"s{i}", f"o{i}{g}", "c", g, g[0], "M", 1) for i in range(12) for g in others]
    for share in (1000, 3):  # the crowd split over tasks, too
        monkeypatch.setattr(N, "SHARE", share)
        got = {(r.block, r.given): r["head"] for r in N.given_anchors(spark.createDataFrame(forms, FORMS))[0].collect()}
        assert all(got[f"s{i}", "beppo"] == "roberto" for i in range(4))
        assert all(got[f"s{i}", g] == g for i in range(12) for g in ("roberto", *others))


STATS = "record_id string, player_name string, club string, position string, text string, block string"
TEAMS = "row_id long, team_id string, team_name string, text string"


def link(spark, stats, teams):
    df = N.same_names(spark.createDataFrame([(*s, "clash", "clash") for s in stats], STATS), spark.createDataFrame([(i, *t, "clash") for i, t in enumerate(teams)], TEAMS))
    return sorted(tuple(r) for r in df.collect())


def test_links(spark):
    stats = [
        ("r1", "Santiago Fajavett", "FC Rithobdudheim", "Forward"), ("r2", "Fajavett, Santi", "Rithobdud. FC", "F"), ("r3", "S. Fajvett", "F.C. Rithobdudheim", None),
        ("r4", "Larry Fajavett", "FC Rithobdudheim", "Forward"), ("r5", "Santiago Fajavett", "Rithobdudheim Union", "Forward"), ("r6", None, "FC Rithobdudheim", None), ("r7", "NULL", None, None),
    ]
    teams = [("t1", "FC Rithobdudheim"), ("t2", "FC Ritobdudheim"), ("t3", "Rithobdudheim Union"), ("t1", "FC Rithobdudheim"), (None, "FC Rithobdudheim"), ("t4", None)]
    got = link(spark, stats, teams)
    assert [x[1:] for x in got if x[0] == "player"] == [("r1", "r2"), ("r1", "r3"), ("r2", "r3")]
    assert [x[1:] for x in got if x[0] == "team"] == [("t1", "t2")]
    assert [x[1:] for x in got if x[0] == "club"] == sorted([(r, t) for r in ("r1", "r2", "r3", "r4", "r6") for t in ("t1", "t2")] + [("r5", "t3")])


def test_no_step_gathers_a_side_on_the_driver(spark, monkeypatch):
    """The joins of the names are sorted, none is broadcast; a radius join searches once for both orders of a pair."""
    plans = []

    def kept(df):
        out = session.durable(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for module in (C, M, N, R):
        monkeypatch.setattr(module, "durable", kept)
    stats = [("r1", "Santiago Fajavett", "FC Rithobdudheim", "F"), ("r2", "Fajavett, Santi", "Rithobdud. FC", "F"), ("r3", "S. Fajvett", "F.C. Rithobdudheim", None)]
    assert ("player", "r1", "r2") in link(spark, stats, [("t1", "FC Rithobdudheim"), ("t2", "FC Ritobdudheim")])
    assert len(plans) > 20 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
    words = spark.createDataFrame([("b", "prefix"), ("b", "prefixes"), ("b", "prefex")], "block string, text string")
    found = M.radius_join(words)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    assert sorted((r.a, r.b, r.d) for r in found.collect()) == [("prefex", "prefix", 1), ("prefix", "prefex", 1), ("prefix", "prefixes", 2), ("prefixes", "prefix", 2)]


def test_steps_shuffle_little(spark, monkeypatch):
    """Each shuffle of a plan costs the driver a thread and new plans: the steps of the names have few."""
    shuffles = []

    def kept(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count(" Exchange "))
        return session.durable(df)

    for module in (C, M, N, R):
        monkeypatch.setattr(module, "durable", kept)
    stats = [("r1", "Santiago Fajavett", "FC Rithobdudheim", "F"), ("r2", "Fajavett, Santi", "Rithobdud. FC", "F"), ("r3", "S. Fajvett", "F.C. Rithobdudheim", None)]
    assert ("player", "r1", "r2") in link(spark, stats, [("t1", "FC Rithobdudheim"), ("t2", "FC Ritobdudheim")])
    assert len(shuffles) > 20 and sum(shuffles) <= 165 and max(shuffles) <= 16


def test_the_nearest_value_is_the_only_one(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 1), ("c", "z", 2), ("c", "w", 0), ("d", "v", 2)]
    got = sorted(tuple(r) for r in M.nearest(spark.createDataFrame(rows, "k string, v string, d int"), ["k"], "v").collect())
    assert got == [("a", "x"), ("c", "w"), ("d", "v")]
    got = {r.k0: (r.k, r.v) for r in N._only(spark.createDataFrame([(k, v) for k, v, _ in rows], "k0 string, v string"), ["k0"], "v").collect()}
    assert got == {"a": (2, "x"), "b": (2, "x"), "c": (2, "w"), "d": (1, "v")}


def test_texts_are_read_with_what_stands_beside_them(spark):
    texts = spark.createDataFrame([("Derby Town", 3, ["x"]), ("FC Bristol", 1, None)], "text string, n long, more array<string>")
    got = sorted((r.text, r.town, r.kind, r.reserve, r.n, r.more) for r in C.read_texts(texts, S.read_club, "text string, town string, kind string, reserve boolean").collect())
    assert got == [("Derby Town", "derbi", "town", False, 3, ["x"]), ("FC Bristol", "bristol", "football", False, 1, None)]


def test_a_name_of_initials_alone_is_read(spark):
    names = spark.createDataFrame([("A. B.",), ("Ann Low",), ("Low, A.",), ("Bo Low",)], "text string")
    got = {r.text: (r.surname, r.given, r.letter) for r in R.name_roles(names).collect()}
    assert got["Ann Low"] == ("lov", "an", "a") and got["Low, A."] == ("lov", None, "a") and got["A. B."] == ("b", None, "a") and len(got) == 4


def test_a_familiar_form_of_two_names_stays_apart(spark):
    forms = [("x", "ro", "F"), ("x", "roberto", "F"), ("x", "rosalinda", "F"), ("y", "ro", "F"), ("y", "roberto", "F"), ("y", "rosalinda", "G"), ("z", "rob", ""), ("z", "roberto", "G")]
    rows = [(b, f"{b}{g}", "c", g, g[0], p, 1) for b, g, p in forms]
    got = {(r.block, r.given): r["head"] for r in N.given_anchors(spark.createDataFrame(rows, FORMS))[0].collect()}
    assert got["x", "ro"] == "ro" and got["y", "ro"] == got["z", "rob"] == "roberto"


def test_empty_and_repeated(spark):
    assert link(spark, [], []) == []
    got = link(spark, [("a", "Ann Low", "Lowtownland City", None)] * 1 + [("b", "Ann Low", "Lowtownland City", None)], [])
    assert got == [("player", "a", "b")]
    assert link(spark, [("a", "x" * 20000, "y" * 20000, None), ("b", "?!", "...", None)], []) == []

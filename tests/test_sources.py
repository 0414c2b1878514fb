import io
import json
import zipfile

import pytest

from statloom.plans import pipeline
from statloom.sources import readers, sinks
from statloom.streaming.merge import windowed_counts


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")


def test_csv(spark, tmp_path):
    assert readers.read_csv(spark, str(tmp_path / "absent.csv"), ["a"]).count() == 0
    p = write(tmp_path / "l.csv", "a;b\nMüller;NULL\n", "latin-1")
    assert [tuple(r) for r in readers.read_csv(spark, p, sep=";").collect()] == [("Müller", "NULL")]


def test_encoding_is_decided_on_all_bytes(spark, tmp_path):
    late = write(tmp_path / "late.csv", "a,b\n" + "plain,1\n" * 150_000 + "Müller,2\n", "latin-1")
    assert [r.a for r in readers.read_csv(spark, late).filter("b = 2").collect()] == ["Müller"]
    for end in ("é", "éa", "éab", "éabc", "éabcd"):  # wherever four bytes from the end fall
        p = write(tmp_path / "end.csv", f"a\nMüller{end}")
        assert [r.a for r in readers.read_csv(spark, p).collect()] == [f"Müller{end}"]
    write(tmp_path / "g/1 [x].csv", "a,b\nMüller,1\n")
    write(tmp_path / "g/2.csv", "a,b\nGómez,2\n", "latin-1")
    assert sorted(r.a for r in readers.read_csv(spark, str(tmp_path / "g/*.csv")).collect()) == ["Gómez", "Müller"]


def test_league_files_keep_ragged_rows_and_accents(spark, tmp_path):
    head = "Date,HomeTeam,AwayTeam,FTHG,FTAG,Referee\n"
    write(tmp_path / "1516/E0.csv", head + "11/06/16,Green,Grey,1,0,R One,,\n\n12/06/16,Red\n13/06/16,Blue,Pink,2,2,\"R, Two\"\n")
    write(tmp_path / "1617/E0.csv", head + "11/06/17,Málaga,Cádiz,3,1,R\n", "latin-1")
    write(tmp_path / "1718/E0.csv", "\ufeff" + head + "11/06/18,Málaga,Grey,0,0,R\n")
    write(tmp_path / "1819/E0.csv", "")
    got = readers.read_league_files(spark, str(tmp_path), {"E0": ("Premier League", "England")}).collect()
    assert sorted((r.Date, r.HomeTeam, r.AwayTeam, r.FTHG, r.FTAG, r.Referee) for r in got if r.AwayTeam) == [
        ("11/06/16", "Green", "Grey", "1", "0", "R One"), ("11/06/17", "Málaga", "Cádiz", "3", "1", "R"),
        ("11/06/18", "Málaga", "Grey", "0", "0", "R"), ("13/06/16", "Blue", "Pink", "2", "2", "R, Two"),
    ]
    assert [r.HomeTeam for r in got if r.AwayTeam is None] == ["Red"]


def test_generic_reader(spark, tmp_path):
    write(tmp_path / "s/a.csv", "a\n1\n")
    write(tmp_path / "s/film.mp4", "x")
    write(tmp_path / "s/t.txt", "one\ntwo")
    write(tmp_path / "s/p.html", "<html><!-- <table><tr><th>h</th></tr><tr><td>v</td></tr></table> --></html>")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d.json", json.dumps({"x": [{"a": {"b": 1}}], "y": [{"c": 2}]}))
    (tmp_path / "s/z.zip").write_bytes(z.getvalue())
    got = {(kind, name): df for _, kind, name, df in readers.read_source(spark, str(tmp_path / "s"), str(tmp_path / "out"))}
    assert set(got) == {("csv", "a"), ("text", "t"), ("html", "p"), ("json", "x"), ("json", "y")}
    assert got["json", "x"].columns[0] == "a.b"
    assert [(r.line_number, r.text) for r in got["text", "t"].orderBy("line_number").collect()] == [(1, "one"), (2, "two")]
    assert [r.cells for r in got["html", "p"].orderBy("row_no").collect()] == [["h"], ["v"]]


def test_archive_may_not_leave_its_folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as f:
        f.writestr("../x", "y")
    with pytest.raises(ValueError):
        readers.unzip(str(tmp_path / "evil.zip"), str(tmp_path / "to"))


def test_rewrite_in_place(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(p)
    sinks.rewrite(spark, spark.read.parquet(p).filter("id > 0"), p)
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [1, 2]


def test_pipeline(spark, tmp_path):
    raw = tmp_path / "raw"
    write(raw / "completed.csv", "season,fecha,local,visitante,marcador,estadio,posesion_local,posesion_visitante,planteles,goles\n2015-2016,11-06-2016,Red,Blue,2-1,Park,0,0,Red: Ann Low; Bo Kim | Blue: Cy,Ann Low 12'; 40' (P)\n")
    write(raw / "leagues/1516/E0.csv", "Date,HomeTeam,AwayTeam,FTHG,FTAG,Referee,X\n11/06/16,Green,Grey,1,0,R One,z\n")
    write(raw / "leagues/1516/ZZ.csv", "Date,HomeTeam,AwayTeam\n11/06/16,No,No\n")
    write(raw / "fixtures/euro/2016--france/euro.txt", "= Euro 2016\nSat Jun 11\n  Gold v Iron 1-0 (0-0)\n  [Di Roe 12; -]\n")
    write(raw / "2021/key_stats.csv", "player_name,club,position,minutes_played,match_played,goals,assists\nAnn Low,Red,FW,90,1,2,0\n")
    write(raw / "2021/attempts.csv", "player_name,club,total_attempts,on_target\nAnn Low,Red,1,3\n")
    write(raw / "players.csv", "Player;Nation;Pos;Squad;Comp;Age;MP;Min;Goals\nEd Fox;ENG;FW;Green;Premier League;20;3;100;1\nNo One;X;FW;Y;Elsewhere;20;1;1;1\n", "latin-1")
    write(raw / "events/matches/1/2.json", json.dumps([{"match_id": 5, "match_date": "2015-01-01", "home_score": 1, "away_score": 0, "competition": {"competition_name": "Cup"}, "season": {"season_name": "2014/2015"}, "home_team": {"home_team_name": "Ash", "country": {"name": "Spain"}}, "away_team": {"away_team_name": "Oak"}}]))
    write(raw / "events/events/5.json", json.dumps([{"id": "e1", "minute": 3, "type": {"name": "Shot"}, "player": {"name": "Gil"}, "shot": {"outcome": {"name": "Goal"}, "type": {"name": "Penalty"}}}, {"id": "e2", "type": {"name": "Pass"}}]))
    xlsx(raw / "matches.xlsx", {"teams": [["TEAM_NAME", "COUNTRY"], ["Red", "Spain"]], "matches": [["MATCH_ID", "SEASON", "DATE_TIME", "HOME_TEAM", "AWAY_TEAM", "STADIUM", "HOME_TEAM_SCORE", "AWAY_TEAM_SCORE"], ["1", "2016", "d", "Red", "Ash", "P", "3", "3"]]})
    report = pipeline.run(spark, str(raw), str(tmp_path / "out"))
    assert {n: r["rows"] for n, r in report.items()} == {"matches": 5, "players": 5, "teams": 8, "goals": 4, "match_stats": 3, "season_stats": 2, "gk": 0}
    m = spark.read.parquet(str(tmp_path / "out/core/matches.parquet"))
    assert m.filter("source = 'completed_csv'").first().possession_home is None and m.schema["home_score"].dataType.simpleString() == "bigint"
    s = spark.read.parquet(str(tmp_path / "out/stats/season_stats.parquet")).filter("goals = 2").first()
    assert s.shots is None and s.minutes_played == 90
    assert "NULL" in next((tmp_path / "out/core/matches.csv").glob("*.csv")).read_text()


def test_empty_pipeline(spark, tmp_path):
    assert all(r["rows"] == 0 for r in pipeline.run(spark, str(tmp_path / "none"), str(tmp_path / "out")).values())


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2020-01-01 10:05:00", "a"), ("2020-01-01 10:55:00", "a"), ("2020-01-01 11:00:00", "a")], "t string, k string").selectExpr("cast(t as timestamp) ts", "k")
    assert sorted(r.n for r in windowed_counts(e, "ts", "k").collect()) == [1, 2]


def test_run_log(spark, tmp_path):
    import json

    from statloom.sources.runlog import RunLog

    log = RunLog()
    log.log("read", step="teams", rows=3)
    log.log("odd value", level="warning", value="é")
    log.write(spark, str(tmp_path / "log"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert [(r["message"], r["level"], r["step"]) for r in got] == [("read", "info", "teams"), ("odd value", "warning", "")] and got[0]["rows"] == 3

"""Every registered query against its SQL on the smallest tables."""

import json
import math
import os
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canonical(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return str([canonical(x) for x in v])
    return v if v is None or isinstance(v, str | int | bool) else str(v)


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(canonical(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, small, name):
    df = QUERIES[name](spark, small)
    want = db.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


def _cells(spark, small, rows):
    """Every cell of the four columns that must be filled has a fill that its column can hold; positions are codes."""
    own = {(r.table_name, r.column_name, r.row_id): r for r in rows}
    wanted = {tuple(r) for r in QUERIES["p5_found"](spark, small).collect()}
    assert len(own) == len(rows) and {k for k in own if k[1] != "position"} == wanted
    low, high = {"height_cm": 140}, {"height_cm": 220, "minutes_played": 130}
    for (_, c, _), r in own.items():
        assert r.category in ("DEF", "FW", "GK", "MID") if c == "position" else low.get(c, 0) <= r.number <= high.get(c, 1e9)


def _heights(spark, small, rows):
    before = {r.row_id: r.height_cm for r in spark.read.parquet(f"{small}/players_cleaned.parquet").collect()}
    assert {r.row_id for r in rows} == set(before) and any(r.height_cm_filled for r in rows)
    assert all(140 <= r.height_cm <= 220 if r.height_cm_filled else r.height_cm == before[r.row_id] for r in rows)


def _scripts(spark, small, rows):
    files = {r.file_id for r in spark.read.parquet(f"{small}/raw_files.parquet").collect()}
    assert {r.file_id for r in rows} == files and len({(r.file_id, r.pos) for r in rows if r.pos is not None}) == sum(r.pos is not None for r in rows)


def _consistent(subject):
    def check(spark, small, rows):
        fields = {r.field_name for r in spark.read.parquet(f"{small}/field_catalog.parquet").collect() if r.subject == subject}
        assert fields <= set(rows[0].asDict()) and len({(r.file_id, r.line_no) for r in rows}) == len(rows) > 50

    return check


def _changes(spark, small, rows):
    order = {r.file_id: r.file_no for r in spark.read.parquet(f"{small}/raw_files.parquet").collect()}
    first = min(order.values())
    assert len({tuple(r) for r in rows}) == len(rows) > 0 and {r.change for r in rows} <= {"renamed", "added", "removed", "retyped"}
    assert all(order[r.file_id] > first for r in rows)  # the first file of a stream has none before it


def _generated(spark, small, rows):
    assert len(rows) == spark.read.parquet(f"{small}/player_match_stats_cleaned.parquet").count()
    assert all(r[c] is not None for r in rows for c in ("minutes_played", "goals", "shots", "touches", "top_speed")) and any(r.generated for r in rows)


def _keepers(spark, small, rows):
    assert rows and all(0 <= r.saves <= 30 and r.penalty_saves in (0, 1) and 0 <= r.punches <= 5 for r in rows)


def _draws(spark, small, rows):
    assert len({r.player_id for r in rows}) == len(rows) > 0
    assert all(16 <= r.age <= 42 and 155 <= r.height_cm <= 210 and 0 <= r.goals_draw <= 5 and 0 <= r.on_target_draw <= 5 and r.saves_draw >= 0 for r in rows if r.profile_data_source == "generated")


def _json(spark, small, rows):
    games = {r.match_id for r in spark.read.parquet(f"{small}/matches_cleaned.parquet").collect()}
    docs = {r.match_id: json.loads(r.document) for r in rows}
    assert set(docs) == games and len(rows) == len(docs)
    goals = [g for g in spark.read.parquet(f"{small}/goals_events_cleaned.parquet").collect() if g.match_id in docs and g.match_id is not None]
    assert sum(len(x["goals"]) for k, x in docs.items() if k is not None) == len(goals)


def _html(spark, small, rows):
    """Each document with a table has a row of it, each without one its text."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    marked = {k for k, t in docs.items() if t and re.search("<(html|p|div|table|br)[ />]", t.lower())}
    assert {r.doc_id for r in rows} <= marked and {k for k in marked if "<td" in docs[k].lower()} <= {r.doc_id for r in rows}


def _norms(spark, small, rows):
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    texts = [v for r in rows for k, v in r.asDict().items() if k != "doc_id" and v]
    assert texts and all(v == v.lower() and v == v.strip() and "  " not in v for v in texts)


def _catalog(spark, small, rows):
    assert len(rows) >= 12 and all(r[0] for r in rows)


def _matrix(spark, small, rows):
    columns = [c for c in rows[0].asDict() if c != "row_id"]
    x = np.array([[r[c] for c in columns] for r in rows])
    assert np.isfinite(x).all() and np.abs(x.mean(0)).max() < 1e-4 and set(np.round(x.std(0), 3)) <= {0.0, 1.0} and len(columns) > 31


def _variance(spark, small, rows):
    ratio = [r.ratio for r in sorted(rows, key=lambda r: r.component)]
    assert ratio == sorted(ratio, reverse=True) and abs(sum(ratio) - 1) < 1e-3 and abs(max(r.cumulative for r in rows) - 1) < 1e-3


def _scores(spark, small, rows):
    x = np.array([[r.pc1, r.pc2] for r in rows])
    assert np.abs(x.mean(0)).max() < 1e-3 and x[:, 0].std() >= x[:, 1].std() and abs(np.corrcoef(x.T)[0, 1]) < 1e-3  # centred, ordered, uncorrelated


def _loadings(spark, small, rows):
    assert {(r.component, r["rank"]) for r in rows} == {(c, k) for c in (1, 2) for k in range(1, 9)}
    for c in (1, 2):
        own = [abs(r.loading) for r in sorted(rows, key=lambda r: r["rank"]) if r.component == c]
        assert own == sorted(own, reverse=True) and own[0] <= 1


def _alike(spark, small, rows):
    """Against brute force."""
    teams = [t for t in spark.read.parquet(f"{small}/teams_cleaned.parquet").collect() if t.team_name is not None and t.country is not None]
    for t in teams:
        others = [(-SequenceMatcher(None, t.team_name.lower(), o.team_name.lower()).ratio(), o.row_id) for o in teams if o.country == t.country and o.row_id != t.row_id]
        best = min(others, default=(0, 0))
        got = [(-r.ratio, r.b) for r in rows if r.a == t.row_id]
        assert got == ([best] if -best[0] > 0.6 else [])


CHECKS = {
    "p5_filled": _cells, "p5_height_table": _heights, "p6_scripts": _scripts, "p6_key_stats": _consistent("key_stats"), "p6_defending": _consistent("defending"), "p6_found": _changes,
    "generated_match_stats": _generated, "generated_keeper_stats": _keepers, "hashed_draws": _draws, "json_export": _json, "html_text_fallback": _html, "soft_norm_documents": _norms,
    "metric_catalog_table": _catalog, "standardise_onehot": _matrix, "pca_variance": _variance, "pca_scores": _scores, "pca_loadings": _loadings, "similarity_best_match": _alike,
}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_what_sql_cannot_say(spark, small, name):
    CHECKS[name](spark, small, QUERIES[name](spark, small).collect())


def test_every_query_is_checked():
    rest = set(QUERIES) - set(SQL) - set(CHECKS)
    assert all(re.match("p[24789]_", n) for n in rest)  # those have tests of their own


def test_entry(spark):
    assert entry.entry(spark).columns == ["finding", "column_name", "ref_id"]

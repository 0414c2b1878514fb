import numpy as np
import pytest

from statloom.operators import mixture as M
from statloom.operators.mixture import Number, fill_cells, fill_table

NUMBERS = [Number("a", high=100, whole=False, fill=True), Number("b")]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(2000):
        g = i % 2
        b = float(rng.normal(20 + 30 * g, 4))
        a = float(0.5 * b + 10 * g + rng.normal(0, 0.5))
        rows.append((i, a, b, "xy"[g], "clash"))
    return rows


def make(spark, rows):
    return spark.createDataFrame(rows, "row_key long, a double, b double, c string, value string")


def test_held_out_accuracy(spark, frame):
    hidden = {r[0]: r[1] for r in frame if r[0] % 9 == 0}
    rows = [(k, None if k in hidden else a, b, c, v) for k, a, b, c, v in frame]
    rows[1] = (1, 500.0, rows[1][2], "x", "")
    rows[3] = (3, float("nan"), None, None, None)
    got = {(r.row_key, r.column_name): r for r in fill_cells(make(spark, rows), NUMBERS, {"c": ["x", "y"]}, ["c"], groups=2).collect()}
    assert {k for k, c in got if c == "a"} == set(hidden) | {1, 3}
    error = np.sqrt(np.mean([(got[k, "a"].number - v) ** 2 for k, v in hidden.items()]))
    assert error < 0.6  # the noise that was added is 0.5, the spread of the column 13
    assert got[3, "c"].category in ("x", "y") and 0 <= got[3, "a"].number <= 100


def test_category_from_numbers(spark, frame):
    rows = [(k, a, b, None if k % 9 == 0 else c, v) for k, a, b, c, v in frame]
    got = fill_cells(make(spark, rows), NUMBERS, {"c": ["x", "y"]}, ["c"], groups=2).collect()
    right = sum(r.category == "xy"[r.row_key % 2] for r in got if r.column_name == "c")
    assert right > 0.95 * 223


def test_observed_cells_stay(spark, frame):
    rows = [(k, None if k < 5 else a, b, c, v) for k, a, b, c, v in frame[:200]]
    df = make(spark, rows).withColumnRenamed("row_key", "id").withColumnRenamed("value", "row_key")
    cells = fill_cells(make(spark, rows), NUMBERS, groups=2)
    out = {r.id: r for r in fill_table(df, "id", cells, NUMBERS).collect()}
    assert len(out) == 200 and all(out[k].a_filled for k in range(5)) and all(out[r[0]].a == r[1] and not out[r[0]].a_filled for r in rows[5:])


def test_empty_and_nothing_observed(spark):
    assert fill_cells(make(spark, []), NUMBERS).count() == 0
    got = fill_cells(make(spark, [(1, None, None, None, None), (1, None, None, None, None)]), NUMBERS, {"c": ["x"]}).collect()
    assert [(r.row_key, r.column_name, r.number) for r in got] == [(1, "a", None)] * 2
    got = fill_cells(make(spark, [(1, 5.0, 2.0, "x", ""), (2, None, 2.0, "x", "")]), NUMBERS).collect()
    assert len(got) == 1 and abs(got[0].number - 5) < 1


def test_fit_converges(spark, frame):
    rows = [(k, None if k % 9 == 0 else a, None if k % 13 == 0 else b, c, v) for k, a, b, c, v in frame]
    few, *_ = M.fitted(make(spark, rows), NUMBERS, {"c": ["x", "y"]}, groups=3)
    assert few.converged and all(b >= a - 1e-3 for a, b in zip(few.log_likelihood, few.log_likelihood[1:]))
    more, *_ = M.fitted(make(spark, rows), NUMBERS, {"c": ["x", "y"]}, groups=3, tolerance=1e-8)
    assert more.converged and abs(more.log_likelihood[-1] - few.log_likelihood[-1]) < 0.01
    got = [{r.row_key: r.number for r in fill_cells(make(spark, rows), NUMBERS, {"c": ["x", "y"]}, groups=3, tolerance=t).collect()} for t in (M.TOLERANCE, 1e-8)]
    assert max(abs(got[0][k] - got[1][k]) for k in got[0]) < 0.2
    with pytest.warns(UserWarning, match="gained"):
        fill_cells(make(spark, rows), NUMBERS, groups=3, rounds=2)


def test_blocks_keep_all_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "HELD", 50)
    _, packed, _ = M.fitted(make(spark, frame[:300] + [(-1, None, None, None, None)]), NUMBERS, {"c": ["x", "y"]}, groups=2)
    blocks = packed.collect()
    assert sum(b.n for b in blocks) == 301 and max(b.n for b in blocks) <= 7 and sorted(k for b in blocks for k in b["keys"]) == [-1, *range(300)]

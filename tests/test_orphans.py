import random
from datetime import datetime, timedelta

from statloom.operators.orphans import Reference, change_deltas, current_orphans, keep_ledger, ledger, orphan_references, orphan_report

T0 = datetime(2020, 1, 1)
REFS = [Reference("r", "k1", "t", "key"), Reference("r", "k2", "t", "key")]


def tables(spark, refs, keys):
    return {
        "r": spark.createDataFrame(refs, "row_id long, k1 string, k2 string, loaded_at timestamp, target string, salt int"),
        "t": spark.createDataFrame(keys, "row_id long, key string, loaded_at timestamp, deleted_at timestamp"),
    }


def brute(refs, keys):
    out = set()
    for rid, k1, k2, at, *_ in refs:
        for c, k in (("k1", k1), ("k2", k2)):
            if k is None or k.strip().upper() in ("", "NULL", "NA", "NONE"):
                continue
            own = [x for x in keys if x[1] is not None and x[1].strip().lower() == k.strip().lower()]
            if not own:
                out.add((rid, c, "missing"))
            elif at is None:
                continue
            elif min(x[2] for x in own) > at:
                out.add((rid, c, "late"))
            elif all(x[3] for x in own) and max(x[3] for x in own) <= at:
                out.add((rid, c, "deleted"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    day = lambda: T0 + timedelta(days=rnd.randrange(40))
    keys = [(i, rnd.choice(["a", "b", " C", "d ", "e", None]), day(), rnd.choice([None, day()])) for i in range(14)]
    names = ["a", "B", "c", "D", "e", "x", " ", "null", None]
    refs = [(i, "hot" if i % 3 == 0 else rnd.choice(names), rnd.choice(names), rnd.choice([day(), None]), "clash", 1) for i in range(300)]
    got = {(r.row_id, r.column_name, r.reason) for r in orphan_references(tables(spark, refs, keys), REFS).collect()}
    assert got == brute(refs, keys) and len(got) > 50


def test_ties_and_empty_tables(spark):
    keys = [(1, "a", T0, T0)]
    refs = [(1, "a", None, T0, "", 0), (1, "a", None, T0, "", 0)]
    assert [r.reason for r in orphan_references(tables(spark, refs, keys), REFS).collect()] == ["deleted", "deleted"]
    assert orphan_references(tables(spark, [], []), REFS).count() == 0
    o = orphan_references(tables(spark, [(1, "x", "y", None, "", 0)], []), REFS)
    assert {(r.month, r.orphans) for r in orphan_report(o).collect()} == {(None, 1)}


def test_ledger_kept_load_by_load(spark, tmp_path):
    rnd = random.Random(3)
    day = lambda: T0 + timedelta(days=rnd.randrange(40))
    names = ["a", "B", "c", "D", "e", "x", None]
    keys = [(i, rnd.choice(names), day(), rnd.choice([None, day()])) for i in range(10)]
    refs = [(i, rnd.choice(names), rnd.choice(names), day(), rnd.choice([None, None, day()])) for i in range(60)]
    data = {
        "r": spark.createDataFrame(refs, "row_id long, k1 string, k2 string, loaded_at timestamp, deleted_at timestamp"),
        "t": spark.createDataFrame(keys, "row_id long, key string, loaded_at timestamp, deleted_at timestamp"),
    }
    deltas = change_deltas(data, REFS).cache()
    for week in range(7):  # in any order, and one load given twice
        part = deltas.filter(f"pmod(datediff(at, date'2020-01-01'), 7) = {week}")
        book = keep_ledger(spark, str(tmp_path / "book"), part, f"load{week}")
        book = keep_ledger(spark, str(tmp_path / "book"), part, f"load{week}") if week == 3 else book
    whole = ledger(deltas)
    assert sorted(map(str, book.collect())) == sorted(map(str, whole.collect()))
    got = sorted((r.row_id, r.column_name, r.reason) for r in orphan_references(data, REFS, book=book).collect())
    assert got == sorted((r.row_id, r.column_name, r.reason) for r in orphan_references(data, REFS).collect()) and got
    # signs decide: a withdrawn reference and a withdrawn record no longer count
    live = lambda k: sum(1 for r in refs for v in r[1:3] if v and v.lower() == k and r[4] is None)
    gone = lambda k: all(x[3] for x in keys if x[1] and x[1].lower() == k)
    assert {(r.key, r.refs) for r in current_orphans(book).collect()} == {(k, live(k)) for k in "abcdex" if live(k) and gone(k)}

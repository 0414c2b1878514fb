"""References to records that do not exist.

The ledger holds, for each key of a target table, signed counts made from change
deltas: a delivered row is +1, a withdrawn one -1, on the existence side of its own
key and on the reference side of the keys it refers to. A key with references and
no existence is an orphan now; its first and last delta times tell whether it was
one for a while. A ledger is kept from load to load: entries of a key are merged by
sums, least and greatest, so the deltas of a load are all that it has to read.

Plan: both sides are pre-aggregated per key before they meet (map-side combine),
so a key that a third of all rows refers to costs one row a task and one row in
the ledger. Only keys that can be orphans, usually a small part, are joined back
to the referring rows, and those are spread by a salt, so that a hot orphan key
doesn't end in one task either.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.missing import norm_key

SALTS = 16


@dataclass(frozen=True)
class Reference:
    """``table.column`` refers to the key ``target_key`` of ``target``."""

    table: str
    column: str
    target: str
    target_key: str


def reference_rows(tables: dict[str, DataFrame], refs: list[Reference], row_key: str = "row_id", at: str = "loaded_at") -> DataFrame:
    """(table_name, column_name, target, key, row_id, at): the references that aren't missing.

    Each table is read once, however many of its columns refer to something.
    """
    parts = []
    for name in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == name]
        cells = F.array(*[F.struct(F.lit(r.column).alias("c"), F.lit(r.target).alias("t"), norm_key(F.col(r.column)).alias("k")) for r in own])
        parts.append(
            tables[name]
            .select(F.col(row_key).alias("row_id"), F.col(at).alias("at"), F.explode(cells).alias("x"))
            .select(F.lit(name).alias("table_name"), F.col("x.c").alias("column_name"), F.col("x.t").alias("target"), F.col("x.k").alias("key"), "row_id", "at")
            .filter(F.col("key").isNotNull())
        )
    return reduce(DataFrame.unionByName, parts)


#: how two entries of a key become one
_SUMS, _LEAST, _GREATEST = ("refs", "referred", "exists", "came"), ("first_ref", "first_at"), ("last_ref", "last_gone")
BOOK = "target string, key string, refs bigint, referred bigint, exists bigint, came bigint, first_ref timestamp, first_at timestamp, last_ref timestamp, last_gone timestamp"


def change_deltas(tables: dict[str, DataFrame], refs: list[Reference], row_key: str = "row_id", at: str = "loaded_at", gone: str = "deleted_at") -> DataFrame:
    """(target, key, side, delta, at): every change of the tables as a signed delta.

    ``side`` is ref or exist. A delivered row is +1 at its loading, a withdrawn
    one -1 at its withdrawal, for its own key and for the keys that it refers to.
    A record without a loading time existed always. Keys are compared trimmed and without case.
    """
    parts = []
    for name in dict.fromkeys([r.table for r in refs] + [r.target for r in refs]):
        own = [("ref", r.column, r.target) for r in refs if r.table == name]
        own += [("exist", k, name) for k in dict.fromkeys(r.target_key for r in refs if r.target == name)]
        t = tables[name]
        left = F.col(gone) if gone in t.columns else F.lit(None).cast("timestamp")
        always = F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp"))
        events = []
        for side, column, target in own:
            what = [F.lit(target).alias("target"), norm_key(F.col(column)).alias("key"), F.lit(side).alias("side")]
            events.append(F.struct(*what, F.lit(1).alias("delta"), (always if side == "exist" else F.col(at)).alias("at")))
            events.append(F.when(left.isNotNull(), F.struct(*what, F.lit(-1).alias("delta"), left.alias("at"))))
        parts.append(t.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select("e.*").filter(F.col("key").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


def entries(deltas: DataFrame) -> DataFrame:
    """Each delta as an entry of the ledger."""
    ref, up = F.col("side") == "ref", F.col("delta") > 0
    return deltas.select(
        "target", "key",
        F.when(ref, F.col("delta")).otherwise(0).cast("bigint").alias("refs"), (ref & up).cast("bigint").alias("referred"),
        F.when(ref, 0).otherwise(F.col("delta")).cast("bigint").alias("exists"), (~ref & up).cast("bigint").alias("came"),
        F.when(ref & up, F.col("at")).alias("first_ref"), F.when(~ref & up, F.col("at")).alias("first_at"),
        F.when(ref & up, F.col("at")).alias("last_ref"), F.when(~ref & ~up, F.col("at")).alias("last_gone"),
    )


def settle(book: DataFrame) -> DataFrame:
    """One entry a key: counts add up, first times are least, last times greatest. The order of merging doesn't matter."""
    return book.groupBy("target", "key").agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in _LEAST], *[F.max(c).alias(c) for c in _GREATEST]
    ).select("target", "key", *_SUMS, *_LEAST, *_GREATEST)


def ledger(deltas: DataFrame) -> DataFrame:
    """(target, key, refs, referred, exists, came, first_ref, first_at, last_ref, last_gone) of deltas.

    refs and exists are the signed counts as they stand, referred and came how often they rose.
    """
    return settle(entries(deltas))


def keep_ledger(spark: SparkSession, folder: str, deltas: DataFrame, load: str) -> DataFrame:
    """The ledger in ``folder`` after the deltas of ``load``: the one kept so far and theirs, merged and kept.

    Each load writes a version of its own, so a load given again changes nothing
    and one that was lost on the way is simply repeated. Only the deltas of the
    load and the entries are read, never the tables.
    """
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")) or []
    kept = sorted(str(f.getPath().getParent().getName()) for f in found)  # number-load
    same = [k for k in kept if k.partition("-")[2] == load]
    if not same:
        old = spark.read.schema(BOOK).parquet(f"{folder}/{kept[-1]}") if kept else spark.createDataFrame([], BOOK)
        same = [f"{len(kept):08d}-{load}"]
        settle(old.unionByName(ledger(deltas))).write.mode("overwrite").parquet(f"{folder}/{same[0]}")
    return spark.read.schema(BOOK).parquet(f"{folder}/{same[0]}")


def current_orphans(book: DataFrame) -> DataFrame:
    """(target, key, refs): keys with references and no existence, as the ledger stands."""
    return book.filter("refs > 0 and exists <= 0").select("target", "key", "refs")


def possible_orphans(book: DataFrame) -> DataFrame:
    """Keys with references and, at the time of at least one of them, no existence."""
    late = F.col("first_ref") < F.col("first_at")
    deleted = (F.col("exists") == 0) & (F.col("last_ref") >= F.col("last_gone"))
    return book.filter((F.col("referred") > 0) & ((F.col("came") == 0) | late | deleted))


def orphan_references(tables: dict[str, DataFrame], refs: list[Reference], row_key: str = "row_id", at: str = "loaded_at", gone: str = "deleted_at", book: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, row_id, reason, at): every orphan reference once.

    ``book`` is a kept ledger of the tables; without one it is made from them.

    ``missing``: the key was never delivered. ``late``: it was first delivered
    after the referring row. ``deleted``: all its records were withdrawn, the
    last not after the referring row was loaded. A missing reference (NULL or a
    marker) is no orphan. A referring row without a time can only be ``missing``.
    Repeated rows are separate references, since each has its own row key. Other
    columns of the tables, also ones with clashing names, aren't read.
    """
    rows = reference_rows(tables, refs, row_key, at)
    book = possible_orphans(ledger(change_deltas(tables, refs, row_key, at, gone)) if book is None else book)
    # salted, since one orphan key may hold a third of all references
    keys = book.select("target", "key", "came", "exists", "first_at", "last_gone").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(keys, ["target", "key", "salt"])
    reason = (
        F.when(F.col("came") == 0, "missing")
        .when(F.col("first_at") > F.col("at"), "late")
        .when((F.col("exists") == 0) & (F.col("last_gone") <= F.col("at")), "deleted")
    )
    return hit.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("table_name", "column_name", "row_id", "reason", "at")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(table_name, column_name, month, reason, orphans): per table, column and month of loading."""
    return (
        orphans.withColumn("month", F.date_format("at", "yyyy-MM"))
        .groupBy("table_name", "column_name", "month", "reason")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )

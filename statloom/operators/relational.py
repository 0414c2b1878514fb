"""Relational operators with a total order: dedupe, merge, combine, upsert, roles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import is_missing
from statloom.functions.text import deterministic_int


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; NULL keys are a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return keep_one(df, key, [F.col(c).desc() for c in order])


def union_by_priority(frames: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Bag union of frames with differing columns; of each key the row of the first frame that has it."""
    tagged = [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_one(both, key, [F.col("_prio"), *[F.col(c) for c in order]]).drop("_prio")


def merge_non_null(df: DataFrame, key: list[str], columns: list[str], order: Column, last: bool = False) -> DataFrame:
    """One row a key: of each column the first (or last) value in order that isn't NULL.

    An aggregation with map-side combine, so no group is sorted in one task.
    """
    pick = F.max_by if last else F.min_by
    return df.groupBy(*key).agg(*[pick(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def best_row_merge(df: DataFrame, key: list[str], columns: list[str], tie: str) -> DataFrame:
    """One row a key: the fullest row, its gaps filled from the next fullest; ties by ``tie``."""
    score = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return merge_non_null(df, key, columns, F.struct((-score).alias("s"), F.col(tie).alias("t")))


def full_outer_combine(base: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Base with NULLs filled from the other, and the other's keys that base lacks."""
    b = other.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_o_{c}") for c in columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key])
    return base.join(b, on, "full_outer").select(*[F.coalesce(k, f"_k_{k}").alias(k) for k in key], *[F.coalesce(c, f"_o_{c}").alias(c) for c in columns])


def upsert_fill_only(target: DataFrame, source: DataFrame, key: list[str], columns: list[str], markers: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated, conflicts, not_found): empty cells of the target filled from the source.

    source has one row a key. conflicts: (key, field, current, offered) of cells
    that hold something else; not_found: source rows without a target.
    """
    s = source.select(*key, *[F.when(~is_missing(F.col(c), markers), F.col(c)).alias(f"_s_{c}") for c in columns])
    both = target.join(s, key, "left")
    empty = {c: is_missing(F.col(c), markers) for c in columns}
    updated = both.withColumns({c: F.when(empty[c] & F.col(f"_s_{c}").isNotNull(), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"_s_{c}" for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("current"), F.col(f"_s_{c}").alias("offered"), empty[c].alias("empty")) for c in columns])
    conflicts = both.select(*key, F.explode(cells).alias("x")).filter("not x.empty and x.offered is not null and x.current <> x.offered").select(*key, "x.field", "x.current", "x.offered")
    return updated, conflicts, source.join(target.select(*key).distinct(), key, "left_anti")


def lookup(df: DataFrame, dim: DataFrame, key: list[str], columns: list[str], defaults: dict[str, object] | None = None, dim_order: list[Column] | None = None) -> DataFrame:
    """Left lookup that never multiplies rows: the dim is reduced to one row a key first."""
    one = keep_one(dim, key, dim_order) if dim_order else dim
    out = df.join(one.select(*key, *columns), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def both_roles(df: DataFrame, shared: list[str], home: dict[str, str], away: dict[str, str]) -> DataFrame:
    """Two rows a game, one for each side, from one scan: home and away map new names to columns."""
    sides = F.array(*[F.struct(F.lit(h).alias("is_home"), *[F.col(c).alias(n) for n, c in m.items()]) for h, m in ((1, home), (0, away))])
    return df.select(*shared, F.explode(sides).alias("x")).select(*shared, "x.*")


def carry_forward(df: DataFrame, partition: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """The last value at or before each row that isn't NULL."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def alias_map(players: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """(alias_id, target_id): one-word names that can only be the one longer name of their group with that last word."""
    words = F.split(F.col(name), " ")
    x = players.select(F.col(key).alias("id"), F.col(group).alias("g"), F.element_at(words, -1).alias("last"), F.size(words).alias("n"))
    long = x.filter("n > 1").groupBy("g", "last").agg(F.count_distinct("id").alias("k"), F.min("id").alias("target_id")).filter("k = 1")
    return x.filter("n = 1").select(F.col("id").alias("alias_id"), "g", "last").distinct().join(long, ["g", "last"]).select("alias_id", "target_id").filter("alias_id <> target_id")


def rewrite_ids(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Ids that are aliases replaced by their targets."""
    one = aliases.groupBy("alias_id").agg(F.min("target_id").alias("target_id"))
    return df.join(one.withColumnRenamed("alias_id", column), column, "left").withColumn(column, F.coalesce("target_id", column)).drop("target_id")


def slots(df: DataFrame, n: int) -> DataFrame:
    """Every row with each ``slot`` from 1 to n."""
    return df.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))


def hash_pick(plan: DataFrame, members: DataFrame, group: list[str], member: str, by: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``plan`` with a ``member`` of its group, picked by the hash of the columns ``by``; pairs of ``taken`` (by its columns) are left out.

    Members are numbered in their order within the group, so no list of a group
    is made. Groups without members have no rows; NULL members don't count.
    """
    own = members.filter(F.col(member).isNotNull()).select(*group, member).distinct()
    size = own.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(member)).cast("long") - 1)
    x = plan.join(size, group).withColumn("_h", deterministic_int(1 << 48, *[F.col(c) for c in by])).withColumn("_at", F.col("_h") % F.col("_size"))
    x = x.join(own, [*group, "_at"]).select(*plan.columns, member)
    return x if taken is None else x.join(taken, taken.columns, "left_anti")


def passthrough(df: DataFrame) -> DataFrame:
    """The table as it is: the cleaning step of tables that need none."""
    return df

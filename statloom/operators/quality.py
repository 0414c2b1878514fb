"""Quality gates: completeness, anomalies, duplicates, repeats, targets, cross-checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import ALL_MARKERS, finite, is_missing

NULL_RATIO = 0.0025


def cell_missing(df: DataFrame, c: str, markers: tuple[str, ...] = ALL_MARKERS) -> Column:
    """Whether a cell is missing, by the type of its column."""
    kind = dict(df.dtypes)[c]
    if kind == "string":
        return is_missing(F.col(c), markers)
    return F.col(c).isNull() | F.isnan(c) if kind in ("double", "float") else F.col(c).isNull()


def unpivot_agg(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One row a column from one aggregation: measures[column][name] are its aggregates."""
    flat = df.agg(*[a.alias(f"{c}\u0001{n}") for c, own in measures.items() for n, a in own.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}\u0001{n}`").alias(n) for n in own]) for c, own in measures.items()])
    return flat.select(F.explode(rows).alias("x")).select("x.*")


def completeness(df: DataFrame, threshold: float = NULL_RATIO, markers: tuple[str, ...] = ALL_MARKERS) -> DataFrame:
    """(column_name, rows, missing, ratio, passed): one pass over the table. An empty table has ratio 0."""
    per = {c: {"rows": F.count(F.lit(1)), "missing": F.coalesce(F.sum(cell_missing(df, c, markers).cast("long")), F.lit(0))} for c in df.columns}
    ratio = F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0))
    return unpivot_agg(df, per).withColumn("ratio", F.round(ratio, 6)).withColumn("passed", (ratio <= threshold).cast("int"))


def coverage(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, filled, missing, pct): A18."""
    c = completeness(df.select(*metrics))
    return c.select(F.col("column_name").alias("metric"), (F.col("rows") - F.col("missing")).alias("filled"), "missing", F.round(100 * (1 - F.col("ratio")), 2).alias("pct"))


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column_name, type, missing, missing_pct, example): the example is the smallest value."""
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    per = {
        c: {"rows": F.count(F.lit(1)), "missing": F.sum(cell_missing(df, c).cast("long")), "example": F.min(F.when(~cell_missing(df, c), F.col(c))).cast("string")}
        for c in df.columns
    }
    x = unpivot_agg(df, per)
    return x.select("column_name", kinds[F.col("column_name")].alias("type"), "missing", F.round(100 * F.try_divide("missing", "rows"), 2).alias("missing_pct"), "example")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, median, low, high) rounded to four places; columns without a number are left out."""
    per = {}
    for c in columns:
        v = finite(F.col(c))
        per[c] = {"n": F.count(v), "mean": F.round(F.avg(v), 4), "median": F.round(F.median(v), 4), "low": F.round(F.min(v), 4), "high": F.round(F.max(v), 4)}
    return unpivot_agg(df, per).filter("n > 0")


def fake_zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, observed, fake): columns whose observed values are all zero."""
    per = {c: {"observed": F.count(c), "most": F.max(F.abs(F.col(c))).cast("double")} for c in columns}
    return unpivot_agg(df, per).select("column_name", "observed", F.coalesce(F.col("most") == 0, F.lit(False)).cast("int").alias("fake"))


def duplicate_profile(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct_keys, duplicate_rows, keys_repeated. NULL is a key value like any other."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count(F.when(F.col("n") > 1, 1)).alias("keys_repeated"),
    )


def duplicate_examples(df: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    """(key, rows): the first ``n`` keys, in their order, that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").orderBy(*[F.col(c).asc_nulls_first() for c in key]).limit(n)


def table_completeness(df: DataFrame, markers: tuple[str, ...] = ALL_MARKERS) -> DataFrame:
    """One row: cells, present and their share over the whole table; an empty table has share 0."""
    c = completeness(df, markers=markers).agg(F.sum("rows").alias("cells"), F.sum(F.col("rows") - F.col("missing")).alias("present"))
    return c.withColumn("share", F.round(F.coalesce(F.try_divide("present", "cells"), F.lit(0.0)), 6))


def coverage_report(matches: DataFrame, stats: DataFrame, fields: list[str], advanced: list[str], target: int = 1_500_000) -> DataFrame:
    """(field, filled, missing, pct): fields of the matches, matches with statistics, cells of statistics that aren't zero, and records against the target.

    Missing cells of statistics are counted against the matches, as one figure a match is wanted.
    """
    own = coverage(matches, fields).select(F.col("metric").alias("field"), "filled", "missing", F.round(F.coalesce(F.try_divide(100 * F.col("filled"), F.col("filled") + F.col("missing")), F.lit(0.0)), 1).alias("pct"))
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    seen = [F.count_distinct("match_id").alias("player_stats")]
    seen += [F.count(F.when(~cell_missing(stats, c) & (F.col(c) != 0), 1)).alias(f"stat_{c}") for c in advanced]
    wide = stats.agg(*seen).crossJoin(F.broadcast(total))  # two rows
    names = ["player_stats", *[f"stat_{c}" for c in advanced]]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("filled"), (F.col("total") - F.col(n)).alias("missing")) for n in names])
    rest = wide.select("total", F.explode(cells).alias("x")).select("x.field", "x.filled", "x.missing", F.round(F.when(F.col("x.field") == "player_stats", F.coalesce(F.try_divide(100 * F.col("x.filled"), F.col("total")), F.lit(0.0))), 1).alias("pct"))
    records = F.col("total") + F.col("player_stats")
    goal = wide.select(F.lit("records").alias("field"), records.alias("filled"), F.greatest(F.lit(0), target - records).alias("missing"), F.round(100 * records / target, 1).alias("pct"))
    return own.unionByName(rest).unionByName(goal)


def fast_gate(df: DataFrame, key: list[str], threshold: float = NULL_RATIO, least: int = 0) -> DataFrame:
    """One row: rows, columns_failed, duplicate_rows, passed: the gate without anomalies and repeats, in one pass and one aggregation by key."""
    failed = completeness(df, threshold).agg(F.max("rows").alias("rows"), F.sum(1 - F.col("passed")).alias("columns_failed"))
    both = failed.crossJoin(F.broadcast(duplicate_profile(df, key).select("duplicate_rows")))  # one row each
    return both.withColumn("passed", ((F.col("columns_failed") == 0) & (F.col("duplicate_rows") == 0) & (F.col("rows") >= least)).cast("int"))


def nullify_fake_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns whose observed values are all zero made NULL; one row is broadcast."""
    most = df.agg(*[F.max(F.abs(F.col(c))).alias(f"_z_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(most))
    return out.withColumns({c: F.when(F.col(f"_z_{c}") != 0, F.col(c)) for c in columns}).drop(*[f"_z_{c}" for c in columns])


def needs_enrichment(matches: DataFrame, stats: DataFrame, fields: list[str], zero_too: list[str], counts: list[str], key: str = "match_id") -> DataFrame:
    """The matches with a missing field (for ``zero_too`` also the text 0), without statistics, or whose ``counts`` sum to zero."""
    sums = stats.groupBy(key).agg(sum((F.coalesce(F.sum(c), F.lit(0)) for c in counts), F.lit(0)).alias("_sum"))
    gap = reduce(Column.__or__, [cell_missing(matches, c) | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "0" if c in zero_too else F.lit(False)) for c in fields])
    x = matches.join(sums, key, "left")
    return x.filter(gap | (F.coalesce("_sum", F.lit(0)) == 0)).drop("_sum")


def incomplete_head(df: DataFrame, fields: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows, by ``order``, that lack one of the fields: a batch to look up."""
    return df.filter(reduce(Column.__or__, [cell_missing(df, c) for c in fields])).orderBy(*order).limit(n)


def adjacent_repeats(df: DataFrame, partition: list[str], order: list[str], compare: list[str], key: list[str]) -> DataFrame:
    """One row: exact and similar repeats of the row before, in each partition. NULL equals NULL.

    similar: all columns but the key agree. The first row of a partition repeats nothing.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    same = {c: F.lag(c).over(w).eqNullSafe(F.col(c)) for c in compare}
    has = F.lag(F.lit(1)).over(w).isNotNull()
    exact = reduce(Column.__and__, same.values(), has)
    similar = reduce(Column.__and__, [s for c, s in same.items() if c not in key], has)
    return df.select(exact.alias("e"), similar.alias("s")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("e").cast("long")), F.lit(0)).alias("exact"), F.coalesce(F.sum(F.col("s").cast("long")), F.lit(0)).alias("similar")
    )


@dataclass(frozen=True)
class Rule:
    """A named anomaly: rows where the condition is true."""

    name: str
    condition: Column


def count_rules(counts: list[str]) -> list[Rule]:
    """A count is neither negative nor fractional."""
    whole = {c: F.abs(F.rint(F.col(c).cast("double")) - F.col(c)) > 1e-9 for c in counts}
    return [Rule(f"{kind}_{c}", bad) for c in counts for kind, bad in (("negative", F.col(c) < 0), ("fractional", whole[c]))]


def season_stats_rules(counts: list[str]) -> list[Rule]:
    """Counts, and the two of the match rules that hold for totals, too."""
    return [*count_rules(counts), Rule("completed_above_attempted", F.col("passes_completed") > F.col("passes_attempted")), Rule("on_target_above_shots", F.col("shots_on_target") > F.col("shots"))]


def match_stats_rules(counts: list[str]) -> list[Rule]:
    parts = F.coalesce("shots_on_target", F.lit(0)) + F.coalesce("shots_off_target", F.lit(0)) + F.coalesce("shots_blocked", F.lit(0))
    return [
        *count_rules(counts),
        Rule("completed_above_attempted", F.col("passes_completed") > F.col("passes_attempted")),
        Rule("on_target_above_shots", F.col("shots_on_target") > F.col("shots")),
        Rule("parts_above_shots", parts > F.col("shots")),
        Rule("accuracy_out_of_range", ~finite(F.col("pass_accuracy")).between(0, 1)),
    ]


def anomalies(df: DataFrame, key: list[str], rules: list[Rule]) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks; one pass."""
    hits = F.array_compact(F.array(*[F.when(r.condition, r.name) for r in rules]))
    return df.select(*key, F.explode(hits).alias("rule"))


def possession_sum_off(home: Column, away: Column, tolerance: float = 0.02) -> Column:
    return F.abs(home + away - 1) > tolerance


def target_gate(tables: dict[str, tuple[DataFrame, str]], minimum: dict[str, int]) -> DataFrame:
    """(table_name, records, entities, minimum, passed): distinct keys against their minimum."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("entities")).select(
            F.lit(name).alias("table_name"), "records", "entities", F.lit(minimum[name]).cast("long").alias("minimum"), (F.col("entities") >= minimum[name]).cast("int").alias("passed")
        )
        for name, (df, key) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def sparse_columns(df: DataFrame, most: float = 0.9, markers: tuple[str, ...] = ALL_MARKERS) -> DataFrame:
    """(column_name, missing_share, kept): columns with a greater share of missing cells than ``most`` aren't kept; of an empty table all are."""
    c = completeness(df, markers=markers)
    return c.select("column_name", F.col("ratio").alias("missing_share"), (F.col("ratio") <= most).cast("int").alias("kept"))


def drop_sparse(df: DataFrame, most: float = 0.9, also: tuple[str, ...] = (), fills: dict[str, object] | None = None) -> DataFrame:
    """``df`` without sparse columns and those in ``also``, and with the gaps of some filled by constants; one row a column reaches the driver."""
    kept = [r.column_name for r in sparse_columns(df, most).filter("kept = 1").collect()]
    out = df.select(*[c for c in df.columns if c in kept and c not in also])
    return out.fillna({c: v for c, v in (fills or {}).items() if c in out.columns})


# --- what charts are drawn from


def bars(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """(by, rows): rows of each value, the commonest first in ``n`` (of equals the smallest); missing values have no bar."""
    per = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    return per if n is None else per.orderBy(F.desc("rows"), by).limit(n)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, starts, rows) of the numbers from ``low`` to ``high``; the last bin has its upper end, too, and empty bins are there."""
    v = finite(F.col(column))
    at = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (low + F.col("id") * ((high - low) / bins)).alias("starts"))
    return every.join(counts, "bin", "left").select("bin", "starts", F.coalesce("rows", F.lit(0)).alias("rows"))

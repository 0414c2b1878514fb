"""Writers: typed Parquet with a CSV twin, nested JSON, reports, and safe rewriting in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.missing import null_if_missing
from statloom.functions.text import number
from statloom.sources.readers import exists


def typed(df: DataFrame, whole: list[str] = (), decimal: list[str] = (), boolean: list[str] = ()) -> DataFrame:
    """Texts in the types of their columns; what doesn't fit is NULL, and so are markers."""
    out = {}
    for c, kind in df.dtypes:
        if kind != "string":
            continue
        v = null_if_missing(F.col(c))
        if c in whole:
            out[c] = F.rint(number(v)).cast("long")
        elif c in decimal:
            out[c] = number(v)
        elif c in boolean:
            out[c] = F.when(F.lower(v).isin("true", "1"), True).when(F.lower(v).isin("false", "0"), False)
        else:
            out[c] = v
    return df.withColumns(out) if out else df


def write_pair(df: DataFrame, folder: str, name: str) -> None:
    """Parquet, and CSV with missing cells written as NULL."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    df.write.mode("overwrite").options(header=True, nullValue="NULL", emptyValue="").csv(f"{folder}/{name}.csv")


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite the Parquet that ``df`` is read from: write beside it, then swap."""
    df.write.mode("overwrite").parquet(f"{path}.next")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, nxt, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.next", f"{path}.old"))
    fs = target.getFileSystem(conf)
    if exists(spark, path):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(nxt, target)
    fs.delete(old, True)


def nested_seasons(matches: DataFrame, goals: DataFrame, stats: DataFrame) -> DataFrame:
    """(season, match_id, document): a match with its goals and player rows as a JSON document.

    Goals and rows are gathered per match, which the game bounds.
    """
    g = goals.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("minute", "player_name", "goal_type"))).alias("goals"))
    s = stats.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("player_id", "minutes_played", "goals"))).alias("stats"))
    x = matches.join(g, "match_id", "left").join(s, "match_id", "left")
    empty = F.array()
    doc = F.to_json(F.struct("match_id", "home_team_id", "away_team_id", "home_score", "away_score", F.coalesce("goals", empty.cast(g.schema["goals"].dataType)).alias("goals"), F.coalesce("stats", empty.cast(s.schema["stats"].dataType)).alias("stats")))
    return x.select("season", "match_id", doc.alias("document"))


def write_seasons(documents: DataFrame, folder: str) -> None:
    """One folder a season, one document a line."""
    documents.select("season", "document").write.mode("overwrite").partitionBy("season").text(folder)


def run_report(tables: dict[str, DataFrame]) -> dict[str, dict[str, object]]:
    """Rows and columns of each table, for a JSON report."""
    return {n: {"rows": df.count(), "columns": df.columns} for n, df in tables.items()}


def summary_markdown(summary: DataFrame) -> str:
    """A small collected summary as a Markdown table."""
    rows = summary.collect()
    head = "| " + " | ".join(summary.columns) + " |\n|" + " --- |" * len(summary.columns)
    return "\n".join([head, *["| " + " | ".join(str(v) for v in r) + " |" for r in rows]])


def append_mismatches(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

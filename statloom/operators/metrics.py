"""Catalog of metric formulas: a name, its column, what it needs and what it means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions.missing import finite
from statloom.functions.text import round_null, safe_div


@dataclass(frozen=True)
class Metric:
    name: str
    formula: str
    column: Column | None


def catalog(player: str = "player_id") -> list[Metric]:
    """The metrics over a player-match row with match_possession and opponent_possession.

    A missing input makes the metric NULL. Two metrics need an outside model and
    are declared, but never computed.
    """
    c = {n: finite(F.col(n)) for n in (
        "passes_completed", "passes_attempted", "pass_accuracy", "dribbles", "tackles", "tackles_won", "interceptions", "clearances",
        "fouls_committed", "yellow_cards", "red_cards", "distance_covered", "top_speed", "minutes_played", "match_possession", "opponent_possession",
    )}
    share = F.coalesce(c["pass_accuracy"], safe_div(c["passes_completed"], c["passes_attempted"]))
    mean_distance = F.avg(c["distance_covered"]).over(Window.partitionBy(player))
    return [
        Metric("expected_threat_total", "0.05 passes_completed + 0.07 dribbles", 0.05 * c["passes_completed"] + 0.07 * c["dribbles"]),
        Metric("vaep_rating", "passes_completed + dribbles + tackles_won + interceptions - fouls", c["passes_completed"] + c["dribbles"] + c["tackles_won"] + c["interceptions"] - c["fouls_committed"]),
        Metric("expected_assists", "0.1 passes_attempted pass_accuracy", 0.1 * c["passes_attempted"] * share),
        Metric("progressive_pass_dist", "distance passes_completed / passes_attempted", safe_div(c["distance_covered"] * c["passes_completed"], c["passes_attempted"])),
        Metric("defensive_action_height", "(tackles + interceptions + clearances) / distance", safe_div(c["tackles"] + c["interceptions"] + c["clearances"], c["distance_covered"])),
        Metric("pressing_intensity", "opponent possession / (tackles + interceptions + fouls)", safe_div(c["opponent_possession"], c["tackles"] + c["interceptions"] + c["fouls_committed"])),
        Metric("acwr_index", "distance / mean distance of the player", safe_div(c["distance_covered"], mean_distance)),
        Metric("metabolic_power", "15.48 speed distance / (60 minutes)", safe_div(15.48 * c["top_speed"] * c["distance_covered"], 60 * c["minutes_played"])),
        Metric("foul_severity_index", "fouls + 3 yellow + 6 red", c["fouls_committed"] + 3 * c["yellow_cards"] + 6 * c["red_cards"]),
        Metric("possession_involvement", "(passes_attempted + dribbles) / (possession minutes)", safe_div(c["passes_attempted"] + c["dribbles"], c["match_possession"] * c["minutes_played"])),
        Metric("xg_probability", "needs an outside model", None),
        Metric("shot_quality_index", "needs an outside model", None),
    ]


def with_metrics(df: DataFrame, metrics: list[Metric] | None = None) -> DataFrame:
    return df.withColumns({m.name: F.lit(None).cast("double") if m.column is None else round_null(m.column) for m in metrics or catalog()})


def with_possession(stats: DataFrame, games: DataFrame) -> DataFrame:
    """Each player's own and the opponent's possession; NULL for a team that didn't play the match.

    games: match_id, home_team_id, away_team_id, possession_home, possession_away, one row a match.
    """
    x = stats.join(games, "match_id", "left")
    home, away = F.col("team_id") == F.col("home_team_id"), F.col("team_id") == F.col("away_team_id")
    own = F.when(home, F.col("possession_home")).when(away, F.col("possession_away"))
    other = F.when(home, F.col("possession_away")).when(away, F.col("possession_home"))
    return x.withColumns({"match_possession": own, "opponent_possession": other}).drop("home_team_id", "away_team_id", "possession_home", "possession_away")


def catalog_table(spark: SparkSession) -> DataFrame:
    """(metric, formula, computed): the catalog as a table."""
    return spark.createDataFrame([(m.name, m.formula, int(m.column is not None)) for m in catalog()], "metric string, formula string, computed int")

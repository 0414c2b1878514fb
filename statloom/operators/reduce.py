"""Reduction of numeric profiles: impute, standardise, one-hot, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import finite


def standardise(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numbers by median, mean and population deviation; a column that doesn't vary is 0.

    The statistics are two rows of as many numbers as columns, so they become
    constants of the plan, which stays one projection.
    """
    medians = df.agg(*[F.median(finite(F.col(c))).alias(c) for c in numeric]).first()
    filled = df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(float(medians[c] or 0.0))) for c in numeric})
    stats = filled.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    return filled.withColumns({c: (F.col(c) - float(stats[f"a_{c}"])) / float(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.lit(0.0) for c in numeric})


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Missing categories by the commonest, of equals the smallest."""
    top = df.filter(F.col(column).isNotNull()).groupBy(column).count().agg(F.min(F.struct((-F.col("count")).alias("k"), F.col(column).alias("v"))).alias("m"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.coalesce(F.col(column), F.col("m.v"))).drop("m")


def one_hot(df: DataFrame, column: str, most: int = 200) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for each category, in sorted order; more than ``most`` categories are refused."""
    values = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories")
    names = [f"{column}_{v}" for v in values]
    return df.withColumns({n: F.coalesce(F.col(column) == v, F.lit(False)).cast("double") for n, v in zip(names, values)}), names


@dataclass
class Components:
    """components: features of each component; ratio: its share of the variance; needed: how many reach 90 %."""

    features: list[str]
    components: np.ndarray
    ratio: np.ndarray
    needed: int


def principal_components(df: DataFrame, features: list[str]) -> Components:
    """All components of columns that are centred already.

    The library's distributed covariance does the pass over the rows; only a
    matrix of features by features reaches the driver. Signs: the largest loading
    is positive. Fewer than two rows have no variance to share.
    """
    p = len(features)
    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(df.select(*features)).select("_v")
    if len(rows.head(2)) < 2:
        return Components(features, np.eye(p), np.zeros(p), 1)
    model = PCA(k=p, inputCol="_v", outputCol="_p").fit(rows)
    vectors, ratio = model.pc.toArray().T, np.nan_to_num(model.explainedVariance.toArray())
    vectors = vectors * np.sign(vectors[np.arange(p), np.abs(vectors).argmax(1)])[:, None]
    return Components(features, vectors, ratio, int((np.cumsum(ratio) < 0.9).sum()) + 1)


def scores(df: DataFrame, c: Components, k: int = 2) -> DataFrame:
    """pc1 to pck of every row, as sums of products in the JVM."""
    return df.withColumns({f"pc{i + 1}": F.round(sum((F.col(f) * float(w) for f, w in zip(c.features, c.components[i])), F.lit(0.0)), 6) for i in range(k)})


def variance_table(df: DataFrame, c: Components) -> DataFrame:
    """(component, ratio, cumulative)."""
    rows = df.sparkSession.createDataFrame([(i + 1, float(r)) for i, r in enumerate(c.ratio)], "component int, ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as features
    return rows.select("component", F.round("ratio", 6).alias("ratio"), F.round(F.sum("ratio").over(w), 6).alias("cumulative"))


def top_loadings(df: DataFrame, c: Components, k: int = 2, n: int = 8) -> DataFrame:
    """(component, rank, feature, loading): the n largest loadings of the first k components."""
    rows = []
    for i in range(min(k, len(c.features))):
        for rank, j in enumerate(np.argsort(-np.abs(c.components[i]), kind="stable")[:n]):
            rows.append((i + 1, rank + 1, c.features[j], round(float(c.components[i][j]), 6)))
    return df.sparkSession.createDataFrame(rows, "component int, rank int, feature string, loading double")

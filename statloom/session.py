"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session without one (a local test) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="statloom-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Drop the shuffles, broadcasts and checkpoints that nothing refers to any more.

    Spark's cleaner goes by the collector of the driver, which doesn't run for
    long while a job of many short steps leaves them behind, on the driver and on disk.
    """
    df.sparkSession.sparkContext._jvm.System.gc()


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for steps whose cost isn't in their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with a right side of one row a key, or few, so that a hot key is shared by ``salts`` tasks.

    ``spread`` is a column of the left side that differs between the rows of a key.
    The copies are never broadcast: the planner takes them for as small as the
    right side was, and the driver would gather ``salts`` times of it.
    """
    rows = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def even_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join with a right side of one row a key, of whose keys the left side has few rows each, but for the missing one.

    Rows without a key match nothing; they are shared by ``salts`` tasks, so no copies of the right side are needed.
    """
    rows = left.withColumn("_salt", F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    one = right.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int"))  # 0, but no constant, for which it would be left out of the keys
    return rows.join(one.hint("merge"), [key, "_salt"], how).drop("_salt")

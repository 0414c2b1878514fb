"""Which club a spelling names: its town in a metric space of whole town names, and its kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.metric import follow, nearest, point, radius_join, slip, swapped
from statloom.llm.spelling import read_club
from statloom.session import durable, shuffle_width

#: letters that a town needs so that one edit, and two, are taken for a slip
ONE, TWO = 6, 9
#: a kind below this share of its town's names is a slip
SLIP = 0.1


def read_texts(texts: DataFrame, read: Callable[[str], tuple], schema: str) -> DataFrame:
    """``texts`` (text and others) with what ``read`` makes of each; schema: of text and the results."""
    names = [c.split()[0] for c in schema.split(", ")]
    others = [c for c in texts.columns if c != "text"]
    schema = ", ".join([schema, *[f"`{c}` {kind}" for c, kind in texts.dtypes if c != "text"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, *read(t)) for t in batch["text"]], columns=names).assign(**{c: batch[c].array for c in others})

    # by number, else the few bytes of all names would be read by one task
    return texts.repartition(shuffle_width(texts), F.xxhash64("text")).mapInPandas(run, schema)


def town_anchors(towns: DataFrame) -> DataFrame:
    """(town, town_id): each of ``towns`` (town, n) with the town it stands for.

    Whole names are compared: a slip of the pen goes to the commonest town within
    its radius, and two common names stay two towns however near they are. A
    shortened spelling (at least half of a longer name, perhaps with a slip) goes
    to the only town it can be short for; if there are several it stays its own.
    """
    # written once: as a constant the block would be left out of the keys of joins, and their sides shuffled again
    space = durable(towns.select(F.lit("").alias("block"), F.col("town").alias("text"), "n"))
    heads = durable(point(space, radius_join(space.select("block", "text")).filter(slip(ONE, TWO))))
    sizes = heads.filter("anchor = text").select("block", "text", "n")  # the towns that are no slips
    size = F.length("text")
    cuts = sizes.filter(size >= ONE).select("block", F.col("text").alias("whole"), F.col("n").alias("nw"), F.explode(F.sequence(F.greatest(F.lit(4), F.ceil(size / 2).cast("int")), size - 2)).alias("k"))
    cuts = cuts.select("block", F.substring(F.col("whole"), F.lit(1), F.col("k")).alias("b"), "whole", "nw")
    near = radius_join(sizes.select("block", "text"), 2, cuts.select("block", F.col("b").alias("text")).distinct())
    near = near.filter((F.col("d") == 0) | ((F.length("a") >= ONE) & ((F.col("d") == 1) | swapped())))
    short = near.join(cuts.hint("merge"), ["block", "b"]).join(sizes.select("block", F.col("text").alias("a"), "n").hint("merge"), ["block", "a"])
    short = short.filter((F.col("whole") != F.col("a")) & (F.length("whole") >= F.length("a") + 2) & ((F.col("n") <= 2) | (F.col("nw") >= 2 * F.col("n"))))
    short = nearest(short, ["block", "a"], "whole").withColumnRenamed("a", "text")
    # a slip points at its town, a short town at the whole one: one chain
    up = heads.join(short.hint("merge"), ["block", "text"], "left").select("block", "text", F.when(F.col("anchor") == F.col("text"), F.coalesce("whole", "anchor")).otherwise(F.col("anchor")).alias("anchor"))
    return follow(up).select(F.col("text").alias("town"), F.col("anchor").alias("town_id"))


def club_spellings(texts: DataFrame) -> DataFrame:
    """(text, town_id, kind, reserve, kinds): every spelling in ``texts`` (text, n) with its town and kind of club.

    A spelling without a kind gets that of its town if the town has only one.
    """
    read = durable(read_texts(texts.select("text", "n"), read_club, "text string, town string, kind string, reserve boolean").filter("town != ''"))
    towns = town_anchors(read.groupBy("town").agg(F.sum("n").alias("n")))
    read = durable(read.join(towns.hint("merge"), "town"))
    # kinds that a town is known with; one that is written once in many is a slip
    kinds = read.filter("kind is not null and not reserve").groupBy("town_id", "kind").agg(F.sum("n").alias("n"))
    total = kinds.groupBy("town_id").agg(F.sum("n").alias("all"))
    kinds = kinds.join(total.hint("merge"), "town_id").filter(F.col("n") >= SLIP * F.col("all"))
    only = kinds.groupBy("town_id").agg(F.max(F.struct("n", "kind")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    return read.join(only.hint("merge"), "town_id", "left").select(
        "text", "town_id", F.when(F.col("kind").isNull() & (F.col("kinds") == 1), F.col("top.kind")).otherwise(F.col("kind")).alias("kind"), "reserve", F.coalesce("kinds", F.lit(0)).alias("kinds")
    )

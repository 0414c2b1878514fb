"""Joins on names that are only alike, each through an equi-join on what they share."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import soft_norm
from statloom.session import shuffle_width

# Words that don't tell teams apart.
STOP_WORDS = ("fc", "cf", "ac", "sc", "rb", "bv", "sl", "de", "as", "us", "ss", "sb", "cl")
# Short names and the names they stand for.
ALIASES = {
    "psg": ("paris",), "paris saint germain": ("paris",), "inter milan": ("inter",), "atletico": ("atleti", "atletico", "atletico madrid"),
    "atletico madrid": ("atleti", "atletico"), "bayer munich": ("baviera", "munchen", "munich"), "stade brestois": ("brest",), "as monaco": ("monaco",),
    "sl benfica": ("benfica",), "borussia dortmund": ("dortmund",), "rb leipzig": ("leipzig",), "losc lille": ("lille",),
}


def key_words(c: Column) -> Column:
    """The distinct words of a normalised name that tell it apart."""
    return F.array_distinct(F.array_except(F.split(soft_norm(c), " "), F.array(*[F.lit(w) for w in (*STOP_WORDS, "")])))


def teams_alike(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or a shared word that isn't a stop word."""
    x, y = soft_norm(a), soft_norm(b)
    return (x == y) | x.contains(y) | y.contains(x) | F.arrays_overlap(key_words(a), key_words(b))


def token_overlap_join(left: DataFrame, right: DataFrame, block: str, lkey: str, lname: str, rkey: str, rname: str) -> DataFrame:
    """(lkey, rkey, shared): pairs of a block that share words, with how many; through the words, not all pairs."""
    a = left.select(block, F.col(lkey).alias("_l"), F.explode(key_words(F.col(lname))).alias("w"))
    b = right.select(block, F.col(rkey).alias("_r"), F.explode(key_words(F.col(rname))).alias("w"))
    return a.join(b, [block, "w"]).groupBy("_l", "_r").agg(F.count(F.lit(1)).alias("shared")).select(F.col("_l").alias(lkey), F.col("_r").alias(rkey), "shared")


def three_tier_match(left: DataFrame, right: DataFrame, block: str, lkey: str, lname: str, rkey: str, rname: str, itself: bool = True) -> DataFrame:
    """(lkey, rkey, tier): the smallest right key that fits best: 1 the same name, 2 the same surname, 3 a shared word.

    Without ``itself`` a key doesn't match its equal, as within one table. Rows
    without a block or name match nothing. Only the least keys of each name,
    surname and word are joined (the two least without ``itself``), never all pairs.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        n = soft_norm(F.col(name))
        words = F.split(n, " ")
        marks = F.array(F.struct(F.lit(1).alias("tier"), F.array(n).alias("t")), F.struct(F.lit(2).alias("tier"), F.array(F.element_at(words, -1)).alias("t")), F.struct(F.lit(3).alias("tier"), F.array_distinct(words).alias("t")))
        return df.filter(F.length(n) > 0).select(F.col(block).alias("_b"), F.col(key).alias("_k"), F.explode(marks).alias("m")).select("_b", "_k", "m.tier", F.explode("m.t").alias("t"))

    on = ["_b", "tier", "t"]
    r = side(right, rkey, rname)
    least = r.groupBy(*on).agg(F.min("_k").alias("_r"))
    if not itself:
        second = r.join(least, on).filter("_k <> _r").groupBy(*on).agg(F.min("_k").alias("_r2"))
        least = least.join(second, on, "left")
    x = side(left, lkey, lname).join(least, on)
    if not itself:
        x = x.withColumn("_r", F.when(F.col("_r") != F.col("_k"), F.col("_r")).otherwise(F.col("_r2"))).filter("_r is not null")
    best = x.groupBy("_k").agg(F.min(F.struct("tier", "_r")).alias("b"))
    return best.select(F.col("_k").alias(lkey), F.col("b._r").alias(rkey), F.col("b.tier").alias("tier"))


def orientation(home: Column, away: Column, listed_home: Column, listed_away: Column) -> Column:
    """2 if both teams are alike as listed, 1 if they are the other way round, 0 otherwise."""
    return F.when(teams_alike(home, listed_home) & teams_alike(away, listed_away), 2).when(teams_alike(home, listed_away) & teams_alike(away, listed_home), 1).otherwise(0)


def expand_aliases(df: DataFrame, key: str, name: str, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """(key, expansion): the normalised name and the names it may stand for; the alias list is fixed and small."""
    n = soft_norm(F.col(name))
    hits = [F.when(n.contains(k) | F.lit(k).contains(n), F.array(*[F.lit(v) for v in vs])) for k, vs in aliases.items()]
    every = F.array_distinct(F.flatten(F.array_compact(F.array(F.array(n), *hits))))
    return df.filter(n != "").select(key, F.explode(every).alias("expansion"))


def best_similar(pairs: DataFrame, key: str, a: str, b: str, candidate: str, least: float = 0.6) -> DataFrame:
    """(key, candidate, ratio): of each key's blocked candidates the one whose name has the highest matching ratio above ``least``."""
    kinds = dict(pairs.dtypes)

    def ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            r = [SequenceMatcher(None, (s or "").lower(), (t or "").lower()).ratio() for s, t in zip(x["_a"], x["_b"])]
            yield x[[key, candidate]].assign(ratio=r)

    x = pairs.select(key, candidate, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInPandas(ratio, f"`{key}` {kinds[key]}, `{candidate}` {kinds[candidate]}, ratio double")
    w = Window.partitionBy(key).orderBy(F.desc("ratio"), candidate)
    return x.filter(F.col("ratio") > least).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: distinct names of a side that one task compares at once
TILE = 400


def _best_of_tile(names: list[str], others: list[str], ids: list[int], least: float) -> Iterator[tuple[str, float, int]]:
    """(name, ratio, id) of the best other name of each, by the exact ratio.

    The letters two names share, in whatever order, bound the ratio from above; classes of
    letters bound it too. Candidates are compared from the highest bound down to the best ratio.
    """
    def counts(texts: list[str]) -> np.ndarray:
        c = np.zeros((len(texts), 64), dtype=np.int32)
        for i, t in enumerate(texts):
            for ch in t:
                c[i, ord(ch) % 64] += 1
        return c

    low = [o.lower() for o in others]
    theirs, size = counts(low), np.array([len(o) for o in low])
    for name, mine in zip(names, counts([n.lower() for n in names])):
        a = name.lower()
        total = len(a) + size
        # two empty texts are equal
        bound = np.where(total > 0, 2.0 * np.minimum(mine, theirs).sum(axis=1) / np.maximum(total, 1), 1.0)
        best: tuple[float, int] | None = None
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] <= least or (best and bound[j] < -best[0]):
                break
            if others[j] != name:
                r = SequenceMatcher(None, a, low[j]).ratio()
                if r > least and (best is None or (-r, ids[j]) < best):
                    best = (-r, ids[j])
        if best:
            yield name, -best[0], best[1]


def most_alike(df: DataFrame, key: str, name: str, block: str, least: float = 0.6, tile: int = TILE) -> DataFrame:
    """(a, b, ratio): for each row's key the other row of its block with the highest ratio above ``least``, of equals the smallest key.

    Exact: all distinct names of a block are compared, in tiles of about ``tile`` by ``tile``,
    where a bound above the ratio spares most comparisons. Keys are whole numbers. Rows without
    a name or block match nothing.
    """
    rows = df.filter(F.col(name).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("_g"), F.col(name).alias("_n"), F.col(key).cast("long").alias("a"))
    w = Window.partitionBy("_g", "_n").orderBy("a")
    rows = rows.withColumn("_first", F.first("a").over(w)).withColumn("_next", F.lead("a").over(w))
    rows = rows.withColumn("_twin", F.when(F.col("a") == F.col("_first"), F.col("_next")).otherwise(F.col("_first")))
    names = rows.groupBy("_g", "_n").agg(F.min("a").alias("id"))
    many = names.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("k"))
    placed = names.join(many, "_g").withColumn("p", F.pmod(F.xxhash64("_n"), F.col("k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    left = placed.select("_g", F.col("p").alias("i"), every.alias("j"), "_n")
    right = placed.select(F.col("_g").alias("h"), every.alias("x"), F.col("p").alias("y"), F.col("_n").alias("t"), "id")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"_g": [], "_n": [], "ratio": [], "b": []})
        found = pd.DataFrame(_best_of_tile(a["_n"].tolist(), b["t"].tolist(), b["id"].tolist(), least), columns=["_n", "ratio", "b"])
        return found.assign(_g=(a["_g"].iloc[0]))[["_g", "_n", "ratio", "b"]]

    kind = dict(rows.dtypes)["_g"]
    # by number, else the few bytes of all names would be compared by one task
    left, right = left.repartition(shuffle_width(left), "_g", "i", "j"), right.repartition(shuffle_width(right), "h", "x", "y")
    found = left.groupBy("_g", "i", "j").cogroup(right.groupBy("h", "x", "y")).applyInPandas(compare, f"_g {kind}, _n string, ratio double, b long")
    best = found.groupBy("_g", "_n").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "b")).alias("other"))
    pair = "struct<r:double,b:bigint>"
    twin = F.when(F.col("_twin").isNotNull() & (F.lit(1.0) > least), F.struct(F.lit(-1.0).alias("r"), F.col("_twin").alias("b")))
    m = rows.join(best, ["_g", "_n"], "left").withColumn("m", F.least(F.col("other").cast(pair), twin.cast(pair)))
    return m.filter("m is not null").select("a", F.col("m.b").alias("b"), (-F.col("m.r")).alias("ratio"))

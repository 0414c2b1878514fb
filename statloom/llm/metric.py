"""Texts within an edit radius of one another, found in a metric space.

The space is divided twice. First by segments: a text of length l is cut into
radius + 1 parts; whatever lies within the radius has at least one of these parts
unchanged, moved by no more than the edits before and after it allow, so the parts
and the places where they may be found are keys that lose no pair. Then by pivots:
in the texts of a key each text is assigned to its nearest pivot, texts near the
border of a cell are replicated into it by the triangle inequality, and inside a
cell an exact join by edit distance runs over rings around the pivot.

Plan: pivots are chosen by an aggregate of fixed size per key (no list of a
block's texts is ever made). A key that is still large is split by a salt that
grows with its size, so that neither a hot block nor a dense ring is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import durable, release

PIVOTS = 4
#: texts of one key that a task compares with the others of a ring
SHARE = 20_000


def _part(length: Column, i: Column, radius: int) -> tuple[Column, Column]:
    """(start, size) of part ``i`` of the radius + 1 parts of a text of ``length``; the longer ones come last."""
    k = radius + 1
    base, late = F.floor(length / k).cast("int"), (length % k).cast("int") - (k - i)
    return 1 + i * base + F.greatest(F.lit(0), late), base + (late >= 0).cast("int")


def _keys(c: str, steps: list[tuple[int, int, int]], radius: int) -> Column:
    """Keys (length, part, letters): for each step (delta, i, o) the place of part i of a text that is delta shorter, o further on."""
    n, text = F.length(c), F.col(c)

    def key(x: Column) -> Column:
        other = (n - x["d"]).cast("int")
        start, size = _part(other, x["i"], radius)
        at = start + x["o"]
        inside = (other >= 1) & (at >= 1) & ((at + size - 1 <= n) | (size == 0))
        return F.when(inside, F.concat_ws("\u001f", other.cast("string"), x["i"].cast("string"), F.substring(text, at, size)))

    places = F.from_json(F.lit(str([{"d": d, "i": i, "o": o} for d, i, o in steps]).replace("'", '"')), "array<struct<d:int,i:int,o:int>>")
    return F.array_distinct(F.array_compact(F.transform(places, key)))


def _held(radius: int) -> list[tuple[int, int, int]]:
    """A text's own parts."""
    return [(0, i, 0) for i in range(radius + 1)]


def _sought(radius: int, shorter_only: bool) -> list[tuple[int, int, int]]:
    """Where the parts of texts within ``radius`` of this one may be."""
    return [
        (delta, i, o)
        for delta in range(0 if shorter_only else -radius, radius + 1)
        for i in range(radius + 1)
        for o in range(max(-i, delta - (radius - i)), min(i, delta + (radius - i)) + 1)
    ]


def radius_join(names: DataFrame, radius: int = 2, others: DataFrame | None = None) -> DataFrame:
    """(block, a, b, d): all ordered pairs of different texts of a block within ``radius`` edits.

    ``names`` has distinct (block, text). With ``others`` a comes from ``names``
    and b from ``others``, and equal texts are pairs of distance 0. Empty texts
    and NULLs join nothing. Empty tables give no rows.
    """
    alone = others is None
    right = names if alone else others
    held = right.select("block", F.col("text").alias("b"), F.explode(_keys("text", _held(radius), radius)).alias("key")).filter("b != '' and block is not null")
    held = held.repartition("block", "key")  # shuffled once for the pivots of its keys and for the cells
    sought = names.select("block", F.col("text").alias("a"), F.explode(_keys("text", _sought(radius, alone), radius)).alias("key"))
    # up to PIVOTS texts of a key, picked by hash; more of them the more texts there are
    picks = F.array_distinct(F.array(*[F.min_by("b", F.xxhash64("b", F.lit(j))) for j in range(PIVOTS)]))
    cells = held.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"), picks.alias("pivots"))
    cells = cells.select(
        "block", "key",
        F.slice("pivots", F.lit(1), F.greatest(F.lit(1), F.least(F.size("pivots"), F.floor(F.sqrt("n") / 2).cast("int")))).alias("pivots"),
        F.ceil(F.col("n") / SHARE).cast("int").alias("salts"),
    ).hint("merge")
    at = lambda c: F.transform("pivots", lambda p: F.struct(F.levenshtein(c, p).alias("d"), p.alias("pivot")))
    on, wide = ["block", "key", "pivot", "ring", "salt"], 2 * radius + 1
    own = sought.join(cells, ["block", "key"]).select("*", F.array_min(at("a")).alias("home"))
    own = own.select(
        "block", "key", "a", F.col("home.pivot").alias("pivot"), F.col("home.d").alias("da"),
        F.floor(F.col("home.d") / wide).alias("ring"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"),
    )
    # d(a, b) <= r puts b within 2r of its own nearest pivot's distance in a's cell
    far = held.join(cells, ["block", "key"]).select("*", at("b").alias("all")).withColumn("near", F.array_min("all")["d"] + 2 * radius)
    far = far.select("block", "key", "b", "salts", F.explode(F.filter("all", lambda x: x["d"] <= F.col("near"))).alias("cell"))
    rings = F.array_distinct(F.array(F.floor((F.col("cell.d") - radius) / wide), F.floor((F.col("cell.d") + radius) / wide)))
    far = far.select("block", "key", "b", "salts", F.col("cell.pivot").alias("pivot"), F.col("cell.d").alias("db"), F.explode(rings).alias("ring"))
    far = far.select("block", "key", "b", "pivot", "db", "ring", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = F.abs(F.col("da") - F.col("db")) <= radius
    d = F.levenshtein("a", "b", radius)  # -1 beyond the radius, found in a band of that width
    found = own.join(far.hint("merge"), on).filter(near)
    if alone:
        found = found.filter("a != b")
    found = found.select("block", "a", "b", d.alias("d")).filter("d >= 0")
    if alone:  # only shorter texts were sought; both orders come from one join, which a union would run twice
        there, back = F.struct("a", "b"), F.when(F.length("a") > F.length("b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        found = found.select("block", F.explode(F.array_compact(F.array(there, back))).alias("x"), "d").select("block", "x.a", "x.b", "d")
    return found.distinct()


def swapped(a: str = "a", b: str = "b") -> Column:
    """Whether two texts have the same letters: at distance 2, two letters that changed places."""
    return (F.length(a) == F.length(b)) & (F.array_sort(F.split(F.col(a), "")) == F.array_sort(F.split(F.col(b), "")))


def slip(one: int, two: int) -> Column:
    """Whether a pair (a, b, d) is near enough for its length.

    One edit, or two letters changed places, in texts of ``one`` letters or more;
    two edits in texts of ``two`` or more.
    """
    least = F.least(F.length("a"), F.length("b"))
    return (F.col("d") == 0) | ((F.col("d") == 1) & (least >= one)) | ((F.col("d") == 2) & ((least >= two) | ((least >= one + 1) & swapped())))


def rare(n: Column, other: Column, times: int = 3) -> Column:
    """Whether a text seen ``n`` times can be a slip for one seen ``other`` times: two common texts are two names."""
    return (n <= 2) | (other >= times * n)


def nearest(cands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the only ``value`` at the least distance ``d`` of each key; keys with several have no row."""
    least, most = F.min(F.struct("d", value)), F.max(F.struct((-F.col("d")).alias("d"), value))  # of those at the least distance
    at = cands.groupBy(*keys).agg(least[value].alias(value), most[value].alias("_most"))
    return at.filter(F.col(value) == F.col("_most")).drop("_most")


def follow(up: DataFrame) -> DataFrame:
    """(block, text, anchor) where each text points at another: at the end of its chain, by doubling until nothing moves.

    Chains must not turn back; the rounds are logarithmic in the longest.
    """
    while True:
        up = durable(up)
        release(up)
        away = up.filter("anchor != text")  # few, as most texts are no slips
        on = away.select("block", F.col("text").alias("anchor"), F.col("anchor").alias("_next")).hint("merge")
        if away.join(on, ["block", "anchor"], "left_semi").isEmpty():
            return up
        up = up.join(on, ["block", "anchor"], "left").select("block", "text", F.coalesce("_next", "anchor").alias("anchor"))


def point(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, text, n, anchor): each text with the commonest text that it may be a slip for, itself if there is none.

    ``counted`` has distinct (block, text) with n. A text points at its commonest neighbour if
    that is commoner (of equals, the one that sorts first) and it is itself rare beside it.
    """
    n_b = counted.select("block", F.col("text").alias("b"), F.col("n").alias("nb")).hint("merge")
    near = pairs.join(n_b, ["block", "b"]).select("block", F.col("a").alias("text"), "b", "d", "nb")
    to = rare(F.col("n"), F.col("nb")) & ((F.col("nb") > F.col("n")) | ((F.col("nb") == F.col("n")) & (F.col("b") < F.col("text"))))
    best = F.min(F.when(to, F.struct((-F.col("nb")).alias("k"), "d", "b")))["b"]
    # one join by text, and the aggregate in its order
    own = counted.select("block", "text", "n").join(near.hint("merge"), ["block", "text"], "left").groupBy("block", "text").agg(F.max("n").alias("n"), best.alias("anchor"))
    return own.select("block", "text", "n", F.coalesce("anchor", "text").alias("anchor"))


def anchor(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same followed to the end: a text that points at a text that itself points on goes with it."""
    return follow(point(counted, pairs).drop("n"))

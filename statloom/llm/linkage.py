"""Matching records of two sources that share no key, by probabilistic linkage.

Candidates come from several blocking passes, each an equi-join on a pair of
attributes. The attributes of a candidate pair are compared at agreement levels;
expectation-maximisation over the counts of level patterns estimates how likely
each level is among matches and among non-matches, and the posterior of a pair's
pattern is the confidence of its match.

Plan: no pass compares all pairs of a group: a key holds the games of two clubs,
or of one club on one day. There are at most as many patterns as combinations of
levels, so their counts and posteriors are of a fixed size whatever the tables';
only these reach the driver and are broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.dates import parse_date
from statloom.functions.missing import is_missing, norm_key, null_if_missing, strip
from statloom.functions.text import strip_accents
from statloom.llm.clubs import club_spellings
from statloom.session import durable, salted_join

#: pairs below this confidence aren't matches
THRESHOLD = 0.7
#: listings of one key that a task pairs with its matches
SHARE = 2000
# Levels of agreement, 0 for none; a missing attribute is NULL and says nothing.
# The game is what two clubs play on a day: 6 times the agreement of the clubs (0 one
# differs, 1 one agrees and the other is unknown, 2 both may agree, 3 both agree) plus that of the days (0 none, 1 the
# match is undated but of that season, 2 up to 75 days later, as of a game put off, 3 scraped just after it, 4 a day off, 5
# equal). Clubs and days depend on each other among the candidates, hence one attribute.
# Sides are 1 as the match has them and 0 the wrong way round; the clubs and the score are
# compared in the orientation in which the clubs agree better. The game the other way round
# is another of the season at the other's ground, so what non-matches agree in depends on the sides.
LEVELS = {"game": 24, "sides": 2, "score": 3, "place": 3, "league": 2}


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], levels: list[int], share: float = 0.1, rounds: int = 200, by: int | None = None) -> tuple[list[float], float, list[np.ndarray], list[np.ndarray]]:
    """(posterior of each pattern, share of matches, m, u) by expectation-maximisation.

    patterns: level of each attribute (None where missing) and number of pairs.
    The start has matches agree at high levels. Counts are smoothed by a hundredth of a pair a
    level, so that no level is impossible. Without any pattern the posteriors are empty.
    With ``by``, an attribute that is never missing, the other u depend on its level (a row each).
    """
    if not patterns:
        return [], share, [], []
    n = np.array([c for _, c in patterns], dtype=float)
    x = np.array([[-1 if v is None else v for v in p] for p, _ in patterns])
    m = [np.array([2.0 ** (3 * i) for i in range(k)]) for k in levels]
    m = [v / v.sum() for v in m]
    # the row of u that a pattern has in each attribute
    at = [np.zeros(len(n), dtype=int) if by is None or j == by else x[:, by] for j in range(len(levels))]

    def shares(j: int, w: np.ndarray, least: float) -> np.ndarray:
        c = np.full((levels[by] if by is not None and j != by else 1, levels[j]), least)
        seen = x[:, j] >= 0
        np.add.at(c, (at[j][seen], x[seen, j]), w[seen])
        return c / c.sum(axis=1, keepdims=True)

    u = [shares(j, n, 0.1) for j in range(len(levels))]
    post = np.zeros(len(n))
    for _ in range(rounds):
        a, b = np.full(len(n), np.log(share)), np.full(len(n), np.log1p(-share))
        for j in range(len(levels)):
            seen = x[:, j] >= 0
            a[seen] += np.log(m[j][x[seen, j]])
            b[seen] += np.log(u[j][at[j][seen], x[seen, j]])
        new = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        share = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for j, k in enumerate(levels):
            seen = x[:, j] >= 0
            c = np.bincount(x[seen, j], weights=(n * post)[seen], minlength=k) + 0.01
            m[j] = c / c.sum()
            u[j] = shares(j, n * (1 - post), 0.01)
    return post.tolist(), share, m, [v[0] if len(v) == 1 else v for v in u]


def confidences(pairs: DataFrame, levels: dict[str, int], by: str | None = None) -> DataFrame:
    """``pairs`` with the posterior of their levels as ``confidence``; ``by`` as of `estimate`."""
    names = list(levels)
    rows = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()  # at most the product of (levels + 1)
    post, *_ = estimate([(tuple(r[c] for c in names), r["n"]) for r in rows], list(levels.values()), by=None if by is None else names.index(by))
    spark = pairs.sparkSession
    schema = ", ".join(f"_{c} int" for c in names) + ", confidence double"
    table = spark.createDataFrame([(*[r[c] for c in names], p) for r, p in zip(rows, post)], schema)
    same = reduce(Column.__and__, [F.coalesce(F.col(c), F.lit(-1)) == F.coalesce(F.col(f"_{c}"), F.lit(-1)) for c in names])
    return pairs.join(F.broadcast(table), same).drop(*[f"_{c}" for c in names])


# --- games


def _plain(c: str) -> Column:
    """A place or league without case, accents' marks and punctuation; NULL where missing."""
    t = strip_accents(F.lower(strip(F.col(c))))
    return F.when(~is_missing(F.col(c)), F.trim(F.regexp_replace(t, r"[^\p{L}0-9]+", " ")))


def held_games(matches: DataFrame, teams: DataFrame, clubs: DataFrame) -> DataFrame:
    """(match_id, day, home_town, home_kind, away_town, away_kind, gh, ga, place, league, season): one row a match.

    Of the repeated rows of a match the first loaded value that isn't missing
    counts. clubs: the readings of all names, by text.
    """
    named = teams.filter(~is_missing(F.col("team_name"))).select(norm_key(F.col("team_id")).alias("id"), F.col("team_name").alias("text")).join(clubs, "text")
    named = named.groupBy("id").agg(F.min(F.struct(F.col("kind").isNull(), "town_id", "kind")).alias("c")).select("id", "c.town_id", "c.kind")
    order = F.struct("loaded_at", "row_id")
    first = {
        "day": parse_date(F.col("date")), "home": norm_key(F.col("home_team_id")), "away": norm_key(F.col("away_team_id")),
        "gh": F.col("home_score"), "ga": F.col("away_score"), "place": _plain("stadium"), "league": _plain("competition"),
        "season": F.regexp_extract("season", r"((?:19|20)[0-9]{2})", 1).try_cast("int"),
    }
    games = (
        matches.filter(~is_missing(F.col("match_id")))
        .groupBy("match_id")
        .agg(*[F.min_by(v, F.when(v.isNotNull(), order)).alias(k) for k, v in first.items()])
    )
    for side in ("home", "away"):
        dim = named.select(F.col("id").alias(side), F.col("town_id").alias(f"{side}_town"), F.col("kind").alias(f"{side}_kind"))
        games = salted_join(games, dim, [side], "match_id", "left")
    return games.drop("home", "away")


def listed_games(listings: DataFrame, clubs: DataFrame) -> DataFrame:
    """The same of each listing, with ``listing_id``, ``seen`` (the day of scraping) and ``reserve``."""
    goals = F.regexp_extract_all(F.regexp_replace("score", r"[^0-9]+", " "), F.lit(r"[0-9]+"), F.lit(0))
    played = F.when((F.size(goals) == 2) & F.col("score").rlike(r"^\s*[0-9]{1,2}\s*[^0-9\s]\s*[0-9]{1,2}\s*$"), goals)
    x = listings.select(
        "listing_id", "home_name", "away_name",
        parse_date(null_if_missing(F.col("listed_date"))).alias("day"), F.to_date("scraped_at").alias("seen"),
        played[0].cast("int").alias("gh"), played[1].cast("int").alias("ga"), _plain("venue").alias("place"), _plain("competition_label").alias("league"),
    )
    for side in ("home", "away"):
        dim = clubs.select(F.col("text").alias(f"{side}_name"), F.col("town_id").alias(f"{side}_town"), F.col("kind").alias(f"{side}_kind"), F.col("reserve").alias(f"{side}_reserve"))
        x = salted_join(x, dim, [f"{side}_name"], "listing_id", "left")
    reserve = F.coalesce("home_reserve", F.lit(False)) | F.coalesce("away_reserve", F.lit(False))
    return x.withColumn("reserve", reserve).drop("home_name", "away_name", "home_reserve", "away_reserve")


def candidates(held: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs of the passes: the two towns; one town and the day; one town and the day before scraping; on whichever side.

    Only ids meet under a key, each pair once; the attributes are joined to what
    is left. A key of many listings is split over tasks.
    """

    def keys(days: Column) -> Column:
        towns = F.array_distinct(F.array_compact(F.array("home_town", "away_town")))
        home, away = F.col("home_town"), F.col("away_town")
        both = F.when(home.isNotNull() & away.isNotNull(), F.concat_ws("|", F.lit("t"), F.least(home, away), F.greatest(home, away)))
        each = F.flatten(F.transform(towns, lambda t: F.transform(days, lambda x: F.concat_ws("|", F.lit("d"), t, x.cast("string")))))
        return F.explode(F.concat(F.array_compact(F.array(both)), each)).alias("key")

    left = held.select("match_id", keys(F.array_compact(F.array("day"))))
    right = listed.select("listing_id", keys(F.array_distinct(F.array_compact(F.array("day", F.date_sub("seen", 1))))))
    salts = right.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    left = left.join(salts, "key").select("match_id", "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = right.join(salts, "key").select("listing_id", "key", F.pmod(F.xxhash64("listing_id"), F.col("salts")).cast("int").alias("salt"))
    ids = left.join(right, ["key", "salt"]).select("match_id", "listing_id").distinct()
    m = held.select("match_id", F.struct(*held.columns).alias("m"))
    return ids.join(m, "match_id").join(listed.select("listing_id", F.struct(*listed.columns).alias("l")), "listing_id").select("m", "l")


def compare(pairs: DataFrame) -> DataFrame:
    """The levels of agreement of each candidate pair."""
    off, since = F.datediff("l.day", "m.day"), F.datediff("l.seen", "m.day")
    at = F.coalesce("l.day", "l.seen")
    day = (
        F.when(F.abs(off) == 0, 5)
        .when(F.abs(off) == 1, 4)
        .when(off.isNull() & since.between(0, 3), 3)
        .when(off.between(2, 75), 2)
        .when(F.col("m.day").isNull() & (F.col("m.season") == F.year(at) - (F.month(at) < 7).cast("int")), 1)
        .otherwise(0)
    )

    def team(side: str, other: str) -> Column:
        k1, k2 = F.col(f"m.{side}_kind"), F.col(f"l.{other}_kind")
        same = F.col(f"m.{side}_town") == F.col(f"l.{other}_town")
        return F.when(same & (k1 == k2), 3).when(same & (k1.isNull() | k2.isNull()), 2).when(same.isNotNull(), 0)  # NULL where a club is unknown

    def sides(home: str, away: str, straight: int) -> Column:
        """(clubs, sum, score, straight) with the listing's sides taken as given; the greater fits better."""
        gh, ga = F.col(f"l.{'gh' if straight else 'ga'}"), F.col(f"l.{'ga' if straight else 'gh'}")
        equal = (F.col("m.gh") == gh) & (F.col("m.ga") == ga)
        near = (F.abs(F.col("m.gh") - gh) + F.abs(F.col("m.ga") - ga) <= 1) | ((F.col("m.gh") == ga) & (F.col("m.ga") == gh))
        score = F.when(equal, 2).when(near, 1).when(equal.isNotNull(), 0)
        h, a = team("home", home), team("away", away)
        known = F.least(h, a)  # of one, if the other is unknown
        clubs = F.when(h.isNotNull() & a.isNotNull(), known).when(known > 0, 1).otherwise(0)
        return F.struct(clubs.alias("clubs"), (F.coalesce(h, F.lit(0)) + F.coalesce(a, F.lit(0))).alias("sum"), score.alias("score"), F.lit(straight).alias("straight"))

    pairs = pairs.withColumn("s", F.greatest(sides("home", "away", 1), sides("away", "home", 0)))
    place = F.when(F.col("m.place") == F.col("l.place"), 2).when(F.col("m.place").startswith(F.col("l.place")) | (F.levenshtein("m.place", "l.place") <= 3), 1).when(F.col("m.place").isNotNull() & (F.length("l.place") > 0), 0)
    # by the beginnings of their words, since labels shorten them: all of one's in the other, none, or else no telling
    starts = [F.array_distinct(F.filter(F.transform(F.split(f"{r}.league", " "), lambda w: F.substring(w, 1, 3)), lambda w: F.length(w) == 3)) for r in ("m", "l")]
    shared = F.size(F.array_intersect(*starts))
    fewer = F.least(F.size(starts[0]), F.size(starts[1]))
    league = F.when(F.col("m.league") == F.col("l.league"), 1).when((fewer > 0) & (shared == 0), 0).when((fewer > 0) & (shared == fewer), 1)
    return pairs.select(
        F.col("m.match_id").alias("match_id"), F.col("l.listing_id").alias("listing_id"), F.abs(off).alias("off"), since.alias("since"), (F.col("s.clubs") * 6 + day).cast("int").alias("game"),
        F.col("s.straight").cast("int").alias("sides"), F.col("s.score").cast("int").alias("score"), place.cast("int").alias("place"), league.cast("int").alias("league"),
    )


def link_games(matches: DataFrame, teams: DataFrame, listings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(match_id, listing_id, confidence): the match of each listing that has one.

    A listing goes to the match with the highest confidence of at least
    ``threshold`` (of equals the nearer in date, then the smaller id); listings
    of reserve teams match nothing. Missing attributes say nothing for or against;
    a listing without any name has no candidates. Repeated rows of a match count
    once, repeated listings are matched each. Empty tables give no rows.
    """
    texts = (
        listings.select(F.explode(F.array("home_name", "away_name")).alias("text"))
        .unionByName(teams.select(F.col("team_name").alias("text")))
        .filter(~is_missing(F.col("text")))
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    clubs = durable(club_spellings(texts).select("text", "town_id", "kind", "reserve"))
    held, listed = durable(held_games(matches, teams, clubs)), durable(listed_games(listings, clubs).filter("not reserve"))
    pairs = durable(compare(candidates(held, listed)))
    scored = confidences(pairs, LEVELS, by="sides").filter(F.col("confidence") >= threshold)
    best = Window.partitionBy("listing_id").orderBy(F.desc("confidence"), F.asc_nulls_last("off"), F.abs("since"), "match_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("match_id", "listing_id", F.round("confidence", 6).alias("confidence"))

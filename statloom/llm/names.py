"""Variant spellings of names typed by people.

Names are read into parts (given names, surname; town and kind of a club), and the
parts that carry the identity are linked in a metric space (`metric`): towns as a
whole, surnames within a club, given names within a surname of a club. A text goes
to the commonest text within its radius if it is rare beside it. What no edit
explains is learned: which words are given names (`roles`), and which familiar
forms stand for which given names, from the people who are listed under both.

Plan: everything before the last join works on distinct spellings, by equi-joins
and aggregates of fixed size; no list of a club's or a surname's people is made.
A club that has a third of all names is spread by its segments, pivots and salts.
Joins are hinted to be sorted: of the many small sides each would be gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import is_missing
from statloom.llm.clubs import club_spellings
from statloom.llm.metric import anchor, follow, nearest, point, radius_join, slip
from statloom.llm.roles import name_roles
from statloom.session import durable, release, salted_join

__all__ = ["club_spellings", "link_names", "same_names"]

#: letters of a surname, and of a given name, that one edit, and two, need to be taken for a slip
SURNAME, GIVEN = (4, 6), (4, 9)
#: a familiar form is one whose people are listed under the full name, too, in at least this share
FAMILIAR = 0.2
#: given names of a surname of a club up to which two of them listed together count as one; in a larger crowd, where more of them are by chance, in proportion less
CROWD = 12
#: records of one person, or rows of one club, that one task pairs with the others
SHARE = 1000


def _position(c: str) -> Column:
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(~is_missing(F.col(c)) & first.isin("G", "D", "M", "F"), first).otherwise("")


def _only(cands: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, k, value): the least value of each key; k: 1 if it has no other, else 2."""
    return cands.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), 1).otherwise(2).alias("k"), F.min(value).alias(value))


def settle(forms: DataFrame) -> DataFrame:
    """``forms`` (town_id, club_id, kinds, surname, parts, n) with their club and ``family``, the surname that theirs stands for in it.

    A form whose club is open goes to the only club of its town that has its
    surname, by the nearest spelling. Half of a compound surname goes with the
    compound, if the club has one such and nobody of that name. Forms whose club stays open are left out.
    """
    # the near surnames of a town, halves of compounds among them: found once for all that follows
    texts = forms.select(F.col("town_id").alias("block"), F.explode(F.array_union(F.array("surname"), "parts")).alias("text")).filter("block is not null and text != ''").distinct()
    pairs = radius_join(texts).filter(slip(*SURNAME))
    near = durable(pairs.unionByName(texts.select("block", F.col("text").alias("a"), F.col("text").alias("b"), F.lit(0).alias("d"))))
    sure, guessed = forms.filter("club_id is not null"), forms.filter("club_id is null")
    own = sure.filter("kinds > 1").select(F.col("town_id").alias("block"), "club_id", F.explode(F.array_union(F.array("surname"), "parts")).alias("b")).distinct()
    wanted = guessed.select(F.col("town_id").alias("block"), F.col("surname").alias("a")).distinct()
    owners = nearest(near.join(wanted.hint("merge"), ["block", "a"]).join(own.hint("merge"), ["block", "b"]), ["block", "a"], "club_id")
    guessed = guessed.drop("club_id").join(owners.select(F.col("block").alias("town_id"), F.col("a").alias("surname"), "club_id").hint("merge"), ["town_id", "surname"])
    forms = durable(sure.unionByName(guessed.select(*sure.columns)))

    names = forms.groupBy("town_id", "club_id", "surname").agg(F.sum("n").alias("n"), F.max("parts").alias("parts"))
    names = durable(names.select(F.col("town_id").alias("town"), F.col("club_id").alias("block"), F.col("surname").alias("text"), "n", "parts"))
    of_town = near.filter("a != b").withColumnRenamed("block", "town")
    in_club = of_town.join(names.select("town", "block", F.col("text").alias("a")).hint("merge"), ["town", "a"])
    heads = durable(point(names.select("block", "text", "n"), in_club.select("block", "a", "b", "d")))
    halves = names.filter(F.size("parts") > 1).join(heads.hint("merge"), ["block", "text"]).select("town", "block", F.explode("parts").alias("b"), F.col("anchor").alias("whole")).distinct()
    simple = names.filter(F.size("parts") < 2).select("town", "block", F.col("text").alias("a"))
    joined = near.withColumnRenamed("block", "town").join(simple.hint("merge"), ["town", "a"]).join(halves.hint("merge"), ["town", "block", "b"]).filter("whole != a")
    whole = nearest(joined, ["block", "a"], "whole").withColumnRenamed("a", "text")
    up = heads.join(whole.hint("merge"), ["block", "text"], "left").select("block", "text", F.when(F.col("anchor") == F.col("text"), F.coalesce("whole", "anchor")).otherwise(F.col("anchor")).alias("anchor"))
    family = follow(up).select(F.col("block").alias("club_id"), F.col("text").alias("surname"), F.col("anchor").alias("family"))
    return salted_join(forms, family, ["club_id", "surname"], "player_name")


def _short_keys(c: str) -> Column:
    """What a familiar form shares with the full name: the stem before its ending, as a beginning, or all of it as an end."""
    stem = F.regexp_replace(c, "(?<=..)(ie|i|o|a|u|is)$", "")
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.length(s) >= 2, F.concat(F.lit("<"), s)) for s in (stem, F.col(c))], F.when(F.length(c) >= 3, F.concat(F.lit(">"), F.col(c))))))


def _full_keys(c: str) -> Column:
    """The beginnings and ends of a full name that a familiar form may be."""
    n = F.length(c)
    begins = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n - 1)), lambda k: F.concat(F.lit("<"), F.substring(F.col(c), F.lit(1), k)))
    ends = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), n - 1)), lambda k: F.concat(F.lit(">"), F.right(F.col(c), k)))
    return F.array_distinct(F.concat(begins, ends))


def given_anchors(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, given, head), (given, full)): each given name of a surname with the one it stands for, and the familiar forms learned.

    forms: (block, given, position, n), the block being a surname of a club. Slips
    are linked by edit distance among all given names; familiar forms that share a
    beginning or an end with the only fuller name of their block and position by
    that, others by what was learned.
    """
    typed = durable(forms.filter("given is not null").groupBy("block", "given").agg(F.collect_set("position").alias("positions")))
    words = durable(typed.groupBy(F.lit("").alias("block"), F.col("given").alias("text")).agg(F.count(F.lit(1)).alias("n")))
    heads = anchor(words, radius_join(words.select("block", "text")).filter(slip(*GIVEN))).select(F.col("text").alias("given"), F.col("anchor").alias("name"))
    typed = salted_join(typed, heads, ["given"], "block")
    names = durable(typed.groupBy("block", "name").agg(F.array_distinct(F.flatten(F.collect_set("positions"))).alias("positions")))
    common = names.groupBy("name").agg(F.count(F.lit(1)).alias("common"))
    several = names.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    left = durable(salted_join(names.join(several.hint("merge"), "block"), common, ["name"], "block"))
    w = left.select("block", F.col("name").alias("w"), F.col("common").alias("nw"), F.col("positions").alias("pw"), "k")
    f = left.select("block", F.col("name").alias("f"), F.col("common").alias("nf"), F.col("positions").alias("pf"), "k")
    less = (F.col("nw") < F.col("nf")) | ((F.col("nw") == F.col("nf")) & (F.length("w") < F.length("f")))
    meets = F.arrays_overlap("pw", "pf") | F.array_contains("pw", "") | F.array_contains("pf", "")
    # learned: people listed under both, in crowds of any size, of those listed under the familiar form; once is enough for a form hardly seen of a common name
    salts = F.ceil(F.col("k") / SHARE).cast("int")  # a large crowd is split over tasks
    sides = w.withColumn("salt", F.pmod(F.xxhash64("w"), salts).cast("int")).join(f.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("k").hint("merge"), ["block", "salt"])
    weight = F.least(F.lit(1.0), (CROWD - 1) / (F.col("k") - 1))
    both = sides.filter(less & meets).groupBy("w", "f").agg(F.sum(weight).alias("c"), F.max("nw").alias("nw"), F.max("nf").alias("nf"))
    enough = (F.col("c") >= FAMILIAR * F.col("nw")) & ((F.col("c") >= 2) | ((F.col("nw") <= 2) & (F.col("nf") >= 3 * F.col("nw"))))
    learned = durable(both.filter(enough).select("w", "f", "c"))
    keyed = w.select("block", "w", "pw", F.explode(_short_keys("w")).alias("key")).join(f.select("block", "f", "pf", F.explode(_full_keys("f")).alias("key")).hint("merge"), ["block", "key"])
    keyed = keyed.filter(F.length("w") < F.length("f")).select("block", "w", "f", meets.alias("meets"), F.lit(True).alias("part"))
    known = salted_join(w, learned, ["w"], "block").join(f.drop("k").hint("merge"), ["block", "f"]).select("block", "w", "f", meets.alias("meets"), F.lit(False).alias("part"))
    # the only full name of the position; what shares letters comes before what doesn't
    part = F.when(F.col("part"), F.col("f"))
    pick = keyed.unionByName(known).filter("meets").groupBy("block", "w").agg(*[g(c).alias(f"{n}_{g.__name__}") for n, c in (("part", part), ("all", F.col("f"))) for g in (F.min, F.max)])
    at = F.when(F.col("part_min").isNotNull(), F.struct(F.col("part_min").alias("a"), F.col("part_max").alias("z"))).otherwise(F.struct(F.col("all_min").alias("a"), F.col("all_max").alias("z")))
    pick = pick.select("block", F.col("w").alias("text"), at.alias("x")).filter("x.a = x.z").select("block", "text", F.col("x.a").alias("full"))
    up = names.select("block", F.col("name").alias("text")).join(pick.hint("merge"), ["block", "text"], "left").select("block", "text", F.coalesce("full", "text").alias("anchor"))
    found = follow(up).select("block", F.col("text").alias("name"), F.col("anchor").alias("head"))
    return typed.select("block", "given", "name").join(found.hint("merge"), ["block", "name"]).select("block", "given", "head"), learned.filter("c >= 2").select(F.col("w").alias("given"), F.col("f").alias("full"))


def persons(forms: DataFrame) -> DataFrame:
    """``forms`` (block, player_name, club, given, letter, position, n) with ``person_id``.

    Forms with a given name are persons. One with an initial or nothing before the
    surname goes to the only person it fits, or to the only one of those with its
    position; initials that fit nobody are a person of their own. What fits
    several people of one position has a NULL person.
    """
    heads, learned = given_anchors(forms)
    named = durable(salted_join(forms.filter("given is not null"), heads, ["block", "given"], "player_name").withColumn("person_id", F.concat_ws("|", "block", "head")))
    # the letters and positions each person is known with
    people = named.groupBy("block", "person_id", "given", "position").agg(F.first("letter").alias("letter"))
    full = people.join(learned.hint("merge"), "given").select("block", "person_id", "position", F.substring("full", 1, 1).alias("letter"))
    known = durable(people.select("block", "person_id", "position", "letter").unionByName(full).distinct())
    first = forms.filter("given is null and letter is not null")

    def fit(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.join(_only(known, keys, "person_id").select(*keys, F.col("k").alias("k1"), F.col("person_id").alias("p1")).hint("merge"), keys, "left")
        return rows.join(_only(known, [*keys, "position"], "person_id").select(*keys, "position", F.col("k").alias("k2"), F.col("person_id").alias("p2")).hint("merge"), [*keys, "position"], "left").select(
            *[c for c in rows.columns if c not in ("k1", "p1")], "k1", F.when(F.col("k1") == 1, F.col("p1")).when((F.col("position") != "") & (F.col("k2") == 1), F.col("p2")).alias("person_id")
        )

    lettered = fit(first, known, ["block", "letter"])
    lettered = durable(lettered.withColumn("person_id", F.when(F.col("k1").isNull(), F.concat_ws("|", "block", F.lit("."), "letter")).otherwise(F.col("person_id"))))
    loose = lettered.filter("k1 is null").select("block", "person_id", "position", "letter").distinct()
    bare = fit(forms.filter("letter is null"), known.unionByName(loose), ["block"])
    bare = bare.withColumn("person_id", F.when(F.col("k1").isNull(), F.concat_ws("|", "block", F.lit("."))).otherwise(F.col("person_id")))
    own = [*forms.columns, "person_id"]
    return named.select(*own).unionByName(lettered.select(*own)).unionByName(bare.select(*own))


def link_names(stats: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, clubs): (record_id, club_id, person_id) of the statistics and (team_id, club_id) of the teams.

    stats: record_id, player_name, club, position; teams: team_id, team_name.
    Records and teams without a name or club have NULL ids and are linked to
    nothing. A club that could be two of its town goes to the one that has the
    record's surname, if only one has. Persons are persons of one club. Repeated
    records are one person's records; empty tables give empty results.
    """
    stats = stats.select("record_id", "player_name", "club", _position("position").alias("position"))
    typed = stats.filter(~is_missing(F.col("club"))).select(F.col("club").alias("text"))
    named = teams.filter(~is_missing(F.col("team_name"))).select(F.col("team_name").alias("text"))
    clubs = club_spellings(typed.unionByName(named).groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    club_id = F.when(F.col("kind").isNotNull() | (F.col("kinds") == 0), F.concat_ws("|", "town_id", F.coalesce("kind", F.lit("")), F.when(F.col("reserve"), "2")))
    clubs = durable(clubs.withColumn("club_id", club_id))

    forms = stats.filter(~is_missing(F.col("player_name"))).groupBy("player_name", "club", "position").agg(F.count(F.lit(1)).alias("n"))
    people = name_roles(forms.select(F.col("player_name").alias("text")).distinct()).withColumnRenamed("text", "player_name")
    forms = salted_join(forms, clubs.withColumnRenamed("text", "club").select("club", "town_id", "club_id", "kinds"), ["club"], "player_name")
    forms = durable(forms.join(people.hint("merge"), "player_name"))
    release(forms)
    forms = settle(forms).withColumn("block", F.concat_ws("|", "club_id", "family"))
    own = persons(durable(forms.select("block", "club_id", "player_name", "club", "given", "letter", "position", "n")))

    records = salted_join(stats, own.select("player_name", "club", "position", "club_id", "person_id"), ["player_name", "club", "position"], "record_id", "left")
    plain = salted_join(records.select("record_id", "club", F.col("club_id").alias("own"), "person_id"), clubs.select(F.col("text").alias("club"), "club_id"), ["club"], "record_id", "left")
    records = plain.select("record_id", F.coalesce("own", "club_id").alias("club_id"), "person_id")
    team_ids = teams.select("team_id", F.col("team_name").alias("text")).join(clubs.select("text", "club_id").hint("merge"), "text", "left").select("team_id", "club_id").filter("team_id is not null").distinct()
    return records, team_ids


def _pairs(rows: DataFrame, group: str, key: str, kind: str) -> DataFrame:
    """(kind, key_a, key_b) of the different keys of each group; a large group is split over tasks."""
    salts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(salts.hint("merge"), group)
    a = rows.select(group, F.col(key).alias("key_a"), F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias("salt"))
    b = rows.select(group, F.col(key).alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return a.join(b.hint("merge"), [group, "salt"]).filter("key_a < key_b").select(F.lit(kind).alias("kind"), "key_a", "key_b")


def same_names(stats: DataFrame, teams: DataFrame) -> DataFrame:
    """(kind, key_a, key_b): pairs of records of one person, of teams of one club, of records and teams of one club."""
    records, team_ids = link_names(stats, teams)
    records, team_ids = durable(records), durable(team_ids.filter("club_id is not null"))
    release(records)
    players = _pairs(records.filter("person_id is not null").select("person_id", "record_id"), "person_id", "record_id", "player")
    same = _pairs(team_ids, "club_id", "team_id", "team").distinct()
    own = salted_join(records.filter("club_id is not null").select("record_id", "club_id"), team_ids, ["club_id"], "record_id")
    clubs = own.select(F.lit("club").alias("kind"), F.least("record_id", "team_id").alias("key_a"), F.greatest("record_id", "team_id").alias("key_b"))
    return players.unionByName(same).unionByName(clubs)

"""Parsers of texts that hold records: line-ups, goals, feeds, match and squad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import strip
from statloom.functions.text import WEEKDAYS, clean_text, date_line, let, path_meta, season_of_path, split_team_country, stable_id


def lineups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, team_name, player_name): 'Team: P; P | Team: P, P'. Parts without a colon are left out."""
    teams = df.select(key, F.explode(F.split(clean_text(F.col(text)), r"\|")).alias("part")).filter(F.instr("part", ":") > 0)
    names = teams.select(key, strip(F.substring_index("part", ":", 1)).alias("team_name"), F.explode(F.split(F.regexp_replace("part", "^[^:]*:", ""), "[;,]")).alias("n"))
    return names.select(key, "team_name", clean_text(F.col("n")).alias("player_name")).filter("player_name is not null")


_TIME = r"([0-9]+(?:\+[0-9]+)?)'?(\s*\((P|OG)\))?"


def goals(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, player_name, minute, minute_base, minute_added, goal_type, goal_id).

    "Name 45'; 90+1' (P); X 12' (OG)": a token that is only a minute is the goal
    of the player before it; tokens that are neither are left out.
    """
    t = df.select(key, F.posexplode(F.split(clean_text(F.col(text)), ";")).alias("position", "tok")).withColumn("tok", strip(F.col("tok"))).filter("tok <> ''")
    repeat = rf"^{_TIME}$"
    first = rf"^(.+?)\s+{_TIME}"
    named = F.when(~F.col("tok").rlike(repeat), clean_text(F.regexp_extract("tok", first, 1)))
    t = t.withColumn("named", named)
    t = t.withColumn("player_name", F.last("named", ignorenulls=True).over(Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.col("tok").rlike(repeat)
    minute = F.when(alone, F.regexp_extract("tok", repeat, 1)).otherwise(F.regexp_extract("tok", first, 2))
    marker = F.when(alone, F.regexp_extract("tok", repeat, 3)).otherwise(F.regexp_extract("tok", first, 4))
    kind = F.when(marker == "P", "penalty").when(marker == "OG", "own_goal").otherwise("regular")
    out = t.withColumns({"minute": minute, "goal_type": kind}).filter("minute <> '' and player_name is not null")
    return out.select(
        key, "position", "player_name", "minute",
        F.substring_index("minute", "+", 1).try_cast("int").alias("minute_base"), F.when(F.instr("minute", "+") > 0, F.substring_index("minute", "+", -1).try_cast("int")).alias("minute_added"),
        "goal_type", stable_id("goal", F.col(key).cast("string"), F.col("player_name"), F.col("minute"), F.col("goal_type")).alias("goal_id"),
    )


# What a mark in brackets after a minute says about the goal.
_MARKS = {"p": "penalty", "pen.": "penalty", "og": "own_goal", "o.g.": "own_goal"}


def scorers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, side, player_name, minute, goal_type) of '[A 12, B 40 (p); C 90 (og)]': home before the semicolon, away after it.

    Read word by word: words gather to a name, a minute ends it and makes a goal,
    a mark in brackets after it says of which type, a comma starts anew. A minute
    without a name, or with one of a single letter, is no goal. Only the outer
    brackets go, so that a mark at the end keeps its own.
    """
    t = clean_text(F.col(text))
    t = F.when((t.startswith("[") & t.endswith("]")) | (t.startswith("(") & t.endswith(")")), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    halves = F.split(t, ";", 2)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.trim(F.get(halves, F.lit(i))).alias("part")) for i, s in enumerate(("home", "away"))])
    x = df.filter(F.instr(text, ";") > 0).select(key, F.explode(sides).alias("s")).select(key, "s.side", "s.part").filter("part not in ('-', '')")
    # commas and brackets are words of their own
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("part", ",", " , "), r"\(", " (")), r"\s+")
    goal = "struct<name:string,minute:string,kind:string>"
    begin = F.struct(F.lit("").alias("name"), F.lit(False).alias("open"), F.array().cast(f"array<{goal}>").alias("goals"))

    def read(seen: Column, w: Column) -> Column:
        name, goals = seen["name"], seen["goals"]
        plain = F.rtrim(w, F.lit("'"))
        last = F.try_element_at(goals, F.lit(-1))
        mark = F.create_map(*[F.lit(v) for kv in _MARKS.items() for v in kv])[F.lower(F.trim(w, F.lit("()")))]
        marked = F.concat(F.slice(goals, 1, F.size(goals) - 1), F.array(F.struct(last["name"].alias("name"), last["minute"].alias("minute"), mark.alias("kind"))))
        scored = F.concat(goals, F.array(F.struct(name.alias("name"), plain.alias("minute"), F.lit("regular").alias("kind"))))
        # open: right behind a goal, where a mark may stand
        out = lambda n, o, g: F.struct(n.alias("name"), F.coalesce(o, F.lit(False)).alias("open"), g.cast(f"array<{goal}>").alias("goals"))
        return (
            F.when(plain.rlike("^[0-9]{1,3}([+][0-9]{1,2})?$"), out(F.lit(""), F.length(name) > 1, F.when(F.length(name) > 1, scored).otherwise(goals)))
            .when(w.startswith("("), out(F.lit(""), F.lit(False), F.when(seen["open"] & mark.isNotNull(), marked).otherwise(goals)))
            .when(w == ",", out(F.lit(""), F.lit(False), goals))
            .otherwise(out(F.trim(F.concat_ws(" ", name, w)), F.lit(False), goals))
        )

    hits = x.select(key, "side", F.explode(F.aggregate(words, begin, read)["goals"]).alias("h"))
    return hits.select(key, "side", clean_text(F.col("h.name")).alias("player_name"), F.col("h.minute").alias("minute"), F.col("h.kind").alias("goal_type"))


def feed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, field, value) of a feed 'ST~name¬S1~v¬S2~v¬': fields belong to the section before them."""
    t = df.select(key, F.posexplode(F.split(F.col(text), "¬")).alias("position", "tok")).filter(F.instr("tok", "~") > 0)
    t = t.select(key, "position", F.substring_index("tok", "~", 1).alias("field"), F.regexp_replace("tok", "^[^~]*~", "").alias("value"))
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("section", F.last(F.when(F.col("field") == "ST", F.col("value")), ignorenulls=True).over(w)).filter("field <> 'ST'").select(key, "section", "field", "value")


def _words(words: Column, first: Column, last: Column) -> Column:
    """The words from ``first`` to ``last``, from 1; NULL if there are none."""
    n = last - first + 1
    return F.when(n > 0, F.array_join(F.slice(words, first, F.greatest(n, F.lit(0))), " "))


def _where(words: Column, test) -> Column:
    """The place of the first word that passes, 0 without one; ``test`` takes a word and its place from 1."""
    hits = F.filter(F.transform(words, lambda w, i: F.when(test(w, i + 1), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0)).cast("int")


def _word(words: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(words, F.lit(i) if isinstance(i, int) else i), F.lit(""))


def _timed(words: Column, skipped: Column, marks: str) -> Column:
    """One more than ``skipped`` if the word there is a time of day."""
    return skipped + _word(words, skipped).rlike(f"^[0-9]{{1,2}}[{marks}][0-9]{{2}}$").cast("int")


def _is_score(w: Column) -> Column:
    return w.rlike("^[0-9]+-[0-9]+$")


def _note(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^(\([^)]+\))", 1)


_GAME = "struct<home:string,away:string,score:string,stadium:string,city:string>"


def _versus(words: Column, lead: Column) -> Column:
    """The game of 'Home v Away score', NULL for others; ``lead`` words come before the teams."""

    def divided(at: Column) -> Column:
        v, s = at["v"], at["s"]
        rest = F.coalesce(_words(words, s + 1, F.size(words)), F.lit(""))
        home = let(_words(words, at["skip"] + 1, v - 1), lambda t: split_team_country(t)["team"])
        away = let(_words(words, v + 1, s - 1), lambda t: split_team_country(t)["team"])
        null = F.lit(None).cast("string")
        score = F.trim(F.concat_ws(" ", _word(words, s - 1), _note(rest)))
        return F.when((v > 0) & (s > 0), F.struct(home.alias("home"), away.alias("away"), score.alias("score"), null.alias("stadium"), null.alias("city"))).cast(_GAME)

    def scored(at: Column) -> Column:
        return let(F.struct(at["skip"].alias("skip"), at["v"].alias("v"), _where(words, lambda w, i: _is_score(w) & (i > at["v"] + 1)).alias("s")), divided)

    return let(_timed(words, lead, ".:"), lambda skip: let(F.struct(skip.alias("skip"), _where(words, lambda w, i: (w == "v") & (i > skip + 1)).alias("v")), scored))


def _scored(words: Column, lead: Column, line: Column) -> Column:
    """The game of 'Home score Away @ Venue, City', NULL for others; ``lead`` words come before the teams."""

    def named(x: Column) -> Column:
        venue = F.when(F.instr(line, "@") > 0, clean_text(F.substring_index(F.get(F.split(line, "@", 2), F.lit(1)), "#", 1)))
        parts = let(venue, lambda v: F.transform(F.split(v, ",", 2), clean_text))
        usable = ~x["home"].startswith("Winner ") & ~x["away"].startswith("Winner ") & ~line.contains(" - ")
        game = let(parts, lambda p: F.struct(x["home"].alias("home"), x["away"].alias("away"), x["score"].alias("score"), F.get(p, F.lit(0)).alias("stadium"), F.get(p, F.lit(1)).alias("city")))
        return F.when(usable, game.cast(_GAME))

    def divided(at: Column) -> Column:
        c, after = at["c"], F.filter(F.split(F.trim(F.substring(at["tail"], F.length(at["said"]) + 1, F.length(at["tail"]))), " "), lambda w: w != "")
        away = let(after, lambda a: let(_where(a, lambda w, i: w.startswith("@") & (i > 1)), lambda t: _words(a, F.lit(1), F.when(t > 0, t - 1).otherwise(F.size(a)))))
        score = F.trim(F.concat_ws(" ", _word(words, c - 1), at["said"]))
        game = F.struct(let(_words(words, at["skip"] + 1, c - 1), clean_text).alias("home"), let(away, clean_text).alias("away"), score.alias("score"))
        return F.when(c > 0, let(game, named))

    def noted(at: Column) -> Column:
        c = at["c"]
        extra = _word(words, c).isin("pen.", "a.e.t.") & _word(words, c + 1).rlike(r"^\([0-9]+-[0-9]+\)$")
        tail = F.coalesce(_words(words, c + 1, F.size(words)), F.lit(""))
        said = F.when(extra, F.concat_ws(" ", _word(words, c), _word(words, c + 1))).otherwise(_note(tail))
        return let(F.struct(at["skip"].alias("skip"), c.alias("c"), tail.alias("tail"), said.alias("said")), divided)

    return let(_timed(words, lead, ":"), lambda skip: let(F.struct(skip.alias("skip"), _where(words, lambda w, i: _is_score(w) & (i > skip + 1)).alias("c")), noted))


def match_line(line: Column) -> Column:
    """struct(home, away, score, stadium, city) of a line 'Home v Away 2-1 (1-0)' or 'Home 2-1 Away @ Venue, City'; NULL for others.

    The words before the teams (a number in brackets, the day, the time) are
    counted off one by one; then the first word that is a score divides the line,
    and 'v' or '@' divide its sides. A note in brackets after the score belongs to it.
    """

    def read(words: Column) -> Column:
        numbered = _word(words, 0).rlike(r"^\([0-9]+\)$").cast("int")
        dated = lambda n: n + F.when(_word(words, n).isin(*WEEKDAYS) & _word(words, n + 1).rlike("^[A-Za-z]+/?[0-9]{1,2}$"), 2).otherwise(0)
        return let(numbered, lambda n: F.coalesce(_versus(words, n), _scored(words, dated(n), line)))

    return let(F.filter(F.split(line, r"\s+"), lambda w: w != ""), read)


def fixture_lines(lines: DataFrame) -> DataFrame:
    """Matches of fixture texts: lines (path, line_no, text) to one row a match with its date, scorer line, season and competition.

    State is carried over lines by a window of the file: the date line before a
    match, and the scorer line right after it.
    """
    file = Window.partitionBy("path").orderBy("line_no")
    header = F.first(F.when(F.col("text").startswith("="), F.col("text")), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = lines.withColumn("season", season_of_path(F.col("path"), header))
    x = x.withColumn("_date", date_line(F.col("text"), F.col("season"))).withColumn("m", match_line(F.col("text")))
    x = x.withColumn("date", F.last("_date", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    follows = F.lead("text").over(file)
    scorer = F.when(follows.rlike(r"[\[(]") & follows.rlike(r"\d") & F.lead("m").over(file).isNull() & F.lead("_date").over(file).isNull(), follows)
    meta = path_meta(F.col("path"))
    return x.withColumn("scorer_line", scorer).filter("m is not null").select(
        "path", "line_no", "season", "date", "m.*", "scorer_line", meta["competition"].alias("competition"), meta["scope"].alias("scope"), meta["country"].alias("country")
    )


def squad_lines(lines: DataFrame, year: Column | None = None) -> DataFrame:
    """(path, number, player_name, position, age) of 'no, Name, POS, ... b. YYYY'; ages below zero are 0."""
    p = r"^\s*([0-9]+),\s*([^,]+),\s*([A-Z]{2}),.*?b\.\s*([0-9]{4})"
    now = F.year(F.current_date()) if year is None else year
    g = [F.regexp_extract("text", p, i) for i in (1, 2, 3, 4)]
    return lines.filter(F.col("text").rlike(p)).select("path", g[0].cast("int").alias("number"), strip(g[1]).alias("player_name"), g[2].alias("position"), F.greatest(now - g[3].cast("int"), F.lit(0)).alias("age"))

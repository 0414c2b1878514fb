"""Schemas that drift between the files of a stream.

A file's schema is a tree: fields are nodes, a dotted header nests. The edit
distance between the trees of two successive files, with nodes matched level by
level at minimum cost, gives the script of added, removed, renamed, moved and
retyped fields; the scripts, chained along a stream, are compiled into a
projection for every file, and all files are read through theirs into one table.

The cost of matching two fields with different headers is nothing if both are
known names of one field of the catalog and prohibitive if they are names of two;
with a name the catalog doesn't know, it comes from the likeness of names, types
and values. Values are known by a sketch (mean, bottom hashes) of fixed size.

Plan: lines are split in the JVM. The join of lines with their file's separator
is salted, since one file may hold a third of all lines. Column types and sketches
are one aggregation with map-side combine. Scripts are made from one small row a
file, streamed in order of file number with the state of one file, so a stream of
any length fits. Only headers and sketches ever reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.missing import strip
from statloom.session import shuffle_width

SALTS = 16
HASHES = 8
#: a delete and an insert cost this much each; a match that costs more than both isn't made
GAP = 0.5
FORBIDDEN = 9.0
TYPES = ("integer", "decimal", "text")
#: what a cell says instead of a value, trimmed and in upper case (fixed values)
NO_VALUE = ("", "NULL", "NA", "NAN", "NONE", "-")

#: Known headers of the catalog's fields besides their own names (a parameter of the operator).
ALIASES = {
    "serial": ("rank", "no"),
    "id_player": ("pid", "player_no", "player_id"),
    "player_name": ("name", "player", "jugador"),
    "club": ("team", "squad", "equipo"),
    "position": ("pos", "role"),
    "minutes_played": ("mins", "minutos", "min_played", "time_on_pitch"),
    "matches_played": ("match_played", "matches_appareance", "matches_appearance", "match_count", "matches", "games", "apps", "partidos"),
    "goals": ("goals_scored", "goles", "gls"),
    "assists": ("ast", "asistencias", "assist_count"),
    "distance_covered": ("distance_covered(km/h)", "distance_km", "dist_covered", "km_run"),
    "top_speed": ("vel_max", "max_speed", "speed_max_kmh"),
    "balls_recovered": ("balls_recoverd", "ball_recov", "recoveries", "balls_won_back", "balones_recuperados"),
    "tackles": ("tkl", "tackles_total", "entradas"),
    "tackles_won": ("t_won", "tkl_w", "won_tackles"),
    "tackles_lost": ("t_lost", "tkl_l", "lost_tackles"),
    "clearances_attempted": ("clearance_attempted", "clearances", "clr_att", "despejes"),
}


@dataclass
class Node:
    """A field: its header (the last part of a dotted one), type, sketch and nested fields."""

    name: str
    path: str = ""
    kind: str = "integer"
    known: str | None = None
    mean: float | None = None
    hashes: tuple[int, ...] = ()
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def tree(fields: list[Node]) -> Node:
    """The schema tree of a file's fields; ``a.b`` nests b in a."""
    root = Node("")
    for f in fields:
        at = root
        *parents, last = f.path.split(".")
        for p in parents:
            at = next((c for c in at.children if c.name == p and c.children), None) or (at.children.append(Node(p, path="")) or at.children[-1])
        f.name = last
        at.children.append(f)
    return root


def _trigrams(s: str) -> set[str]:
    s = f"  {s} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _alike(a: str, b: str) -> float:
    x, y = _trigrams(a), _trigrams(b)
    return len(x & y) / len(x | y)


def resolve(header: str, catalog: dict[str, str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> str | None:
    """The catalog field that a header is a known name of, or the only one it is nearly spelled like."""
    names = {f: (f, *aliases.get(f, ())) for f in catalog}
    for f, own in names.items():
        if header in own:
            return f
    best = sorted(((max(_alike(header, n) for n in own), f) for f, own in names.items()), reverse=True)[:2]
    if best and best[0][0] >= 0.7 and (len(best) == 1 or best[0][0] - best[1][0] >= 0.2):
        return best[0][1]
    return None


def match_cost(a: Node, b: Node) -> float:
    """What it costs to take field a of one file for field b of the next."""
    if a.name == b.name:
        return 0.0
    if a.known and b.known:
        return 0.2 if a.known == b.known else FORBIDDEN
    if a.kind == "text" and b.kind == "text" and a.hashes and b.hashes:
        values = sum(x == y for x, y in zip(a.hashes, b.hashes)) / HASHES
    elif a.mean is not None and b.mean is not None:
        values = max(0.0, 1 - abs(math.log((abs(b.mean) + 1) / (abs(a.mean) + 1))))
    else:
        values = 0.0
    return 1.6 - 0.6 * _alike(a.name, b.name) - 0.7 * values - 0.3 * (a.kind == b.kind)


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in a square matrix's assignment of least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for row in range(n):
        owner[n], at = row, n
        slack, back, done = [math.inf] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while owner[at] != n:
            done[at] = True
            i = owner[at]
            for j in range(n):
                if not done[j] and (c := cost[i][j] - u[i] - v[j]) < slack[j]:
                    slack[j], back[j] = c, at
            nxt = min((j for j in range(n) if not done[j]), key=slack.__getitem__)
            step = slack[nxt]
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < n:
                    slack[j] -= step
            at = nxt
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [0] * n
    for j in range(n):
        out[owner[j]] = j
    return out


def _distance(a: Node, b: Node) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    """Edit distance of two subtrees whose roots are matched, and the pairs of the script."""
    p, q = a.children, b.children
    if not p and not q:
        return 0.0, []
    inner = [[_distance(x, y) if x.children or y.children else (0.0, []) for y in q] for x in p]
    n = len(p) + len(q)
    cost = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i < len(p) and j < len(q):
                cost[i][j] = match_cost(p[i], q[j]) + inner[i][j][0]
            elif i < len(p):
                cost[i][j] = GAP * p[i].size()
            elif j < len(q):
                cost[i][j] = GAP * q[j].size()
    total, pairs = 0.0, []
    for i, j in enumerate(assign(cost)):
        total += cost[i][j]
        if i < len(p) and j < len(q):
            pairs += [(p[i], q[j]), *inner[i][j][1]]
        elif i < len(p):
            pairs += [(x, None) for x in _walk(p[i])]
        elif j < len(q):
            pairs += [(None, y) for y in _walk(q[j])]
    return total, pairs


def _walk(n: Node) -> list[Node]:
    return [n, *(x for c in n.children for x in _walk(c))]


def edit_script(prev: list[Node], cur: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """(field before, field now) of two files; one side is None where a field was added or removed.

    A field that was removed under one parent and added under another is the same
    field moved, if the catalog or the header says so.
    """
    _, pairs = _distance(tree(prev), tree(cur))
    pairs = [(a, b) for a, b in pairs if (a or b).path]
    gone, new = [a for a, b in pairs if b is None], [b for a, b in pairs if a is None]
    moved = []
    for a in gone:
        b = next((b for b in new if match_cost(a, b) <= 0.2), None)
        if b is not None:
            new.remove(b)
            moved.append((a, b))
    taken = [id(x) for pair in moved for x in pair]
    return [(a, b) for a, b in pairs if (a and b) or id(a or b) not in taken] + moved


# --- from lines to columns


def _split(line: Column, separator: Column) -> Column:
    """The fields of a line, trimmed and without quotes; a quoted field may hold the separator."""
    sep = F.concat(F.lit(r"\Q"), separator, F.lit(r"\E"))
    pattern = F.concat(sep, F.lit(r'(?: *"(?:[^"]|"")*" *(?='), sep, F.lit(r"|$)|[^"), sep, F.lit(r"]*)"))
    raw = F.regexp_extract_all(F.concat(separator, line), pattern, F.lit(0))

    def bare(x: Column) -> Column:
        x = strip(F.substring(x, 2, 1 << 30))
        quoted = x.rlike(r'(?s)^".*"$') & (F.length(x) >= 2)
        return strip(F.when(quoted, F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), '""', '"')).otherwise(x))

    return F.transform(raw, bare)


def cells(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, line_no, header, fields): the data lines with their file's header, as arrays.

    Blank lines and repetitions of the header line are left out; lines of files
    that aren't listed, and files without a line 1, too. Repeated data lines stay.
    """
    head = (
        files.select("file_id", "separator")
        .join(lines.filter("line_no = 1").select("file_id", F.col("line").alias("first")), "file_id")
        .withColumn("first", F.regexp_replace("first", "^﻿", ""))
        .withColumn("header", F.transform(_split(F.col("first"), F.col("separator")), lambda x: F.lower(x)))
    )
    salted = head.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    data = lines.filter((F.col("line_no") > 1) & (F.trim("line") != "")).select("file_id", "line_no", "line", F.pmod("line_no", F.lit(SALTS)).cast("int").alias("salt"))
    return (
        data.join(salted, ["file_id", "salt"])
        .filter(F.col("line") != F.col("first"))
        .select("file_id", "line_no", "header", _split(F.col("line"), F.col("separator")).alias("fields"))
    )


def _number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def _reading(value: Column) -> Column:
    """The number that a cell stands for: with a letter before it (P12), a unit or an
    asterisk after it (9.5 km, 12*), or as hours and minutes (7:53, in minutes)."""
    plain = F.regexp_extract(value, r"^[A-Za-z]?([+-]?[0-9]+(?:[.,][0-9]+)?) ?(?:[A-Za-z%]{1,4}(?:/[A-Za-z])?|\*)?\z", 1)
    clock = value.rlike(r"^[0-9]+:[0-5][0-9]\z")
    hours, minutes = F.substring_index(value, ":", 1).try_cast("double"), F.substring_index(value, ":", -1).try_cast("double")
    return F.when(clock, hours * 60 + minutes).when(plain != "", _number(plain))


def column_profiles(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, columns): each file's columns in order: pos, name, kind, mean, hashes.

    kind is the narrowest of integer, decimal and text for all values; a column
    without values is an integer. Files with a header only have columns too.
    """
    head = (
        files.select("file_id", "separator")
        .join(lines.filter("line_no = 1").select("file_id", F.col("line").alias("first")), "file_id")
        .select("file_id", F.posexplode(_split(F.regexp_replace("first", "^﻿", ""), F.col("separator"))).alias("pos", "name"))
        .select("file_id", "pos", F.lower("name").alias("name"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("value"))
    )
    value = F.when(~F.upper("value").isin(*NO_VALUE), F.col("value"))
    kind = F.when(value.isNull() | value.rlike(r"^[+-]?[0-9]+\z"), 0).when(value.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?\z"), 1).otherwise(2)
    body = (
        cells(files, lines)
        .select("file_id", F.size("header").alias("n"), F.posexplode("fields").alias("pos", "value"))
        .filter(F.col("pos") < F.col("n"))
        .select("file_id", "pos", F.lit(None).cast("string").alias("name"), kind.alias("kind"), F.when(kind < 2, _number(value)).alias("num"), F.lower(value).alias("value"))
    )
    hashes = [F.min(F.when(F.col("value").isNotNull(), F.xxhash64("value", F.lit(i)))).alias(f"h{i}") for i in range(HASHES)]
    per = (
        head.unionByName(body)
        .groupBy("file_id", "pos")
        .agg(F.max("name").alias("name"), F.max("kind").alias("kind"), F.avg("num").alias("mean"), *hashes)
        .filter(F.col("name").isNotNull())
        .withColumn("hashes", F.array_compact(F.array(*[f"h{i}" for i in range(HASHES)])))
    )
    return per.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "mean", "hashes"))).alias("columns"))


SCRIPT = (
    "stream_id string, file_id string, file_no long, subject string, pos int, header string, quantity string, "
    "kind string, previous string, previous_kind string, change string"
)


def _scripts(known: dict[str, dict[str, str]], aliases: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, before, quantities = None, [], {}
        resolved: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.stream_id != stream:
                    stream, before, quantities, first = r.stream_id, [], {}, True
                else:
                    first = False
                catalog = known.get(r.subject, {})
                now = []
                for c in r.columns:
                    key = (r.subject, c["name"])
                    if key not in resolved:
                        resolved[key] = resolve(c["name"], catalog, aliases)
                    mean = c["mean"]
                    now.append((c["pos"], Node(c["name"], c["name"], TYPES[c["kind"]], resolved[key], None if mean is None or mean != mean else mean, tuple(c["hashes"]))))
                place = {id(n): p for p, n in now}
                names = {id(n): n.path for _, n in now} | {id(n): n.path for n in before}
                pairs = [(None, n) for _, n in now] if first else edit_script(before, [n for _, n in now])
                follow = {}
                taken: set[str] = set()
                for a, b in sorted(pairs, key=lambda x: place.get(id(x[1]), -1)):
                    if b is None:
                        out.append((stream, r.file_id, r.file_no, r.subject, None, names[id(a)], quantities.get(id(a)), None, names[id(a)], a.kind, "removed"))
                        continue
                    q = (quantities.get(id(a)) if a is not None else None) or b.known or names[id(b)]
                    q = q if q not in taken else f"{names[id(b)]}#{place[id(b)]}"
                    taken.add(q)
                    follow[id(b)] = q
                    changes = []
                    if a is None:
                        changes = [] if first else ["added"]
                    else:
                        if names[id(a)] != names[id(b)]:
                            changes.append("moved" if names[id(a)].rpartition(".")[2] == names[id(b)].rpartition(".")[2] else "renamed")
                        if a.kind != b.kind:
                            changes.append("retyped")
                    for change in changes or [None]:
                        out.append((stream, r.file_id, r.file_no, r.subject, place[id(b)], names[id(b)], q, b.kind, a and names[id(a)], a and a.kind, change))
                before, quantities = [n for _, n in now], follow
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCRIPT.split(", ")]).astype({"pos": "Int32"})

    return run


def schema_scripts(files: DataFrame, lines: DataFrame, catalog: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """One row per field of each file, and one per change (``change`` is NULL where nothing changed).

    The catalog is a fixed list of fields, read on the driver. A stream's subject
    is its family without ``_data``. Files of one number are taken in order of
    their id; files without lines have no fields and are skipped.
    """
    known: dict[str, dict[str, str]] = {}
    for r in catalog.select("subject", "field_name", "field_type").collect():
        known.setdefault(r[0], {})[r[1]] = r[2]
    named = files.select("stream_id", "file_id", "file_no", F.regexp_replace("family", "_data$", "").alias("subject"))
    rows = column_profiles(files, lines).join(named, "file_id").repartition(shuffle_width(files), "stream_id").sortWithinPartitions("stream_id", "file_no", "file_id")
    return rows.select("stream_id", "file_id", "file_no", "subject", "columns").mapInPandas(_scripts(known, aliases), SCRIPT)


def schema_changes(scripts: DataFrame) -> DataFrame:
    """(file_id, field_name, change): every difference of a file from the one before it."""
    return scripts.filter("change is not null").select("file_id", F.col("header").alias("field_name"), "change")


def consistent_table(files: DataFrame, lines: DataFrame, catalog: DataFrame, subject: str, scripts: DataFrame | None = None) -> DataFrame:
    """All files of a subject as one table with the catalog's fields in the catalog's types.

    file_id and line_no name the origin. A text that isn't of its field's type
    becomes NULL and stays as written in ``unread``; values of fields that the
    catalog doesn't know stand in ``extra``. Repeated lines of a file count once
    (the first line_no). A file without lines adds no rows.
    """
    scripts = schema_scripts(files, lines, catalog) if scripts is None else scripts
    maps = (
        scripts.filter((F.col("subject") == subject) & F.col("pos").isNotNull())
        .dropDuplicates(["file_id", "pos"])
        .groupBy("file_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("quantity", "pos"))).alias("places"))
    )
    salted = maps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    data = cells(files.filter(F.regexp_replace("family", "_data$", "") == subject), lines).withColumn("salt", F.pmod("line_no", F.lit(SALTS)).cast("int"))
    data = data.groupBy("file_id", "fields").agg(F.min("line_no").alias("line_no"), F.min("salt").alias("salt"))
    rows = data.join(salted, ["file_id", "salt"])

    def text(q: str) -> Column:
        v = F.try_element_at("fields", F.try_element_at("places", F.lit(q)) + 1)
        return F.when(~F.upper(v).isin(*NO_VALUE), v)

    fields = [(r[0], r[1]) for r in catalog.filter(F.col("subject") == subject).select("field_name", "field_type").collect()]
    cast = {"integer": lambda v: F.when(F.round(_reading(v)) == _reading(v), _reading(v)).cast("long"), "decimal": _reading, "text": lambda v: v}
    known = [f for f, _ in fields]
    extra = F.map_filter(F.transform_values("places", lambda k, p: F.try_element_at("fields", p + 1)), lambda k, v: ~k.isin(*known) & v.isNotNull())
    unread = F.map_from_entries(
        F.array_compact(F.array(*[F.when(text(f).isNotNull() & cast[t](text(f)).isNull(), F.struct(F.lit(f), text(f))) for f, t in fields if t != "text"]))
    )
    return rows.select("file_id", "line_no", *[cast[t](text(f)).alias(f) for f, t in fields], extra.alias("extra"), unread.alias("unread"))

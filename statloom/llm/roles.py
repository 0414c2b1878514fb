"""Which words of a typed name are given names and which the surname, learned from the names themselves.

A given name is shared by many people and mostly stands first, or behind a comma;
a surname is shared by few and mostly stands last, or before a comma. Each word
has expected counts in both roles; expectation-maximisation reads every name by
the counts of the other names and counts again, until hardly a reading changes.

Plan: a round is a join of the words of the distinct names with their counts and
one aggregate by name and one by word; no list of words reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.clubs import read_texts
from statloom.llm.spelling import parts_of, read_person, sound
from statloom.session import durable, salted_join

#: counts an unseen word has as a given name (few names, much used) and as a surname (many, hardly used)
UNSEEN_GIVEN, UNSEEN_FAMILY = 0.1, 0.4
#: names that are typed with the surname first, before any is read
REVERSED = 0.15
#: share of names whose reading may still change when the rounds end, and rounds at most
SETTLED, ROUNDS = 0.001, 10
_SECOND = 0.2  # share of people with a second given name, and with a second surname


def readings(tokens: list[str], cut: int, given: dict[str, float], family: dict[str, float]) -> list[tuple[float, int, int]]:
    """(weight, from, to): the ways to read a name, with the tokens that are its given names.

    given, family: how likely each word is in the role. Weights sum to one.
    """
    n = len(tokens)
    if cut > 0:
        return [(1.0, cut, n)]
    if n < 2:
        return [(1.0, n, n)]
    g = [sum(math.log(given[p]) for p in parts_of([t])) for t in tokens]
    s = [sum(math.log(family[p]) for p in parts_of([t])) if len(t) > 1 else -50.0 for t in tokens]
    out = []
    for k in range(1, n):
        extra = math.log(_SECOND) * ((k - 1) + (n - k - 1))
        out.append((math.log(1 - REVERSED) + extra + sum(g[:k]) + sum(s[k:]), 0, k))
        out.append((math.log(REVERSED) + extra + sum(s[: n - k]) + sum(g[n - k :]), n - k, n))
    top = max(w for w, _, _ in out)
    weights = [math.exp(w - top) for w, _, _ in out]
    total = sum(weights)
    return [(w / total, a, b) for w, (_, a, b) in zip(weights, out)]


def _own(tokens: list[str], ways: list[tuple[float, int, int]]) -> list[float]:
    """How probably each word of the name is a given name."""
    return [sum(w for w, a, b in ways if a <= i < b) for i, t in enumerate(tokens) for _ in parts_of([t])]


def _start(tokens: list[str], cut: int) -> list[float]:
    if cut > 0:
        return _own(tokens, readings(tokens, cut, {}, {}))
    last = len(tokens) - 1
    at = [0.0 if last == 0 else 1 - REVERSED if i == 0 else REVERSED if i == last else 0.5 for i in range(last + 1)]
    return [at[i] for i, t in enumerate(tokens) for _ in parts_of([t])]


def name_roles(texts: DataFrame) -> DataFrame:
    """(text, surname, parts, given, letter) of each distinct text; texts without a letter have no row.

    surname: as it sounds, without blanks; parts: of a compound one; given: the
    first given name as it sounds, NULL without one; letter: its first letter, also of an initial.
    """
    raw = read_texts(texts.select("text"), lambda t: (lambda tokens, cut: (tokens, cut, _start(tokens, cut), [parts_of([x]) for x in tokens]))(*read_person(t)), "text string, tokens array<string>, cut int, own array<double>, words array<array<string>>")
    names = durable(raw.withColumn("words", F.flatten("words")).filter(F.size("tokens") > 0))
    schema = "text string, tokens array<string>, cut int, own array<double>, words array<string>, first int, last int, changed boolean"
    names = names.withColumns({"first": F.lit(-1), "last": F.lit(-1)})
    for _ in range(ROUNDS):
        # each word with its place; the first brings the name itself, so that names and counts meet in one shuffle by text
        own = F.struct(*names.columns[:7])
        words = names.select("text", own.alias("name"), F.posexplode_outer(F.arrays_zip("words", "own")).alias("i", "x"))
        words = words.select("text", "i", F.col("x.words").alias("word"), F.col("x.own").alias("own"), F.when(F.coalesce("i", F.lit(0)) == 0, F.col("name")).alias("name"))
        counts = words.filter("word is not null").groupBy("word").agg(F.sum("own").alias("g"), F.sum(1 - F.col("own")).alias("s"))
        seen = F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "g", "s")))).alias("seen")  # as long as the name
        whole = salted_join(words, counts, ["word"], "text", "left").groupBy("text").agg(F.first("name", ignorenulls=True).alias("name"), seen)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    given, family = {}, {}
                    for w, own, x in zip(r.words, r.own, r.seen if r.seen is not None else []):
                        # the counts of the other names
                        given[w] = max(x["g"] - own, 0.0) + UNSEEN_GIVEN
                        family[w] = max(x["s"] - (1 - own), 0.0) + UNSEEN_FAMILY
                    ways = readings(list(r.tokens), r.cut, given, family)
                    _, a, b = max(ways, key=lambda v: v[0])
                    out.append((r.text, list(r.tokens), r.cut, _own(list(r.tokens), ways), list(r.words), a, b, (a, b) != (r.first, r.last)))
                yield pd.DataFrame(out, columns=["text", "tokens", "cut", "own", "words", "first", "last", "changed"])

        names = durable(whole.select("name.*", "seen").mapInPandas(read, schema))
        moved = names.agg(F.coalesce(F.avg(F.col("changed").cast("int")), F.lit(0.0))).first()[0]
        if moved <= SETTLED:
            break
        names = names.drop("changed")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                tokens = list(r.tokens)
                first = tokens[r.first : r.last]
                rest = tokens[: r.first] + tokens[r.last :]
                parts = [p for p in (sound(p) for t in rest for p in t.split("-")) if p]
                given = next((sound(t) for t in first if len(t) > 1), None)
                letter = sound(first[0])[:1] if first else None
                if parts:
                    out.append((r.text, "".join(parts), parts if len(parts) > 1 else [], given or None, letter or None))
            yield pd.DataFrame(out, columns=["text", "surname", "parts", "given", "letter"])

    return names.select("text", "tokens", "first", "last").mapInPandas(finish, "text string, surname string, parts array<string>, given string, letter string")

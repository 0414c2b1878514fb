"""How typed names are read: letters, sounds, the words of a club's name and the tokens of a person's."""

from __future__ import annotations

import re
import unicodedata

# Letters that normalisation doesn't take apart.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "Ø": "O", "Ł": "L", "Đ": "D"})
# Words for kinds of clubs the world over, as written in full, shortened and in other languages.
KINDS = {
    "academical": ("academical", "accies"),
    "albion": ("albion", "alb"),
    "alliance": ("alliance", "alianza", "alianca"),
    "america": ("america",),
    "argyle": ("argyle",),
    "athletic": ("athletic", "athl", "ath", "ac", "atletico", "atl", "atletic"),
    "borussia": ("borussia", "bor"),
    "celtic": ("celtic",),
    "central": ("central", "ctl"),
    "city": ("city", "cty", "ciudad", "stadt"),
    "county": ("county", "cnty"),
    "deportivo": ("deportivo", "depor", "dep", "cd", "desportivo"),
    "dynamo": ("dynamo", "dinamo", "dyn", "din"),
    "eintracht": ("eintracht", "eintr"),
    "estrella": ("estrella", "stella", "zvezda", "steaua"),
    "football": ("football", "futbol", "fussball", "calcio", "fc"),
    "fortuna": ("fortuna",),
    "forest": ("forest",),
    "forward": ("forward", "vorwarts", "avanti"),
    "harriers": ("harriers",),
    "hotspur": ("hotspur", "hspur"),
    "independent": ("independiente", "independent", "indep"),
    "inter": ("inter", "international", "internazionale", "internacional"),
    "locomotive": ("lokomotiv", "lokomotive", "locomotive", "lok", "loko"),
    "national": ("national", "nacional", "nac"),
    "olympic": ("olympic", "olimpic", "olympique", "olympia", "olimpia", "oly", "olym"),
    "orient": ("orient",),
    "palace": ("palace",),
    "partizan": ("partizan", "partisan", "part"),
    "progress": ("progress", "progreso", "progres"),
    "racing": ("racing", "rac", "rc"),
    "railway": ("railway", "ferrocarril", "ferroviario", "zeleznicar"),
    "rangers": ("rangers", "rgrs", "rang"),
    "rapid": ("rapid", "rap"),
    "real": ("real", "royal"),
    "rovers": ("rovers", "rov", "rvrs"),
    "shakhtar": ("shakhtar", "shakhter", "miner"),
    "slavia": ("slavia",),
    "sparta": ("sparta", "spartak", "spartacus"),
    "sporting": ("sporting", "sport", "sp"),
    "stade": ("stade", "stadium"),
    "thistle": ("thistle",),
    "torpedo": ("torpedo",),
    "town": ("town", "tn"),
    "union": ("union", "un", "uniao"),
    "united": ("united", "utd", "untd", "unt"),
    "university": ("university", "universidad", "universitario", "univ"),
    "victoria": ("victoria", "viktoria", "vitoria"),
    "villa": ("villa",),
    "wanderers": ("wanderers", "wand", "wdrs", "wndrs"),
    "wednesday": ("wednesday", "wed"),
    "workers": ("workers", "arbeiter", "trabajadores"),
}
# Kinds that many clubs put beside another one, which then counts.
_WEAK = {"football", "athletic", "sporting"}
# Words that say nothing about which club it is.
_LEGAL = {"ev", "sad", "club", "afc", "cf", "the", "sa", "spa", "plc", "ltd", "gmbh"}
# Words for teams of a club that aren't its first; also u and an age.
_RESERVES = {"ii", "iii", "b", "reserves", "reserve", "res", "women", "ladies", "femenino", "feminine", "frauen", "youth", "juniors", "juvenil", "academy", "amateurs"}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words}


def fold(s: str) -> str:
    """Lower case without accents; text that was decoded wrongly is first decoded rightly."""
    s = re.sub("[ãâäåøð](?=[\x80-\xbfŒ-™])", lambda m: m[0].upper(), s)
    if re.search("[ÃÂÄÅØÐ][\x80-\xbfŒ-™]", s):
        for coding in ("latin-1", "cp1252"):
            try:
                s = s.encode(coding).decode()
                break
            except UnicodeError:
                continue
    s = unicodedata.normalize("NFKD", s.translate(_LETTERS))
    return "".join(c for c in s if not unicodedata.combining(c)).lower().translate(_LETTERS)


def sound(s: str) -> str:
    """Letters that are written for one another made one: ph f, w v, c q k, y i, z s; doubles single."""
    s = re.sub(r"[\W\d_]", "", s).replace("ph", "f").translate(str.maketrans("wcqyz", "vkkis"))
    return re.sub(r"(.)\1+", r"\1", s)


def one_edit(a: str, b: str) -> bool:
    """Whether one letter more, less or other, or two neighbours swapped, make a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def read_club(name: str) -> tuple[str, str | None, bool]:
    """(town as it sounds, kind of club or None, whether it isn't the first team)."""
    s = re.sub(r"\([^)]*\)\s*$|\s-\s[^\W\d_][\w ]*$", " ", fold(name).strip())
    s = re.sub(r"\b(?:[a-z]\.){2,}(?:[a-z]\b)?", lambda m: m[0].replace(".", ""), s)
    tokens = [t for t in re.split(r"[\W_]+", s) if t and not t.isdigit()]
    other = [t in _RESERVES or bool(re.fullmatch("u[12][0-9]", t)) for t in tokens]
    reserve = any(other)
    tokens = [t for t, o in zip(tokens, other) if not o]
    kind, rest = None, []
    for t in tokens:
        k = _KIND_OF.get(t)
        if k is None and len(t) >= 4:
            k = next((k for k in KINDS if one_edit(t, k)), None)
        if k and len(tokens) > 1:
            kind = k if kind is None or kind in _WEAK or k not in _WEAK else kind
        elif t not in _LEGAL:
            rest.append(t)
    if not rest and tokens:
        rest, kind = [max(tokens, key=len)], None
    return sound("".join(rest)), kind, reserve


_WORD = re.compile(r"[^\W\d_]+(?:['’`\-][^\W\d_]+)*\.?")


def read_person(name: str) -> tuple[list[str], int]:
    """(tokens, how many of them stand before a comma, or -1 without one); an initial is a token of one letter."""
    s = fold(name).replace("_", " ")
    left, comma, right = s.partition(",")
    tokens = [[re.sub("['’`]", "", w.rstrip(".")) for w in _WORD.findall(part)] for part in (left, right)]
    if not comma or not tokens[0] or not tokens[1]:
        return [*tokens[0], *tokens[1]], -1
    return [*tokens[0], *tokens[1]], len(tokens[0])


def parts_of(tokens: list[str]) -> list[str]:
    """The words of the tokens, taken apart at hyphens; initials are none."""
    return [p for t in tokens for p in t.split("-") if len(p) > 1]

"""Keyed surrogates of personal information (used by problem 9).

A value is taken apart into entities: a Latin name into given and family name, so
that "P. Arkwell", "Arkwell, Petra" and "Petra J. Arkwell" share their parts; a
number into its digits without country code and trunk prefix; other kinds are one
entity. Each entity gets a surrogate of its type, script and gender drawn from a
keyed stream. The first letter of a given name depends on the real first letter
alone, so an initial and the full name agree. Entities whose surrogates collide,
or hit a real entity, draw again with more room until all differ.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.llm.names import FEMALE, HAN, MALE, ZH_FAMILY, ZH_GIVEN
from tracewake.session import cut

#: Redraws before giving up; each has more room than the one before.
TURNS = 40
PARTS = "part string, entity string, rank int, surrogate string"
_ONSET = ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "br", "dr", "kr", "st", "tr")
_VOWEL = ("a", "e", "i", "o", "u", "ei", "au")
_FEMALE, _MALE = frozenset(FEMALE), frozenset(MALE)
_FEMININE = re.compile(r"(?:a|e|ie|elle|ette|ine|rid|th|xanthe|is|unn|yn|een)$")
_COUNTRY = re.compile(r"^(?:\+|00)(?:1(?!\d{0,8}$)|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0123458]|\d{3})")
_AT, _DOT = re.compile(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|[@＠]", re.I), re.compile(r"\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.", re.I)
_TYPES = frozenset(
    "street st avenue ave boulevard blvd road rd lane ln court ct close drive dr way terrace place pl square sq crescent parade highway hwy circle row mews gardens grove walk green parkway pkwy trail loop alley broadway quay rise vale of the n s e w ne nw se sw "
    "calle avenida avda av plaza pza paseo camino carretera ctra ronda travesía glorieta gran vía rambla callejón de del la las los el y san santa c am an der den auf dem im in unter hinter zum zur straße str weg gasse allee platz ring ufer damm nd rd th número".split()
)
_SUFFIX = re.compile(r"(?:straße|strasse|str|weg|gasse|allee|platz|ring|ufer|damm|steig|markt|hof|chaussee)$")


class _Stream:
    """Keyed numbers for one entity."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def word(self, syllables: int) -> str:
        return "".join(_ONSET[self.below(len(_ONSET))] + _VOWEL[self.below(len(_VOWEL))] for _ in range(syllables))


def national_number(value: str) -> str:
    """Digits without country code and trunk prefix."""
    v = value.replace("(0)", "")
    digits = re.sub(r"[^\d+]", "", v)
    if m := _COUNTRY.match(digits):
        return digits[m.end() :].lstrip("0") or digits
    if len(digits) == 11 and digits[0] == "1" and not re.match(r"1\d{2}[ -]?\d{4}[ -]?\d{4}$", value):
        return digits[1:]
    return digits.lstrip("+").lstrip("0") or digits


def name_parts(value: str) -> tuple[str, str]:
    """Given name (or initial) and family name, without case."""
    v = value.casefold()
    if "," in v:
        family, given = (x.strip() for x in v.split(",", 1))
        return re.split(r"[ .]", given)[0], family
    words = [w for w in re.split(r"\s+|(?<=\.)", v) if w]
    return words[0].rstrip("."), words[-1]


def entity(kind: str, value: str) -> str:
    """The value without format: what two spellings of one entity share."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", value.casefold()))
    if kind == "phone":
        return national_number(value)
    if kind == "name":
        return value if re.search(f"[{HAN}]", value) else " ".join(name_parts(value))
    if kind == "address":
        return re.sub(r"[\W_]+", " ", value.casefold()).strip()
    return re.sub(r"[\W_]+", "", value.casefold())


def parts_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(part, entity) of a value; a single letter of a given name needs no entry, as it follows from the key."""
    if kind != "name" or re.search(f"[{HAN}]", value):
        return [(kind, entity(kind, value))]
    given, family = name_parts(value)
    return [("family", family)] + ([("given", given)] if len(given) > 1 else [])


def initial(letter: str, key: bytes) -> str:
    """The letter that stands for a real first letter: a keyed permutation, so different letters stay different."""
    letters = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda c: hmac.new(key, b"initial" + c.encode(), hashlib.sha256).digest())
    base = letter.casefold()[:1]
    return letters["abcdefghijklmnopqrstuvwxyz".index(base)] if "a" <= base <= "z" else letters[ord(base) % 26]


def draw(part: str, ent: str, key: bytes, rank: int = 0) -> str:
    """The surrogate entity; rank counts the redraws and widens the room."""
    s = _Stream(key, part, ent, str(rank) if rank else "")
    if part in ("phone", "id_number"):
        out = [str(s.below(10)) if c.isdigit() else chr(97 + s.below(26)) if c.isalpha() else c for c in ent]
        if part == "phone" and out and out[0] == "0":
            out[0] = str(1 + s.below(9))
        if len(ent) == 18 and ent[:17].isdigit():  # a date of birth stands inside
            out[6:14] = list(f"{1940 + s.below(60)}{1 + s.below(12):02d}{1 + s.below(28):02d}")
        return "".join(out)
    if part == "email":
        return f"{s.word(2)}.{s.word(3 + rank // 2)}@{s.word(3)}.example"
    if re.search(f"[{HAN}]", ent):
        # after a few draws any character of the common block may stand in the given name
        pick = lambda: ZH_GIVEN[s.below(len(ZH_GIVEN))] if rank < 4 else chr(0x4E00 + s.below(20_000))
        if part == "address":
            return f"{pick()}{pick()}{''.join(pick() for _ in range(rank // 4))} {s.below(900) + 10}"
        return ZH_FAMILY[s.below(len(ZH_FAMILY))] + "".join(pick() for _ in range(len(ent) - 1))
    if part == "address":
        return f"{s.word(3 + rank // 2)} {s.below(900) + 10}"
    if part == "given":
        feminine = ent in _FEMALE or (ent not in _MALE and bool(_FEMININE.search(ent)))
        first = initial(ent, key)
        body = s.word(2 + rank // 2)
        return (first + (body if first in "aeiou" else body.lstrip("bdfgklmnprstv"))) + ("a" if feminine else "n")
    return f"{s.word(3 + rank // 2)}r"


def _case_like(value: str, out: str) -> str:
    return out.upper() if value.isupper() and len(value) > 1 else out


def formatted(kind: str, value: str, drawn: list[str], key: bytes) -> str:
    """The surrogate entities written as value was: separators, order, case, script, spelling."""
    if kind == "phone":
        digits = [k for k, c in enumerate(value) if c.isdigit()]
        own = len(national_number(value))
        kept, out = set(digits[: len(digits) - own]), list(value)
        for k, c in zip([k for k in digits if k not in kept], drawn[0], strict=False):
            out[k] = c
        return "".join(out)
    if kind == "id_number":
        chars = iter(drawn[0])
        return "".join((d.upper() if c.isupper() else d) if c.isalnum() and (d := next(chars, "0")) else c for c in value)
    if kind == "email":
        user, _, domain = drawn[0].partition("@")
        at = _AT.search(value)
        dot = _DOT.search(value, at.end())
        return _case_like(value, user + at.group() + domain.replace(".", dot.group() if dot else "."))
    if kind == "address":
        name, no = drawn[0].rsplit(" ", 1)
        if re.search(f"[{HAN}]", value):
            return re.sub(r"\d+", no, re.sub(rf"^[{HAN}]+?(?=大街|大道|胡同|街道|[路街巷弄道里])", name, value), count=1)
        state = {"named": False}

        def swap(m: re.Match[str]) -> str:
            w = m.group()
            if w.casefold() in _TYPES or len(w) == 1:
                return w
            suffix = _SUFFIX.search(w)
            first, state["named"] = not state["named"], True
            return (name.title() if first else draw("street", f"{w.casefold()}|{name}", key)[:6].title()) + (suffix.group() if suffix else "")

        rest = re.sub(r"[^\W\d_]+", swap, value)
        if not state["named"]:  # only a number beside a type
            return re.sub(r"\d+", no, rest, count=1)
        return re.sub(r"\d+", no, rest, count=1)
    if re.search(f"[{HAN}]", value):
        return drawn[0]
    given, _ = name_parts(value)
    family = drawn[0].title()
    first = drawn[1].title() if len(drawn) > 1 else initial(given, key).upper() + "."
    middle = "".join(f" {initial(m, key).upper()}." for m in re.findall(rf"(?<=[\w.] )([A-ZÀ-ÖØ-Þ])\.", value))
    if "," in value:
        out = f"{family}, {first}{middle}"
    else:
        particle = m.group(1) if (m := re.search(r"\w( (?:(?:van|von|de|der|den|del|la|di|da|dos|zu|bin|al) )+)", value)) else " "
        out = f"{first}{middle}{particle}{family}"
    return _case_like(value, out)


def surrogate_table(parts: DataFrame, key: bytes) -> DataFrame:
    """part, entity, surrogate: one per entity of the corpus, distinct within a part.

    Of entities that drew the same surrogate the first keeps it; the others, and
    those that hit a real entity, draw again with more room.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(surrogate=[draw(p, e, key, int(r)) for p, e, r in zip(b["part"], b["entity"], b["rank"], strict=True)])

    todo = parts.select("part", "entity").distinct().withColumn("rank", F.lit(0))
    taken = parts.select("part", F.col("entity").alias("surrogate"))
    done = None
    for turn in range(1, TURNS + 1):
        drawn = cut(todo.mapInPandas(run, PARTS))
        groups = drawn.groupBy("part", "surrogate").agg(F.min("entity").alias("entity"))
        good = groups.join(taken if done is None else taken.unionByName(done.select("part", "surrogate")), ["part", "surrogate"], "left_anti")
        done = cut(good.select("part", "entity", "surrogate") if done is None else done.unionByName(good.select("part", "entity", "surrogate")))
        todo = cut(drawn.select("part", "entity").join(done, ["part", "entity"], "left_anti").withColumn("rank", F.lit(turn)))
        if todo.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {TURNS} draws")

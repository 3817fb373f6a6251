"""Personal information inside free text (problem 9).

Mentions are found by form and context: addresses of mail (also spelled out),
phone numbers by national numbering rules, identity numbers, street addresses,
and names by the scored tagger of names.py. Each mention has an entity, its value
without format, so that spellings of one person, number or address corefer:
numbers lose country code and trunk prefix, names are taken by their parts.
Every mention gets a keyed surrogate of its type (surrogates.py), checked for
collisions over the corpus; what is listed is what was replaced.

The tagger is fitted on every text: all words are counted and all distinct
name-like spans are examples. These stay on the executors; words and features that
several texts or spans share, and sums, reach the driver (corpus.py).

Nulls and edge cases: null texts and ids give nothing to the list; a null text
stays null in the rewritten table; overlapping finds keep the longer one;
a value repeated in a text is listed once; a name is a given name or initial
with a family name; an empty lexicon leaves the built-in lists and the context.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewake.llm import names as tagging
from tracewake.llm.corpus import Spread
from tracewake.llm.surrogates import entity, formatted, parts_of, surrogate_table
from tracewake.session import cut, spread

#: The lexicon goes to every worker; more names than this are refused rather than sent.
MAX_LEXICON = 500_000
HAN = "一-鿿"
TEXTS, WORDS, RECORDS = range(3)
MENTIONS = "doc_id long, kind string, value string"

# ---- mail
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+"
EMAIL = re.compile(
    rf"{_LOCAL}(?: ?(?:@|＠|[\[({{] ?(?:at|AT) ?[\])}}]) ?{_LABEL}(?:(?:\.| ?[\[({{] ?(?:dot|DOT) ?[\])}}] ?){_LABEL})+"
    rf"| (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL})+)"
)
AT_SIGNS = ("@", "＠", " dot ", " DOT ", *(f"{b}{s}{w}" for b in "[({" for s in ("", " ") for w in ("at", "AT")))
DOMAIN_END = re.compile(r"[A-Za-z]{2,}$")

# ---- numbers
SPAN = re.compile(r"(?<![A-Za-z0-9_.+-])[+(]{0,2}\d[\d ()./–-]*\d(?:-?[A-Z])?(?![A-Za-z0-9_])")
DIGITS = re.compile(r"\d[\d ()./–-]{3,}\d")
ID_FORMS = re.compile(
    r"(?<![A-Za-z0-9-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{4}\d{5}|[XYZ]?\d{7,8}-?[A-Z]|\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?![A-Za-z0-9])"
)
SSN = re.compile(r"(?<![A-Za-z0-9_-])\d{3}([- ])\d{2}\1\d{4}(?![A-Za-z0-9_-])")
ID_LABEL = re.compile(r"(?:SSN|social security(?: number| no\.?)?|tax id|tax no\.?|identity no\.?|national id|passport(?: no\.?| number)?|DNI|NIE|NIF|Ausweisnummer|Ausweis-?Nr\.?|Personalausweis|Steuer-?ID|身份证号?码?|证件号码?|护照号?码?)[:： ]{0,3}$", re.I)
# fixed values: national numbering rules, as country code, trunk prefix and written form of the rest
PHONE_FORMS = tuple(
    re.compile(p)
    for p in (
        r"\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?!\d)",
        r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
        r"(?:\+44 ?(?:\(0\) ?)?|0044 ?|0)7\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)",
        r"(?:\(0[12]\d{0,4}\) ?|0[12]\d{0,4}[ -])\d{3,4}[ -]\d{3,4}(?!\d)",  # United Kingdom and Australia, fixed lines
        r"(?:\(01\d{3,4}\) ?|01\d{3,4}[ -])\d{5,6}(?!\d)",
        r"(?:\(0[2378]\) ?|0[2378] )\d{4}[ -]\d{4}(?!\d)|04\d{2}[ -]\d{3}[ -]\d{3}(?!\d)",
        r"0\d(?:[ .]\d{2}){4}(?!\d)",  # France
        r"(?:\+49|0049)[ /-]?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,6}[ -]?\d{0,5}(?!\d)",
        r"(?:\(0\d{2,4}\) ?|0\d{2,4}[/ ])\d{3,8}(?:[ -]\d{1,5})?(?!\d)",  # Germany
        r"(?:\+34|0034)[ .-]?\d{3}[ .-]?\d{2,3}[ .-]?\d{2,3}[ .-]?\d{0,2}(?!\d)",
        r"[5-9]\d{2} \d{2} \d{2} \d{2}(?!\d)",
        r"[5-9]\d{2}([ .])\d{3}\1\d{3}(?!\d)",
        r"(?:\+86|0086)[ -]?1\d{2}[ -]?\d{4}[ -]?\d{4}(?!\d)",
        r"1\d{2}[ -]\d{4}[ -]\d{4}(?!\d)",
        r"(?:\(0\d{2,3}\) ?|0\d{2,3}[ -])\d{7,8}(?!\d)|0\d{2,3}-\d{4}[ -]\d{4}(?!\d)",  # China, fixed lines
        r"(?:\+|00)[1-9]\d{0,2}(?:[ ./-]?\(?\d{1,5}\)?){2,6}(?!\d)",
    )
)
BARE = re.compile(r"(?<![A-Za-z0-9_.+/-])\d{9,13}(?![A-Za-z0-9_-])")
PHONE_CUE = re.compile(r"(?:(?<![A-Za-z])(?:call|text|phone|phone_number|tel|telefon|mobile|mobil|cell|handy|fax|answered|back on|ring|dial|sms|whatsapp|llamar al|llame al|móvil|teléfono|anrufen|bitte an|erreichbar unter)\.?|(?<=_)(?:phone|mobile|tel)|电话|手机|致电|联系方式|手机号码?)\W{0,5}$", re.I)
ROW_CUE = re.compile(r"\|\s*$")
DATE_LIKE = re.compile(r"0?\d{1,2}[ ./-]\d{1,2}[ ./-](?:19|20)\d{2}(?!\d)|\d{1,3}(?:\.\d{1,3}){3}(?![.\d])|(?:19|20)\d{2}[-./]\d{2}[-./]\d{2}")

# ---- addresses
_EN_TYPE = r"(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Lane|Ln\.?|Court|Ct\.?|Close|Drive|Dr\.?|Way|Terrace|Place|Pl\.?|Square|Sq\.?|Crescent|Parade|Highway|Hwy\.?|Circle|Row|Mews|Gardens|Grove|Walk|Green|Parkway|Pkwy\.?|Trail|Loop|Alley|Broadway|Quay|Rise|Vale)"
EN_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_./-])\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})?,? (?:(?:[A-Z][A-Za-z'’-]+|[A-Z]\.|\d{{1,3}}(?:st|nd|rd|th)|of|the) ){{1,4}}?{_EN_TYPE}(?![A-Za-z0-9_])(?: (?:N|S|E|W|NE|NW|SE|SW)(?![A-Za-z0-9_]))?")
_DE = "[A-ZÄÖÜ][a-zäöüß]+"
DE_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_-])(?:(?:{_DE}-)*(?:{_DE}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|markt|hof|chaussee)|{_DE}-(?:Straße|Str\.|Weg|Allee|Platz|Ring|Ufer|Damm))|(?:{_DE} )?(?:Straße|Str\.|Weg|Gasse|Allee|Platz)"
    rf"|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Unter den|Unter der|Hinter der|Zum|Zur) {_DE}(?: {_DE})?)\s?\d{{1,4}}(?: ?[a-z](?![A-Za-z]))?(?:-\d{{1,4}})?(?![A-Za-z0-9_])"
)
_ES_WORD = r"(?:de|del|la|las|los|el|y|san|santa|[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñü'’-]*)"
ES_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_/])(?:Calle|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Carretera|Ctra\.|Ronda|Travesía|Glorieta|Gran Vía|Rambla|Callejón|C/)\s?(?:{_ES_WORD}\s){{0,5}}?(?:{_ES_WORD},?\s?)?(?:n[º.°]\s?|número )?\d{{1,4}}[A-Za-z]?(?![A-Za-z0-9_])")
ZH_ADDRESS = re.compile(rf"[{HAN}]{{1,8}}?(?:大街|大道|胡同|街道|[路街巷弄道里])(?:[东西南北]段?|[一二三四五六七八九十]段)?\s?\d{{1,5}}\s?(?:弄\s?\d+\s?)?号")
ZH_LEAD = re.compile("^.*(?:寄到|送到|送至|寄往|寄至|位于|地址是|地址为|地址|住在|住址|家住|搬到|前往|[省市区县镇乡到在于至往是为])")
# fixed values: what ends or begins a street name, and the form it belongs to
_CUES = (
    *((f" {w}", EN_ADDRESS) for w in "Street St Avenue Ave Boulevard Blvd Road Rd Lane Ln Court Ct Close Drive Dr Way Terrace Place Pl Square Sq Crescent Parade Highway Hwy Circle Row Mews Gardens Grove Walk Green Parkway Pkwy Trail Loop Alley Broadway Quay Rise Vale".split()),
    *((w, DE_ADDRESS) for w in "straße strasse str. weg gasse allee platz ring ufer damm steig markt hof chaussee Straße Str. Weg Gasse Allee Platz Ring Ufer Damm".split()),
    *((w, DE_ADDRESS) for w in ("Am ", "An der ", "An den ", "Auf der ", "Auf dem ", "Im ", "In der ", "Unter den ", "Unter der ", "Hinter der ", "Zum ", "Zur ")),
    *((w, ES_ADDRESS) for w in ("Calle", "Avenida", "Avda.", "Av.", "Plaza", "Pza.", "Paseo", "P.º", "Camino", "Carretera", "Ctra.", "Ronda", "Travesía", "Glorieta", "Gran Vía", "Rambla", "Callejón", "C/")),
)
_STREETS = ahocorasick.Automaton()
for _w, _form in _CUES:
    _STREETS.add_word(_w, (_w[-1:] == " ", _form))
_STREETS.make_automaton()


def _emails(t: str) -> Iterator[tuple[int, int]]:
    if not any(x in t for x in AT_SIGNS):
        return
    for m in EMAIL.finditer(t):
        a, b = m.span()
        v = m.group()
        local = re.split(r"\s?[@＠\[({]|\s(?:at|AT)\s", v, maxsplit=1)[0]
        if not DOMAIN_END.search(v) or local.casefold() in ("git", "hg", "svn"):
            continue
        # a login of a URL: from the last slashes on there is neither slash nor space
        head = t.rfind("://", 0, a)
        if head >= 0 and not re.search(r"[\s/]", t[head + 3 : a]):
            continue
        if re.match(r":[^\s:]|/", t[b : b + 2]):
            continue
        yield a, b


def _numbers(t: str) -> Iterator[tuple[int, int, str]]:
    seen = 0
    for run in DIGITS.finditer(t):
        lo, hi = run.span()
        n = sum(map(str.isdigit, run.group()))
        if n < 5 or lo < seen:
            continue
        seen = hi
        for m in ID_FORMS.finditer(t, max(0, lo - 6), min(len(t), hi + 4)):
            yield m.start(), m.end(), "id_number"
        if n > 7:
            for s in SPAN.finditer(t, max(0, lo - 2), min(len(t), hi + 4)):
                yield from _in_span(t, *s.span())


def _in_span(t: str, a: int, b: int) -> Iterator[tuple[int, int, str]]:
    for m in BARE.finditer(t, a, b):
        before = t[max(0, m.start() - 28) : m.start()]
        if ID_LABEL.search(before):
            yield m.start(), m.end(), "id_number"
        elif PHONE_CUE.search(before) or (ROW_CUE.search(before) and re.match(r"\s*(?:$|\n|[A-Z#>-]|\|)", t[m.end() : m.end() + 3])):
            yield m.start(), m.end(), "phone"
    at = a
    while at < b:
        if m := SSN.match(t, at, b):
            yield at, m.end(), "id_number"
            at = m.end()
            continue
        hit = None
        if (t[at].isdigit() or t[at] in "+(") and (at == a or not (t[at - 1].isdigit() or (t[at - 1] in ".-/+" and t[at] != "("))):
            if m := DATE_LIKE.match(t, at, b):
                at = m.end()
                continue
            for form in PHONE_FORMS:
                if (m := form.match(t, at, b)) and (hit is None or m.end() > hit.end()) and sum(c.isdigit() for c in m.group()) <= 15:
                    hit = m
        if hit:
            e = hit.end()
            while not t[e - 1].isdigit():
                e -= 1
            yield at, e, "phone"
            at = e
        else:
            at += 1


def _addresses(t: str) -> Iterator[tuple[int, int]]:
    forms = set()
    for last, (leads, form) in _STREETS.iter(t):
        if form not in forms:
            after = t[last + 1 : last + 3]
            if form is EN_ADDRESS:
                ok = not (after[:1].isalnum() or after[:1] == "_")
            elif form is DE_ADDRESS and not leads:
                ok = after[:1].isdigit() or (after[:1].isspace() and after[1:].isdigit())
            else:
                ok = True
            if ok:
                forms.add(form)
    for form in forms:
        for m in form.finditer(t):
            yield m.span()
    if "号" in t:
        for m in ZH_ADDRESS.finditer(t):
            a, b = m.span()
            street = re.match(rf"[{HAN}]+", m.group()).group()
            if lead := ZH_LEAD.match(street[:-2]):
                a += lead.end()
            yield a, b


def mentions(t: str, tagger: tagging.Tagger) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all mentions, without overlaps, by position."""
    found = [(a, b, "email") for a, b in _emails(t)]
    found += _numbers(t)
    found += [(a, b, "address") for a, b in _addresses(t)]
    found += [(a, b, "name") for a, b in tagger.names(t)]
    found = sorted({x for x in found if x[1] > x[0]}, key=lambda x: (x[0] - x[1], x[0], x[2] != "id_number", x[2]))
    kept: list[tuple[int, int, str]] = []
    for x in found:
        k = bisect_left(kept, x)
        if (k and kept[k - 1][1] > x[0]) or (k < len(kept) and kept[k][0] < x[1]):
            continue
        kept.insert(k, x)
    return kept


def _lexicon(names: DataFrame) -> list[tuple[str, str, str]]:
    rows = names.where(F.col("name").isNotNull() & (F.length(F.trim("name")) > 0)).select("name", "name_part", "script").distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} names")
    return sorted((r[0].strip(), r[1] or "", r[2] or "") for r in rows)


def fit(documents: DataFrame, names: DataFrame) -> Broadcast[tagging.Tagger]:
    """The name tagger, fitted on all texts."""
    lexicon = _lexicon(names)
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")
    surnames = frozenset(tagging.ZH_FAMILY) | {w for w, p, s in lexicon if s == "zh" and p == "family"}
    given = frozenset(w for w, p, s in lexicon if s == "zh" and p == "given")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: Counter[str] = Counter()
            records: set[tagging.Record] = set()
            for t in batch["text"]:
                words.update(tagging.common_words(EMAIL.sub(" ", t) if any(x in t for x in AT_SIGNS) else t))
                if found := list(tagging.latin_candidates(t)):
                    streets = list(_addresses(t))
                    records.update(r for a, b, r in found if not any(a < d and c < b for c, d in streets))
                if not t.isascii():
                    records.update(r for *_, r in tagging.han_candidates(t, surnames, None, given=given))
            rows = [(TEXTS, [], len(batch)), *((WORDS, [w], n) for w, n in words.items()), *((RECORDS, list(r), 1) for r in records)]
            yield pd.DataFrame(rows, columns=["what", "r", "n"])

    counted = cut(spread(texts).mapInPandas(extract, "what int, r array<string>, n long").groupBy("what", "r").agg(F.sum("n").alias("n")))
    n = counted.where(F.col("what") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counted.where((F.col("what") == WORDS) & (F.col("n") >= tagging.least_texts(n))).select(F.col("r")[0], "n").collect()
    tagger = tagging.train(lexicon, Spread(counted.where(F.col("what") == RECORDS).select("r")), [tuple(w) for w in words], n)
    return documents.sparkSession.sparkContext.broadcast(tagger)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def find(documents: DataFrame, names: DataFrame, tagger: Broadcast[tagging.Tagger] | None = None) -> DataFrame:
    """doc_id, kind, value: each distinct value of each text."""
    shared = tagger or fit(documents, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, v) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for k, v in sorted({(k, t[a:b]) for a, b, k in mentions(t, shared.value)})]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value"])

    return spread(_texts(documents).where("text IS NOT NULL")).mapInPandas(run, MENTIONS)


def redacted(documents: DataFrame, names: DataFrame, tagger: Broadcast[tagging.Tagger] | None = None) -> DataFrame:
    """doc_id, mentions, redacted, values: typed placeholders, numbered per entity of the text, and what they stand for."""
    shared = tagger or fit(documents, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                if t is None:
                    rows.append((i, 0, None, []))
                    continue
                numbers: dict[tuple[str, str], int] = {}
                of_kind: dict[str, int] = {}
                out, values, at = [], [], 0
                for a, b, k in mentions(t, shared.value):
                    e = (k, entity(k, t[a:b]))
                    if e not in numbers:
                        numbers[e] = of_kind[k] = of_kind.get(k, 0) + 1
                    out += [t[at:a], f"[{k.upper()}_{numbers[e]}]"]
                    values.append(t[a:b])
                    at = b
                rows.append((i, len(values), "".join(out) + t[at:], values))
            yield pd.DataFrame(rows, columns=["doc_id", "mentions", "redacted", "values"])

    return spread(_texts(documents)).mapInPandas(run, "doc_id long, mentions int, redacted string, values array<string>")


_PLACEHOLDER = re.compile(r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)_\d+\]")


def put_back(text: Column, values: Column) -> Column:
    """Redacted texts with their values again; the round trip that shows that nothing else changed.

    Texts that held such placeholders of their own come back only if those stand behind all mentions.
    """

    @F.pandas_udf("string")
    def back(t: pd.Series, v: pd.Series) -> pd.Series:
        def one(text: str | None, vals: list[str]) -> str | None:
            left = iter(vals)
            return None if text is None else _PLACEHOLDER.sub(lambda m: next(left, m.group()), text)

        return pd.Series([one(a, list(b)) for a, b in zip(t, v, strict=True)], dtype=object)

    return back(text, values)


def swapped_back(text: Column, replaced: Column) -> Column:
    """Rewritten texts with each surrogate, in order, turned back into its value."""

    @F.pandas_udf("string")
    def back(t: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for text, swaps in zip(t, pairs, strict=True):
            parts, at = [], 0
            for x in swaps if text is not None else ():
                a = text.index(x["surrogate"], at)
                parts += [text[at:a], x["value"]]
                at = a + len(x["surrogate"])
            out.append(None if text is None else "".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return back(text, replaced)


def replacements(documents: DataFrame, names: DataFrame, key: bytes, tagger: Broadcast[tagging.Tagger] | None = None) -> DataFrame:
    """doc_id, kind, value, surrogate of every distinct value of every text."""
    found = cut(find(documents, names, tagger))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, v, n, p, e) for k, v in zip(b["kind"], b["value"], strict=True) for n, (p, e) in enumerate(parts_of(k, v))]
            yield pd.DataFrame(rows, columns=["kind", "value", "no", "part", "entity"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [formatted(k, v, [x["surrogate"] for x in sorted(p, key=lambda x: x["no"])], key) for k, v, p in zip(b["kind"], b["value"], b["p"], strict=True)]
            yield b[["kind", "value"]].assign(surrogate=rows)

    values = found.select("kind", "value").distinct()
    parts = cut(values.mapInPandas(split, "kind string, value string, no int, part string, entity string"))
    table = surrogate_table(parts.select("part", "entity").distinct(), key)
    per_value = parts.join(table, ["part", "entity"]).groupBy("kind", "value").agg(F.collect_list(F.struct("no", "surrogate")).alias("p"))
    return found.join(per_value.mapInPandas(write, "kind string, value string, surrogate string"), ["kind", "value"]).select("doc_id", "kind", "value", "surrogate")


def with_surrogates(documents: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with every mention replaced by its surrogate, replaced: the values and surrogates in order."""
    tagger = fit(documents, names)
    pairs = replacements(documents, names, key, tagger).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, done = [], []
            for t, m in zip(b["text"], b["m"], strict=True):
                to = {(x["kind"], x["value"]): x["surrogate"] for x in m} if m is not None else {}
                parts, swaps, at = [], [], 0
                for a, e, k in mentions(t, tagger.value) if to else ():
                    parts += [t[at:a], to[k, t[a:e]]]
                    swaps.append({"value": t[a:e], "surrogate": parts[-1]})
                    at = e
                texts.append(t if t is None else "".join(parts) + t[at:])
                done.append(swaps)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "replaced": done})

    return _texts(documents).join(pairs, "doc_id", "left").mapInPandas(run, "doc_id long, text string, replaced array<struct<value:string,surrogate:string>>")

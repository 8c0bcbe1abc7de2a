"""Variant spellings of names typed by people (problem 2), by noisy-channel attribution.

A name is read as a body (authority, company or person) in some spelling. Reading undoes what carries no
identity: look-alike characters, traditional forms, spacing, courtesy titles, legal forms, tickers,
word order. Places and trades are learned as frequent beginnings and ends of company names, given
names as frequent words of Latin names, their short forms as given names that share surnames with them far more often
than by chance; what is left is the rare core. Numbered offices and funds keep
their number and are bodies of their own.

Spellings are counted over entities and relations and ranked; each is a candidate canonical form for
the less certain spellings that share one of its keys: the core, its pronunciation, its letters with
neighbours swapped, the core less one letter, its romanisation (every reading of two to six syllables). The channel gives the likelihood of a
variant given a candidate (abbreviation, homophone, swap, lost or doubled letter, initial, nickname,
romanisation with learned letters); the prior is the frequency; a rare character speaks for a
typing error and a usual one for a name of its own, by learned character frequencies; characters are taken for each other
where companies differ in them more often than chance makes. Every variant is
attached to its maximum posterior. Where the place and trade, the surname or the given name that two
spellings share leave no doubt, they are linked whichever is the more frequent. Bodies are the
components of these links.

Null and blank names, titles of documents and policies name no body. Equal names under several types are
one spelling. Repeated rows count as one entity. A name that occurs in a third of all relations is
counted by a partial aggregate. Learned tables that are too large for a lookup raise; none is cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.canonical_text import Canonicalizer, look_alikes
from newsloom.runtime import drop, materialize, pairs_within

#: Legal forms, titles and units in names.
_LEGAL = ("集团股份有限公司", "集团有限责任公司", "集团有限公司", "股份有限公司", "有限责任公司", "有限公司", "集团公司", "公司")
_SHORT_LEGAL = ("集团", "股份", "科技", "银行", "证券", "保险")
_TITLES = ("董事长", "总经理", "总裁", "主席", "行长", "董事", "监事", "经理", "博士", "教授", "先生", "女士", "小姐")
_UNIT = re.compile(r"(第?[一二三四五六七八九十百\d]+(?:号)?[^一二三四五六七八九十\d]{0,6}(?:营业部|分公司|支行|分行|办事处|基金|计划))$")
_LATIN_LEGAL = re.compile(r"[\s,]*\b(?:co|ltd|inc|plc|corp|corporation|company|limited|llc|group|holdings?|technology|technologies|ag)\b\.?", re.I)
_LATIN_TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "cfa", "phd", "mba", "jr", "sr", "cpa", "esq"}
_HAN = "㐀-鿿"
_SPACED = re.compile(rf"(?<=[{_HAN}（）()])\s+(?=[{_HAN}（）()])")
_TICKER = re.compile(rf"^[A-Z]{{2,6}}\s+(?=[{_HAN}])")
_PAREN = re.compile(rf"[(（]([{_HAN}]{{2,5}})[)）]")
SHARE = 0.25  # of the most neighbours that an end or word has: so many make a place, trade or given name
LEAST = 6  # different neighbours that it has at least
COHESION = 0.1  # of the names with either part of a place or trade so many have both: a core's characters are met in any order
SURE = 16.0  # -log of the most that chance may make as many coincidences: one in nine million
RARE = 0.4  # of the usual count: a character is unusual
TOGETHER, LIFT = 2, 4.0  # surnames that a given name and its short form share at least, and how many times more than by chance
MOST_GIVEN = 50  # in a surname of more given names chance pairs count
MOST_SYLLABLES = 6  # of a romanised core
LONGEST_PART = 8  # letters of a romanised syllable
MOST_CONFUSED = 100_000  # pairs of characters in a lookup table
MOST_SPELLED = 200_000  # spellings of characters in a lookup table
CHANCE = 0.002  # expected people of that name below which no rare character is asked for


@dataclass(frozen=True)
class Letters:
    """Bounded tables over Unicode: pronunciation and simplified form of Han characters, look-alikes."""

    sounds: dict[str, str]
    simple: dict[str, str]
    alike: dict[str, str]

    @classmethod
    def load(cls, spark: SparkSession) -> Letters:
        """From the transliterators in Spark's ICU; about 28,000 characters."""
        make = spark._jvm.com.ibm.icu.text.Transliterator.getInstance
        han = [chr(c) for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)) for c in range(a, b + 1)]
        text = "\n".join(han)
        plain = "".join(c for c in unicodedata.normalize("NFD", make("Han-Latin").transliterate(text)) if not "\u0300" <= c <= "\u036f")
        simple = make("Hant-Hans").transliterate(text).split("\n")
        return cls(
            {c: s for c, s in zip(han, plain.split("\n"), strict=True) if s.isascii() and s.isalpha()},
            {c: s for c, s in zip(han, simple, strict=True) if s != c and len(s) == 1},
            look_alikes(spark),
        )


@dataclass
class Affixes:
    places: set[str] = field(default_factory=set)
    trades: set[str] = field(default_factory=set)
    given: set[str] = field(default_factory=set)
    partners: dict[str, set[str]] = field(default_factory=dict)  # given names that people use for each other

    def forms(self, given: str) -> set[str]:
        """The name and the ones that stand for it."""
        return {given} | self.partners.get(given, set())


@dataclass(frozen=True)
class Body:
    """One reading: what the name says of its body. ``core`` identifies, the rest narrows down."""

    kind: str
    core: str
    place: str = ""
    trade: str = ""
    unit: str = ""


class Reader:
    def __init__(self, letters: Letters, authorities: dict[str, str], terms: set[str], affixes: Affixes | None = None):
        self.letters = letters
        self.canonical = Canonicalizer(letters.alike)
        self.simple = str.maketrans(letters.simple)
        self.authorities = {self.plain(k): self.plain(v) for k, v in authorities.items()}
        self.terms = {self.plain(t) for t in terms}
        self.affixes = affixes or Affixes()

    def plain(self, name: str) -> str:
        name = self.canonical(name).translate(self.simple).strip()
        if re.fullmatch(r"\S(?:\s+\S){5,}", name):  # every character stands alone
            name = re.sub(r"\s(\s*)", lambda m: " " if m[1] else "", name)
        return _SPACED.sub("", re.sub(r"\s+", " ", name))

    def stem(self, name: str) -> tuple[str, str, str]:
        """(name without legal form, place in brackets, unit) of a company in Han characters."""
        name = _TICKER.sub("", name)
        unit = ""
        if found := _UNIT.search(name):
            name, unit = name[: found.start()], found[0]
        place = ""
        if found := _PAREN.search(name):
            name, place = name[: found.start()] + name[found.end() :], found[1]
        for form in _LEGAL:
            if name.endswith(form) and len(name) > len(form) + 1:
                return name[: -len(form)].removesuffix("集团"), place, unit
        return name, place, unit

    @staticmethod
    def is_title(name: str) -> bool:
        return bool(re.search(r"[，。：；！？《》【】…]|第\d+号|关于", name))

    def words(self, name: str) -> list[str]:
        plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
        return [w for w in re.findall(r"[A-Za-z'-]+\.?|,", plain) if w.rstrip(".").lower() not in _LATIN_TITLES]

    def read(self, name: str | None) -> Body | None:
        if not name or not (plain := self.plain(name)):
            return None
        if plain in self.authorities:
            return Body("authority", self.authorities[plain])
        if plain in self.terms or self.is_title(plain):
            return None
        if not re.search(f"[{_HAN}]", plain):
            return self._latin(plain)
        person = re.sub(r"[\s·•・.]", "", plain)
        for _ in range(2):
            for title in _TITLES:
                if len(person) >= len(title) + 2:
                    person = person.removeprefix(title).removesuffix(title) if len(person) - len(title) <= 4 else person
        if re.fullmatch(f"[{_HAN}]{{2,3}}", person):
            return Body("person", person)
        if found := re.fullmatch(rf"([A-Za-z]+(?: [A-Za-z]+)?) ?([{_HAN}]{{1,2}})", plain):
            return Body("person", "~" + found[2] + "|" + found[1].replace(" ", "").lower())
        return self._company(plain)

    def _company(self, plain: str) -> Body | None:
        stem, place, unit = self.stem(plain)
        stem = stem.replace(" ", "")
        trade = ""
        for size in range(min(6, len(stem) - 2), 1, -1):
            if not place and size <= 4 and stem[:size] in self.affixes.places and stem[:size] not in self.affixes.trades:
                place, stem = stem[:size], stem[size:]
                break
        for size in range(min(6, len(stem) - 2), 1, -1):
            if stem[-size:] in self.affixes.trades:
                trade, stem = stem[-size:], stem[:-size]
                break
            if stem[:size] in self.affixes.trades:
                trade, stem = stem[:size], stem[size:]
                break
        if not trade:
            for form in _SHORT_LEGAL:
                if stem.endswith(form) and len(stem) >= len(form) + 2:
                    stem = stem.removesuffix(form)
                    break
        return Body("company", stem, place, trade, unit) if stem else None

    def _latin(self, plain: str) -> Body | None:
        if re.search(r"\d", plain):
            return None
        if _LATIN_LEGAL.search(plain):
            core = re.sub(r"[^a-z]", "", _LATIN_LEGAL.sub("", plain).lower())
            return Body("company", "~" + core) if core else None
        words = self.words(plain)
        while words and words[-1] == ",":
            words.pop()
        comma = words.index(",") if "," in words else 0
        names = [w.rstrip(".").lower() for w in words if w != ","]
        if not 2 <= len(names) <= 4 or comma >= len(names):
            return None
        if comma:
            last, given = "".join(names[:comma]), names[comma:]
        else:
            full = [n for n in names if len(n) > 1]
            known = [n in self.affixes.given or n in self.affixes.partners for n in full]
            last = full[0] if len(full) > 1 and known[-1] and not known[0] else (full or names)[-1]
            given = list(names)
            given.remove(last)
        full = [n for n in given if len(n) > 1]
        return Body("latin", last, (full or given)[0])

    def romanised(self, letters: str) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        """All readings of a romanised word of two to six syllables: (syllables, their spelling with a distinguishing letter)."""
        if len(letters) > MOST_SYLLABLES * LONGEST_PART:
            return []
        syllables = _syllables(self.letters)
        parts: dict[int, list[tuple[int, str, str]]] = {}
        need = {len(letters): 0}  # from where the word can be read to its end, with so many syllables at least
        for start in range(len(letters) - 1, -1, -1):
            for stop in range(start + 1, min(start + LONGEST_PART, len(letters)) + 1):
                part = letters[start:stop]
                if stop in need and (sounds := {part, part[:-1] if part[-1] in "heu" else part} & syllables):
                    parts.setdefault(start, []).extend((stop, sound, part) for sound in sorted(sounds))
                    need[start] = min(need.get(start, MOST_SYLLABLES + 1), need[stop] + 1)
        done: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
        open_: list[tuple[int, tuple[str, ...], tuple[str, ...]]] = [(0, (), ())]
        while open_:
            start, said, spelled = open_.pop()
            if start == len(letters):
                done.append((said, spelled))
            elif len(said) + need.get(start, MOST_SYLLABLES + 1) <= MOST_SYLLABLES:
                open_ += [(stop, (*said, sound), (*spelled, part)) for stop, sound, part in parts[start]]
        return sorted((x for x in done if len(x[0]) >= 2), key=lambda x: (len(x[0]), x))


_known_syllables: dict[int, frozenset[str]] = {}


def _syllables(letters: Letters) -> frozenset[str]:
    key = id(letters)
    if key not in _known_syllables:
        _known_syllables[key] = frozenset(letters.sounds.values())
    return _known_syllables[key]


def beyond_chance(n: int, expected: float) -> bool:
    """Are ``n`` coincidences more than chance makes where it makes ``expected`` on average? (Chernoff's bound.)"""
    return n > expected and (expected == 0 or n * math.log(n / expected) - (n - expected) >= SURE)


def learn_affixes(counts: dict[tuple[str, str], int], most: dict[str, int]) -> Affixes:
    """Places, trades and given names: beginnings (P), ends (S) and words (W) by the number of different neighbours.

    Inside a place or trade few characters come next, at its edge many do: the shortest beginning or
    end with many neighbours is taken, and none that holds it. ``most`` are the most neighbours of a side.
    """

    def edges(side: str, longest: int) -> set[str]:
        own = {a: n for (s, a), n in counts.items() if s == side and a not in _SHORT_LEGAL}
        least = max(LEAST, SHARE * most.get(side, 0))
        found: set[str] = set()
        for affix in sorted(own, key=len):
            inner = (affix[:k] if side == "P" else affix[-k:] for k in range(2, len(affix)))
            if own[affix] >= least and len(affix) <= longest and not found.intersection(inner):
                found.add(affix)
        return found

    out = Affixes(trades=edges("S", 6))
    out.places = {p for p in edges("P", 4) if not any(t.startswith(p) for t in out.trades)}
    out.given = {w for (s, w), n in counts.items() if s == "W" and n >= max(LEAST, SHARE * most.get("W", 0))}
    return out


def learn_partners(pairs: list[tuple[str, str, int]], surnames: dict[str, int], total: int, everywhere: Iterable[tuple[str, str, int]] = (), crowd: float = 0.0) -> dict[str, set[str]]:
    """Given names (a, b, surnames that have both) that share surnames far more often than by chance: short forms and their names.

    ``everywhere`` counts crowded surnames, too. In those any two given names meet by chance, ``crowd`` times
    for each surname of the one and of the other.
    """
    out: dict[str, set[str]] = defaultdict(set)
    for a, b, n in pairs:
        if n >= TOGETHER and n * total >= LIFT * surnames[a] * surnames[b]:
            out[a].add(b)
            out[b].add(a)
    for a, b, n in everywhere:
        if n >= TOGETHER and n * total >= LIFT * surnames[a] * surnames[b] and beyond_chance(n, surnames[a] * surnames[b] * (crowd + 1 / total)):
            out[a].add(b)
            out[b].add(a)
    return dict(out)


class Channel:
    """Log likelihoods of a spelling given a candidate canonical form."""

    def __init__(self, letters: Letters, characters: dict[str, int], people: int, spelled: dict[tuple[str, str], int], confused: set[tuple[str, str]], reader: Reader):
        self.letters, self.reader, self.confused = letters, reader, confused
        self.classes: dict[str, str] = {}
        for pair in sorted(confused):  # readings of one character that the table of sounds doesn't have
            a, b = (self._class(letters.sounds.get(x, x)) for x in pair)
            self.classes[max(a, b)] = min(a, b)
        self.characters, self.people, self.spelled = characters, people, spelled
        total, half = sum(characters.values()), 0
        self.total = max(total, 1)
        self.usual = 1
        for n in sorted(characters.values(), reverse=True):
            half += n
            self.usual = n
            if 2 * half >= total:
                break
        self.sound_total = Counter()
        for (char, _), n in spelled.items():
            self.sound_total[char] += n

    def _class(self, sound: str) -> str:
        while (up := self.classes.get(sound, sound)) != sound:
            sound = up
        return sound

    def sounds(self, text: str) -> tuple[str, ...]:
        return tuple(self._class(self.letters.sounds.get(c, c)) for c in text)

    def sound(self, text: str) -> str:
        return " ".join(self.sounds(text))

    def readings(self, letters: str) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
        return [(tuple(map(self._class, s)), parts) for s, parts in self.reader.romanised(letters)]

    def alike(self, a: str, b: str) -> bool:
        """Do people take the one character for the other?"""
        return self.letters.sounds.get(a) == self.letters.sounds.get(b, "") or (min(a, b), max(a, b)) in self.confused

    def unusual(self, char: str) -> bool:
        return self.characters.get(char, 0) <= RARE * self.usual

    def keys(self, body: Body) -> set[str]:
        """Blocking keys: two spellings are compared if they share one."""
        core, unit = body.core, body.unit
        if body.kind == "authority":
            return set()
        if body.kind == "latin":
            return {f"L|{core}"} | {f"D|{core[:i]}{core[i + 1 :]}" for i in range(len(core))} | {f"D|{core}"}
        if core.startswith("~"):
            if body.kind == "person":
                surname, letters = core[1:].split("|")
                return {f"R|{surname} {' '.join(s)}" for s, _ in self.readings(letters) if len(s) <= 3}
            return {f"R|{' '.join(s)}|{unit}" for s, _ in self.readings(core[1:])}
        if body.kind == "person":
            return {f"R|{core[0]} {self.sound(core[1:])}"}
        out = {f"C|{core}|{unit}", f"R|{self.sound(core)}|{unit}", f"S|{''.join(sorted(core))}|{unit}"}
        if len(core) > 2:
            out |= {f"D|{core[:i]}{core[i + 1 :]}|{unit}" for i in range(len(core))} | {f"D|{core}|{unit}"}
        return out

    def rank(self, body: Body, frequency: float) -> float:
        """How certain a spelling is as a canonical form: its frequency and its characters."""
        if body.kind == "latin":
            informed = 0 if len(body.place) == 1 else 2 if body.place in self.reader.affixes.given else 1
            return informed * 100 + math.log1p(frequency)
        if body.core.startswith("~"):
            return -1000 + math.log1p(frequency)
        rare = sum(min(0.0, math.log((self.characters.get(c, 0) + 0.5) / self.usual)) for c in body.core)
        informed = bool(body.place) + bool(body.trade)
        return informed * 100 + math.log1p(frequency) + 3 * rare

    def likelihood(self, v: Body, c: Body) -> float | None:
        """Of variant ``v`` given ``c``, with the evidence of what they share; None if impossible."""
        if v.kind != c.kind or v.unit != c.unit:
            return None
        if v.kind == "latin":
            first = self._given(v.place, c.place)
            if first is None:
                return None
            if v.core == c.core:
                return first
            whole = len(v.place) > 1 and len(c.place) > 1
            return first - 4 if whole and min(len(v.core), len(c.core)) > 4 and near(v.core, c.core) else None
        if v.core.startswith("~"):
            return None if c.core.startswith("~") else self._romanised(v, c)
        if c.core.startswith("~"):
            return None
        shared = 0.0
        for a, b in ((v.place, c.place), (v.trade, c.trade)):
            if a and b and a != b:
                return None
            shared += 3 if a and b else -0.5
        if v.core == c.core:
            return shared
        return self._person(v.core, c.core) if v.kind == "person" else self._typed(v.core, c.core, shared)

    @staticmethod
    def sure(v: Body, c: Body) -> bool:
        """Does what the spellings share decide, whichever is the more frequent?"""
        if v.core == c.core or v.core.startswith("~") or c.core.startswith("~"):
            return False
        return v.kind != "company" or (v.trade == c.trade != "" and v.place == c.place)

    def _typed(self, v: str, c: str, shared: float) -> float | None:
        if len(v) == len(c):
            off = [i for i in range(len(v)) if v[i] != c[i]]
            if len(off) == 2 and off[1] == off[0] + 1 and v[off[0]] == c[off[1]] and v[off[1]] == c[off[0]]:
                return shared - 5 if len(v) >= 3 else None
            if all(self.alike(v[i], c[i]) for i in off) and len(v) - len(off) >= 2:
                return shared - 4 * len(off)
            rare = len(off) == 1 and len(v) >= 4 and shared > 2 and (self.unusual(v[off[0]]) or self.unusual(c[off[0]]))
            return shared - 6 if rare else None
        long, short = (v, c) if len(v) > len(c) else (c, v)
        if len(long) == len(short) + 1 and len(short) >= 3 and any(long[:i] + long[i + 1 :] == short for i in range(len(long))):
            return shared - 6
        return None

    def _person(self, v: str, c: str) -> float | None:
        off = [i for i in range(min(len(v), len(c))) if v[i] != c[i]]
        if len(v) != len(c) or not off or off[0] == 0 or len(off) > 1 or not self.alike(v[off[0]], c[off[0]]):
            return None
        p = {x: (self.characters.get(x, 0) + 0.5) / self.total for x in v + c}
        alone = self.people * self.usual / self.total / 15
        for i in range(1, len(v)):
            alone *= self.usual / self.total if i == off[0] else p[v[i]]
        if alone * 15 * self.total / self.usual > CHANCE and not self.unusual(v[off[0]]) and not self.unusual(c[off[0]]):
            return None
        return -3.0

    def _given(self, a: str, b: str) -> float | None:
        if a == b:
            return 0.0
        forms = self.reader.affixes.forms
        if len(a) == 1 or len(b) == 1:
            one, other = (a, b) if len(a) == 1 else (b, a)
            return -1.0 if any(f[0] == one for f in forms(other)) else None
        if forms(a) & forms(b):
            return -1.0
        if a.replace("ue", "u").replace("oe", "o").replace("ae", "a") == b.replace("ue", "u").replace("oe", "o").replace("ae", "a"):
            return -0.5
        return -2.0 if a.startswith(b) or b.startswith(a) else -5.0 if near(a, b) and min(len(a), len(b)) > 3 else None

    def _romanised(self, v: Body, c: Body) -> float | None:
        surname, letters = v.core[1:].split("|") if v.kind == "person" else ("", v.core[1:])
        if not c.core.startswith(surname):
            return None
        target = c.core[len(surname) :]
        sounds = self.sounds(target)
        best = None
        for syllables, parts in self.readings(letters):
            if syllables == sounds:
                score = sum(math.log((self.spelled.get((char, part), 0) + 0.2) / (self.sound_total[char] + 1)) for char, part in zip(target, parts, strict=True))
                best = score if best is None else max(best, score)
        return best


def near(a: str, b: str) -> bool:
    """One letter lost, added, changed or swapped with its neighbour."""
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        return len(off) == 1 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _mapped(rows: DataFrame, columns: list[str], schema: str, each: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Rows of ``columns`` through a function made once per task that gives any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = each()
        for batch in batches:
            out = [row for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in function(*values)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.sparkSession.createDataFrame([], schema).schema
    arrow, names = to_arrow_schema(kind), kind.names
    return rows.select(*columns).mapInArrow(run, schema)


def _whole_affixes(pieces: DataFrame) -> DataFrame:
    """``pieces`` (side, affix, count, n) without the beginnings and ends that fall apart.

    With enough names any two characters of cores have as many neighbours as a place, and any last character of a core with
    a short legal form as many as a trade. Their parts are met as often with others, however many names there are.
    """
    first = F.col("side") == "P"
    parts = pieces.where("side <> 'W'").withColumns({
        "rest": F.when(first, F.expr("substring(affix, 1, length(affix) - 1)")).otherwise(F.expr("substring(affix, 2)")),
        "last": F.when(first, F.expr("right(affix, 1)")).otherwise(F.expr("left(affix, 1)")),
        "size": F.length("affix"),
    })
    single = parts.where("size = 2").groupBy("side", "rest").agg(F.sum("n").alias("n_rest"))
    rests = single.unionByName(pieces.where("side <> 'W'").select("side", F.col("affix").alias("rest"), F.col("n").alias("n_rest")))
    lasts = parts.groupBy("side", "size", "last").agg(F.sum("n").alias("n_last"))
    whole = parts.join(rests, ["side", "rest"]).join(lasts, ["side", "size", "last"]).where(F.col("n") >= COHESION * F.greatest("n_rest", "n_last"))
    return whole.select(*pieces.columns).unionByName(pieces.where("side = 'W'"))


def _lookup(rows: DataFrame, most: int, what: str) -> list[Row]:
    """All ``rows`` of a lookup table; more than ``most`` raise."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"too many {what} for a lookup table")
    return found


def _partners(read: DataFrame) -> dict[str, set[str]]:
    """Learned from the given names that full names of one surname have.

    A given name of one surname only shares no two, so it pairs with nothing; all others of a surname are paired, in blocks.
    Surnames of very many given names count by what they show beyond chance.
    """
    full = materialize(read.where("kind = 'latin' and length(place) > 1").select(F.col("core").alias("surname"), F.col("place").alias("given")).distinct(), "given-names")
    sizes = materialize(full.groupBy("surname").agg(F.count("*").alias("size")), "surname-sizes")
    total, all_, squares = sizes.agg(F.count("*"), F.sum("size"), F.sum(F.when(F.col("size") > MOST_GIVEN, F.col("size").cast("double") * (F.col("size") - 1)).otherwise(0.0))).first()
    if not total:
        return {}
    seen = materialize(full.groupBy("given").agg(F.count("*").alias("seen")).where(F.col("seen") >= TOGETHER), "given-seen")
    held = materialize(full.join(seen, "given", "left_semi").join(sizes.where("size > 1"), "surname").withColumn("few", (F.col("size") <= MOST_GIVEN).cast("int")), "given-held")
    pairs = pairs_within(held, ["surname", "few"], ["given"], F.lit(True)).select(F.least("a_given", "b_given").alias("a"), F.greatest("a_given", "b_given").alias("b"), "few")
    pairs = pairs.groupBy("a", "b").agg(F.sum("few").alias("few"), F.count("*").alias("n")).where(F.col("n") >= TOGETHER)
    for side in ("a", "b"):
        pairs = pairs.join(seen.select(F.col("given").alias(side), F.col("seen").alias(f"{side}_seen")), side)
    # the others fail in learn_partners, too
    found = pairs.where(F.col("n") * total >= LIFT * F.col("a_seen") * F.col("b_seen")).collect()
    surnames = {name: seen for r in found for name, seen in ((r.a, r.a_seen), (r.b, r.b_seen))}
    everywhere = [(r.a, r.b, r.n) for r in found if r.n > r.few]
    return learn_partners([(r.a, r.b, r.few) for r in found], surnames, total, everywhere, squares / all_**2)


BODY = ["kind", "core", "place", "trade", "unit"]


def name_bodies(entities: DataFrame, relations: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``entity_id, body bigint``: the body that each entity names; entities that name none are left out."""
    spark = entities.sparkSession
    terms = lexicon.where("term is not null and kind in ('institution', 'alias', 'industry', 'event')").select("term", "kind", "canonical").limit(50_001).collect()
    if len(terms) > 50_000:
        raise ValueError("the lexicon has too many rows for a lookup table")
    authorities = {r.term: r.canonical or r.term for r in terms if r.kind in ("institution", "alias")}
    others = {r.term for r in terms if r.kind in ("industry", "event")}
    letters = spark.sparkContext.broadcast(Letters.load(spark))

    counts = relations.select(F.explode(F.array("source", "target")).alias("name")).where("name is not null").groupBy("name").count()
    named = entities.where("entity_id is not null and name is not null").select("entity_id", "name").distinct()
    spellings = materialize(named.select("name").distinct().join(counts, "name", "left").select("name", (F.coalesce("count", F.lit(0)) + 1).alias("n")), "spellings")

    def affixes_of() -> Callable[..., list[tuple]]:
        reader = Reader(letters.value, authorities, others)

        def of(name: str) -> list[tuple]:
            plain = reader.plain(name)
            if not plain or plain in reader.authorities or plain in reader.terms or reader.is_title(plain):
                return []
            if not re.search(f"[{_HAN}]", plain):
                words = [w.lower() for w in reader.words(plain) if len(w) > 2 and not w.endswith(".")]
                return [] if _LATIN_LEGAL.search(plain) or len(words) != 2 else [("W", words[0], words[1]), ("W", words[1], words[0])]
            stem = reader.stem(plain)[0].replace(" ", "")
            if len(stem) < 6 or not re.fullmatch(f"[{_HAN}]+", stem):
                return []
            ends = [("S", stem[-k:], stem[-k - 1]) for k in range(2, min(7, len(stem) - 1))]
            return [("P", stem[:k], stem[k]) for k in range(2, 5)] + ends

        return of

    pieces = materialize(_mapped(spellings, ["name"], "side string, affix string, beside string", affixes_of).groupBy("side", "affix", "beside").agg(F.count("*").alias("n")).groupBy("side", "affix").agg(F.count("*").alias("count"), F.sum("n").alias("n")), "affixes")
    # ends have at most as many neighbours as there are characters; the words are cut at a share of the largest
    most = pieces.groupBy("side").agg(F.max("count").alias("most"), F.max(F.when(~F.col("affix").isin(*_SHORT_LEGAL), F.col("count"))).alias("most_own"))
    largest = {r.side: r.most_own or 0 for r in most.collect()}
    many = pieces.join(F.broadcast(most), "side").where((F.col("count") >= LEAST) & (F.col("count") >= SHARE * F.col("most"))).select("side", "affix")
    frequent = _whole_affixes(pieces).join(many, ["side", "affix"], "left_semi").limit(100_001).collect()
    if len(frequent) > 100_000:
        raise ValueError("too many frequent ends of names for a lookup table")
    affixes = learn_affixes({(r.side, r.affix): r["count"] for r in frequent}, largest)

    def bodies_of() -> Callable[..., list[tuple]]:
        reader = Reader(letters.value, authorities, others, affixes)

        def of(name: str, n: int) -> list[tuple]:
            body = reader.read(name)
            return [] if body is None else [(name, n, body.kind, body.core, body.place, body.trade, body.unit)]

        return of

    affixes.partners = _partners(_mapped(spellings.where(~F.col("name").rlike(f"[{_HAN}]")), ["name", "n"], "name string, n bigint, kind string, core string, place string, trade string, unit string", bodies_of))

    read = materialize(_mapped(spellings, ["name", "n"], "name string, n bigint, kind string, core string, place string, trade string, unit string", bodies_of).withColumn("node", F.xxhash64(*BODY)), "read")
    nodes = materialize(read.groupBy("node", *BODY).agg(F.sum("n").alias("n"), F.count("*").alias("names")), "nodes")

    # at most one row a Han character
    used = nodes.where("kind in ('person', 'company') and core not like '~%'").select("kind", F.explode(F.split(F.when(F.col("kind") == "person", F.expr("substring(core, 2)")).otherwise(F.col("core")), "")).alias("char")).where("char <> ''").groupBy("kind", "char").count()
    by_kind: dict[str, dict[str, int]] = {"person": {}, "company": {}}
    for r in used.where(F.col("char").rlike(f"^[{_HAN}]$")).collect():
        by_kind[r.kind][r.char] = r["count"]
    people = nodes.where("kind = 'person'").count()

    # characters that stand for each other in companies of the same place, trade and other letters
    typed = nodes.where("kind = 'company' and trade <> '' and length(core) >= 4 and core not like '~%'").select("place", "trade", "unit", "core").distinct()
    spots = typed.withColumn("i", F.explode(F.expr("sequence(1, length(core))"))).select("place", "trade", "unit", F.expr("concat(substring(core, 1, i - 1), '_', substring(core, i + 1))").alias("rest"), F.expr("substring(core, i, 1)").alias("a")).distinct()
    twins = spots.join(spots.withColumnRenamed("a", "b"), ["place", "trade", "unit", "rest"]).where("a < b").groupBy("a", "b").count().where("count > 1")
    # of so many companies some differ in one character by chance: (cores a cell)^2 * places * (chance that two characters agree)^(places - 1)
    total = max(1, sum(by_kind["company"].values()))
    agree = sum((n / total) ** 2 for n in by_kind["company"].values())
    cells = typed.groupBy("place", "trade", "unit", F.length("core").alias("size")).count().groupBy("size").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("squares"))
    coincide = sum(r.squares * r["size"] * agree ** (r["size"] - 1) for r in cells.collect())
    share = {c: n / total for c, n in by_kind["company"].items()}
    confused = {(r.a, r.b) for r in _lookup(twins, MOST_CONFUSED, "confused characters") if beyond_chance(r["count"], coincide * share.get(r.a, 0) * share.get(r.b, 0))}

    def channels(spelled: dict[tuple[str, str], int]) -> dict[str, Channel]:
        reader = Reader(letters.value, authorities, others, affixes)
        return {kind: Channel(letters.value, by_kind["company" if kind == "company" else "person"], people, spelled, confused, reader) for kind in ("person", "company", "latin", "authority")}

    def keys_of() -> Callable[..., list[tuple]]:
        known = channels({})

        def of(node: int, n: int, *body: str) -> list[tuple]:
            b = Body(*body)
            rank = known[b.kind].rank(b, n)
            return [(f"{b.kind}|{key}", node, n, rank, *body) for key in known[b.kind].keys(b)]

        return of

    keyed = materialize(_mapped(nodes, ["node", "n", *BODY], "key string, node bigint, n bigint, rank double, kind string, core string, place string, trade string, unit string", keys_of), "keys")
    # keys of one spelling only pair nothing
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    shared = materialize(keyed.join(several, "key", "left_semi").distinct(), "shared-keys")
    columns = ["node", "n", "rank", *BODY]
    # the less certain spelling of a pair is the variant
    later = F.struct("b_rank", "b_node") > F.struct("a_rank", "a_node")
    met = pairs_within(shared, ["key"], columns, F.lit(True)).select(
        *(F.when(later, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns), *(F.when(later, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"{c}_c") for c in columns)
    )
    pairs = materialize(met.select("node", "n", *BODY, "node_c", "n_c", *(f"{c}_c" for c in BODY)).distinct(), "pairs")
    drop(keyed, shared)

    def letters_of() -> Callable[..., list[tuple]]:
        channel = channels({})["company"]

        def of(core: str, core_c: str) -> list[tuple]:
            sounds = channel.sounds(core_c)
            fits = [parts for syllables, parts in channel.readings(core[1:]) if syllables == sounds]
            return list(zip(core_c, fits[0], strict=True)) if len(fits) == 1 else []

        return of

    roman = pairs.where("kind = 'company' and core like '~%' and core_c not like '~%'").groupBy("core").agg(F.min("core_c").alias("core_c"), F.max("core_c").alias("other")).where("core_c = other")
    parts = _mapped(roman, ["core", "core_c"], "char string, part string", letters_of).groupBy("char", "part").count()
    spelled = {(r.char, r.part): r["count"] for r in _lookup(parts, MOST_SPELLED, "spellings of characters")}

    def scores_of() -> Callable[..., list[tuple]]:
        known = channels(spelled)

        def of(node: int, n: int, kind: str, core: str, place: str, trade: str, unit: str, node_c: int, n_c: int, *body_c: str) -> list[tuple]:
            v, c = Body(kind, core, place, trade, unit), Body(*body_c)
            likelihood = known[kind].likelihood(v, c)
            return [] if likelihood is None else [(node, node_c, likelihood + math.log1p(n_c), known[kind].sure(v, c))]

        return of

    scored = materialize(_mapped(pairs, ["node", "n", *BODY, "node_c", "n_c", *(f"{c}_c" for c in BODY)], "node bigint, parent bigint, score double, sure boolean", scores_of), "scored")
    best = scored.groupBy("node").agg(F.max(F.struct("score", "parent")).alias("best")).select("node", "best.parent")
    roots = components(nodes.select("node"), best.union(scored.where("sure").select("node", "parent")).distinct())
    return named.join(read.select("name", "node"), "name").join(roots, "node").select("entity_id", F.col("root").alias("body"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component.

    Every turn takes the smallest root among neighbours and then jumps to that root's root, so that
    long chains shrink by a power; each turn is a written table.
    """
    ends = edges.toDF("node", "other")
    ends = materialize(ends.union(ends.select("other", "node")).distinct(), "ends")
    current = materialize(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        near = ends.join(current.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("least"))
        lowered = current.join(near, "node", "left").select("node", F.least("root", F.coalesce("least", "root")).alias("next"), "root")
        up = lowered.select(F.col("node").alias("next"), F.col("next").alias("above"))
        jumped = materialize(lowered.join(up, "next").select("node", F.col("above").alias("next"), (F.col("above") != F.col("root")).alias("moved")), "roots")
        current = jumped.select("node", F.col("next").alias("root"))
        if not jumped.where("moved").limit(1).count():
            return current


def found_variants(entities: DataFrame, relations: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``entity_a, entity_b``: all pairs of entities that name the same body; a body's entities meet in blocks of bounded size."""
    bodies = materialize(name_bodies(entities, relations, lexicon).distinct(), "bodies")
    pairs = pairs_within(bodies, ["body"], ["entity_id"], F.lit(True))
    return pairs.select(F.least("a_entity_id", "b_entity_id").alias("entity_a"), F.greatest("a_entity_id", "b_entity_id").alias("entity_b")).distinct()


def bodies_of(entities: DataFrame, relations: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``entity_id, body_id, links``: a row an entity that names a body; the smallest entity of the body, and how many others name it."""
    bodies = materialize(name_bodies(entities, relations, lexicon).distinct(), "bodies")
    sizes = bodies.groupBy("body").agg(F.min("entity_id").alias("body_id"), (F.count("*") - 1).alias("links"))
    return bodies.join(sizes, "body").select("entity_id", "body_id", "links")

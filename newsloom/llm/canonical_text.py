"""One form for texts that look the same (problem 6).

A quick-check class holds every character that the canonical form changes (NFC quick check No, or a
mapping below) or that may join with characters before it (quick check Maybe, or a combining class other
than 0). Text outside it is stable and is copied as it is. An unstable segment, a
run of such characters with the one before it as boundary context, is mapped and composed alone
and spliced back. Mapping: characters without a shape of their own (zero-width, soft hyphen, bidi
marks, variation selectors) vanish, wide and narrow forms, compatibility ideographs, radicals and
ligatures become plain, every one-character space becomes U+0020, before and after the text is taken
apart; then NFC. Superscripts, circled
and squared characters look different and stay. Look-alike letters of other scripts become Latin
where the whole word then reads as ASCII letters with accents; the table comes from the Unicode
confusables shipped with Spark's ICU, case kept.

Letter case, wording and the number of visible spaces are kept. Null stays null; an empty text
stays empty. A zero-width joiner between pictographs stays. Texts of any length are scanned once.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.runtime import drop, expand_links, materialize, pairs_within

#: The decompositions that keep the look of a character.
_KEPT_TAGS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Ranges of default-ignorable characters.
_IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Scripts whose letters may pass for Latin ones: Greek, Cyrillic, Armenian, Cherokee, Lisu and letter-like forms.
_ALIKE = [(0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x58F), (0x13A0, 0x13FF), (0x1C80, 0x1C8F), (0x2C60, 0x2C7F), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF), (0xA640, 0xA69F), (0xAB70, 0xABBF)]
_ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts that look like one ASCII letter, of the same case where there is a choice."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [chr(c) for a, b in _ALIKE for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == "L"]
    by_skeleton: dict[str, list[str]] = {}
    for letter, skeleton in zip(_ASCII_LETTERS, checker.getSkeleton("\n".join(_ASCII_LETTERS)).split("\n"), strict=True):
        by_skeleton.setdefault(skeleton, []).append(letter)
    out = {}
    for letter, skeleton in zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True):
        same = by_skeleton.get(skeleton, [])
        best = [x for x in same if x.isupper() == letter.isupper()] or same
        if best:
            out[letter] = best[0]
    return out


@lru_cache(maxsize=1)
def _plain_forms() -> dict[str, str]:
    """Characters with a plainer form of the same look; '' for those without a shape."""
    out: dict[str, str] = {}
    for c in range(0x80, 0x30000):
        char = chr(c)
        tag = unicodedata.decomposition(char).split(" ", 1)[0]
        if tag in _KEPT_TAGS and (plain := unicodedata.normalize("NFKC", char)) != char and not (plain.startswith(" ") and len(plain) > 1):
            out[char] = plain
        elif unicodedata.category(char) == "Zs":
            out[char] = " "
    for a, b in _IGNORABLE:
        out |= {chr(c): "" for c in range(a, b + 1)}
    return out


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters of NFC quick check Maybe: the ones that end the decomposition of a character that composes again."""
    found = {chr(c) for a, b in ((0x1161, 0x1175), (0x11A8, 0x11C2)) for c in range(a, b + 1)}
    for c in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", "".join(chr(int(p, 16)) for p in parts)) == chr(c):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern[str]:
    """A segment: unstable characters with the stable one before them."""
    plain, maybe = _plain_forms(), joining()
    ranges: list[list[int]] = []
    for c in range(0x80, 0xE1000):
        if 0xD800 <= c < 0xE000 or 0x30000 <= c < 0xE0000:
            continue
        char = chr(c)
        apart = unicodedata.normalize("NFD", char)
        if char in maybe or unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char) or any(p in plain for p in (char, *apart)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    inside = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in ranges)
    return re.compile(rf"[^{inside}]?[{inside}]+", re.S)


class Canonicalizer:
    def __init__(self, alike: dict[str, str]):
        self.alike = alike
        self.plain = {ord(k): v for k, v in _plain_forms().items()}
        self.unstable = _unstable()
        # with the composed letters whose base looks like another
        composed = {chr(c) for a, b in _ALIKE for c in range(a, b + 1) if unicodedata.normalize("NFD", chr(c))[0] in alike}
        self.any_alike = re.compile(f"[{''.join(map(re.escape, sorted({*alike, *composed})))}]") if alike else None

    def _segment(self, found: re.Match[str]) -> str:
        text = found[0]
        if "\u200d" in text:
            after = found.string[found.end() : found.end() + 1]
            text = re.sub("\u200d", lambda m: "\U000f0000" if self._pictograph(text[: m.start()], text[m.end() :] + after) else "", text)
        apart = unicodedata.normalize("NFD", text.translate(self.plain))
        return unicodedata.normalize("NFC", apart.translate(self.plain)).replace("\U000f0000", "\u200d")

    @staticmethod
    def _pictograph(before: str, after: str) -> bool:
        before, after = before.rstrip("\ufe0f"), after.lstrip("\ufe0f")
        return bool(before and after) and all(unicodedata.category(c) in ("So", "Sk") for c in (before[-1], after[0]))

    def _word(self, found: re.Match[str]) -> str:
        word = found[0]
        if not self.any_alike.search(word):
            return word
        parts = unicodedata.normalize("NFD", word)
        mapped = "".join(self.alike.get(c, c) for c in parts)
        if all(c in _ASCII_LETTERS or unicodedata.combining(c) for c in mapped):
            return unicodedata.normalize("NFC", mapped)
        return self._runs(parts, word)  # scripts without spaces touch Latin words

    def _runs(self, parts: str, word: str) -> str:
        out, changed = [], False
        for run in re.findall(r"[\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff]+|[^\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff]+", parts):
            mapped = "".join(self.alike.get(c, c) for c in run)
            if mapped != run and all(c in _ASCII_LETTERS or unicodedata.combining(c) for c in mapped):
                out.append(mapped)
                changed = True
            else:
                out.append(run)
        return unicodedata.normalize("NFC", "".join(out)) if changed else word

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text if text is None else text.replace("\r\n", "\n")
        text = self.unstable.sub(self._segment, text).replace("\r\n", "\n")
        return _WORD.sub(self._word, text) if self.any_alike and self.any_alike.search(text) else text


_made: dict[int, Canonicalizer] = {}


def _canonicalizer(alike: dict[str, str]) -> Canonicalizer:
    key = hash(frozenset(alike.items()))
    if key not in _made:
        _made[key] = Canonicalizer(alike)
    return _made[key]


def canonical_forms(records: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``canonical``: the one form of each row's text."""
    alike = look_alikes(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = _canonicalizer(alike)
        for batch in batches:
            forms = pa.array([canonical(t) for t in batch.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], forms], names=[*keys, "canonical"])

    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    return records.select(*keys, text).mapInArrow(run, f"{kinds}, canonical string")


def _digests(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, raw, form``: 128-bit digests of each text and of its one form."""
    alike = look_alikes(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = _canonicalizer(alike)
        for batch in batches:
            raws, forms = [], []
            for text in batch.column(2).to_pylist():
                form = canonical(text)
                raws.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                forms.append(None if not form.strip() else raws[-1] if form == text else hashlib.blake2b(form.encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raws, pa.binary()), pa.array(forms, pa.binary())], names=["rec_kind", "rec_id", "raw", "form"])

    return records.where("text is not null and rec_id is not null").select("rec_kind", "rec_id", "text").mapInArrow(run, "rec_kind string, rec_id string, raw binary, form binary")


def spellings(records: DataFrame) -> DataFrame:
    """``rec_kind, form, raw, rec_id`` of records whose text has another spelling that looks the same; a written table.

    Blank forms show no text. Groups with one spelling are left out by an aggregate, so that a text
    copied any number of times costs nothing more.
    """
    rows = materialize(_digests(records).where("form is not null"), "forms")
    varied = rows.groupBy("rec_kind", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low <> high").select("rec_kind", "form")
    kept = materialize(rows.join(varied, ["rec_kind", "form"], "left_semi").distinct(), "varied")
    drop(rows)
    return kept


def same_looking(records: DataFrame) -> DataFrame:
    """``rec_kind, id_a, id_b`` of records (rec_kind, rec_id, text) that look the same and differ.

    Spellings of one form are paired, then the records of both written out, each in blocks of
    bounded size; exact copies pair with each other's spellings only.
    """
    kept = spellings(records)
    linked = pairs_within(kept.select("rec_kind", "form", "raw").distinct(), ["rec_kind", "form"], ["raw"], F.lit(True)).select("rec_kind", F.col("a_raw").alias("a"), F.col("b_raw").alias("b"))
    pairs = expand_links(linked, kept.select("rec_kind", F.col("raw").alias("group"), F.col("rec_id").alias("id")), ["rec_kind"])
    return pairs.where("x <> y").select("rec_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def same_looking_classes(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, class_id, spellings``: a row for each record that looks like one of other characters; the smallest id of that look, and its number of spellings."""
    kept = spellings(records)
    classes = kept.groupBy("rec_kind", "form").agg(F.min("rec_id").alias("class_id"), F.count_distinct("raw").alias("spellings"))
    return kept.join(classes, ["rec_kind", "form"]).select("rec_kind", "rec_id", "class_id", "spellings").distinct()


def _records(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    return chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), F.col("content").alias("text")).unionByName(
        entities.select(F.lit("entity").alias("rec_kind"), F.col("entity_id").cast("string").alias("rec_id"), F.col("name").alias("text"))
    )


def found_same_looking(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs among chunk contents and among entity names."""
    return same_looking(_records(chunks, entities))


def classes_of(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """As found_same_looking, a row a record."""
    return same_looking_classes(_records(chunks, entities))

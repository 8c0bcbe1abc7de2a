"""Raw publication times of many notations to one UTC instant (problem 5).

Each text is reduced to a shape mask: digits become ``d``, Latin letters ``a``, all else stays. A
mask fixes the length and the place of every field, so each distinct mask is mapped to a parser
once and all texts of that mask are converted together as one matrix of code points. Local times
go through transition tables of the IANA zones (one sorted array of switch times a zone). The driver reads its zone
files once and sends them, with their version, to all tasks, which make the tables from them and
never look at zone files of their own; so all instants of a run come from one version. Zone and
date order of a feed are joined to the records.

Rules: missing smaller units are zero; an hour stands alone if an hour sign, a T or AM or PM shows
that it is one. Every year of the calendar holds, 1 to 9999, as the zone database has it: local mean
time before a zone's first switch, its last rule for ever after. Bare digits are a calendar date (8), date and time (14) or
a Unix count in s, ms, us or ns (10, 13, 16, 19). A zone in the text wins: offset, abbreviation,
bracketed IANA name or 北京时间. Else the zone of the feed holds; without a known feed the result
is null. A local time that occurs twice means the first, a skipped one takes the offset before the
change. An abbreviation means the feed's own zone if that has it, else the one feed zone that has
it. Null, empty and blank texts, words, and dates that don't exist give null. Texts of any length are
safe: beyond ``LONGEST`` characters, without spaces and a label in front, no notation goes on.
"""

from __future__ import annotations

import importlib.resources
import importlib.util
import io
import pathlib
import re
import unicodedata
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 200
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_YEARS = (1, 10_000)
#: The zone database has no switch before; from the second on the rules of all zones hold that repeat with the calendar, after ``_CYCLE``.
_LISTED = (1800, 2100)
_CYCLE = 146_097 * 86_400_000_000
#: Names in texts.
_MONTHS = {name: i % 12 + 1 for i, name in enumerate("jan feb mar apr may jun jul aug sep oct nov dec january february march april may june july august september october november december".split())} | {"sept": 9}
_DAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}
_CHINESE = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "○": 0}
_REPEATED = int((datetime(_LISTED[1], 1, 1, tzinfo=UTC) - _EPOCH).total_seconds()) * 1_000_000
_UNIX = {10: (1_000_000, 1), 13: (1000, 1), 16: (1, 1), 19: (1, 1000)}

_DATE = r"""(?:(?P<Y>dddd)\s*(?P<sep1>[-/.年])\s*(?P<M>dd?)\s*[-/.月]\s*(?P<D>dd?)日?
    |(?P<Y2>dddd)(?P<M2>dd)(?P<D2>dd)
    |(?P<P>dd?)(?P<sep2>[-/.])(?P<Q>dd?)(?P=sep2)(?P<Y3>dddd)
    |(?:(?P<wd>a+)\.?,?\s+)?(?P<D4>dd?)(?:\s+|-)(?P<mon4>a+)\.?,?(?:\s+|-)(?P<Y4>dddd)
    |(?:(?P<wd5>a+)\.?,\s+)?(?P<mon5>a+)\.?\s+(?P<D5>dd?),?\s+(?P<Y5>dddd))"""
_TIME = r"""(?:(?P<cn>上午|下午|凌晨|早上|中午|晚上)?\s*(?:(?P<h>dd?)\s*(?:[:时点]\s*(?P<m>dd?)(?:\s*[:分]\s*(?P<s>dd?)(?:[.,](?P<f>d{1,9}))?秒?|分)?|[时点]整?)|(?P<h2>dd)(?P<m2>dd)(?P<s3>dd)(?:[.,](?P<f2>d{1,9}))?|(?P<bare>(?<!d)(?P<h4>dd?))))"""
_ZONE = r"""(?:\s*(?P<w1>a+))?(?:\s*(?P<w2>a+))?(?:\s*(?P<sg>[+-])(?P<oh>dd?)(?::?(?P<om>dd))?)?(?:\s*\[(?P<zone>[a/_+d-]+)\])?"""
_SHAPE = re.compile(rf"(?:(?:发布时间|发布日期|更新时间|时间|日期|a+)\s*:\s*)?(?P<bj>北京时间)?\s*{_DATE}(?:(?:(?P<T>a)|\s*,?\s*){_TIME}{_ZONE}|(?P<only>{_ZONE.replace('P<', 'P<o_')}))", re.X)
_LABEL = re.compile(r"^(?:发布时间|发布日期|更新时间|时间|日期|[A-Za-z]+) ?: ?")
_TO_MASK = str.maketrans({**{chr(c): "d" for c in range(48, 58)}, **{chr(c): "a" for c in (*range(65, 91), *range(97, 123))}})


@dataclass
class ZoneTable:
    """Offsets of one zone: ``offsets[i]`` holds for local times from ``switches[i - 1]`` on (microseconds)."""

    switches: np.ndarray
    offsets: np.ndarray
    names: dict[str, int] = field(default_factory=dict)

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        listed = local - np.maximum((local - _REPEATED) // _CYCLE, 0) * _CYCLE
        return local - self.offsets[np.searchsorted(self.switches, listed, side="right")]


@dataclass
class Zones:
    """Zone files by name, of one version of the database; tables are made when they are asked for."""

    version: str
    raw: dict[str, bytes]
    tables: dict[str, ZoneTable] = field(default_factory=dict)

    @classmethod
    @lru_cache(maxsize=1)
    def of_system(cls) -> Zones:
        """All zones of this machine's database (some 600 files, about a MB)."""
        raw, version = {}, "unknown"
        for folder in zoneinfo.TZPATH:
            try:
                with open(f"{folder}/tzdata.zi") as lines:
                    version = lines.readline().split()[-1]
                    break
            except OSError:
                continue
        packaged = importlib.resources.files("tzdata") if importlib.util.find_spec("tzdata") else None
        if version == "unknown" and packaged:
            version = importlib.import_module("tzdata").IANA_VERSION
        for name in zoneinfo.available_timezones():
            places = [pathlib.Path(folder, name) for folder in zoneinfo.TZPATH] + ([packaged.joinpath("zoneinfo", *name.split("/"))] if packaged else [])
            for place in places:
                if place.is_file():
                    raw[name] = place.read_bytes()
                    break
        return cls(version, raw)

    def table(self, name: str | None) -> ZoneTable | None:
        """None for unknown names."""
        if name not in self.raw:
            return None
        if name not in self.tables:
            self.tables[name] = _transitions(self.raw[name], name)
        return self.tables[name]


def _transitions(raw: bytes, name: str) -> ZoneTable:
    """Transitions of the years of ``_LISTED`` and of one cycle more, found by halving weeks."""
    zone = zoneinfo.ZoneInfo.from_file(io.BytesIO(raw), key=name)

    def offset(second: int) -> int:
        return int((_EPOCH + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    week = 7 * 86400
    at, stop = (int((datetime(y, 1, 1, tzinfo=UTC) - _EPOCH).total_seconds()) for y in (_LISTED[0], _LISTED[1] + 401))
    switches, offsets = [], [offset(at)]
    names: dict[str, int] = {}
    while at < stop:
        after = offset(at + week)
        if after != offsets[-1]:
            low, high = at, at + week
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            switches.append(high + max(offsets[-1], after))
            offsets.append(after)
        at += week
        if 946_684_800 < at < 4_102_444_800:  # abbreviations from 2000 to 2100
            names.setdefault((_EPOCH + timedelta(seconds=at)).astimezone(zone).tzname(), after)
    million = 1_000_000
    return ZoneTable(np.array(switches, dtype=np.int64) * million, np.array(offsets, dtype=np.int64) * million, {k: v * million for k, v in names.items() if k.isalpha()})


@lru_cache(maxsize=20_000)
def shape_parser(mask: str) -> dict[str, tuple[int, int]] | None:
    """The fields of a mask by name, as spans; None if the mask is of no known notation."""
    if set(mask) == {"d"}:
        return {"digits": (0, len(mask))} if len(mask) in (8, 14, *_UNIX) else None
    found = _SHAPE.fullmatch(mask)
    if not found:
        return None
    spans = {}
    for name in found.re.groupindex:
        if found.start(name) >= 0 and found.end(name) > found.start(name):
            plain = name[2:] if name.startswith("o_") else name
            spans[plain if plain.startswith(("w1", "w2", "sep")) else plain.rstrip("2345")] = found.span(name)
    return spans


def clean(text: str | None) -> str:
    """One width, plain spaces, no edges; Chinese numerals as digits."""
    if not text:
        return ""
    text = " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())
    if len(text) > LONGEST:
        text = _LABEL.sub("", text, count=1)
    if len(text) > LONGEST:
        return ""
    if any(c in _CHINESE or c == "十" for c in text):
        text = re.sub(r"[零〇○一二三四五六七八九十]+", _digits, text)
    return text


def _digits(found: re.Match[str]) -> str:
    run = found[0]
    if "十" not in run:
        return "".join(str(_CHINESE[c]) for c in run)
    tens, _, ones = run.partition("十")
    if len(tens) > 1 or len(ones) > 1:
        return run
    return str((_CHINESE[tens] if tens else 1) * 10 + (_CHINESE[ones] if ones else 0))


class Converter:
    """Texts to microseconds since 1970 UTC, by shape."""

    def __init__(self, feeds: dict[str, tuple[str | None, str | None]] | None = None, zones: Zones | None = None, names: list[str] | None = None):
        """``names``: the zones of all feeds; by default those of ``feeds``."""
        self.feeds = feeds or {}
        self.known = zones or Zones.of_system()
        self.zones = [z for z in dict.fromkeys(sorted(names) if names is not None else (tz for tz, _ in self.feeds.values())) if self.known.table(z)]
        self.zone_number = {z: i for i, z in enumerate(self.zones)}
        self.shared: dict[str, int | None] = {}
        for zone in self.zones:
            for name, offset in self.known.table(zone).names.items():
                self.shared[name] = offset if self.shared.get(name, offset) == offset else None
        self.shared |= {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}

    def convert(self, texts: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As convert_local, by the feeds of ``sources``."""
        found = [self.feeds.get(s, (None, None)) for s in sources]
        return self.convert_local(texts, [tz for tz, _ in found], [order for _, order in found])

    def convert_local(self, texts: list[str | None], zones: list[str | None], orders: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether they hold."""
        n = len(texts)
        out, good = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        by_mask: dict[str, tuple[list[int], list[str]]] = {}
        for i, text in enumerate(texts):
            if text and (plain := clean(text)):
                rows = by_mask.get(mask := plain.translate(_TO_MASK))
                if rows is None:
                    rows = by_mask[mask] = ([], [])
                rows[0].append(i)
                rows[1].append(plain)
        feed_zone = np.array([self.zone_number.get(z, -1) for z in zones])
        feed_order = np.array([{"mdy": 1, "dmy": 2, "ymd": 3}.get(o, 0) for o in orders])
        for mask, (at, plain) in by_mask.items():
            spans = shape_parser(mask)
            if spans is not None:
                rows = np.array(at)
                out[rows], good[rows] = self._shape(spans, np.array(plain), feed_zone[rows], feed_order[rows])
        return out, good

    def _shape(self, spans: dict[str, tuple[int, int]], texts: np.ndarray, zone: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        points = texts.view(np.uint32).reshape(n, -1).astype(np.int64)

        def number(name: str, missing: int = 0) -> np.ndarray:
            if name not in spans:
                return np.full(n, missing, dtype=np.int64)
            a, b = spans[name]
            return (points[:, a:b] - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

        def word(name: str) -> list[str]:
            a, b = spans[name]
            return [t[a:b] for t in texts.tolist()]

        good = np.ones(n, dtype=bool)
        if "digits" in spans and (length := spans["digits"][1]) in _UNIX:
            times, over = _UNIX[length]
            value = texts.astype(object).astype(np.int64) if length < 19 else np.array([int(t) if int(t) < 1 << 63 else -1 for t in texts.tolist()], dtype=np.int64)
            return value * times // over, value >= 0
        if "digits" in spans:
            spans = {"Y": (0, 4), "M": (4, 6), "D": (6, 8)} | ({"h": (8, 10), "m": (10, 12), "s": (12, 14)} if spans["digits"][1] == 14 else {})
        year, month, day = number("Y"), number("M"), number("D")
        if "P" in spans:
            first, second = number("P"), number("Q")
            known = np.where(order == 3, np.where(second > 12, 1, 2), order)
            known = np.where(known == 0, np.where(first > 12, 2, np.where(second > 12, 1, 0)), known)
            good &= known > 0
            month, day = np.where(known == 1, first, second), np.where(known == 1, second, first)
        if "mon" in spans:
            month = np.array([_MONTHS.get(w.lower(), 0) for w in word("mon")], dtype=np.int64)
        if "wd" in spans:
            good &= np.array([w.lower() in _DAYS for w in word("wd")])
        if "T" in spans:
            good &= np.array([w in "Tt" for w in word("T")])
        good &= (month >= 1) & (month <= 12) & (day >= 1) & (year >= _YEARS[0]) & (year < _YEARS[1])
        months = (np.where(good, year, 1970) - 1970) * 12 + np.where(good, month, 1) - 1
        starts = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        ends = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        good &= day <= ends - starts
        hour, minute, second = number("h"), number("m"), number("s")
        offset = np.zeros(n, dtype=np.int64)
        fixed = np.zeros(n, dtype=bool)
        half = np.zeros(n, dtype=np.int64)  # 1: before noon, 2: after
        if "cn" in spans:
            half = np.array([2 if w in ("下午", "晚上", "中午") else 1 for w in word("cn")])
            half = np.where(np.array([w == "中午" for w in word("cn")]) & (hour < 11) | (half == 2) | (hour > 12), half, 1)
        for name in ("w1", "w2"):
            if name in spans:
                for i, w in enumerate(word(name)):
                    up = w.upper()
                    if up in ("AM", "PM") and "h" in spans and not half[i]:
                        half[i] = 1 + (up == "PM")
                    else:
                        own = self.known.table(self.zones[zone[i]]).names.get(up) if zone[i] >= 0 else None
                        value = own if own is not None else self.shared.get(up)
                        good[i] &= value is not None and not fixed[i]
                        offset[i] = value or 0
                        fixed[i] = True
        if "bare" in spans and "T" not in spans:
            good &= half > 0
        if "cn" in spans:
            hour = np.where((half == 2) & (hour < 12), hour + 12, np.where((half == 1) & (hour == 12), 0, hour))
        else:
            good &= (half == 0) | ((hour >= 1) & (hour <= 12))
            hour = np.where(half == 0, hour, hour % 12 + 12 * (half == 2))
        if "sg" in spans:
            sign = np.array([-1 if w == "-" else 1 for w in word("sg")])
            hours, minutes = number("oh"), number("om")
            good &= (hours <= 18) & (minutes < 60) & (~fixed | (offset == 0))
            offset, fixed = sign * (hours * 60 + minutes) * 60_000_000, np.ones(n, dtype=bool)
        good &= (hour < 24) & (minute < 60) & (second < 60)
        local = (starts + day - 1) * 86_400_000_000 + ((hour * 60 + minute) * 60 + second) * 1_000_000
        if "f" in spans:
            a, b = spans["f"]
            local = local + (number("f") * 10 ** (6 - (b - a)) if b - a <= 6 else number("f") // 10 ** (b - a - 6))
        out = local - offset
        if "bj" in spans:
            return self.known.table("Asia/Shanghai").to_utc(local) if not fixed.all() else out, good
        if "zone" in spans and not fixed.all():
            for name in set(names := word("zone")):
                rows = np.array([w == name for w in names])
                table = self.known.table(name)
                good &= ~rows | (table is not None)
                if table is not None:
                    out[rows] = table.to_utc(local[rows])
            return out, good
        for number_ in np.unique(zone[~fixed]):
            rows = ~fixed & (zone == number_)
            if number_ < 0:
                good[rows] = False
            else:
                out[rows] = self.known.table(self.zones[number_]).to_utc(local[rows])
        return out, good


def normalize_times(records: DataFrame, feeds: DataFrame, keys: list[str], raw: str = "publish_time", source: str = "source", zones: Zones | None = None) -> DataFrame:
    """``keys`` and ``utc_us``: one row per row of ``records``, null where no instant is denoted.

    A source that ``feeds`` names more than once has its smallest zone and order. ``zones``: the zone files to
    use, by default the driver's.
    """
    spark = records.sparkSession
    zones = zones or Zones.of_system()
    sent = spark.sparkContext.broadcast((zones.version, zones.raw))
    table = feeds.where("source is not null").groupBy(F.col("source").alias("_feed")).agg(F.min("tz").alias("_tz"), F.min("date_order").alias("_order"))
    # at most as many as the zone database has
    names = sorted({r._tz for r in table.select("_tz").distinct().where(F.col("_tz").isin(sorted(zones.raw))).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        converter = Converter(zones=_received(*sent.value), names=names)
        for batch in batches:
            k = len(keys)
            values, good = converter.convert_local(*(batch.column(i).to_pylist() for i in range(k, k + 3)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(values, mask=~good)], names=[*keys, "utc_us"])

    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    rows = records.select(*keys, F.col(raw).alias("_raw"), F.col(source).alias("_feed")).join(table, "_feed", "left")
    return rows.select(*keys, "_raw", "_tz", "_order").mapInArrow(run, f"{kinds}, utc_us bigint")


_made: dict[tuple[str, int], Zones] = {}


def _received(version: str, raw: dict[str, bytes]) -> Zones:
    """One per Python worker and database, so that tables are made once."""
    key = (version, hash(tuple(sorted(raw.items()))))
    return _made.setdefault(key, Zones(version, raw))


def found_times(documents: DataFrame, chunks: DataFrame, feeds: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, utc_us`` of every record whose publish_time denotes an instant."""
    columns = ["rec_kind", "rec_id", "publish_time", "source"]
    rows = (
        documents.select(F.lit("document").alias("rec_kind"), F.col("doc_id").cast("string").alias("rec_id"), "publish_time", "source")
        .unionByName(chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), "publish_time", "source"))
        .where("publish_time is not null and rec_id is not null")
    )
    return normalize_times(rows.select(columns), feeds, ["rec_kind", "rec_id"]).where("utc_us is not null").distinct()

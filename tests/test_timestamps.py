"""Times of many notations against hand-made values and the zone database."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from newsloom.operators.timestamps import LONGEST, Converter, Zones, clean, found_times, normalize_times, shape_parser

FEEDS = {"sh": ("Asia/Shanghai", "ymd"), "ny": ("America/New_York", "mdy"), "ldn": ("Europe/London", "dmy"), "chi": ("America/Chicago", "mdy"), "none": (None, None)}


def _utc(*parts):
    return int((datetime(*parts, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


CASES = [
    ("2025-09-19", "sh", _utc(2025, 9, 18, 16)),
    ("20250919", "sh", _utc(2025, 9, 18, 16)),
    ("20250919101112", "sh", _utc(2025, 9, 19, 2, 11, 12)),
    ("2021-01-20T16:35:06.195Z", None, _utc(2021, 1, 20, 16, 35, 6, 195000)),
    ("2021-01-20 16:35:06,1957", "ldn", _utc(2021, 1, 20, 16, 35, 6, 195700)),
    ("20220414T163922+0900", None, _utc(2022, 4, 14, 7, 39, 22)),
    ("2023-02-15 22:26:10.291+08", None, _utc(2023, 2, 15, 14, 26, 10, 291000)),
    ("２０２６－０４－０６\u3000２３：４９", "sh", _utc(2026, 4, 6, 15, 49)),
    ("二〇二四年十二月三十一日", "sh", _utc(2024, 12, 30, 16)),
    ("2026年2月19日下午12:13", "sh", _utc(2026, 2, 19, 4, 13)),
    ("2026年2月19日上午0时15分", "sh", _utc(2026, 2, 18, 16, 15)),
    ("北京时间2021年3月21日 01:21", "ny", _utc(2021, 3, 20, 17, 21)),
    ("发布时间：2025-4-28", "sh", _utc(2025, 4, 27, 16)),
    ("06/28/2024 09:40", "ny", _utc(2024, 6, 28, 13, 40)),
    ("04/05/2024 09:40", "ldn", _utc(2024, 5, 4, 8, 40)),
    ("04/05/2024 09:40", "ny", _utc(2024, 4, 5, 13, 40)),
    ("Sun, 26 Mar 2023 02:06:10 +0100", None, _utc(2023, 3, 26, 1, 6, 10)),
    ("May 29, 2024 12:22 AM", "ny", _utc(2024, 5, 29, 4, 22)),
    ("20 Jul 2024 23:52:52 EDT", None, _utc(2024, 7, 21, 3, 52, 52)),
    ("2024-01-05 10:00 CST", "sh", _utc(2024, 1, 5, 2)),
    ("2024-01-05 10:00 CST", "chi", _utc(2024, 1, 5, 16)),
    ("2024-03-15T18:32:22[Asia/Hong_Kong]", None, _utc(2024, 3, 15, 10, 32, 22)),
    ("1742539230", None, 1742539230 * 10**6),
    ("1660670470017", None, 1660670470017 * 1000),
    ("1748012671036769", None, 1748012671036769),
    ("1668052971468654999", None, 1668052971468654),
    ("2024-11-03 01:30", "ny", _utc(2024, 11, 3, 5, 30)),  # twice: the first
    ("2024-03-10 02:30", "ny", _utc(2024, 3, 10, 7, 30)),  # skipped: the offset before
    (" 2022-11-19 13:41:49\n", "sh", _utc(2022, 11, 19, 5, 41, 49)),
]
NOT = ["2025-13-45", "2026-06-31 10:00", "2023年2月29日", "0000-00-00", "待定", "", "  ", "null", "123", "2024-01-01 24:00", "2024-01-01 10:61", "9" * 5000, "13/13/2024 10:00", "2024-01-05 10:00 XYZ", "2024-01-05T10:00[No/Where]", "99999999999999999999"]


@pytest.mark.parametrize(("text", "source", "want"), CASES)
def test_cases(text, source, want):
    values, good = Converter(FEEDS).convert([text], [source])
    assert good[0] and values[0] == want


WHOLE = [
    ("1949-10-01 15:00", "sh", _utc(1949, 10, 1, 7)),
    ("1066-10-14T09:00:00Z", None, _utc(1066, 10, 14, 9)),
    ("0001-01-01 12:00 UTC", None, _utc(1, 1, 1, 12)),
    ("2400-02-29", "sh", _utc(2400, 2, 28, 16)),
    ("9999-07-01 00:00", "ny", _utc(9999, 7, 1, 4)),
    (" " * 90 + "2024-05-01 10:00", "sh", _utc(2024, 5, 1, 2)),
    ("2024-05-01" + " " * 90 + "10:00", "sh", _utc(2024, 5, 1, 2)),
    ("Wednesday, May 1, 2024 12:00:00.123456789 PM -03:00 [America/Argentina/ComodRivadavia]", None, _utc(2024, 5, 1, 15, 0, 0, 123456)),
    ("2024年5月1日10时", "sh", _utc(2024, 5, 1, 2)),
    ("2024年5月1日十时整", "sh", _utc(2024, 5, 1, 2)),
    ("2024年5月1日下午3点", "sh", _utc(2024, 5, 1, 7)),
    ("May 1, 2024 3 PM", "ny", _utc(2024, 5, 1, 19)),
    ("2024-05-01 12AM EDT", None, _utc(2024, 5, 1, 4)),
    ("2024-05-01T10Z", None, _utc(2024, 5, 1, 10)),
]


@pytest.mark.parametrize(("text", "source", "want"), WHOLE)
def test_every_year_and_hours_alone(text, source, want):
    values, good = Converter(FEEDS).convert([text], [source])
    assert good[0] and values[0] == want


@pytest.mark.parametrize("text", ["0000-01-01", "1900-02-29", "2024-05-01 10", "2024-05-01 3 XX", "2024-05-01 13 PM", "202405013 PM", "2024年5月1日25时", "2024-5-123"])
def test_no_hour_alone(text):
    assert not Converter(FEEDS).convert([text], ["ny"])[1][0]


@pytest.mark.parametrize("name", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Shanghai", "Africa/Casablanca"])
def test_zones_of_every_year(name):
    rng, zone, table = random.Random(4), ZoneInfo(name), Zones.of_system().table(name)
    for _ in range(600):
        local = datetime(rng.choice([rng.randrange(2, 9998), rng.randrange(1850, 2150)]), 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 365))
        want = (local.replace(tzinfo=zone, fold=0) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
        assert table.to_utc(np.array([(local - datetime(1970, 1, 1)) // timedelta(microseconds=1)]))[0] == want


@pytest.mark.parametrize("text", NOT)
def test_no_time(text):
    assert not Converter(FEEDS).convert([text], ["ny"])[1][0]


def test_zone_is_needed():
    values, good = Converter(FEEDS).convert(["2024-01-01", "2024-01-01", "2024-01-01", None], ["unknown", None, "none", "sh"])
    assert not good.any() and len(values) == 4
    assert not Converter({}).convert(["2024-01-01"], ["sh"])[1][0]


def test_local_times_follow_the_zone_database():
    rng = random.Random(3)
    for name in ("America/New_York", "Europe/London", "Australia/Sydney", "Asia/Shanghai", "Asia/Tokyo"):
        zone, table = ZoneInfo(name), Zones.of_system().table(name)
        for _ in range(400):
            local = datetime(2021, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 365 * 5))
            want = (local.replace(tzinfo=zone, fold=0) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
            import numpy as np

            naive = (local - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            assert table.to_utc(np.array([naive]))[0] == want


def test_masks_are_parsed_once():
    shape_parser.cache_clear()
    Converter(FEEDS).convert([f"2024-01-{d:02d} 10:00" for d in range(1, 29)], ["sh"] * 28)
    assert shape_parser.cache_info().misses == 1
    assert clean("x" * (LONGEST + 1)) == ""


def test_tables(spark):
    docs = spark.createDataFrame([(1, "2025-09-19", "sh", "x"), (1, "2025-09-19", "sh", "x"), (2, None, "sh", "y"), (3, "待定", None, "z"), (None, "2025-09-19", "sh", "x")], "doc_id bigint, publish_time string, source string, utc_us string")
    chunks = spark.createDataFrame([("c", "1742539230", None)], "chunk_id string, publish_time string, source string")
    feeds = spark.createDataFrame([("sh", "Asia/Shanghai", "ymd"), (None, None, None)], "source string, tz string, date_order string")
    out = {(r.rec_kind, r.rec_id): r.utc_us for r in found_times(docs, chunks, feeds).collect()}
    assert out == {("document", "1"): _utc(2025, 9, 18, 16), ("chunk", "c"): 1742539230 * 10**6}
    assert normalize_times(docs, feeds, ["doc_id"]).count() == 5
    assert found_times(docs.limit(0), chunks.limit(0), feeds.limit(0)).count() == 0


def test_zones_are_those_that_are_sent(spark):
    """The tasks use the files of the run, not their own; a version without a zone doesn't know it."""
    sent = Zones("made", {"Asia/Shanghai": Zones.of_system().raw["Asia/Tokyo"]})
    rows = spark.createDataFrame([(1, "2024-01-01 09:00", "sh"), (2, "2024-01-01 09:00", "ny")], "id bigint, publish_time string, source string")
    feeds = spark.createDataFrame([("sh", "Asia/Shanghai", "ymd"), ("ny", "America/New_York", "mdy")], "source string, tz string, date_order string")
    got = {r.id: r.utc_us for r in normalize_times(rows, feeds, ["id"], zones=sent).collect()}
    assert got == {1: 1_704_067_200_000_000, 2: None}
    assert Zones.of_system().version != ""


def test_many_sources_and_long_labels(spark):
    feeds = spark.range(12_000).selectExpr("concat('s', id) as source", "'UTC' as tz", "'ymd' as date_order")
    label = "x" * 5000
    rows = spark.createDataFrame([(1, "2024-01-01", "s11999"), (2, f"{label}: 2024-01-01", "s1"), (3, label * 10, "s1"), (4, "2024-01-01 " + label, "s1")], "id bigint, publish_time string, source string")
    got = {r.id: r.utc_us for r in normalize_times(rows, feeds, ["id"]).collect()}
    assert got == {1: 1_704_067_200_000_000, 2: 1_704_067_200_000_000, 3: None, 4: None}

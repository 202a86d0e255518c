from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ticketmill.functions import labels, text
from ticketmill.operators import filters
from ticketmill.plans import counts, volume

SCHEMA = (
    "hubspot_ticket_id STRING, closed_at TIMESTAMP_NTZ, category STRING, subcategory STRING, source STRING, "
    "owner_name STRING, owner_id STRING"
)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("1", "2024-01-01 00:00:00", "A", "x", "Email", "Ana", "7"),
        ("2", "2024-01-02 23:59:59.999999", " A ", None, "Email", " ", "7"),
        ("3", "2024-01-03 00:00:00", "A", "x", "Email", "Ana", "7"),
        ("4", "2024-01-02 10:00:00", "\t", "x", " ", None, " "),
        ("5", "2024-01-02 10:00:00", None, "x", None, None, None),
        ("6", None, "A", "x", "Email", "Ana", "7"),
        ("7", "2024-01-01 10:00:00", "B", "", "Phone", None, "8"),
    ]
    parsed = [(r[0], r[1] and datetime.fromisoformat(r[1]), *r[2:]) for r in rows]
    return spark.createDataFrame(parsed, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


DAYS = ("2024-01-01", "2024-01-02")


def test_range_is_inclusive_by_day(frame):
    assert {r[0] for r in rows(filters.closed_between(frame, *DAYS))} == {"1", "2", "4", "5", "7"}
    assert rows(volume.closed_total(frame, *DAYS)) == [(5,)]


def test_top_categories_and_total(frame):
    got = rows(counts.top_categories(frame, *DAYS))
    assert got == [("A", 2), ("\t", 1), ("B", 1), ("Sin categoría", 1)]
    assert rows(counts.returned_total(counts.top_categories(frame, *DAYS, top=1))) == [(2,)]
    assert rows(counts.returned_total(counts.top_categories(frame, "2030-01-01", "2030-01-01"))) == [(0,)]


def test_stored_categories_are_not_trimmed(frame):
    assert rows(counts.category_counts(frame)) == [("A", 3), ("\t", 1), (" A ", 1), ("B", 1)]
    assert rows(counts.category_counts(frame, top=1)) == [("A", 3)]
    assert rows(counts.total_tickets(frame)) == [(7,)]


def test_sources_have_shares(frame):
    got = rows(counts.tickets_by_source(frame, *DAYS))
    assert got == [("Desconocido", 2, 40.0), ("Email", 2, 40.0), ("Phone", 1, 20.0)]
    assert rows(counts.tickets_by_source(frame, "2030-01-01", "2030-01-01")) == []


def test_agents_fall_back_to_their_id(frame):
    assert rows(counts.top_agents(frame, *DAYS)) == [("Sin asignar", 2), ("7", 1), ("8", 1), ("Ana", 1)]


def test_pairs(frame):
    got = rows(counts.top_subcategories(frame, *DAYS))
    assert got[0] == ("\t", "x", 1, "\t — x")
    assert ("B", "Sin subcategoría", 1, "B — Sin subcategoría") in got
    for everything in (None, 0, -3):
        assert len(rows(counts.top_subcategories(frame, *DAYS, top=everything))) == 5
    assert len(rows(counts.top_subcategories(frame, *DAYS, top=2))) == 2


def test_limits_must_not_be_negative(frame):
    for report in (counts.top_categories, counts.top_agents):
        with pytest.raises(ValueError):
            report(frame, *DAYS, top=-1)
    assert rows(counts.top_agents(frame, *DAYS, top=0)) == []


def test_daily_and_monthly_fill_gaps(frame):
    assert rows(volume.closed_daily(frame, "2023-12-31", "2024-01-04")) == [
        ("2023-12-31", 0),
        ("2024-01-01", 2),
        ("2024-01-02", 3),
        ("2024-01-03", 1),
        ("2024-01-04", 0),
    ]
    assert rows(volume.closed_monthly(frame, "2023-12-31", "2024-02-01")) == [
        (date(2023, 12, 1), "Diciembre 2023", 0),
        (date(2024, 1, 1), "Enero 2024", 6),
        (date(2024, 2, 1), "Febrero 2024", 0),
    ]


def test_grain_follows_the_range(frame):
    assert volume.volume_grain("2024-01-01", "2024-01-01") == "total"
    assert volume.volume_grain("2024-01-01", "2024-02-09") == "daily"
    assert volume.volume_grain("2024-01-01", "2024-02-10") == "monthly"
    for days in (("2024-01-01", "2024-01-01"), DAYS, ("2024-01-01", "2024-12-31")):
        assert volume.closed_volume(frame, *days).columns == ["grain", "period", "date", "count"]
    assert len(rows(volume.closed_volume(frame, "2024-01-01", "2024-12-31"))) == 12
    assert len(rows(volume.closed_volume(frame, "2024-01-01", "2024-12-31", grain="daily"))) == 366
    assert rows(volume.closed_volume(frame, *DAYS, grain="total"))[0][0] == "total"
    with pytest.raises(ValueError):
        volume.closed_volume(frame, *DAYS, grain="weekly")


def test_ranges_are_checked(frame):
    for bad in (("2024-13-01", "2024-01-01"), ("x", "y"), ("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError):
            filters.check_range(*bad)
    assert filters.check_range("2024-01-05T10:00", "2024-01-05") == (date(2024, 1, 5), date(2024, 1, 5))


def test_shares_round_half_up(spark):
    pairs = spark.createDataFrame([(1, 16), (1, 3), (2, 3), (1, 1), (0, 5), (3, 16)], "n BIGINT, t BIGINT")
    got = [r[0] for r in pairs.select(labels.percent_share(F.col("n"), F.col("t"))).collect()]
    assert got == [6.3, 33.3, 66.7, 100.0, 0.0, 18.8]


def test_text_functions(spark):
    frame = spark.createDataFrame([("maria@corp.example",), ("ab",), ("x",), (None,)], "c STRING")
    masked = [r[0] for r in frame.select(text.mask_email(F.col("c"))).collect()]
    assert masked == ["ma…@corp.example", "ab…", "x…", None]
    frame = spark.createDataFrame([("abc",), ("abcd",), ("ab",)], "c STRING")
    cut = [tuple(r) for r in frame.select(text.preview_text(F.col("c"), 3), text.preview_text(F.col("c"), 3, "…", True)).collect()]
    assert cut == [("abc", "abc…"), ("abc...", "abc…"), ("ab", "ab")]
    padded = "　\t\x1c a b  \n"
    assert spark.createDataFrame([(padded,)], "c STRING").select(text.strip(F.col("c"))).first()[0] == padded.strip()


def test_iso_text_matches_python(spark):
    times = [datetime(2024, 1, 5, 7, 0), datetime(2024, 1, 5, 7, 0, 0, 500000), datetime(2024, 1, 5, 7, 0, 0, 1)]
    frame = spark.createDataFrame([(t,) for t in times], "t TIMESTAMP_NTZ")
    got = [r[0] for r in frame.select(text.iso_text(F.col("t"))).collect()]
    assert got == [t.isoformat() + "+00:00" for t in times]

import random
from datetime import date, datetime, time, timedelta

import pytest
from pyspark.sql import functions as F

from ticketmill.functions.timecalc import WorkingHours, business_seconds, working_days_before
from ticketmill.operators.expansion import day_expansion
from ticketmill.plans import resolution

# created_at, closed_at, seconds; 2024-01-05 is a Friday
HAND_CASES = [
    ("2024-01-08 08:00:00", "2024-01-08 10:00:00", 7200),
    ("2024-01-05 16:00:00", "2024-01-08 08:00:00", 7200),
    ("2024-01-06 09:00:00", "2024-01-07 15:00:00", 0),
    ("2024-01-08 05:00:00", "2024-01-08 06:30:00", 0),
    ("2024-01-08 05:00:00", "2024-01-09 20:00:00", 72000),
    ("2024-01-08 12:00:00", "2024-01-08 09:00:00", 0),
    ("2024-01-09 12:00:00", "2024-01-08 12:00:00", None),
    (None, "2024-01-08 12:00:00", None),
    ("2024-01-08 08:00:00", "2024-01-08 08:00:00.5", 1),
    ("2024-01-08 07:00:00", "2024-01-15 17:00:00", 216000),
    ("2024-01-08 16:59:59.6", "2024-01-09 07:00:00.4", 0),
    ("1969-12-26 16:00:00", "1970-01-06 08:00:00", 223200),
    ("2024-01-08 16:59:59.5", "2024-01-09 07:00:00.5", 2),
    ("2024-01-08 16:59:59.500001", "2024-01-09 07:00:00.499999", 0),
]

SCHEMA = "hubspot_ticket_id STRING, created_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ"


def tickets(spark, pairs):
    rows = [
        (str(i), *[None if t is None else datetime.fromisoformat(str(t)) for t in pair]) for i, pair in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def seconds_of(frame, hours=WorkingHours()):
    seconds = business_seconds(F.col("created_at"), F.col("closed_at"), hours)
    return {int(r[0]): r[1] for r in frame.select("hubspot_ticket_id", seconds).collect()}


def by_days(frame, hours=WorkingHours()):
    days = day_expansion(frame, hours).groupBy("hubspot_ticket_id").agg(F.sum("work_seconds"))
    return {int(r[0]): r[1] for r in days.collect()}


def brute_force(created, closed, hours):
    """Walk over the days in Python."""
    if created is None or created.date() > closed.date():
        return None
    total, day = 0, created.date()
    while day <= closed.date():
        lo = max(datetime.combine(day, hours.opens), created)
        hi = min(datetime.combine(day, hours.closes), closed)
        if day.weekday() in hours.weekdays and hi > lo:
            total += ((hi - lo) // timedelta(microseconds=1) + 500000) // 1000000
        day += timedelta(days=1)
    return total


def test_hand_cases(spark):
    got = seconds_of(tickets(spark, [(a, b) for a, b, _ in HAND_CASES]))
    assert [got[i] for i in range(len(HAND_CASES))] == [s for _, _, s in HAND_CASES]


@pytest.mark.parametrize(
    "hours",
    [
        WorkingHours(),
        WorkingHours(time(8, 30), time(18, 15, 20)),
        WorkingHours(time(9), time(13), (1, 3, 5)),
        WorkingHours(weekdays=(0, 1, 2, 3, 4, 5, 6)),
        WorkingHours(weekdays=(6,)),
    ],
)
def test_closed_form_equals_days_and_brute_force(spark, hours):
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        created = datetime(2023, 12, 20) + timedelta(microseconds=rng.randrange(40 * 86400 * 10**6))
        opened_for = timedelta(microseconds=rng.randrange(-(10**6) * 90000, rng.choice([10**9, 10**11, 10**12 * 3])))
        pairs.append((created, created + opened_for))
    # times that sit on and next to the rounding points
    for micros in (0, 1, 499999, 500000, 500001, 999999):
        edge = datetime.combine(date(2024, 1, 10), hours.closes) - timedelta(microseconds=micros)
        pairs += [(edge, edge + timedelta(days=1)), (edge, edge + timedelta(seconds=1)), (edge - timedelta(days=1), edge)]
    frame = tickets(spark, pairs)
    expected = {i: brute_force(a, b, hours) for i, (a, b) in enumerate(pairs)}
    assert seconds_of(frame, hours) == expected
    assert by_days(frame, hours) == {i: s for i, s in expected.items() if s is not None}


def test_working_days_before_counts_from_a_monday(spark):
    days = spark.range(-400, 400).select(F.date_add(F.lit(date(1970, 1, 5)), F.col("id").cast("int")).alias("d"))
    got = {r.d: r.n for r in days.select("d", working_days_before(F.col("d")).alias("n")).collect()}
    for d, n in got.items():
        step = 1 if d.weekday() < 5 else 0
        if d + timedelta(days=1) in got:
            assert got[d + timedelta(days=1)] - n == step
    assert got[date(1970, 1, 5)] == 0


def test_hours_are_checked():
    with pytest.raises(ValueError):
        WorkingHours(time(17), time(7))
    with pytest.raises(ValueError):
        WorkingHours(weekdays=(7,))


def test_result_does_not_depend_on_session_zone(spark):
    frame = tickets(spark, [(a, b) for a, b, _ in HAND_CASES] + [("2024-03-09 08:00:00", "2024-03-12 09:30:00")])
    expected = seconds_of(frame)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert seconds_of(frame) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def labelled(spark, rows):
    frame = tickets(spark, [(a, b) for a, b, *_ in rows])
    labels = spark.createDataFrame([(str(i), r[2], r[3]) for i, r in enumerate(rows)], "id STRING, owner_name STRING, source STRING")
    return frame.join(labels, frame.hubspot_ticket_id == labels.id).drop("id").withColumn("subject", F.lit("s"))


def test_means_sort_and_skip_uncounted_tickets(spark):
    frame = labelled(
        spark,
        [
            ("2024-01-08 08:00:00", "2024-01-08 10:00:00", "Ana", " Chat "),
            ("2024-01-08 08:00:00", "2024-01-08 09:00:00", " Ana", None),
            ("2024-01-08 08:00:00", "2024-01-08 09:30:00", None, "  "),
            (None, "2024-01-08 09:30:00", "Never", "Never"),
            ("2024-01-09 08:00:00", "2024-01-08 09:30:00", "Never", "Never"),
        ],
    )
    days = ("2024-01-08", "2024-01-08")
    agents = [tuple(r) for r in resolution.resolution_by_agent(frame, *days).collect()]
    assert agents == [("Ana", 2, 1.5), ("Sin asignar", 1, 1.5)]
    assert [r[0] for r in resolution.resolution_by_agent(frame, *days, top=1).collect()] == ["Ana"]
    sources = [tuple(r) for r in resolution.resolution_by_source(frame, *days).collect()]
    assert sources == [("Desconocido", 2, 1.25), ("Chat", 1, 2.0)]
    slowest_first = resolution.resolution_by_source(frame, *days, order="DESC").collect()
    assert [r.source for r in slowest_first] == ["Chat", "Desconocido"]
    assert resolution.resolution_by_source(frame, *days, order="sideways").first().source == "Desconocido"
    assert tuple(resolution.resolution_overall(frame, *days).first()) == (1.5, 3)
    assert tuple(resolution.resolution_overall(frame, "2030-01-01", "2030-01-01").first()) == (0.0, 0)
    slow = resolution.slow_cases(frame, *days, top=2).collect()
    assert [(r.label, r.hours_business_resolution) for r in slow] == [("0", 2.0), ("2", 1.5)]
    with pytest.raises(ValueError):
        resolution.slow_cases(frame, *days, top=-1)

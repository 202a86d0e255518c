import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import ingest
from ticketmill.plans import resolution
from ticketmill.session import staged
from ticketmill.sources import batches, documents, sql, tickets
from ticketmill.sources.schemas import TICKET_LINES, TICKETS
from ticketmill.streaming.ingest import read_line_stream, stream_ingest
from ticketmill.streaming.volume import read_closed_daily, stream_closed_daily


def lines(spark, items):
    """A batch from Python objects; text is taken as a raw line."""
    rows = [(i, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, TICKET_LINES)


def one(spark, item, tz="UTC"):
    return batches.parse_ticket_rows(lines(spark, [item]), tz).first()


def test_defaults_fill_absent_keys_only(spark):
    row = one(spark, {"hubspot_ticket_id": "1"})
    assert (row.source, row.category, row.subcategory, row.itinerary_number) == (
        "Email",
        "Consulta General",
        "Consulta",
        "N/A",
    )
    assert (row.subject, row.owner_id, row.raw_hubspot, row.error) == (None, None, "{}", None)
    row = one(spark, {"hubspot_ticket_id": "1", "source": None, "category": "", "raw_hubspot": None})
    assert (row.source, row.category, row.raw_hubspot) == (None, "", "null")
    row = one(spark, {"hubspot_ticket_id": "1", "raw_hubspot": {"b": [1, {"ñ": None}], "a": "x"}})
    assert json.loads(row.raw_hubspot) == {"b": [1, {"ñ": None}], "a": "x"}


@pytest.mark.parametrize("value", ["text", '{"a": 1}', 'say "hi"\n', "", 5, 1.25, True, [1, "x"], {"a": {"raw_hubspot": "s"}}])
def test_raw_payload_is_json_text(spark, value):
    row = one(spark, {"hubspot_ticket_id": "1", "raw_hubspot": value})
    assert json.loads(row.raw_hubspot) == value


@pytest.mark.parametrize("missing", [{}, {"hubspot_ticket_id": None}, *[{"hubspot_ticket_id": v} for v in ("", 0, 0.0, False, [], {})]])
def test_id_is_required(spark, missing):
    assert one(spark, missing).error == "Ticket 0: hubspot_ticket_id es requerido"


@pytest.mark.parametrize("value,text", [("0", "0"), ("  ", "  "), (12, "12"), ("false", "false"), (True, "true"), ("[]", "[]")])
def test_other_ids_are_kept_as_text(spark, value, text):
    row = one(spark, {"hubspot_ticket_id": value})
    assert (row.hubspot_ticket_id, row.error) == (text, None)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-05", datetime(2024, 1, 5)),
        ("2024-01-05T10:00:00", datetime(2024, 1, 5, 10)),
        ("2024-01-05 10:00:00.123456", datetime(2024, 1, 5, 10, 0, 0, 123456)),
        ("2024-01-05T10:00:00Z", datetime(2024, 1, 5, 10)),
        ("2024-01-05T10:00:00+02:00", datetime(2024, 1, 5, 8)),
        ("2024-01-05T10:00:00-05:00", datetime(2024, 1, 5, 15)),
        ("2024-07-05 10:00:00 America/New_York", datetime(2024, 7, 5, 14)),
    ],
)
def test_times(spark, text, expected):
    row = one(spark, {"hubspot_ticket_id": "1", "closed_at": text})
    assert (row.closed_at, row.error) == (expected, None)


def test_zoned_times_become_wall_clock(spark):
    row = one(spark, {"hubspot_ticket_id": "1", "closed_at": "2024-07-05T10:00:00Z"}, "Europe/Madrid")
    assert row.closed_at == datetime(2024, 7, 5, 12)


@pytest.mark.parametrize("text", ["not a date", "", "2024", "2024-01", "2024-02-30", 1704448800000])
def test_bad_times_are_rejected(spark, text):
    row = one(spark, {"hubspot_ticket_id": "1", "created_at": text})
    assert row.error == f'Ticket 1: invalid input syntax for type timestamp with time zone: "{text}"'


def test_only_bad_lines_are_set_aside(spark):
    good = {"hubspot_ticket_id": "1"}
    valid, rejected = batches.parse_tickets(lines(spark, [good, "{oops", "[1]", '"x"', good]))
    assert [r.pos for r in valid.orderBy("pos").collect()] == [0, 4]
    assert [r.error for r in rejected.orderBy("pos").collect()] == [
        "Ticket 1: línea JSON inválida",
        "Ticket 2: se esperaba un objeto JSON",
        "Ticket 3: se esperaba un objeto JSON",
    ]


def random_batch(rng, n):
    return [{"hubspot_ticket_id": rng.choice(["", "hot", "hot", str(rng.randrange(40))]), "subject": str(i)} for i in range(n)]


def table_of(spark, base):
    return spark.read.schema(ingest.STORED).parquet(f"{base}/tickets")


def test_ingest_laws(spark, tmp_path):
    """First wins; repeating a batch inserts nothing; counts add up; a replay changes nothing."""
    rng = random.Random(3)
    base = str(tmp_path)
    stored, subject = set(), {}
    given = [random_batch(rng, 60) for _ in range(3)]
    given.append(given[0])
    for number, batch in enumerate(given):
        fresh = {x["hubspot_ticket_id"] for x in batch} - stored - {""}
        for x in reversed(batch):
            if x["hubspot_ticket_id"] in fresh:
                subject[x["hubspot_ticket_id"]] = x["subject"]
        stored |= fresh
        for _ in range(2):  # the second run replaces the first
            ingest.ingest_lines(lines(spark, batch), base, number)
        report = ingest.ingest_counts(spark, base).where(f"ingest_id = {number}").collect()
        assert len(report) == 1
        assert report[0].inserted == len(fresh)
        assert report[0].skipped == sum(not x["hubspot_ticket_id"] for x in batch)
        assert report[0].inserted + report[0].skipped + report[0].duplicate == report[0].total_processed == len(batch)
    assert report[0].inserted == 0
    table = table_of(spark, base)
    assert {r.hubspot_ticket_id: r.subject for r in table.collect()} == subject
    assert table.count() == len(subject)
    assert spark.read.parquet(f"{base}/rejects").count() == sum(not x["hubspot_ticket_id"] for b in given for x in b)
    assert spark.read.parquet(f"{base}/staging").count() == len(given[-1])


def test_tags_agree_with_the_counts(spark, tmp_path):
    batch = random_batch(random.Random(9), 80)
    rows = staged(batches.parse_ticket_rows(lines(spark, batch)), str(tmp_path / "staged"))
    existing = spark.createDataFrame([("hot",)], "hubspot_ticket_id STRING")
    report = ingest.ingest_report(ingest.tag_rows(rows, existing, order_cols=["pos"])).first()
    assert report.inserted == len({x["hubspot_ticket_id"] for x in batch} - {"", "hot"})
    assert report.total_processed == len(batch)


def test_reports_read_what_ingests_insert(spark, tmp_path):
    base = str(tmp_path)
    closed = [{"hubspot_ticket_id": str(i), "created_at": "2024-01-03T09:00:00", "closed_at": f"2024-01-0{4 + i % 2}T12:00:00"} for i in range(6)]
    ingest.ingest_lines(lines(spark, [*closed, {"hubspot_ticket_id": "open"}]), base, 0)
    ingest.ingest_lines(lines(spark, closed), base, 1)
    whole = tickets.read_tickets(spark, f"{base}/tickets")
    assert whole.count() == 7 and whole.where("closed_at IS NULL").count() == 1
    part = tickets.read_tickets(spark, f"{base}/tickets", d_from="2024-01-04", d_to="2024-01-04")
    assert part.count() == 3
    assert "PartitionFilters: [isnotnull(closed_month" in part._jdf.queryExecution().executedPlan().toString()
    assert resolution.resolution_overall(whole, "2024-01-01", "2024-01-31").first().total_closed == 6
    assert [r.id for r in documents.export_documents(whole, "2024-01-05").collect()] == ["1", "3", "5"]


def test_other_layouts_are_refused(spark, tmp_path):
    stored(spark).withColumn("ingest_id", F.lit(0)).write.partitionBy("ingest_id").parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="closed_month"):
        tickets.read_tickets(spark, str(tmp_path / "t"))


def test_keys_are_read_by_bucket(spark, tmp_path):
    base = str(tmp_path)
    ingest.ingest_lines(lines(spark, [{"hubspot_ticket_id": str(i)} for i in range(200)]), base, 0)
    one = spark.createDataFrame([("7",)], "hubspot_ticket_id STRING")
    found = ingest.keys_before(one, f"{base}/keys", 1)
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "key_bucket" in filters and "ingest_id" in filters
    kept = {r.hubspot_ticket_id for r in found.collect()}
    assert "7" in kept and len(kept) < 30
    assert ingest.keys_before(one, f"{base}/keys", 0).count() == 0


def test_streaming_ingest_equals_batches(spark, tmp_path):
    rng = random.Random(5)
    given = [random_batch(rng, 30) for _ in range(3)]
    landing, base = str(tmp_path / "landing"), str(tmp_path / "store")
    expected = {}
    for batch in given:
        lines(spark, batch).write.mode("append").json(landing)
        stream_ingest(read_line_stream(spark, landing), base, str(tmp_path / "checkpoint")).awaitTermination()
        seen = {}
        for x in batch:
            if x["hubspot_ticket_id"]:
                seen.setdefault(x["hubspot_ticket_id"], x["subject"])
        expected = {**seen, **expected}
    table = table_of(spark, base)
    assert {r.hubspot_ticket_id: r.subject for r in table.collect()} == expected
    assert table.count() == len(expected)
    assert {r.ingest_id: r.total_processed for r in ingest.ingest_counts(spark, base).collect()} == {0: 30, 1: 30, 2: 30}


def test_streaming_days_equal_batch_days(spark, tmp_path):
    """Every day comes out, late rows included, over several runs."""
    rng = random.Random(1)
    times = [datetime(2024, 1, 1 + rng.randrange(20), rng.randrange(24)) for _ in range(200)] + [None]
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (times[:120], times[120:]):
        spark.createDataFrame([(t,) for t in part], "closed_at TIMESTAMP_NTZ").write.mode("append").parquet(path)
        arriving = spark.readStream.schema("closed_at TIMESTAMP_NTZ").parquet(path)
        stream_closed_daily(arriving, out, checkpoint).awaitTermination()
    got = {r.day: r["count"] for r in read_closed_daily(spark, out).collect()}
    known = [t.date() for t in times if t]
    assert got == {d: known.count(d) for d in set(known)}


def stored(spark):
    rows = [
        ("a", "2024-01-10 10:00:00"),
        ("b", "2024-02-10 00:00:00"),
        ("c", "2024-02-10 00:00:00"),
        ("d", "2024-03-01 00:00:00.25"),
        ("e", None),
    ]
    parsed = [(i, t and datetime.fromisoformat(t)) for i, t in rows]
    frame = spark.createDataFrame(parsed, "hubspot_ticket_id STRING, closed_at TIMESTAMP_NTZ")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in TICKETS if f.name not in frame.columns}
    return frame.withColumns(missing).select(*TICKETS.fieldNames())


def test_stored_tickets_are_pruned_by_month(spark, tmp_path):
    tickets.write_tickets(stored(spark), str(tmp_path / "t"))
    got = tickets.read_tickets(spark, str(tmp_path / "t"), d_from="2024-02-01", d_to="2024-02-29")
    assert {r.hubspot_ticket_id for r in got.collect()} == {"b", "c"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(closed_month" in plan
    assert "GreaterThanOrEqual(closed_at" in plan.replace(" ", "") or "PushedFilters" in plan
    assert tickets.read_tickets(spark, str(tmp_path / "t")).count() == 5


def test_stored_instants_become_wall_clock(spark, tmp_path):
    rows = [("a", "2024-01-05T23:30:00Z"), ("b", "2024-01-06T23:30:00Z")]
    frame = spark.createDataFrame(rows, "hubspot_ticket_id STRING, t STRING")
    frame = frame.withColumn("closed_at", F.col("t").cast("timestamp")).drop("t")
    frame.withColumn("closed_month", F.lit("2024-01")).write.partitionBy("closed_month").parquet(str(tmp_path / "t"))
    got = tickets.read_tickets(spark, str(tmp_path / "t"), "Europe/Madrid", "2024-01-06", "2024-01-06", instants=True)
    assert [(r.hubspot_ticket_id, r.closed_at) for r in got.collect()] == [("a", datetime(2024, 1, 6, 0, 30))]


def test_export(spark, tmp_path):
    docs = documents.export_documents(stored(spark), "2024-02-10T00:00:00Z", 2)
    assert [r.id for r in docs.collect()] == ["d", "b"]
    assert [r.id for r in documents.export_documents(stored(spark), days=30, now=datetime(2024, 3, 11)).collect()] == ["d", "b", "c"]
    documents.write_documents(documents.export_documents(stored(spark), "2024-01-01", None), str(tmp_path / "docs"))
    written = [json.loads(line) for line in "".join(p.read_text() for p in (tmp_path / "docs").glob("*.json")).splitlines()]
    assert {d["id"] for d in written} == {"a", "b", "c", "d"}
    first = next(d for d in written if d["id"] == "d")
    assert first["text"] == "[Asunto]\n\n\n[Descripción]\n\n\n[Resolución]\n"
    assert first["metadata"]["closed_at"] == "2024-03-01T00:00:00.250000+00:00"
    assert first["metadata"]["owner_name"] is None and len(first["metadata"]) == 9


def test_export_arguments(spark):
    with pytest.raises(ValueError):
        documents.export_documents(stored(spark), "yesterday")
    with pytest.raises(ValueError):
        documents.export_documents(stored(spark), "2024-01-01", -1)
    with pytest.raises(ValueError):
        documents.export_documents(stored(spark))
    with pytest.raises(ValueError):
        documents.export_documents(stored(spark), "2024-01-01", days=3)
    assert documents.export_documents(stored(spark), "2024-01-01").count() == 4
    assert documents.parse_since("2024-01-05T10:00:00+02:00") == datetime(2024, 1, 5, 8)


def test_run_sql_binds_parameters(spark):
    got = sql.run_sql(spark, "SELECT count(*) AS n FROM some_tickets WHERE hubspot_ticket_id > :x", {"x": "b"}, {"some_tickets": stored(spark)})
    assert got.columns == ["n"] and got.first().n == 3

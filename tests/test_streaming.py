"""Streams with state: event-time days, and ingest that remembers ids for a bounded time."""

import json
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import ingest
from ticketmill.operators.numbering import numbered
from ticketmill.sources import batches, documents, tickets
from ticketmill.streaming.ingest import read_line_stream, stream_ingest, stream_ingest_within, stream_rejects
from ticketmill.streaming.volume import read_closed_windows, stream_closed_windows, windowed_counts


def arrive(spark, path, times):
    frame = spark.createDataFrame([(t,) for t in times], "closed_at TIMESTAMP_NTZ")
    frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("closed_at TIMESTAMP_NTZ").parquet(path)


def days_of(spark, out):
    return {r.day.day: r["count"] for r in read_closed_windows(spark, out).collect()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_windows_are_final_once_the_watermark_has_passed(spark, tmp_path, zone):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:

        def run(*times):
            stream_closed_windows(arrive(spark, path, times), out, checkpoint, "2 days").awaitTermination()
            return days_of(spark, out)

        def at(day, hour=12):
            return datetime(2024, 1, day, hour)

        assert run(at(1), at(1, 23), at(3), None) == {}  # the watermark is noon of the 1st
        assert run(at(5)) == {1: 2}  # noon of the 3rd
        # a row of the 1st is too late; one of the 3rd is later than others but within the delay
        assert run(at(1, 5), at(3, 1), at(10)) == {1: 2, 3: 2, 5: 1}
        assert run() == {1: 2, 3: 2, 5: 1}
        filled = read_closed_windows(spark, out, "2024-01-01", "2024-01-31").collect()
        assert [(r.day, r["count"]) for r in filled] == [(date(2024, 1, d), {1: 2, 3: 2, 5: 1}.get(d, 0)) for d in range(1, 6)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_restart_after_a_lost_driver_repeats_no_day(spark, tmp_path):
    """The last commit of the checkpoint is taken away, as after a driver that died before it: the batch is run again."""
    path, out, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    times = [datetime(2024, 1, d, h) for d in range(1, 12) for h in (3, 9)]
    stream_closed_windows(arrive(spark, str(path), times), str(out), str(checkpoint)).awaitTermination()
    before = days_of(spark, str(out))
    assert before == dict.fromkeys(range(1, 9), 2)
    commits = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (checkpoint / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    more = [datetime(2024, 1, 20)]
    stream_closed_windows(arrive(spark, str(path), more), str(out), str(checkpoint)).awaitTermination()
    assert days_of(spark, str(out)) == dict.fromkeys(range(1, 12), 2)


def test_windows_in_batch_equal_days(spark):
    frame = spark.createDataFrame([(datetime(2024, 1, 1 + i % 3, 23, 59, 59, 999999),) for i in range(7)], "closed_at TIMESTAMP_NTZ")
    assert {r.day: r["count"] for r in windowed_counts(frame).collect()} == {date(2024, 1, 1): 3, date(2024, 1, 2): 2, date(2024, 1, 3): 2}


def lines(spark, *rows):
    data = [(pos, json.dumps({"hubspot_ticket_id": key, "subject": f"{key}{pos}", "closed_at": "2024-01-03T12:00:00"})) for pos, key in rows]
    return spark.createDataFrame(data, "pos LONG, line STRING")


def subjects(spark, base):
    stored = ingest.read_ingested(spark, base)
    got = stored.select("hubspot_ticket_id", "subject").collect()
    assert len({r.hubspot_ticket_id for r in got}) == len(got)
    return {r.hubspot_ticket_id: r.subject for r in got}


def test_ids_in_state_keep_the_first_line(spark, tmp_path):
    landing, base, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "cp"))

    def run(*rows, within=timedelta(days=1)):
        lines(spark, *rows).repartition(3).write.mode("append").json(landing)
        stream_ingest_within(read_line_stream(spark, landing), base, checkpoint, within).awaitTermination()
        return subjects(spark, base)

    assert run((7, "a"), (3, "a"), (5, "b"), (9, "a"), (4, "")) == {"a": "a3", "b": "b5"}
    assert run((1, "a"), (2, "c"), (6, "b")) == {"a": "a3", "b": "b5", "c": "c2"}
    assert not (tmp_path / "store" / "keys").exists()
    assert [r.inserted for r in ingest.ingest_counts(spark, base).orderBy("ingest_id").collect()] == [2, 1]
    stream_rejects(read_line_stream(spark, landing), str(tmp_path / "bad"), str(tmp_path / "cp2")).awaitTermination()
    assert [r.pos for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [4]


def test_ids_leave_the_state_after_their_time(spark, tmp_path):
    landing, base, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "cp"))

    def run(*rows):
        lines(spark, *rows).write.mode("append").json(landing)
        stream_ingest_within(read_line_stream(spark, landing), base, checkpoint, timedelta(seconds=1)).awaitTermination()

    run((1, "a"))
    time.sleep(1.5)
    run((2, "b"))  # time goes on, a expires
    time.sleep(1.5)
    run((3, "a"))
    stored = spark.read.schema(ingest.STORED).parquet(f"{base}/tickets")
    assert sorted(r.pos for r in ingest.finished(stored, base).collect()) == [1, 2, 3]


def stop_after_tickets(monkeypatch):
    """An ingest that loses its driver once its tickets are stored."""

    def stopped(valid, base, ingest_id, store=ingest.store_new_tickets):
        store(valid, base, ingest_id)
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest, "store_new_tickets", stopped)


def test_a_stopped_ingest_is_not_seen_and_bars_the_next(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    first, second = lines(spark, (0, "a"), (1, "b")), lines(spark, (0, "b"), (1, "c"))
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        stop_after_tickets(patch)
        ingest.ingest_lines(first, base, 0)
    assert tickets.read_tickets(spark, f"{base}/tickets").count() == 2  # they are there, but
    assert subjects(spark, base) == {}
    with pytest.raises(ingest.UnfinishedIngestError, match="ingest 0 "):
        ingest.ingest_lines(second, base, 1)
    ingest.ingest_lines(first, base, 0)
    ingest.ingest_lines(second, base, 1)
    assert subjects(spark, base) == {"a": "a0", "b": "b1", "c": "c1"}
    ingest.ingest_lines(second, base, 1)  # a finished one may be run again
    assert tickets.read_tickets(spark, f"{base}/tickets").count() == 3


def test_a_stopped_stream_replays_its_batch(spark, tmp_path, monkeypatch):
    landing, base, checkpoint = (str(tmp_path / n) for n in ("landing", "store", "cp"))
    lines(spark, (0, "a"), (1, "b")).write.json(landing)
    with monkeypatch.context() as patch, pytest.raises(Exception, match=r"(?s)KeyboardInterrupt|Stopped|STREAM_FAILED"):
        patch.setattr(ingest, "finish_ingest", lambda *_: 1 / 0)
        stream_ingest(read_line_stream(spark, landing), base, checkpoint).awaitTermination()
    assert subjects(spark, base) == {}
    lines(spark, (2, "b"), (3, "c")).write.mode("append").json(landing)
    stream_ingest(read_line_stream(spark, landing), base, checkpoint).awaitTermination()
    assert subjects(spark, base) == {"a": "a0", "b": "b1", "c": "c3"}


def test_loaded_tickets_are_seen_beside_finished_ingests(spark, tmp_path):
    base = str(tmp_path)
    valid, _ = batches.parse_tickets(lines(spark, (0, "x")))
    tickets.write_tickets(valid, f"{base}/tickets")
    ingest.ingest_lines(lines(spark, (0, "a")), base, 0)
    assert subjects(spark, base) == {"x": "x0", "a": "a0"}


def test_rows_are_numbered_in_their_order(spark, capsys):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    ordered = numbered(rows.orderBy(F.desc("v")))
    ordered.explain()
    assert "Window" not in capsys.readouterr().out
    assert {(r.v, r.position) for r in ordered.collect()} == {(v, 1000 - v) for v in range(1000)}
    assert numbered(rows.where("v < 0").orderBy("v")).collect() == []


def test_written_lines_are_read_in_file_order(spark, tmp_path):
    valid, _ = batches.parse_tickets(lines(spark, *((i, f"k{i:03}") for i in range(300))))
    docs = documents.export_documents(valid, "2024-01-01").repartitionByRange(5, "id").sortWithinPartitions("id")
    documents.write_documents(docs, str(tmp_path / "docs"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [json.loads(r.line)["id"] for r in documents.read_document_lines(spark, str(tmp_path / "docs")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"k{i:03}" for i in range(300)]

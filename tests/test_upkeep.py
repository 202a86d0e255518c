"""Merging of the key table and reports from daily partials."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketmill.operators import ingest, partials as stored
from ticketmill.operators.ingest import TICKET_KEY
from ticketmill.plans import counts, partials, resolution, volume
from ticketmill.sources.schemas import TICKET_LINES, TICKETS

INGESTS = 72


def lines(spark, ids):
    rows = [(i, '{"hubspot_ticket_id": "%s", "closed_at": "2024-01-03T10:00:00"}' % x) for i, x in enumerate(ids)]
    return spark.createDataFrame(rows, TICKET_LINES)


def many_ingests(spark, base, first=0, last=INGESTS):
    """The keys and counts of finished ingests; ingest n brought the keys n-0 to n-2."""
    ids = spark.range(first, last).withColumnRenamed("id", "ingest_id")
    keys = ids.select("ingest_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    keys = keys.select(F.concat_ws("-", "ingest_id", "k").alias(TICKET_KEY), F.lit(0).alias("tier"), F.expr("ingest_id DIV 4").alias("grp"), "ingest_id")
    ingest.write_keys(keys.withColumn("key_bucket", F.expr(f"CAST(pmod(xxhash64({TICKET_KEY}), {ingest.KEY_BUCKETS}) AS INT)")).select(*ingest.KEYS.fieldNames()), f"{base}/keys")
    done = ids.selectExpr("3L AS inserted", "0L AS skipped", "0L AS duplicate", "3L AS total_processed", "ingest_id")
    done.repartition(1).write.mode("append").partitionBy("ingest_id").parquet(f"{base}/counts")


def known(spark, base, upto=INGESTS):
    asked = spark.range(2000).select(F.concat_ws("-", "id", F.lit(1)).alias(TICKET_KEY))
    every = ingest.keys_before(asked, f"{base}/keys", upto)
    return sorted(r[0] for r in every.collect())


def files(base):
    return sum(1 for _ in Path(base, "keys").rglob("*.parquet"))


def test_merged_keys_are_the_same_keys(spark, tmp_path):
    base = str(tmp_path)
    many_ingests(spark, base)
    before, count = known(spark, base), files(base)
    assert len(before) == 3 * INGESTS
    ingest.merge_keys(spark, base, fan=4)
    assert known(spark, base) == before
    assert ingest.merged_below(spark, f"{base}/keys") == [68, 64, 64]
    assert files(base) <= 2 * ingest.KEY_BUCKETS + 4 * 3 and files(base) < count
    left = files(base)
    ingest.merge_keys(spark, base, fan=4)
    assert known(spark, base) == before and files(base) == left
    many_ingests(spark, base, INGESTS, 82)
    ingest.merge_keys(spark, base, fan=4)
    assert ingest.merged_below(spark, f"{base}/keys") == [80, 80, 64]
    assert known(spark, base, 82) == sorted(f"{n}-{k}" for n in range(82) for k in range(3))


@pytest.mark.parametrize("stop", ["before the mark", "after the mark"])
def test_a_stopped_merge_goes_on(spark, tmp_path, monkeypatch, stop):
    base = str(tmp_path)
    many_ingests(spark, base, 0, 40)
    before = known(spark, base)

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        if stop == "after the mark":
            patch.setattr(ingest, "_empty_groups", stopped)
        else:
            patch.setattr(ingest, "MERGES", "no schema")
        with pytest.raises(Exception):  # noqa: B017
            ingest.merge_keys(spark, base, fan=4)
    assert known(spark, base) == before
    ingest.merge_keys(spark, base, fan=4)
    assert known(spark, base) == before
    assert files(base) <= 4 * ingest.KEY_BUCKETS + 4 * 3


def test_ingests_merge_and_still_know_their_keys(spark, tmp_path):
    base = str(tmp_path)
    given = [["a", "b"], ["b", "c"], ["a", "d"], ["c", "d", "e"], ["e", "f"]]
    for number, ids in enumerate(given):
        ingest.ingest_lines(lines(spark, ids), base, number, fan=2)
    assert ingest.merged_below(spark, f"{base}/keys") == [4, 4]
    table = ingest.read_ingested(spark, base)
    assert sorted(r[0] for r in table.select(TICKET_KEY).collect()) == ["a", "b", "c", "d", "e", "f"]
    ingest.ingest_lines(lines(spark, given[4]), base, 4, fan=2)  # the last one may run again
    assert ingest.read_ingested(spark, base).count() == 6
    with pytest.raises(ValueError, match="merged"):
        ingest.ingest_lines(lines(spark, ["z"]), base, 1, fan=2)


def test_partials_of_unfinished_ingests_do_not_show(spark, tmp_path):
    base = str(tmp_path)
    ingest.ingest_lines(lines(spark, ["a", "b"]), base, 0)
    stored.write_partials(ingest.read_ingested(spark, base), f"{base}/partials", 1)
    seen = ingest.read_ingested_partials(spark, base)
    assert partials.closed_total(seen, "2024-01-01", "2024-01-31").first()[0] == 2


def random_tickets(spark, n):
    rng = random.Random(n)
    blank = [None, "", "  ", "x", " x", "y"]
    rows = []
    for i in range(n):
        created = rng.choice([None, datetime(2024, 1, rng.randrange(1, 28), rng.randrange(24), rng.randrange(60))])
        closed = rng.choice([None, datetime(2024, rng.randrange(1, 3), rng.randrange(1, 28), rng.randrange(24))])
        rows.append((str(i), created, closed, *(rng.choice(blank) for _ in range(5))))
    names = f"{TICKET_KEY} STRING, created_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ, source STRING, category STRING, subcategory STRING, owner_id STRING, owner_name STRING"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("n", [0, 300])
def test_reports_from_partials_equal_those_from_tickets(spark, tmp_path, n):
    path = str(tmp_path / "partials")
    tickets = random_tickets(spark, n)
    for part in range(2):
        for _ in range(2):  # the second run replaces the first
            stored.write_partials(tickets.where(F.col(TICKET_KEY).cast("int") % 2 == part), path, part)
    kept = stored.read_partials(spark, path) if n else spark.createDataFrame([], stored.PARTIALS)
    for days in (("2024-01-01", "2024-03-31"), ("2024-01-10", "2024-01-12"), ("2030-01-01", "2030-01-01")):
        for of, names in (
            (counts, ("top_categories", "tickets_by_source", "top_agents", "top_subcategories")),
            (volume, ("closed_total", "closed_daily", "closed_monthly")),
            (resolution, ("resolution_by_agent", "resolution_by_source", "resolution_overall")),
        ):
            for name in names:
                expected = getattr(of, name)(tickets, *days)
                got = getattr(partials, name)(kept, *days)
                assert got.columns == expected.columns and got.collect() == expected.collect(), (name, days)
    assert TICKETS[TICKET_KEY].name in tickets.columns


def test_days_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "partials")
    stored.write_partials(random_tickets(spark, 50), path, 0)
    plan = partials.top_agents(stored.read_partials(spark, path), "2024-01-01", "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "kind" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(day,2024-01-01)" in plan.replace(" ", "")

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import by_order, rows_of
from ticketmill.llm import contamination, mixing, toxicity
from ticketmill.llm.common import read_table
from ticketmill.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def items(spark, odd):
    texts = dict(rows_of(odd.filter("doc_id IS NOT NULL")))
    cut = texts[9].split()
    rows = [(1, " ".join(cut[5000:5040])), (2, texts[3]), (3, texts[5].upper()), (4, None), (5, ""), (6, "..."), (7, "one two"), (8, " ".join(cut[10:14])), (9, "not in any text at all here")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contained_items_equal_brute_force(odd, items):
    expected = {(i, tuple(brute.contained(t, [tuple(x) for x in items.collect()]))) for i, t in rows_of(odd.filter("doc_id IS NOT NULL"))}
    got = {(r.doc_id, tuple(r["items"])) for r in contamination.decontaminate(odd, items).filter("doc_id IS NOT NULL").collect()}
    assert got == expected
    assert sum(len(x) for _, x in expected) >= 6


def test_slices_of_items_give_the_same(odd, items, monkeypatch):
    whole = by_order(contamination.contained_items(odd, items).collect())
    monkeypatch.setattr(contamination, "SLICE_ITEMS", 2)
    assert by_order(contamination.contained_items(odd, items).collect()) == whole


def test_short_items_in_long_texts_are_found(spark):
    """Recall on items of 20 to 60 words inside a text of 20,000."""
    words = [f"w{i * 7919 % 100003}" for i in range(20000)]
    items = [(i, " ".join(words[i * 90 : i * 90 + 20 + i % 40])) for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = contamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).count()
    assert got == 200


def test_items_under_five_words_are_found_inside_texts(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = [(1, " ".join([*words[:2000], "Capital of  France: PARIS", *words[2000:]])), (2, "capital of France"), (3, "of France"), (4, "France Paris of capital"), (5, None)]
    items = [(1, "capital of France Paris"), (2, "capital of France"), (3, "Of france"), (4, "paris"), (5, "paris"), (6, ""), (7, "Paris of France")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contamination.decontaminate(docs, items).collect()}
    assert got == {1: [1, 2, 3, 4, 5], 2: [2, 3], 3: [3], 4: [4, 5], 5: []}
    assert [r.doc_id for r in contamination.without_contaminated(docs, items).collect()] == [5]


def test_empty_decontamination(odd, nothing, items):
    assert contamination.decontaminate(nothing, items).collect() == []
    assert contamination.decontaminate(odd, items.limit(0)).filter("contaminated").collect() == []
    assert contamination.without_contaminated(odd, items.limit(0)).count() == odd.count()


@pytest.mark.parametrize("ranges", [mixing.RANGES, 4])
def test_mix_meets_targets(odd, ranges, monkeypatch):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = [r.asDict() for r in mixing.mix_documents(odd).collect()]
    sizes = {}
    for s, t in [(r.source, r.text) for r in odd.collect()]:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, brute.water_filled([sizes[s] for s in order]), strict=True))
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(r["target"] == pytest.approx(targets[s]) for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(targets[s], abs=1)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and len(rows) == odd.count()
    again = [r.asDict() for r in mixing.mix_documents(odd.repartition(2)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_heavier_documents_are_taken_sooner(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    taken = mixing.mix(rows, total=0.3).filter("taken > 0").collect()
    heavy = sum(r.doc_id % 2 == 0 for r in taken)
    assert len(taken) == pytest.approx(1200, abs=2) and heavy > 0.7 * len(taken)


def test_empty_mix(nothing):
    assert mixing.mix_documents(nothing).collect() == []


@tables
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    for name, sql in ORACLES.items():
        frame, result = QUERIES[name](spark, SF_DIR), con.execute(sql)
        columns = [x[0] for x in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert by_order(frame.select(*columns).collect()) == by_order(result.fetchall())


@tables
def test_pipeline_stages_on_the_smallest_tables(spark):
    docs, stages = read_table(spark, SF_DIR, "documents"), dict(corpus_pipeline.STAGES)
    names = docs.columns
    labels = read_table(spark, SF_DIR, "labels")
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).filter("predicted = 1").collect()}

    first = stages["toxicity"](spark, docs, SF_DIR)
    rows = rows_of(first)
    assert by_order(rows) == by_order(r for r in rows_of(docs) if r[0] not in toxic)
    second = stages["line_dedup"](spark, first, SF_DIR).cache()
    assert by_order(rows_of(second)) == by_order((i, t) for i, t, *_ in brute.lines(rows))
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = stages["near_dedup"](spark, second, SF_DIR).cache()
    assert sorted(i for i, _ in rows_of(third)) == sorted({c for _, _, c in brute.simhash(rows_of(second))})
    fourth = stages["decontamination"](spark, third, SF_DIR).cache()
    items = [tuple(r) for r in read_table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
    assert by_order(rows_of(fourth)) == by_order((i, t) for i, t in rows_of(third) if not brute.contained(t, items))
    assert names == first.columns == second.columns == third.columns == fourth.columns
    last = stages["mixing"](spark, fourth, SF_DIR).collect()
    assert {r.doc_id for r in last} <= {i for i, _ in rows_of(fourth)} and all(0 < r.taken <= 2 * r["size"] for r in last)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert by_order((r.doc_id, r.taken) for r in whole) == by_order((r.doc_id, r.taken) for r in last)


def test_pipeline_stages_on_odd_rows(spark, odd, nothing, tmp_path):
    docs = odd.drop("size")  # which the last stage adds
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that is anywhere in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, nothing.select(docs.columns)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path)).cache()
            assert rows.columns == docs.columns or name == "mixing"
            assert rows.where("n_removed <> 'w' OR mark < 0 OR block <> 'x'").isEmpty()
        assert (rows.count() > 0) == (start is docs)
        assert rows.columns[: len(docs.columns)] == docs.columns

"""Repeated keys in table maintenance, registries and streams."""

from pyspark.sql import functions as F

from folioframe.operators import catalog, linkage, merge
from folioframe.streaming import running


def test_upsert_keeps_the_last_of_repeated_keys(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    changes = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1), ("c", 5, 0)], "k string, v int, at int")
    assert sorted(map(tuple, catalog.upsert(current, changes, ["k"], "at").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_attachments_that_come_in_twice_are_one_row(spark):
    schema = "entry_id long, path string, pos int, title string, artifacts map<string,string>"
    current = spark.createDataFrame([(1, "x", 0, "old", {"a": "1"})], schema)
    incoming = spark.createDataFrame([(1, "x", 1, "new", {"b": "2"}), (1, "x", 2, "", {"b": "3", "c": None})], schema)
    rows = catalog.upsert_attachments(current, incoming, ["title"]).collect()
    assert [(r.title, r.pos, r.artifacts["a"], r.artifacts["b"]) for r in rows] == [("new", 0, "1", "3")]


def test_registry_that_repeats_a_doi_answers_once(spark):
    asked = spark.createDataFrame([(1, "10.1/a"), (2, None), (3, "10.1/z")], "entry_id long, doi string")
    registry = spark.createDataFrame([("10.1/a", "one"), ("10.1/a", "two"), (None, "none")], "doi string, title string")
    rows = sorted(merge.registry_by_doi(asked, [("r", registry)]).select("entry_id", "registry", "record.title").collect())
    assert [(r.entry_id, r.registry) for r in rows] == [(1, "r"), (2, None), (3, None)] and rows[0].title == "one"


def test_title_match_refuses_authors_without_a_latin_name(spark):
    schema = "query_id long, title string, authors array<string>"
    queries = spark.createDataFrame([(1, "Quantum Walks Graphs", ["李浩"]), (2, "Quantum Walks Graphs", None), (3, "Quantum Walks Graphs", ["Ada Ray"])], schema)
    registry = spark.createDataFrame([(10 + i, i, "Quantum Walks Graphs", ["B Ray"]) for i in range(500)], "record_id long, ord int, title string, authors array<string>")
    rows = linkage.jaccard_matches(queries, registry).collect()
    assert sorted((r.query_id, r.record_id) for r in rows) == [(2, 10), (3, 10)]


def test_stream_state_goes_after_the_watermark(spark, tmp_path):
    schema = "session_id long, ts timestamp"
    batches = ["2024-01-01 10:00", "2024-01-01 11:00"], ["2024-01-09 10:00"], ["2024-01-10 10:00", "2024-01-01 12:00"]
    for n, times in enumerate(batches):
        rows = spark.createDataFrame([(1, t) for t in times], "session_id long, t string").select("session_id", F.to_timestamp("t").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = running.file_stream(spark, str(tmp_path / "in"), rows.schema, "*.parquet")
        query = running.keep_changes(running.running_sessions(stream), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None
    total = running.session_totals(spark, str(tmp_path / "out")).first()
    assert total.message_count == 4  # the late row came after its day was closed
    assert held <= 2

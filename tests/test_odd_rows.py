"""Queries against DuckDB on rows that the smallest data does not have."""

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import oracle

GIVEN = Path("/root/testdata/sf0.001")


def folder_with(spark, path, rows, files=0):
    """The smallest data with other documents, in one file or in a folder of `files`."""
    schema = spark.read.parquet(f"{GIVEN}/documents.parquet").schema
    table = spark.createDataFrame([(i, text, "en", "src1", len(text)) for i, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table = table.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    for name in oracle.TABLES:
        if name != "documents":
            os.symlink(GIVEN / f"{name}.parquet", path / f"{name}.parquet")
    if files:
        table.repartition(files).write.parquet(f"{path}/documents.parquet")
    else:
        table.toPandas().to_parquet(path / "documents.parquet", index=False)
    return str(path)


ROWS = [
    (0, "Xx undbeßein aa. Rest"), (1, "Der Spieß ist Groß"), (2, "+1 (744) call"), (3, "Call (235) 555-2058 un"), (4, 'token = "9885103314b39ed955fd8ac9efa74c" here'),
    (6, "é9885103314 und 9885103315é, 9885103316,9885103317"), (7, "ISBN 123456789,1234567890"), (8, "1 2  3, 4 5  6"), (9, "Prices 2058 2001 abstract 1999"), (12, ", 1 2,3 4  5†6 7"),
]


@pytest.mark.parametrize("key", ["clean_authors", "extract_isbn", "spaced_header", "year_extract"])
def test_odd_text(spark, tmp_path, key):
    folder = folder_with(spark, tmp_path, ROWS)
    assert oracle.compare(spark, oracle.connect(folder), key, folder)[0] is None


def same_arxiv_id(body):
    """Two texts, of unlike length and order, whose hashes give one arXiv id."""
    seen = {}
    for i in range(400_000):
        text = body(i)
        arxiv = hashlib.md5(text.encode()).hexdigest().translate(str.maketrans("abcdef", "012345"))[:9]
        if (other := seen.setdefault(arxiv, text)) != text and (len(other) < len(text)) == (other > text):
            return other, text
    raise AssertionError("no pair found")


def test_two_records_of_one_arxiv_id(spark, tmp_path):
    one, other = same_arxiv_id(lambda i: f"{i * 7919 % 400_000} notes" + "x" * (i % 5))
    folder = folder_with(spark, tmp_path, [(0, one), (8, other)])
    assert oracle.compare(spark, oracle.connect(folder), "identify_waterfall", folder)[0] is None


def test_records_of_one_arxiv_id_stay_apart(spark, tmp_path):
    one, other = same_arxiv_id(lambda i: f"{i * 7919 % 400_000:06d} note" + "x" * (11 * (i % 5)))
    folder = folder_with(spark, tmp_path, [(0, one), (8, other)])
    assert oracle.compare(spark, oracle.connect(folder), "registry_arxiv", folder)[0] is None


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    folder = folder_with(spark, tmp_path / "in", ROWS, files=3)
    os.unlink(f"{folder}/conversations.parquet")
    turns = spark.read.parquet(f"{GIVEN}/conversations.parquet")
    turns.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    found = oracle.app.queries()["stream_intake"](spark, folder).collect()
    assert sorted(r.entry_id for r in found) == [i for i, _ in ROWS]
    counted = {r.session_id: r.message_count for r in oracle.app.queries()["stream_sessions"](spark, folder).collect()}
    assert counted == {r.conv_id: r["count"] for r in turns.groupBy("conv_id").count().collect()}

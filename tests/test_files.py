"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from folioframe.sources import files, records, registries, textfiles


def test_index_and_logs(spark, tmp_path):
    entry = {"id": "e1", "title": "T", "publicationTitle": "J", "year": "c. 2001", "authors": ["Roe, Ann"], "editors": ["Bob Doe"], "note": "x"}
    index = {"version": 3, "entries": {"e1": entry, "bad": 5}, "mappings": {"a/b.pdf": {"status": "organized", "entryId": "e1"}}}
    (tmp_path / "index.json").write_text(json.dumps(index))
    read = records.read_index(spark, str(tmp_path / "index.json"))
    rows = records.index_entries(read).collect()
    assert [(r.id, r.publication_title, r.year, r.extra["note"]) for r in rows] == [("e1", "J", 2001, "x")]
    assert [(c.family, c.creator_type) for c in rows[0].creators] == [("Roe", "author"), ("Doe", "editor")]
    assert [(r.rel, r.entry_id) for r in records.index_mappings(read).collect()] == [("a/b.pdf", "e1")]
    (tmp_path / "s1.jsonl").write_text('{"ts":"1","role":"user","content":"hi","k":"v"}\nnot json\n[1]\n')
    rows = records.read_messages(spark, str(tmp_path / "s1.jsonl")).collect()
    assert [(r.session_id, r.role, r.content, r.extra) for r in rows] == [("s1", "user", "hi", {"k": "v"})]


def test_atom_inventory_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.pdf").write_bytes(b"%PDF")
    rows = files.read_inventory(spark, str(tmp_path / "in")).collect()
    assert [(r.rel, r.size) for r in rows] == [("sub/a.pdf", 4)]
    atom = "<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  B</title><published>2021-01-01</published><author><name>Ann Roe</name></author></entry></feed>"
    (tmp_path / "feed.xml").write_text(atom)
    row = registries.read_arxiv(spark, str(tmp_path / "feed.xml")).first()
    assert (row.title, row.arxiv_id, row.year, row.creators[0].family) == ("A B", "2101.00001", 2021, "Roe")
    df = records.bibtex_record(spark.createDataFrame([("k1", "book", "T {x}", "f1")], "cite_key string, item_type string, title string, folder string"))
    records.write_bibtex(df, str(tmp_path / "out.bib"))
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(str(tmp_path / "out.bib")).collect())
    assert text.startswith("@book{k1,\n  title = {T \\{x\\}},\n}")
    for _ in range(2):  # a second run leaves the same files
        records.write_citation_bundles(df.unionByName(df.withColumns({"cite_key": F.lit("k0"), "bibtex": F.lit("@book{k0,}")})), str(tmp_path / "bundles"))
        assert [p.name for p in (tmp_path / "bundles" / "f1").iterdir()] == ["citation.bib"]
    assert (tmp_path / "bundles" / "f1" / "citation.bib").read_text() == "@book{k0,}\n\n@book{k1,\n  title = {T \\{x\\}},\n}\n"
    assert not [p for p in (tmp_path / "bundles").iterdir() if p.name.startswith(".drafts")]
    documents = spark.createDataFrame([(f"d{i % 7}/t{i}.md", f"text {i} ü") for i in range(50)] + [("empty.md", None)], "target string, text string")
    records.write_rendered(documents, str(tmp_path / "docs"))
    found = {str(p.relative_to(tmp_path / "docs")): p.read_text() for p in (tmp_path / "docs").rglob("*.md")}
    assert found == {r.target: r.text or "" for r in documents.collect()}
    records.write_rendered(documents.limit(0), str(tmp_path / "docs"))
    records.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_files_stay_below_their_root(spark, tmp_path):
    for target in (None, "", "/etc/x", "a/../../x", "a//b", ".", ".drafts-x/y"):
        with pytest.raises(Exception, match="not a path below the root"):
            textfiles.write_files(spark.createDataFrame([("ok.md", "x"), (target, "x")], "target string, part string"), str(tmp_path / "root"))
    assert not [p for p in (tmp_path / "root").rglob("*") if p.name.startswith(".drafts")]

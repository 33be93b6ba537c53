"""The Merkle manifest, licence scans and hard negatives against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from folioframe.llm import bitpack, licences, merkle, negatives
from folioframe.llm.queries import BYTE_BPE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """(root, siblings of each node) of a list of digests."""
    proofs = [[] for _ in level]
    place = list(range(len(level)))
    while len(level) > 1:
        for n, p in enumerate(place):
            run = p // 16 * 16
            proofs[n] += [h for i, h in enumerate(level[run : run + 16], run) if i != p]
        level = [sha("".join(level[at : at + 16])) for at in range(0, len(level), 16)]
        place = [p // 16 for p in place]
    return level[0], proofs


def test_midstates_equal_the_library():
    turn = random.Random(1)
    for count in (1, 2, 15, 16):
        kids = np.frombuffer(turn.randbytes(32 * count), np.uint8).reshape(count, 32)
        full = np.zeros((1, 16, 32), np.uint8)
        full[0, :count] = kids
        state = np.array([merkle.START])
        for place in range(count):
            new = np.frombuffer(turn.randbytes(32), np.uint8).reshape(1, 32)
            found = merkle.fold(state, new, full, np.array([place]), np.array([count]))[0].tobytes().hex()
            texts = [k.tobytes().hex() for k in kids]
            assert found == sha("".join(texts[:place] + [new.tobytes().hex()] + texts[place + 1 :]))
            state = merkle.compress(state, merkle.text_block(kids[place : place + 1]))


@pytest.mark.parametrize("count", [0, 1, 5, 900])
def test_manifest_equals_brute_force(spark, count):
    turn = random.Random(count)
    # One source holds two thirds of the rows; nulls, repeated rows and keys, empty and long texts.
    rows = [(i if turn.random() < 0.9 else turn.choice([None, 7, 7, 12]), turn.choice(["hot"] * 9 + [None, "", "ä", "Z", "z9"]), turn.choice(["en", None]),
             turn.choice([None, 3]), turn.choice([None, "", "Ärger AND Text", "low", "X" * 50_000])) for i in range(count)]
    rows += rows[:40]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as number", "'x' as digest", "3 as run", "4 as at")
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots = [climb([x[2] for x in sorted(trees[s])]) for s in order]
    root, tops = climb([r for r, _ in roots]) if roots else ("", [])
    expected = []
    for (subroot, proofs), top, source in zip(roots, tops, order, strict=True):
        for (_, _, own, row), proof in zip(sorted(trees[source]), proofs, strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None and row[4] != re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
            expected.append((row[0], own, subroot, root, sha("".join(proof + top)), not changed))
    found = merkle.check_documents(table).collect()
    assert sorted(map(str, [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in found])) == sorted(map(str, expected))
    assert all((r.folded_root == r.root) == r.verified for r in found)


def test_folded_root_is_that_of_the_changed_table(spark):
    rows = [(i, f"s{i % 40}", "en", 3, f"Text {i}") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for at in (0, 17, 399):
        one = merkle.check_documents(table, F.col("doc_id") == at).where(f"doc_id = {at}").first()
        new = table.withColumn("text", F.when(F.col("doc_id") == at, F.lower("text")).otherwise(F.col("text")))
        assert one.folded_root == merkle.check_documents(new, F.lit(False)).first().root != one.root


def longest(words, at, sequences):
    """Length of the longest stretch of a sequence that ends at a word."""
    texts = [" ".join(["", *s, ""]) for s in sequences]
    length = 0
    while length <= at and any(" ".join(["", *words[at - length : at + 1], ""]) in t for t in texts):
        length += 1
    return length


def test_matching_statistics_equal_brute_force():
    turn = random.Random(2)
    for _ in range(60):
        sequences = [[turn.randrange(3) for _ in range(turn.randint(1, 14))] for _ in range(turn.randint(1, 5))]
        automaton = licences.SuffixAutomaton(sequences)
        words = [turn.randrange(3) for _ in range(60)]
        state = length = 0
        for at in range(len(words)):
            state, length = automaton.step(state, length, words[at])
            assert length == longest([*map(str, words)], at, [[*map(str, s)] for s in sequences])
            ends = {(n, p) for n, s in enumerate(sequences) for p in range(length, len(s) + 1) if length and s[p - length : p] == words[at - length + 1 : at + 1]}
            assert ends == set(automaton.ends(state)) if length else True


def test_phrases_equal_brute_force(spark):
    turn = random.Random(3)
    pool = ["mit", "license", "apache", "general", "public", "GNU", "MIT", "License", "Lizenz", "übung", "2", "ſ", "K"]
    texts = ["".join(turn.choice(pool) + turn.choice([" ", "\n", "-", "_", "{", "\x7f", "  ", "\0"]) for _ in range(turn.randint(0, 90))) for _ in range(150)]
    texts += [None, "", "MIT LICENSE", "general public license " * 30_000]
    table = spark.createDataFrame([*enumerate(texts), (None, "mit license")], "doc_id long, text string").selectExpr("*", "1 as id", "2 as places")
    assert licences.scan(table.limit(0)).count() == 0
    rows = {r.doc_id: r for r in licences.scan(table).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        expected = [(label, at) for phrase, label in licences.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        assert rows[i].n_words == len(words)
        assert sorted(tuple(p) for p in rows[i].places) == sorted(expected)
    assert len(rows[None].places) == 1
    assert rows[150].n_words == 0 and rows[150].places == [] and rows[150].spans == [] and rows[150].best == 0.0


def test_template_spans(spark):
    filler = "lorem ipsum dolor sit amet " * 20
    mit, bsd = (next(t for label, t in licences.TEMPLATES if label == name and len(t) > 200) for name in ("mit", "bsd"))
    worn = bsd.split()
    for at in (10, 25, 40):
        worn[at : at + 1] = ["changed", "wording"]
    cases = [
        filler + mit.upper() + filler, filler + " ".join(worn) + filler, filler + "Licensed under CC BY-NC 4.0.\n" * 3 + filler, filler + "Licensed under CC BY 4.0." + filler,
        filler, mit[: len(mit) // 2], "* ".join(mit.split()), "the software and associated documentation of this work is licensed to any person",
    ]
    table = spark.createDataFrame([*enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan(table).collect()}
    labels = {i: [s.label for s in r.spans] for i, r in rows.items()}
    assert labels == {0: ["mit"], 1: ["bsd"], 2: ["cc-by-nc"] * 3, 3: ["cc-by"], 4: [], 5: [], 6: ["mit"], 7: []}
    assert rows[0].spans[0].start == 100 and rows[0].spans[0].stop - 100 == len(licences.words(mit.encode())) and rows[0].best == rows[0].spans[0].cover == 1.0
    assert 0.8 <= rows[1].best < 1 and 0.4 < rows[5].best < 0.6 and rows[4].best == 0.0
    assert [(s.start, s.stop) for s in rows[2].spans] == [(100, 107), (107, 114), (114, 121)]


def best_chain(pieces, gap):
    """The most words that a chain of anchors covers, by trying every chain."""

    def after(n):
        start, place, length = pieces[n]
        options = [0]
        for m, (start2, place2, length2) in enumerate(pieces):
            behind, ahead = start2 - start - length, place2 - place - length
            overlap = max(0, -behind, -ahead)
            if start < start2 and place < place2 and behind <= gap and ahead <= gap and overlap < length2:
                options.append(length2 - overlap + after(m))
        return max(options)

    return max(pieces[n][2] + after(n) for n in range(len(pieces)))


def test_chains_equal_brute_force():
    scanner = licences.Scanner(licences.TEMPLATES, licences.PHRASES, 3, 4, 0.8)
    turn = random.Random(5)
    for _ in range(300):
        pieces = [(turn.randrange(30), turn.randrange(30), turn.randint(1, 6)) for _ in range(turn.randint(1, 7))]
        assert max(c for c, _, _ in scanner._linked(pieces.copy())) == best_chain(sorted(pieces), 4)


@pytest.mark.parametrize("top", [1.0, 1e30])
def test_negatives_equal_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(negatives, "CANDIDATES", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "STRIP", 2)
    turn = np.random.default_rng(1)
    rows = [(i, v.tolist(), int(turn.integers(0, 3))) for i, v in enumerate(np.round(turn.normal(size=(1200, 4)) + 0.5, 1))]  # many ties
    rows += [(r[0] + 1200, r[1], 0) for r in rows[:200]]
    if top > 1:
        rows += [(1500, [top] * 4, 0), (1600, [-top, 0.0, 0.0, 1.0], 1)]
    odd = [(2000, None, 1), (2100, [1.0, None, 0.0, 0.0], 1), (2200, [float("nan")] * 4, 1), (2300, [float("inf")] * 4, 0), (2400, [], 1), (2500, [1.0] * 4, None),
           (2600, [0.0] * 4, 1), (2700, [1.0, 2.0], 1), (2800, [-3.0, -3.0, -3.0, -3.0], 7), (2801, [3.0] * 4, 7), (None, [1.0] * 4, 1), rows[100]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as length", "3 as known")
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    whole = {i: ([int(np.floor(256 * x)) for x in v], label) for i, v, label in rows + odd if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for a, (v, label) in whole.items():
        if a % 100 == 0:
            scored = sorted((-hold(sum(x * y for x, y in zip(v, w, strict=True))), i, other == label) for i, (w, other) in whole.items() if i != a and len(w) == len(v))
            for below, p, _ in [s for s in scored if s[2]][:5]:
                inside = [(s, i) for s, i, same in scored if not same and 30 * -below <= 100 * -s <= 90 * -below]
                expected |= {(a, p, n, i, -below, -s) for n, (s, i) in enumerate(inside[:10], 1)}
    found = negatives.mine(table).collect()
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == expected and expected
    assert negatives.mine(table.limit(0)).count() == 0


@pytest.mark.parametrize("key", ["op11_merkle", "op13_negatives"])
def test_query_equals_its_sql(spark, key):
    folder = "/root/testdata/sf0.001"
    difference, _ = oracle.compare(spark, oracle.connect(folder), key, folder)
    assert not difference or difference.startswith(" ")


def test_licence_notes_of_the_documents_are_labelled(spark):
    rows = oracle.app.queries()["op12_licences"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id")
    notes = {"CC BY-NC 4.0": "cc-by-nc", "MIT License": "mit", "Apache License": "apache", "General Public License": "gpl"}
    for row in rows.collect():
        assert row.labels.split(",") == (sorted(v for k, v in notes.items() if k in (row.text or "")) or [""])
        assert row.score == 1.0 if row.labels else row.score < 0.8


def test_shards_begin_where_the_sizes_say(spark, tmp_path):
    """Many small shards: keys ascend over all files, nulls first, a repeated key is spread by its texts, nothing is lost."""
    turn = random.Random(7)
    rows = [(turn.choice([None, 5, 5, 5, i, -i]), turn.choice(["", None, "word " * turn.randint(1, 60), f"text {i}"])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as tie", "3 as shard").repartition(5)
    files = bitpack.write_shards(table, lambda: bitpack.ByteEncoder(BYTE_BPE).encode, 50257, 2, f"file://{tmp_path}/t", shard_bytes=500)
    assert files.count() > 10 and files.agg(F.sum("documents")).first()[0] == 400
    back = bitpack.read_shards(files).orderBy("start", F.length("ids")).collect()
    assert [r.id for r in back] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    whole = bitpack.ByteEncoder(BYTE_BPE)
    expected = sorted((str(k), whole.encode(t or "") + (2).to_bytes(4, "little")) for k, t in rows)
    assert sorted((str(r.id), bytes(r.ids)) for r in back) == expected
    start = 0
    for r in back:
        assert r.start == start
        start += len(r.ids) // 4
    sizes = [r.ids for r in files.collect()]
    assert max(sizes) < 4 * (sum(sizes) / len(sizes)) + 600

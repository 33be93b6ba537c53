"""Operators on texts against brute force, the tokenizers library and exact round trips."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioframe.llm import bitpack, bpe, chat, langid, linededup, minhash, packing
from folioframe.llm.queries import BYTE_BPE, WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)
BYTES = Tokenizer.from_file(BYTE_BPE)
ODD = [None, "", " \n\t ", "it's I'LL <|endoftext|>x<|startoftext|> y<|endoftext|", "ΣΑΣ İstanbul é ﬁ ½ 你好 😀👍🏽", "a\x1cb\x85c\xa0d​e　f",
       "\0\x01", "a" * 5000, "\t\t x  \n\n\ny  ", "word " * 3000]
DOCS = "doc_id long, text string, lang string, source string, ids string, id string, node string, score string"


def table(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


def test_bpe_equals_the_library_on_odd_texts(spark):
    rows = {r.doc_id: r for r in bpe.encode_and_decode(table(spark, ODD), WORD_BPE).collect()}
    for i, text in enumerate(ODD):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids
        assert rows[i].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.encode_and_decode(table(spark, ODD).limit(0), WORD_BPE).count() == 0


PREFIX = bpe.prefix_encoder(WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_bpe_equals_the_library_on_any_text(text):
    assert np.frombuffer(PREFIX.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


ENCODER = bitpack.ByteEncoder(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab .,'s\n\t\r 1\0é你", max_size=30), st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40)))
def test_byte_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == BYTES.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=200)), np.uint32)
    packed = bitpack.pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert bitpack.unpack_bits(packed, width, len(ids)).tolist() == ids.tolist()
    half = len(ids) // 2
    assert bitpack.unpack_bits(packed, width, len(ids) - half, half).tolist() == ids[half:].tolist()


def test_shard_gives_random_access(tmp_path):
    docs = [np.arange(n, dtype=np.uint32) * 7 % 1000 for n in (0, 5, 300, 1, 77)]
    with (tmp_path / "shard").open("wb") as file:
        writer = bitpack.ShardWriter(file, 10, block=64)
        for k, ids in enumerate(docs):
            writer.add(None if k == 0 else k, ids)
        writer.close()

    class Local(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    reader = bitpack.ShardReader(Local((tmp_path / "shard").read_bytes()))
    assert reader.keys == [None, 1, 2, 3, 4]
    for n in (4, 0, 2, 3, 1):
        assert reader.document(n).tolist() == docs[n].tolist()


def test_shards_written_and_read_back(spark):
    texts = [*ODD, *[f"text number {i}" for i in range(50)]]
    docs = table(spark, texts).union(table(spark, ["same row"])).repartition(3)
    rows = sorted(bitpack.write_and_read(docs, BYTE_BPE, 50257).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([0, *range(len(texts))])
    at = 0
    for r in rows:
        choices = [BYTES.encode(t or "", add_special_tokens=False).ids + [2] for t in ([texts[0], "same row"] if r.doc_id == 0 else [texts[r.doc_id]])]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() in choices
        at += len(r.ids) // 4
    assert bitpack.write_and_read(docs.limit(0), BYTE_BPE, 50257).count() == 0


def test_best_fit_places_without_overlap():
    turn = random.Random(3)
    sizes = [turn.randint(1, 100) for _ in range(2000)]
    bins, offsets = packing.best_fit(sizes, 100)
    used = {}
    for b, o, n in sorted(zip(bins, offsets, sizes, strict=True)):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert max(used.values()) <= 100 and len(used) <= 1.02 * sum(sizes) / 100


def test_packing_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)  # several rounds
    texts = [*ODD, *["some words " * n for n in range(60)]]
    docs = table(spark, texts).union(table(spark, ["same row"])).repartition(5)
    rows = packing.pack_with_library(docs, WORD_BPE, capacity=64).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = 0
    for i, text in [*enumerate(texts)][1:]:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 64)))
        for r in mine:
            assert r.start == 64 * r.piece and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        total += len(ids)
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_with_library(docs.limit(0), WORD_BPE).count() == 0


def brute_groups(texts):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sets, label


def edited(words, turn, share):
    return " ".join(w if turn.random() > share else f"x{turn.randint(0, 999)}" for w in words)


@pytest.mark.parametrize("large", [4096, 20])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE_BUCKET", large)  # the second run deals large buckets out again
    turn = random.Random(5)
    word = [f"w{i}" for i in range(3000)]
    texts = [*ODD, "Three Words only", "three\nwords ONLY", "ÀB À b"]
    for share, copies in ((0.0, 30), (0.01, 60), (0.03, 60), (0.05, 20)):
        base = [turn.choice(word) for _ in range(turn.choice((12, 60, 150)))]
        texts += [edited(base, turn, share) for _ in range(copies)]
    shared = [turn.choice(word) for _ in range(60)]
    texts += [" ".join([*shared, *[turn.choice(word) for _ in range(40)]]) for _ in range(60)]
    turn.shuffle(texts)
    sets, label = brute_groups(texts)
    rows = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert [rows[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[i].component_id for i in range(len(texts))] == label
    assert all(rows[i].kept == (label[i] == i) for i in rows)


def one_band_texts():
    """Texts 0 to 2 in one bucket: of 1 and 2 with similarity 0.75 it is the only one, 0 is like neither."""
    turn = random.Random(3)

    def bands(text):
        parts = minhash.registers(minhash.shingle_set(text, {})).reshape(minhash.BANDS, minhash.ROWS)
        return {(i, bytes(p)) for i, p in enumerate(parts) if p.any()}

    while True:
        words = [f"w{turn.randrange(10**6)}" for _ in range(8)]
        one, two = " ".join(words), " ".join(words[:7])
        if len(shared := bands(one) & bands(two)) == 1:
            for start in range(3):
                other = " ".join([*words[start : start + 5], *[f"v{turn.randrange(10**6)}" for _ in range(5)]])
                if shared <= bands(other):
                    return [other, one, two]


def test_near_duplicates_that_share_one_band_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE_BUCKET", 2)
    texts = one_band_texts()
    _, label = brute_groups(texts)
    assert label == [0, 1, 1]
    rows = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert [rows[i] for i in range(3)] == label


def test_rows_by_bucket_are_not_broadcast(spark, monkeypatch):
    """Spark sizes 32 rows of an explode like the one they come from, so any of these tables could seem small enough."""
    plans, write = [], minhash.cut
    monkeypatch.setattr(minhash, "LARGE_BUCKET", 2)
    monkeypatch.setattr(minhash, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (5, 55, 105, 155)]
    assert {r.component_id for r in minhash.near_duplicates(table(spark, texts)).collect()} == {0}

    def below(lines, at):
        """The lines of a node's subtree."""
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        end = next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(lines[at])), len(lines))
        return lines[at + 1 : end]

    lines = [p.splitlines() for p in plans if "Generate explode" in p]
    assert lines and not [x for x in lines for k, line in enumerate(x) if "BroadcastExchange" in line and any("Generate explode" in b for b in below(x, k))]


def test_blocks_of_a_bucket_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LARGE_BUCKET", 20)
    rows = [(bucket, i, 1 if bucket == 1 and i < 200 else i, 0, 10) for bucket in (1, 2) for i in range(300)]
    rows += [(3, i, 5, 0, 10) for i in range(50)] + [(4, i, i, 0, 1000) for i in range(8)] + [(5, i, i, 0, 10) for i in range(3)]
    shared = spark.createDataFrame(rows, "bucket long, node long, label long, band int, n long")
    label = {(bucket, node): name for bucket, node, name, _, _ in rows}
    places = {}
    for r in minhash._dealt(shared, minhash.F.lit(1 / 20) + minhash.F.col("n") / 2000).collect():
        places.setdefault((r.bucket, r.one, r.two), []).append(r)
    met = []
    for (bucket, one, two), group in places.items():
        assert len(group) <= 80 and {r.block for r in group} <= {one, two}
        met += [(bucket, *sorted((x.node, y.node))) for i, x in enumerate(group) for y in group[:i] if (one == two or x.block != y.block) and x.label != y.label]
        if bucket == 1 and one != two and {r.block for r in group} == {one, two}:
            assert len({r.label for r in group}) > 1  # the settled label never meets itself
    assert len(met) == len(set(met))
    nodes = {}
    for bucket, node in label:
        nodes.setdefault(bucket, []).append(node)
    assert set(met) == {(b, x, y) for b, held in nodes.items() for x in held for y in held if x < y and label[b, x] != label[b, y]}
    assert len({k for k in places if k[0] == 4}) > 1 and [k for k in places if k[0] == 5] == [(5, 0, 0)]


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(table(spark, ["x"]).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    rows = sorted(minhash.near_duplicates(nameless).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in rows] == [(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_line_dedup_of_odd_tables(spark):
    boiler = "All rights reserved by nobody."
    rows = [(i, f"own line {i}\n{boiler}\n\nend {i % 2}", f"site{i % 5}", "a", 9) for i in range(20)]
    rows += [(20, None, "site1", "a", 9), (21, "", "site1", "a", 9), (22, f"{boiler}\n{boiler}", None, "a", 9), (None, f"{boiler}", "site9", "a", 9), (3, *rows[3][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, site string, lines_in int")
    out = linededup.drop_shared_lines(docs, min_sites=6)
    assert out.columns == ["doc_id", "source", "site", "text", "lines_in", "lines_out"]
    found = sorted(out.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert found[0].text == boiler  # a null key comes first and keeps the line
    assert all(boiler not in r.text for r in found[1:] if r.text)
    assert [r.text for r in found if r.doc_id == 3] == ["own line 3\n\nend 1"] * 2
    assert [(r.text, r.lines_in, r.lines_out) for r in found if r.doc_id in (20, 21, 22)] == [(None, 0, 0), ("", 1, 1), ("", 2, 0)]
    assert linededup.drop_shared_lines(docs.limit(0)).count() == 0


def test_languages(spark):
    turn = random.Random(2)
    stems = {"en": ("the", "ing", "ough"), "de": ("sch", "ung", "ein"), "fr": ("eau", "que", "oux"), "es": ("cion", "ado", "ñez"), "xx": ("zzk", "qqv", "kkw")}
    rows = [(i, " ".join("".join(turn.choices(stems[lang], k=2)) for _ in range(30)), lang) for i, lang in enumerate(sorted(stems) * 30)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 %%%", "en"), (None, "the ough", None), (1003, "sch" * 60000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit("clash"))
    model = langid.learn(docs, sample=15)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "de"]
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:150])
    assert langid.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", ">", "\\", "s", "/", "[", "]", "INST", "<SYS>>", "<|", "</s>", "[/INST]", chat.CLOSE, chat.BODY, "x", "\n"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)
    line = f"{chat.OPEN}{chat.escape(text)}{chat.BODY}{hidden}{chat.CLOSE}"
    assert [t[:2] for t in chat.read_turns(line * 2)] == [(text, text)] * 2


def test_windows_hold_every_turn_once(spark):
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " + "<|done|> " * (i % 7)) for i in range(600)]
    rows += [(2, i, "assistant", "b" * i) for i in (5, 255, 256, 600, 601)] + [(None, 1, None, None), (3, 0, "system", "only"), (4, None, "assistant", "no turn"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", chat.F.lit("clash"))
    windows = chat.format_with_tokenizer(turns, WORD_BPE, 100, 2)
    some = windows.where("conv_id = 1").collect()
    assert all(r.formatted.startswith(f"{chat.OPEN}system") and not r.over_budget for r in some) and sum(r.n_new for r in some) == 600
    assert all(1 <= r.repeated <= 3 for r in some if r.segment == 1)  # system turn and up to two of history
    for r in chat.read_back(windows).collect():
        mine = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1]))]
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(b for a, b in mine if a == "assistant").encode()).hexdigest()
    assert windows.where("conv_id = 3").first().repeated == 0
    assert chat.read_back(chat.format_with_tokenizer(turns.limit(0), WORD_BPE)).count() == 0


def test_windows_of_gaps_null_keys_and_one_repeated_turn(spark):
    rows = [(5, i, "system" if i == 0 else "user", f"turn {i}") for i in (0, 1, 300, 600, 900)]
    rows += [(7, i * 1000, "assistant" if i % 2 else "user", f"far {i}") for i in range(600)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hot = spark.range(20_000).selectExpr("cast(null as long) as conv_id", "id % 3 as turn", "'user' as role", "concat('t', id) as text")
    same = spark.range(20_000).selectExpr("6L as conv_id", "1L as turn", "'assistant' as role", "'x' as text")
    windows = chat.format_with_tokenizer(table.union(hot).union(same), WORD_BPE, 60, 2).cache()
    held = windows.groupBy("conv_id", "segment").agg(chat.F.sum("n_new").alias("n"))
    assert held.agg(chat.F.max("n")).first()[0] <= chat.SEGMENT
    assert {r.conv_id: r.n for r in windows.groupBy("conv_id").agg(chat.F.sum("n_new").alias("n")).collect()} == {5: 5, 7: 600, None: 20_000, 6: 20_000}
    assert [(r.repeated, r.n_new) for r in windows.where("conv_id = 5").orderBy("segment", "window").collect()] == [(0, 5)]
    # Later segments repeat the two turns in front of them.
    firsts = windows.where("conv_id = 7 and segment > 0 and window = 0").collect()
    assert len(firsts) == 2
    for r in firsts:
        read = [t for _, t, _, _ in chat.read_turns(r.formatted)]
        assert r.repeated == 2 and read[:3] == [f"far {256 * r.segment + n}" for n in (-2, -1, 0)]
    assert {r.conv_id: r.n_turns for r in chat.read_back(windows).collect()} == {5: 5, 7: 600, None: 20_000, 6: 20_000}


def test_segments_stream_through_one_pass(spark):
    """No call for each conversation: segments are cut out of sorted batches, also where a batch ends inside one."""
    rows = [(None if c == 7 else c, t, ("user", "assistant", None)[t], f"text {c} {t}" if t else None) for c in range(400) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat.format_windows(turns.coalesce(1), lambda: lambda text: len(text.split()), budget=1000)
    assert "FlatMapGroups" not in windows._jdf.queryExecution().optimizedPlan().toString()
    got = {r.conv_id: r for r in windows.collect()}
    assert len(got) == 400 and windows.count() == 400
    for c, r in got.items():
        c = 7 if c is None else c
        assert [t[:2] for t in chat.read_turns(r.formatted)] == [("user", ""), ("assistant", f"text {c} 1"), ("", f"text {c} 2")]
        assert (r.segment, r.window, r.repeated, r.n_new, r.over_budget) == (0, 0, 0, 3, False)
        assert [r.formatted[x.start : x.stop] for x in r.loss_spans] == [f"text {c} 1"]


@pytest.mark.parametrize("text", ["", "plain", "a < b", "[x]", "|", "<|turn|>", "</s>\\[/INST]", "<\\|"])
def test_escapes_of_texts_with_and_without_signs(text):
    assert chat.escape(text) == chat._PLAIN.sub(r"\\", text) and chat.unescape(chat.escape(text)) == text

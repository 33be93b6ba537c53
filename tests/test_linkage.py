"""The similarity join and candidate pairs against brute force."""

import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

from folioframe.functions import similarity
from folioframe.functions.similarity import TitleBlock, common_length, matching_pairs
from folioframe.operators import linkage
from folioframe.plans.ratio import may_match, ratios


def edited(rng, text, letters, share):
    out = list(text)
    for _ in range(rng.randint(0, max(1, int(len(out) * share)))):
        kind, at = rng.random(), rng.randrange(len(out) + 1)
        if kind < 0.4 and at < len(out):
            out[at] = rng.choice(letters)
        elif kind < 0.7:
            out.insert(at, rng.choice(letters))
        elif at < len(out):
            del out[at]
    return "".join(out)


def some_titles(seed, letters, sizes, count=40):
    rng = random.Random(seed)
    roots = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(count)]
    return sorted({t for r in roots for t in (r, *(edited(rng, r, letters, 0.2) for _ in range(4))) if t})


# Few letters, many letters, letters beyond the basic plane, and long titles whose common letters the matcher leaves out.
@pytest.mark.parametrize("letters,sizes", [("ab", (1, 2, 3, 5, 8)), ("abcdefg hijklmnop", (4, 9, 18, 40)), ("史𝔘éa ", (3, 12, 30)), ("abc def", (190, 210, 260))])
def test_signature_join_equals_brute_force(spark, letters, sizes):
    titles = some_titles(len(letters), letters, sizes, 40 if max(sizes) < 100 else 8)
    df = spark.createDataFrame([(t,) for t in titles], "key string")
    some = spark.createDataFrame([(t,) for t in titles[::3]], "key string")
    for threshold in (0.92, 0.85, 0.7):
        want = {(a, b) for a in titles for b in titles if SequenceMatcher(None, a, b).ratio() >= threshold}
        assert {(r.left_key, r.right_key) for r in linkage.similar_titles(df, df, threshold).collect()} == want
        assert {(r.left_key, r.right_key) for r in linkage.similar_titles(some, df, threshold).collect()} == {p for p in want if p[0] in titles[::3]}


def test_one_title_repeated_and_empty_tables(spark):
    rows = [(i, i, None, "A Study of Everything") for i in range(10_000)] + [(10_000, 10_000, None, "a study of everything!?"), (10_001, 10_001, None, "A Study of Everythink")]
    table = spark.createDataFrame(rows, "entry_id long, ord long, doi string, title string")
    found = linkage.find_duplicates(table, table, earlier_only=True)
    assert found.count() == 10_001 and {r.match_id for r in found.select("match_id").distinct().collect()} == {0}
    assert {r.group_base for r in linkage.near_part_groups(table.selectExpr("title as base", "ord")).select("group_base").distinct().collect()} == {"A Study of Everything"}
    assert linkage.find_duplicates(table.limit(0), table.limit(0)).count() == 0
    for threshold in (0.5, 1.0):
        with pytest.raises(ValueError):
            linkage.title_candidates(table, table, threshold)


def test_common_length():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert common_length(a, b) == best[-1][-1]


def test_candidate_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    titles = some_titles(5, "abcdefgh ij", (6, 20), 25)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, (i * 7) % 101, pick(None, "", *titles), pick(None, None, "10.1000/a", "https://doi.org/10.1000/A", "10.1000/b"), pick(None, None, "2101.1", "2101.2"), pick(None, None, "", "978-0-306-40615-7", "9780306406157")) for i in range(101)]
    table = spark.createDataFrame(rows, "entry_id long, ord long, title string, doi string, arxiv_id string, isbn string")
    key = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())
    fold = {"https://doi.org/10.1000/A": "10.1000/a"}
    doi, isbn = (lambda r: fold.get(r[3], r[3])), (lambda r: (r[5] or "").replace("-", ""))
    firsts = {}
    for name, of in (("title", lambda r: key(r[2])), ("doi", doi), ("arxiv", lambda r: r[4]), ("isbn", isbn)):
        for row in sorted(rows, key=lambda r: r[1]):
            if of(row):
                firsts.setdefault((name, of(row)), row)
    want = {}
    for row in rows:
        mates = [firsts.get((n, v)) for n, v in (("doi", doi(row)), ("arxiv", row[4]), ("isbn", isbn(row))) if v]
        mates += [r for (n, k), r in firsts.items() if n == "title" and key(row[2]) and SequenceMatcher(None, key(row[2]), k).ratio() >= 0.85]
        for mate in mates:
            if mate[0] != row[0]:
                both = key(row[2]) and key(mate[2])
                want[row[0], mate[0]] = SequenceMatcher(None, key(row[2]), key(mate[2])).ratio() if both else 0.0
    assert {(r.l_id, r.c_id): r.ratio for r in linkage.candidate_pairs(table).collect()} == want and len(want) > 100


def test_ratio_in_sql():
    rng = random.Random(3)
    letters = "aaabbcde ü史"
    pairs = set()
    for _ in range(120):
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 30, 60, 250])))
        pairs |= {(a, edited(rng, a, letters, 0.3)), (a, "".join(rng.choice(letters) for _ in range(rng.choice([1, 20, 220]))))}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", sorted(pairs))
    found = con.execute(f"WITH RECURSIVE {ratios('SELECT a, b FROM p')} SELECT a, b, ratio, {may_match(0.85)} FROM rt").fetchall()
    assert len(found) == len(pairs)
    for a, b, ratio, may in found:
        assert ratio == SequenceMatcher(None, a, b).ratio() and (may or ratio < 0.85)


def test_unlike_titles_of_one_language_stay_in_their_task(spark):
    """Titles that share letters and pieces but do not match must not be shuffled as pairs."""
    rng = random.Random(11)
    syllables = ["the", "an", "er", "in", "ou", "tion", "st", "ha", "en", "re"]
    titles = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(14)) for _ in range(1500)})
    df = spark.createDataFrame([(t,) for t in titles], "key string").repartition(4).cache()
    near = linkage.title_candidates(df, df, 0.85)
    assert near.count() < 2 * len(titles)
    likely = linkage._block_pairs(df.selectExpr("key", "true as is_left", "true as is_right", "length(key) as len"), 0.85)
    assert likely.count() < 8 * len(titles)


def test_blocks_with_wide_and_mixed_titles():
    titles = some_titles(5, "abcd efghi", (3, 150, 300, 420, 500), 20)
    block, some = TitleBlock(titles), TitleBlock(titles[::2])
    reach = lambda a, b: 2 * common_length(a, b) >= 0.85 * (len(a) + len(b)) - 1e-9
    assert set(matching_pairs(block, block, 0.85)) == {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if reach(titles[i], titles[j])}
    assert set(matching_pairs(some, block, 0.85)) == {(i, j) for i, a in enumerate(titles[::2]) for j, b in enumerate(titles) if reach(a, b)}


def test_halves_rule_titles_out_and_lose_none(monkeypatch):
    """Titles with the same letters in other places go before their subsequences are compared."""
    tried, reaching = [], similarity._reaching
    monkeypatch.setattr(similarity, "FEW", 1)
    monkeypatch.setattr(similarity, "_reaching", lambda a, b, i, *rest: tried.append(len(i)) or reaching(a, b, i, *rest))
    swapped = ["ab" * 20 + "cd" * 20 + "ef" * k for k in range(8)] + ["dc" * 20 + "ba" * 20 + "ef" * k for k in range(8)]
    random.Random(3).shuffle(swapped)
    block = TitleBlock(swapped)
    found = matching_pairs(block, block, 0.85)
    assert sum(tried) == len(found) < 8 * 8
    titles = some_titles(9, "abcd efghi", (4, 40, 90, 200), 25)
    one, other = TitleBlock(titles), TitleBlock(titles[::-1][::2])
    reach = lambda a, b: 2 * common_length(a, b) >= 0.85 * (len(a) + len(b)) - 1e-9
    assert set(matching_pairs(one, one, 0.85)) == {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if reach(titles[i], titles[j])}
    assert set(matching_pairs(other, one, 0.85)) == {(i, j) for i, a in enumerate(other.titles) for j, b in enumerate(titles) if reach(a, b)}


def test_titles_of_one_side_do_not_meet_each_other(monkeypatch):
    """A short batch against a large library: pairs within the library are not even counted."""
    met = []
    counted = lambda a, b, least: met.append(len(a.titles) * len(b.titles)) or matching_pairs(a, b, least)
    monkeypatch.setattr(linkage, "matching_pairs", counted)
    keys = [f"a study of {n:04d} things and others" for n in range(300)]
    rows = pd.DataFrame({"own": [n % 2 for n in range(300)], "key": keys, "is_left": [n < 10 for n in range(300)], "is_right": [n >= 8 for n in range(300)]})
    got = linkage._compared(0.92)(rows)
    assert sum(met) <= 10 * 292
    reach = lambda a, b: 2 * common_length(a, b) >= 0.92 * (len(a) + len(b)) - 1e-9
    assert sorted(zip(got["left_key"], got["right_key"], strict=True)) == sorted(
        (a, b) for i, a in enumerate(keys[:10]) for j, b in enumerate(keys) if j >= 8 and (i - j) % 2 and reach(a, b)
    )

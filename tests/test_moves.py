"""Orders of moves, replayed on a set of files."""

import random

import pytest

from folioframe.operators import moves


def replayed(steps, files):
    """The files (place -> content) after all steps; each step must leave every file whole, in whatever order its moves run."""
    state = {f: f for f in files}
    for step in sorted({r.step for r in steps if r.step is not None}):
        some = [r for r in steps if r.step == step]
        assert len({r.dst for r in some}) == len(some) and not {r.dst for r in some} & set(state)
        for r in some:
            state[r.dst] = state.pop(r.src)
    return state


@pytest.mark.parametrize("seed", range(3))
def test_no_step_overwrites(spark, seed):
    turn = random.Random(seed)
    files = [f"d{i % 3}/f{i}.pdf" for i in range(60)]
    ring, rest = turn.sample(files, 20), [*files]
    wanted = {a: b for part in (ring[:2], ring[2:5], ring[5:12]) for a, b in zip(part, part[1:] + part[:1], strict=True)}
    for f in turn.sample([f for f in rest if f not in wanted], 30):
        wanted[f] = turn.choice([f"new/n{turn.randrange(12)}.pdf", turn.choice(files), f])
    table = spark.createDataFrame([*wanted.items()], "src string, dst string")
    steps = moves.in_order(table, spark.createDataFrame([(f,) for f in files], "rel string")).collect()
    state = replayed(steps, files)
    # By hand: a move can be made unless its target stays, somebody smaller wants it, or the move behind it cannot be made.
    real = {s: d for s, d in wanted.items() if s != d}

    def reason(s, seen=()):
        d = real[s]
        if d in files and d not in real:
            return moves.TAKEN
        if min(x for x in real if real[x] == d) != s:
            return moves.TWICE
        if d in real and d not in seen and reason(d, (*seen, s)):
            return moves.BEHIND
        return None

    assert {r.src: r.reason for r in steps if r.step is None} == {s: reason(s) for s in real if reason(s)}
    assert state == {**{f: f for f in files if f not in real or reason(f)}, **{d: s for s, d in real.items() if not reason(s)}}
    assert {r.kind for r in steps} == {moves.MOVE, moves.AWAY, moves.BACK}


def test_long_chain_and_empty_plan(spark):
    chain = [(f"f{i}", f"f{i + 1}") for i in range(1000)]
    steps = moves.in_order(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([(s,) for s, _ in chain], "rel string")).collect()
    assert {r.src: r.step for r in steps} == {f"f{i}": 999 - i for i in range(1000)}
    none = spark.createDataFrame([], "src string, dst string")
    assert moves.in_order(none, none.selectExpr("src as rel")).count() == 0
    assert moves.with_sidecars(none, none.selectExpr("src as rel")).count() == 0


def test_sidecars_go_with_their_document(spark):
    plan = [("a/x.pdf", "b/y.pdf"), ("a/x.v2.pdf", "a/z.pdf"), ("top.pdf", "c/top.pdf")]
    files = ["a/x.pdf", "a/x.v2.pdf", "a/parsed/x/full.md", "a/parsed/x/images/1.png", "a/parsed/other/full.md", "a/notes/x.summary.md", "a/notes/x.other.md", "a/translations/x.zh-Hans.md",
             "a/translations/x.v2.zh-Hans.md", "b/notes/x.summary.md", "notes/top.summary.md", "parsed/top/full.md", "top.pdf", "a/notes/x.v2.summary.md"]
    found = {(r.src, r.dst) for r in moves.with_sidecars(spark.createDataFrame(plan, "src string, dst string"), spark.createDataFrame([(f,) for f in files], "rel string")).collect()}
    assert found - set(plan) == {
        ("a/parsed/x/full.md", "b/parsed/y/full.md"), ("a/parsed/x/images/1.png", "b/parsed/y/images/1.png"), ("a/notes/x.summary.md", "b/notes/y.summary.md"),
        ("a/translations/x.zh-Hans.md", "b/translations/y.zh-Hans.md"), ("a/translations/x.v2.zh-Hans.md", "a/translations/z.zh-Hans.md"),
        ("notes/top.summary.md", "c/notes/top.summary.md"), ("parsed/top/full.md", "c/parsed/top/full.md"), ("a/notes/x.v2.summary.md", "a/notes/z.summary.md"),
    }

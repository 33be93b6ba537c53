"""A Merkle tree over the rows of a table, kept as SHA-256 midstates.

A leaf is the digest of one row. In every tree (one for each group of rows) each
run of 16 nodes becomes a parent: the digest of their digests as hex text. Such a
text fills exactly one block of SHA-256, so the state of the hash before a child
is 32 bytes; a parent keeps the state before each of its children. To fold a
changed leaf up to the root, the state of its place is resumed with the new
digest and the siblings to its right; those to its left are never hashed again.
The roots of all trees, in order of their groups, are the leaves of the top tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import batches, cut, numbered

FAN = 16
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]
# The hash's constants: 32 bits of the fractions of the square and cube roots of primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in PRIMES[:8]], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in PRIMES], np.uint32)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) of n hashes after one more block (n, 16) each, all unsigned 32 bit."""
    w = [*np.ascontiguousarray(block.T)]
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = np.ascontiguousarray(state.T)
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def text_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of bytes as blocks (n, 16) that hold their hex text."""
    halves = np.stack([digests >> 4, digests & 15], axis=2).reshape(len(digests), 64)
    return HEX[halves].view(">u4").astype(np.uint32)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (n, 32) of hashes that have taken `blocks` (n) whole blocks."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = blocks * 512
    return _state_bytes(compress(state, last))


def _state_bytes(state: np.ndarray) -> np.ndarray:
    return state.astype(">u4").view(np.uint8).reshape(len(state), 32)


def _state_words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(len(raw), 8)


def fold(states: np.ndarray, changed: np.ndarray, children: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of parents whose child at `place` is replaced by `changed` (n, 32).

    `states` (n, 8) are those before that child, `children` (n, 16, 32) all
    digests of the parent, `count` how many it has.
    """
    state = compress(states, text_block(changed))
    for step in range(1, FAN):
        rows = np.flatnonzero(place + step < count)
        if not len(rows):
            break
        state[rows] = compress(state[rows], text_block(children[rows, place[rows] + step]))
    return finish(state, count)


def leaf_hash(*columns: Column) -> Column:
    """The digest (hex) of a row: each value as its UTF-8 byte count, a colon and itself; null is a hyphen."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Manifest(NamedTuple):
    """Nodes of all trees, each level a written table: tree, run, nodes (at this level of its tree), children, states, digest."""

    runs: DataFrame  # level one, with `rows`: the key, leaf and changed leaf of each row of a run
    levels: list[DataFrame]  # from level two up
    tops: list[DataFrame]  # levels of the top tree
    roots: DataFrame  # tree, level (of its root), digest, number (its place in the top tree), count (of trees)
    root: DataFrame  # the digest of the top tree, no row for an empty table


def _parents(groups: DataFrame) -> DataFrame:
    """Written parents of `groups`, whose last column `digests` lists the children; adds children, states and digest."""
    kept = [f for f in groups.schema.fields if f.name != "digests"]

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column(len(kept)).to_pylist()
            count = np.array([len(x) for x in lists], np.int64)
            children = np.frombuffer(b"".join([b"".join(x) + bytes(32 * (FAN - len(x))) for x in lists]), np.uint8).reshape(len(lists), FAN, 32)
            state = np.tile(START, (len(lists), 1))
            states = np.zeros((len(lists), FAN, 8), np.uint32)
            for place in range(FAN):
                states[:, place] = state
                rows_ = np.flatnonzero(place < count)
                state[rows_] = compress(state[rows_], text_block(children[rows_, place]))
            digests = finish(state, count)
            out = [
                [children[n, :c].tobytes() for n, c in enumerate(count)],
                [_state_bytes(states[n, :c]).tobytes() for n, c in enumerate(count)],
                [d.tobytes() for d in digests],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, pa.binary()) for c in out)], [*(f.name for f in kept), "children", "states", "digest"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", children binary, states binary, digest binary"
    return cut(batches(groups, work, schema))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Levels above `nodes` (tree, number, count, digest), whose largest tree has `most` nodes."""
    out = []
    while most > 1:
        most = -(-most // FAN)
        groups = nodes.where("count > 1").groupBy("tree", F.floor(F.col("number") / FAN).alias("run")).agg(
            F.ceil(F.first("count") / FAN).alias("nodes"), F.sort_array(F.collect_list(F.struct("number", "digest"))).alias("list"))
        out.append(_parents(groups.select("tree", "run", "nodes", F.col("list.digest").alias("digests"))))
        nodes = _as_nodes(out[-1])
    return out


def _as_nodes(level: DataFrame) -> DataFrame:
    return level.select("tree", F.col("run").alias("number"), F.col("nodes").alias("count"), "digest")


def build(docs: DataFrame, leaf: Column, changed: Column, key: str = "doc_id", group: str = "source") -> Manifest:
    """The manifest of a table: one tree for each value of `group` over its rows in order of `key`.

    `leaf` is the digest (hex) of a row, `changed` that of its new version or
    null. Rows with a null key come first; rows that share a key stand in order
    of their leaves. A null group is a tree of its own, in front of all others.
    """
    # Null sorts first and the order of the others is that of their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = cut(docs.select(tree.alias("tree"), F.col(key).cast("long").alias("key"), F.unhex(leaf).alias("digest"), F.unhex(changed).alias("changed"))
                 .withColumn("tie", F.monotonically_increasing_id()))
    nodes = numbered(leaves, ["tree"], ["key", "digest", "tie"])
    row = F.struct("number", "key", "digest", "changed")
    runs = nodes.groupBy("tree", F.floor(F.col("number") / FAN).alias("run")).agg(F.first("count").alias("count"), F.sort_array(F.collect_list(row)).alias("rows"))
    runs = _parents(runs.select("tree", "run", F.ceil(F.col("count") / FAN).alias("nodes"), (F.col("count") == 1).alias("lone"), "rows", F.col("rows.digest").alias("digests")))
    most = runs.agg(F.coalesce(F.max("nodes"), F.lit(0))).first()[0]
    levels = _levels(_as_nodes(runs), most)
    ends = runs.where("nodes = 1").select(
        "tree", F.when(F.col("lone"), 0).otherwise(1).alias("level"), F.when(F.col("lone"), F.col("rows")[0]["digest"]).otherwise(F.col("digest")).alias("digest"))
    for n, level in enumerate(levels, 2):
        ends = ends.union(level.where("nodes = 1").select("tree", F.lit(n), "digest"))
    roots = cut(numbered(ends.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "digest"), ["tree"], ["name"]))
    trees = roots.count()
    tops = _levels(roots.select("tree", "number", "count", "digest"), trees)
    return Manifest(runs, levels, tops, roots.withColumn("tree", F.col("name")).drop("name"), (tops[-1] if tops else roots).select("digest"))


STEP = "struct<place:int,children:binary,state:binary>"


def _steps(level: DataFrame) -> DataFrame:
    """Each child of a level's parents: tree, run (its number), path (its step, then those above)."""
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("children") / 32 - 1).cast("int")))
    children = level.select("tree", "run", "children", "states", "path", place.alias("place"))
    step = F.struct("place", "children", F.expr("substring(states, place * 32 + 1, 32)").alias("state"))
    return children.select("tree", (F.col("run") * FAN + F.col("place")).alias("run"), F.concat(F.array(step), "path").alias("path"))


def _descend(levels: Sequence[tuple[int, DataFrame]], ends: DataFrame) -> DataFrame:
    """tree, run, path of the lowest of `levels`, given the path above each tree's root (`ends`: tree, level, path)."""
    paths = None
    for n, level in sorted(levels, key=lambda x: -x[0]):
        here = ends.where(F.col("level") == n).select("tree", F.lit(0).cast("long").alias("run"), "path")
        paths = here if paths is None else here.union(paths)
        if n > min(x[0] for x in levels):
            paths = _steps(level.join(paths, ["tree", "run"]))
    return paths


def fold_changes(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """Every row's proof, and the root that follows from its changed leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    `subroot` is the root of the row's tree, `proof_sha256` the digest of its
    siblings at all levels; `folded_root` starts from the changed leaf, or from the
    leaf itself where nothing has changed. Steps go down the trees level by level,
    one join a level on (tree, run), so that a run of 16 rows gets one path.
    """
    none = F.array().cast(f"array<{STEP}>")
    trees = manifest.roots.select("tree", "level", "digest", F.col("number").alias("run"))
    if manifest.tops:
        height = len(manifest.tops)
        top = manifest.runs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(height).alias("level"), none.alias("path"))
        above = _descend([*enumerate(manifest.tops, 1)] + [(0, manifest.tops[0])], top).select("run", "path")
        trees = trees.join(above, "run").drop("run")
    else:
        trees = trees.drop("run").withColumn("path", none)
    trees = cut(trees)
    lowest = _descend([(1, manifest.runs), *enumerate(manifest.levels, 2)], trees)
    lowest = lowest.union(trees.where("level = 0").select("tree", F.lit(0).cast("long"), "path"))
    ready = manifest.runs.join(lowest, ["tree", "run"]).join(trees.select("tree", F.col("digest").alias("subroot")), "tree")
    ready = ready.select("lone", "rows", "children", "states", "path", "subroot").withColumn("root", manifest.root.select("digest").scalar())
    names = ["id", "leaf", "subroot", "root", "proof", "folded"]

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[tuple] = []
            now: list[bytes] = []
            steps: list[list[tuple[int, bytes, bytes]]] = []
            for run in batch.to_pylist():
                upper = [(s["place"], s["children"], s["state"]) for s in run["path"]]
                proof = b"".join([(c[: 32 * p] + c[32 * p + 32 :]).hex().encode() for p, c, _ in upper])
                children = run["children"]
                for place, row in enumerate(run["rows"]):
                    at = 32 * place
                    siblings = (children[:at] + children[at + 32 :]).hex().encode()
                    out.append((row["key"], row["digest"], run["subroot"], run["root"], hashlib.sha256(siblings + proof).digest()))
                    now.append(row["changed"] or row["digest"])
                    own = [] if run["lone"] else [(place, children, run["states"][at : at + 32])]
                    steps.append(own + upper)
            digests = np.frombuffer(b"".join(now), np.uint8).reshape(len(now), 32).copy()
            for depth in range(max(map(len, steps), default=0)):
                some = [n for n, s in enumerate(steps) if len(s) > depth]
                taken = [steps[n][depth] for n in some]
                kids = np.frombuffer(b"".join([c + bytes(32 * FAN - len(c)) for _, c, _ in taken]), np.uint8).reshape(len(taken), FAN, 32)
                states = _state_words(np.frombuffer(b"".join([s for _, _, s in taken]), np.uint8).reshape(len(taken), 32))
                places = np.array([p for p, _, _ in taken], np.int64)
                digests[some] = fold(states, digests[some], kids, places, np.array([len(c) // 32 for _, c, _ in taken], np.int64))
            columns = [*map(list, zip(*out, strict=True))] + [[d.tobytes() for d in digests]] if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "id" else pa.binary()) for c, n in zip(columns, names, strict=True)], names)

    folded = batches(ready, work, "id long, leaf binary, subroot binary, root binary, proof binary, folded binary")
    text = {n: F.lower(F.hex(n)) for n in names[1:]}
    return folded.select(
        F.col("id").alias(key), text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
        text["proof"].alias("proof_sha256"), text["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def check_documents(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest of documents by source, folded with a tampered version of some.

    Where `tampered` holds, the text's A-Z are in lower case in the new version.
    By default that is so for a fifth of the rows, by the checksum of doc_id; a
    null doc_id is never among them, and a null text stays null. Any column may
    be null; other columns are not read. An empty table gives an empty result.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold_changes(build(docs, leaf_hash(*fields, F.col("text")), F.when(tampered, leaf_hash(*fields, low))))

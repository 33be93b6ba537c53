"""Near-duplicate documents by HyperMinHash sketches and full shingle sets.

A document is the set of its distinct word shingles, each a 64-bit hash. The
sketch keeps, for each of 128 buckets, the smallest hash as its number of leading
zeros and the 10 bits behind the first one: 2 bytes a bucket. Bands of four
registers propose pairs; the share of equal registers, corrected for registers
that agree by chance, drops hopeless ones; the rest is decided on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import batches, cut, discard, free_name, worker_keep
from folioframe.llm.components import connected_components, merged_components

BUCKETS, ROWS, MANTISSA = 128, 4, 10
BANDS = BUCKETS // ROWS
SHINGLE = 5
# Links have 100 * intersection >= 75 * union.
SHARE = 75
# Rows of a block: larger buckets are joined in pairs of hashed blocks, so no task holds more than two of them.
LARGE_BUCKET = 4096
# Shingles of a block (8 bytes each) where rows bring their full sets.
LARGE_SETS = 4_000_000
# Parts of a block are counted in whole numbers, so that a sum is the same each time.
WHOLE = 10**9
# Up to so many ids (8 bytes each) the texts of candidates are found by a broadcast, beyond by a shuffle.
BROADCAST_IDS = 500_000
# How far below the threshold a sketch may estimate, in standard errors.
MARGIN = 5.0

REMEMBER_WORDS = 400_000
MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text with fewer words gives one for all of them, without words none."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    try:
        hashes = [words[w] for w in parts]
    except KeyError:
        if len(words) > REMEMBER_WORDS:
            words.clear()
        hashes = []
        for w in parts:
            if (h := words.get(w)) is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 48:
                    words[w] = h
            hashes.append(h)
    row = np.array(hashes, np.uint64)
    width = min(size, len(row))
    out = np.full(len(row) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * MIX[0] + row[k : len(row) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a sorted hash set; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bits = BUCKETS.bit_length() - 1
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted: the first of a bucket is its least
        rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits, exact as a double
        zeros = 53 - np.frexp(rest.astype(np.float64))[1]
        mantissa = ((rest << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        out[bucket[first]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def estimate(equal: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The Jaccard share behind so many equal registers of those that either side uses.

    Two different least hashes get the same register if leading zeros and
    mantissa agree: a third of 2**-mantissa of the time. That share is taken off.
    """
    chance = 2.0**-MANTISSA / 3
    return (equal / np.maximum(used, 1) - chance) / (1 - chance)


def plausible(share: np.ndarray, used: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the threshold can lie behind an estimate from so many registers, for sets whose sizes add up to `sizes`.

    The registers in use are a sample without replacement from the union, which
    at the threshold holds sizes / 1.75 shingles; of small sets it is nearly all.
    """
    need, used = SHARE / 100, np.maximum(used, 1)
    union = sizes / (1 + need)
    error = np.sqrt(need * (1 - need) / used * np.clip(1 - used / union, 0, 1))
    return share >= need - MARGIN * error - 1.5 / used


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n, set_hash, sketch) of every row."""

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_keep("word hashes", dict)
        for batch in rows:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "set_hash", "sketch"],
            )

    return batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, n long, set_hash binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node, band): a row for each band with a register in use."""
    band = F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b as band, substring(sketch, b * {2 * ROWS} + 1, {2 * ROWS}) as part))"))
    return nodes.select("node", band.alias("band")).where(F.col("band.part") != F.lit(bytes(2 * ROWS))).select(F.xxhash64("band.band", "band.part").alias("bucket"), "node", "band.band")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have the needed Jaccard share."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= SHARE * (len(x) + len(y) - both)


def _sets(docs: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """(node, items): the full sets of some nodes, from their texts."""
    needed = needed.distinct()
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(needed, "node", "left_semi")

    def shingles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_keep("word hashes", dict)
        for batch in rows:
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "items"])

    return cut(batches(texts, shingles, "node long, items binary"))


def _linked(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    sets = _sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), key, text)

    def confirm(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            hit = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    with_sets = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        .select("a", "b", "items_a", "items_b")
    )
    found = cut(batches(with_sets, confirm, "a long, b long").distinct())
    discard(sets)
    return found


def _candidates(n: np.ndarray, label: np.ndarray, sketch: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, estimates) of rows in order of their set sizes: later rows of other labels, and of the other block if there are two, that can be similar enough."""
    two = len(block) > 0 and block.min() < block.max()
    reach = np.searchsorted(n, n * 100 // SHARE, side="right")  # longer sets cannot be
    names, held = np.unique(label, return_counts=True)
    others = {name: np.flatnonzero(label != name) for name in names[held > 64].tolist()}
    for i in range(len(n) - 1):
        at = others.get(int(label[i]))
        if at is None:
            at = np.arange(i + 1, reach[i])
            at = at[label[at] != label[i]]
        else:
            at = at[np.searchsorted(at, i + 1) : np.searchsorted(at, reach[i])]
        if two:
            at = at[block[at] != block[i]]
        if not len(at):
            continue
        used = ((sketch[at] != 0) | (sketch[i] != 0)).sum(1)
        share = estimate(((sketch[at] == sketch[i]) & (sketch[at] != 0)).sum(1), used)
        hit = plausible(share, used, n[at] + n[i])
        if hit.any():
            yield i, at[hit], share[hit]


def _met_here(one: np.ndarray, others: np.ndarray, band: int) -> np.ndarray:
    """Which of the sketches share no earlier band with `one` than the bucket's, so that a pair counts in one bucket only."""
    same = (others == one).reshape(-1, BANDS, ROWS).all(2) & (one.reshape(BANDS, ROWS) != 0).any(1)
    return same[:, band] & ~same[:, :band].any(1)


def _likeliest(bucket: int, rows: list[tuple]) -> Iterator[tuple[int, int, float]]:
    """(node, partner, estimate): for each node of a bucket its likeliest partner of another label."""
    node, label, n, block = (np.array([r[k] for r in rows]) for k in (0, 1, 2, 5))
    order = np.argsort(n, kind="stable")
    node, label, n, block = node[order], label[order], n[order], block[order]
    sketch = np.frombuffer(b"".join([rows[i][3] for i in order.tolist()]), np.uint16).reshape(-1, BUCKETS)
    best, partner = np.full(len(n), -2.0), np.full(len(n), -1)
    for i, at, share in _candidates(n, label, sketch, block):
        top = share.argmax()
        if share[top] > best[i]:
            best[i], partner[i] = share[top], at[top]
        better = share > best[at]
        best[at[better]], partner[at[better]] = share[better], i
    for i in np.flatnonzero(partner >= 0).tolist():
        yield int(node[i]), int(node[partner[i]]), float(best[i])


def _open_nodes(bucket: int, rows: list[tuple]) -> Iterator[tuple[int, int, float]]:
    """(bucket, node, 0) of the nodes with a plausible partner of another label that they meet here first."""
    node, label, n, block = (np.array([r[k] for r in rows]) for k in (0, 1, 2, 5))
    order = np.argsort(n, kind="stable")
    node, label, n, block = node[order], label[order], n[order], block[order]
    sketch = np.frombuffer(b"".join([rows[i][3] for i in order.tolist()]), np.uint16).reshape(-1, BUCKETS)
    marked = np.zeros(len(n), bool)
    for i, at, _ in _candidates(n, label, sketch, block):
        here = _met_here(sketch[i], sketch[at], rows[0][4])
        marked[at[here]] = True
        marked[i] |= here.any()
    for i in np.flatnonzero(marked).tolist():
        yield bucket, int(node[i]), 0.0


def _links_inside(bucket: int, rows: list[tuple]) -> Iterator[tuple[int, int, float]]:
    """(a, b, 0): links on full sets that join labels not joined before in this bucket; the rows hold sets in place of sketches."""
    rows = sorted(rows, key=lambda r: r[2])
    node, label, n, block = (np.array([r[k] for r in rows]) for k in (0, 1, 2, 5))
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sketch = np.array([registers(x) for x in sets])
    home = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    for i, at, _ in _candidates(n, label, sketch, block):
        at = at[_met_here(sketch[i], sketch[at], rows[0][4])]
        for j in at.tolist():
            one, two = root(int(label[i])), root(int(label[j]))
            if one != two and similar(sets[i], sets[j]):
                home[max(one, two)] = min(one, two)
                yield int(node[i]), int(node[j]), 0.0


def _within_buckets(rows: DataFrame, held: str, find: Callable[[int, list[tuple]], Iterator[tuple[int, int, float]]]) -> DataFrame:
    """(a, b, share) as `find` gives them for each pair of blocks of a bucket; `rows` has bucket, one, two, node, label, n, `held` (sketch or items), band and block."""

    def work(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grouped() -> Iterator[tuple[int, list[tuple]]]:
            now, group = None, []
            for batch in batches_:
                for bucket, one, two, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (bucket, one, two) != now and group:
                        yield now[0], group
                        group = []
                    now = (bucket, one, two)
                    group.append(tuple(row))
            if group:
                yield now[0], group

        def put(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "share"])

        out: list[tuple[int, int, float]] = []
        for bucket, group in grouped():
            for row in find(bucket, group):
                out.append(row)
                if len(out) >= 10_000:
                    yield put(out)
                    out = []
        if out:
            yield put(out)

    place = ["bucket", "one", "two"]
    dealt = rows.select(*place, "node", "label", "n", held, "band", "block").repartition(*place).sortWithinPartitions(*place)
    return batches(dealt, work, "a long, b long, share double")


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (bucket, node, band) with the component of each node so far."""
    rows = shared.join(labels.withColumnRenamed("component", "label"), "node", "left")
    return rows.select("bucket", "node", F.coalesce("label", "node").alias("label"), "band")


def _dealt(rows: DataFrame, share: Column) -> DataFrame:
    """The rows of buckets that hold several labels, with their block, once for each pair of blocks (one <= two) they are compared in.

    `share` is the part of a block that a row fills. A bucket that fills more
    than one is cut into hashed blocks and every block meets every other and
    itself, so each pair of rows meets in one place. A label that fills more
    than one has blocks of its own, which do not meet each other: a settled
    group costs as much as the rows beside it, not the square of its size.
    """
    held = rows.withColumn("share", F.floor(share * WHOLE)).groupBy("bucket", "label").agg(F.sum("share").alias("share"))
    sizes = held.groupBy("bucket").agg(F.sum("share").alias("filled"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    mixed = cut(rows.join(sizes.select("bucket", "filled"), "bucket"))
    whole = mixed.where(f"filled <= {WHOLE}").drop("filled").select("*", *[F.lit(0).alias(c) for c in ("block", "one", "two")])
    large = mixed.where(f"filled > {WHOLE}").drop("filled")
    if large.isEmpty():
        return whole
    held = held.join(sizes.where(f"filled > {WHOLE}").select("bucket"), "bucket")
    owners = held.groupBy("bucket", F.when(F.col("share") > WHOLE, F.col("label")).alias("owner")).agg(F.ceil(F.sum("share") / WHOLE).cast("int").alias("blocks"))
    in_order = Window.partitionBy("bucket").orderBy("owner").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(owners.withColumn("first", F.coalesce(F.sum("blocks").over(in_order), F.lit(0)).cast("int")))
    totals = ranges.groupBy("bucket").agg(F.sum("blocks").cast("int").alias("total"))
    own = ranges.where("owner is not null").select("bucket", F.col("owner").alias("label"), F.col("blocks").alias("own_blocks"), F.col("first").alias("own_first"))
    common = ranges.where("owner is null").drop("owner").join(totals, "bucket", "right")
    spread = large.join(own, ["bucket", "label"], "left").join(common, "bucket")
    blocks, first = F.coalesce("own_blocks", "blocks"), F.coalesce("own_first", "first")
    # Blocks of one label lie side by side, from `first` on.
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda x: F.col("own_blocks").isNull() | (x < first) | (x >= first + blocks))
    placed = spread.withColumn("block", (first + F.pmod(F.xxhash64("node"), blocks)).cast("int")).withColumn("partner", F.explode(others))
    placed = placed.withColumn("one", F.least("block", "partner")).withColumn("two", F.greatest("block", "partner"))
    return whole.unionByName(placed.select(*whole.columns))


def _classified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n, home and set_hash (null where a row links with nothing) of every row; see `near_duplicates`."""
    base = cut(sketches(docs, key, text))
    classes = base.where("n > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    nodes = classes.drop("set_hash")
    bands = _bands(nodes)
    leaders = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    # Rows by bucket are merged with others: Spark sizes exploded rows like the table they come from and would broadcast them.
    shared = cut(bands.hint("merge").join(leaders, "bucket"))

    # First each node with the leader it meets in most buckets.
    met = shared.where("node <> leader").groupBy("node", "leader").count()
    best = met.groupBy("node").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    links = _linked(docs, cut(best.select(F.col("leader").alias("a"), F.col("node").alias("b"))), key, text)
    labels = connected_components(links)
    # Then each node with its likeliest partner in another component.
    rest, by_rows = shared.select("bucket", "node", "band"), F.lit(1 / LARGE_BUCKET)
    likely = _within_buckets(_dealt(_labelled(rest, labels), by_rows).hint("merge").join(nodes, "node"), "sketch", _likeliest)
    likely = likely.groupBy("a").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b"))
    pairs = cut(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = merged_components(labels, _linked(docs, pairs, key, text))
    # At last all pairs that are still plausible, inside their buckets: only nodes that have such a partner bring their sets there.
    rows = _labelled(rest, labels)
    open_nodes = cut(_within_buckets(_dealt(rows, by_rows).hint("merge").join(nodes, "node"), "sketch", _open_nodes).select(F.col("a").alias("bucket"), F.col("b").alias("node")).distinct())
    sets = _sets(docs, open_nodes.select("node"), key, text)
    full = _dealt(rows.join(open_nodes, ["bucket", "node"]).join(nodes.select("node", "n"), "node"), by_rows + F.col("n") / LARGE_SETS).hint("merge").join(sets, "node")
    links = cut(_within_buckets(full, "items", _links_inside).select("a", "b"))
    labels = merged_components(labels, links)

    homes = classes.select("set_hash", "node").join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("home"))
    placed = base.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    alone = placed.where("set_hash is null").select("doc_id", "n", F.col("doc_id").alias("home"), "set_hash")
    return placed.where("set_hash is not null").join(homes, "set_hash").select("doc_id", "n", "home", "set_hash").union(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: key, n_shingles, component_id, kept, one row for each row of `docs`.

    Words are runs of anything but ASCII white space, A-Z in lower case. Two
    documents link if their sets of five-word shingles have a Jaccard similarity
    of 0.75 or more; fewer words make one shingle; without words (or a null
    text) a document links with nothing. The component is the smallest key
    reachable. Equal sets are reduced to one node first. Then each node is
    compared with the bucket leader it meets most often, then with its likeliest
    partner outside its component so far. What is still plausible between
    components is decided on full sets inside the buckets, which give only links
    that join components: a group of copies is never written out as its pairs.

    Rows with a null key link with nothing and have a null component; rows that
    share a key count as one document. Other columns are not kept. The texts are
    read once for the sketches and once for each of up to three rounds of
    candidates; only the sets of candidates are shuffled.
    """
    result = _classified(docs, key, text)
    return result.select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("home").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("home"), F.lit(True)).alias("kept"),
    )


def _with_set_hash(docs: DataFrame, text: str, into: str) -> DataFrame:
    """`docs` with the hash of each text's shingle set, null without words."""
    place = docs.columns.index(text)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_keep("word hashes", dict)
        for batch in rows:
            sets = [shingle_set(t, words) for t in batch.column(place).to_pylist()]
            hashes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return batches(docs, work, f"{kinds}, `{into}` binary")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group: that of the smallest key.

    Rows that share a key but not their text go or stay each by its own text;
    rows equal in both stay or go together. All columns stay as they are. Only
    texts of keys with rows of both kinds are read once more.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("home"), F.lit(True))
    found = cut(_classified(docs, key, text).select("doc_id", "set_hash", kept.alias("kept")))
    verdicts = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).where("not every and doc_id is not null")
    its_id, its_hash, tag = (free_name(n, docs.columns) for n in ("its id", "its hash", "set hash"))
    odd = cut(verdicts.select(F.col("doc_id").alias(its_id), "some"))
    same = F.col(key).cast("long") == F.col(its_id)
    mixed = _with_set_hash(docs.join(odd.where("some"), same, "left_semi"), text, tag)
    good = found.where("kept").select(F.col("doc_id").alias(its_id), F.col("set_hash").alias(its_hash)).distinct()
    stay = mixed.join(good, same & F.col(tag).eqNullSafe(F.col(its_hash)), "left_semi").drop(tag)
    return docs.join(odd, same, "left_anti").union(stay)

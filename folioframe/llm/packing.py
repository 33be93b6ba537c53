"""Best-fit packing of token sequences, partition by partition and then up a tree of underfull bins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.bpe import library_encoder
from folioframe.llm.common import batches, cut, worker_keep

# Pieces a task packs at once, and bins in one group of a later round.
GROUP = 50_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every size, by best fit in order of falling size; ties stay in their order.

    Bins wait in lists by free space; a bit mask of the free spaces in use finds
    the smallest one that suffices.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    bin_of, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = mask >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, bins
            bins += 1
        bin_of[i], offset[i] = b, capacity - space
        if (left := space - size) > 0:
            free[left].append(b)
            mask |= 1 << left
    return bin_of, offset


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int, capacity: int = 4096, slack: int = 16,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents and their places: key, piece, start, length, ids_crc32, sequence_id, offset.

    `encoder` makes, in a worker, the function from a text to ids as
    little-endian unsigned 32-bit integers; `end_id` is added to each document.
    A document longer than `capacity` is cut into pieces of that length and a
    last, shorter one; others are one piece. A null text counts as empty and so
    is a piece of one token. Rows stay as they are, repeated ones (and null keys)
    included; an empty table gives an empty table; other columns are not kept.

    Round one packs the pieces of each task as they are encoded, `GROUP` at a
    time, without a shuffle. Bins with at most `slack` free places are done. The
    rest become items: groups of at most `GROUP` of them are packed again, round
    after round, until one group holds them all or a round saves less than a
    hundredth. Bins that are left then stay as they are, so nothing is dropped
    and no task sees more than a group.
    """

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_keep(("packing", key_of_encoder), encoder)
        end = end_id.to_bytes(4, "little")
        base, done = TaskContext.get().partitionId() << 40, 0
        names = ["id", "piece", "start", "length", "crc", "seq", "off", "fill"]
        pieces: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal done
            lengths = [p[3] for p in pieces]
            bins, offsets = best_fit(lengths, capacity)
            fill = [0] * (max(bins) + 1)
            for b, n in zip(bins, lengths, strict=True):
                fill[b] += n
            columns = [*map(list, zip(*pieces, strict=True)), [base + done + b for b in bins], offsets, [fill[b] for b in bins]]
            done += len(fill)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in rows:
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = (encode(t) if t else b"") + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    pieces.append((i, n, at // 4, len(part) // 4, zlib.crc32(part)))
                if len(pieces) >= GROUP:
                    yield packed()
                    pieces.clear()
        if pieces:
            yield packed()

    key_of_encoder = encoder.__qualname__ + repr([c.cell_contents for c in encoder.__closure__ or ()])
    first = cut(batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), work,
                        "id long, piece long, start long, length long, crc long, seq long, off long, fill long"))
    # A bin's first piece stands for it.
    moves = None
    items = first.where((F.col("off") == 0) & (F.col("fill") < capacity - slack)).select(F.col("seq").alias("item"), F.col("fill").alias("size"))
    count = items.count()
    rounds = [first]
    while count > 1:
        groups = -(-count // GROUP)

        def again(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("item", kind="stable")
            bins, offsets = best_fit(group["size"].tolist(), capacity)
            heads: dict[int, int] = {}
            total: dict[int, int] = {}
            for b, o, i, n in zip(bins, offsets, group["item"], group["size"], strict=True):
                if o == 0:
                    heads[b] = i
                total[b] = total.get(b, 0) + n
            return pd.DataFrame({"item": group["item"], "into": [heads[b] for b in bins], "shift": offsets, "fill": [total[b] for b in bins]})

        move = cut(items.withColumn("group", F.pmod(F.xxhash64("item", F.lit(len(rounds))), F.lit(groups))).groupBy("group")
                   .applyInPandas(again, "item long, into long, shift long, fill long"))
        rounds.append(move)
        if moves is None:
            moves = move.select("item", "into", "shift")
        else:
            step = move.select(F.col("item").alias("into"), F.col("into").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(step, "into", "left").select("item", F.coalesce("next", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        items = move.where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select(F.col("into").alias("item"), F.col("fill").alias("size"))
        before, count = count, items.count()
        bins_now = move.where("shift = 0").count()
        if groups == 1 or bins_now > 0.99 * before:
            break
    sequence, offset = F.col("seq"), F.col("off")
    placed = first
    if moves is not None:
        placed = first.join(moves.withColumnRenamed("item", "seq"), "seq", "left")
        sequence, offset = F.coalesce("into", "seq"), F.col("off") + F.coalesce("shift", F.lit(0))
    return placed.select(
        F.col("id").alias(key), F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"),
        sequence.alias("sequence_id"), offset.alias("offset"),
    )


def pack_with_library(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """`pack` with the ids of a tokenizer file that drops white space."""

    def make() -> Callable[[str], bytes]:
        return library_encoder(tokenizer).encode

    return pack(docs, make, end_id, capacity)

"""Token ids in binary shards of fixed-width bit-packed blocks.

Layout of a shard, all numbers little-endian:

    magic    8 bytes  b"BITTOK01"
    blocks   each block holds up to `block` ids of `width` bits, packed from the
             low bit up and filled to whole bytes
    offsets  unsigned 64 bit: the place of each block in the file
    index    signed 64 bit: the key of each document, then the number of ids
             before it in the shard, each in ascending key order
    footer   eight unsigned 64 bit: width, ids in a block, ids, documents, those
             at the front that have no key, blocks, place of the offsets, place of
             the index
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.bpe import MARKS, Recent, byte_letters, is_word
from folioframe.llm.common import batches, cut, worker_keep
from folioframe.session import checkpoint_dir, hadoop_folder

MAGIC = b"BITTOK01"
BLOCK = 1 << 16
FOOTER = 8
# Text bytes that go into one shard, about.
SHARD_BYTES = 64 << 20

# The split pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# White space other than blank and line feed, or the mark used below: such texts take the pattern at once.
UNUSUAL = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
RUNS = tuple(a + b + c for a in " \n" for b in " \n" for c in " \n")
ENDS = tuple(a + b for a in " \n" for b in " \n")


class ByteEncoder:
    """Ids of whole texts for a byte-level vocabulary; pieces at blanks and line feeds are remembered up to a bound.

    Inside runs of at most two white-space characters the pattern always splits
    in front of the last one, so such texts can be cut there first. Words go
    through the library's model; texts with added tokens or letters beyond
    U+024F through the whole library.
    """

    def __init__(self, path: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._tokenize = self._library.model.tokenize
        self._letters = byte_letters()
        self._added = tuple(t.content for t in self._library.get_added_tokens_decoder().values())
        self._blank = self._letters[32]
        self._pieces = Recent(remember)

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if (found := self._pieces.older(piece)) is not None:
            return found
        word = piece[1:] if piece[0] == " " else piece
        if is_word(word):
            plain = word if word.isascii() else "".join([self._letters[b] for b in word.encode()])
            ids = [t.id for t in self._tokenize(plain if word is piece else self._blank + plain)]
        elif len(word) > 1 and word[-1] in MARKS and is_word(word[:-1]):
            found = (self._pieces.new.get(piece[:-1]) or self._piece(piece[:-1])) + self._piece(piece[-1])
            self._pieces.keep(piece, found)
            return found
        elif piece.isascii() or max(piece) < "ɐ":
            letters, ids = self._letters, []
            for word in PATTERN.findall(piece):
                ids += [t.id for t in self._tokenize("".join([letters[b] for b in word.encode()]))]
        else:
            ids = self._library.encode(piece, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        if len(piece) <= 48:
            self._pieces.keep(piece, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(a in text for a in self._added):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if UNUSUAL.search(text) or text.endswith(ENDS) or any(r in text for r in RUNS):
            pieces = PATTERN.findall(text) if text.isascii() or max(text) < "ɐ" else [text]
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        get, piece = self._pieces.new.get, self._piece
        return b"".join([get(p) or piece(p) for p in pieces])


def bits_for(vocabulary: int) -> int:
    """The bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width, `width` bits each."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int, start: int = 0) -> np.ndarray:
    """`count` ids from the `start`-th on."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    at = (start + np.arange(count, dtype=np.int64)) * width
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
    first = at >> 3
    word = raw[first]
    for k in range(1, 5):
        word = word | (raw[first + k] << np.uint64(8 * k))
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class ShardWriter:
    """Writes one shard; ids come document by document and leave block by block."""

    def __init__(self, file, width: int, block: int = BLOCK):
        self._file, self._width, self._block = file, width, block
        self._waiting: list[np.ndarray] = []
        self._held = self.ids = self._nameless = 0
        self._keys: list[int] = []
        self._starts: list[int] = []
        self._offsets: list[int] = []
        self._at = len(MAGIC)
        file.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self._width)
        self._offsets.append(self._at)
        self._at += len(data)
        self._file.write(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """A document; those without a key come first."""
        if len(ids) and int(ids.max()) >> self._width:
            raise ValueError("an id does not fit into the width")
        self._nameless += key is None
        self._keys.append(key or 0)
        self._starts.append(self.ids)
        self.ids += len(ids)
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self._block:
            held = np.concatenate(self._waiting)
            whole = len(held) // self._block * self._block
            for at in range(0, whole, self._block):
                self._put(held[at : at + self._block])
            self._waiting, self._held = [held[whole:]], len(held) - whole

    def close(self) -> None:
        if self._held:
            self._put(np.concatenate(self._waiting))
        offsets_at = self._at
        index_at = offsets_at + 8 * len(self._offsets)
        for part in (np.array(self._offsets, "<u8"), np.array(self._keys, "<i8"), np.array(self._starts, "<i8"),
                     np.array([self._width, self._block, self.ids, len(self._keys), self._nameless, len(self._offsets), offsets_at, index_at], "<u8")):
            self._file.write(part.tobytes())


class ShardReader:
    """Random access to a shard by document number or position."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        self.width, self.block, self.ids, documents, nameless, blocks, offsets_at, index_at = map(int, self._numbers(size - 8 * FOOTER, FOOTER, "<u8"))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        self._offsets = [*map(int, self._numbers(offsets_at, blocks, "<u8")), offsets_at]
        keys = self._numbers(index_at, documents, "<i8").tolist()
        self.keys = [None] * nameless + keys[nameless:]
        self.starts = np.append(self._numbers(index_at + 8 * documents, documents, "<i8"), self.ids)
        self._last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _numbers(self, at: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(at, 8 * count), kind)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from place `start` up to `stop` of the shard."""
        out = []
        while start < stop:
            number, inside = divmod(start, self.block)
            if self._last[0] != number:
                self._last = number, self._read(self._offsets[number], self._offsets[number + 1] - self._offsets[number])
            count = min(stop - start, self.block - inside)
            out.append(unpack_bits(self._last[1], self.width, count, inside))
            start += count
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        return self.slice(int(self.starts[number]), int(self.starts[number + 1]))


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """(has a key, key, tie) of the first row of each shard, over `rows` (id, tie, size) in order of id and tie, nulls first.

    Sizes are summed up by ranges of the order, and inside each range by a window.
    The driver gets one row for each `shard_bytes` of the table.
    """
    light = cut(rows)
    ranged = cut(light.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("range").agg(F.sum("size").alias("n")).select("range", before.alias("before"))  # one row for each range
    inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("sum", F.sum("size").over(inside)).join(offsets, "range")
    shard = F.floor((F.col("before") + F.col("sum") - F.col("size")) / shard_bytes)
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "tie")).alias("first"))
    table = firsts.select("first.*").distinct().orderBy("known", "id", "tie").toArrow()
    return list(zip(*(table.column(n).to_pylist() for n in ("known", "id", "tie")), strict=True))


def write_shards(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], vocabulary: int, end_id: int, target: str,
                 key: str = "doc_id", text: str = "text", block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents in ascending key order; returns (shard, path, ids, documents), one row for each file.

    First a pass over keys, text hashes and lengths finds where shards begin (see
    `shard_starts`). Then the scan's own tasks encode the texts, and only key and
    packed ids are dealt to the shards and sorted within; each task writes one
    file under a name of its own attempt, then moves it to its final name, so that
    a task that runs again replaces its file whole. A null text is empty; `end_id` ends
    every document. Rows with a null key come first. Rows that share a key stand
    together, ordered by a hash of their text. `target` is a folder that all executors share.
    """
    width = bits_for(max(vocabulary, end_id + 1))

    inner = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    starts = shard_starts(inner.select("id", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")), shard_bytes)

    def encoded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_keep(("bit pack", name), encoder)
        end = end_id.to_bytes(4, "little")
        for batch in rows:
            keys, ties, texts = (c.to_pylist() for c in batch.columns)
            ids = [np.frombuffer((encode(t) if t else b"") + end, "<u4") for t in texts]
            if any(int(i.max()) >> width for i in ids):
                raise ValueError("an id does not fit into the width")
            shard = [max(0, bisect_right(starts, (k is not None, k or 0, t)) - 1) for k, t in zip(keys, ties, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), batch.column(0), batch.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array([pack_bits(i, width) for i in ids], pa.binary())],
                ["shard", "id", "tie", "count", "packed"],
            )

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer = handle = None
        documents = 0
        for batch in rows:
            for k, count, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    files, folder = _place(target)
                    files.create_dir(folder, recursive=True)
                    draft, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/shard-{shard:07d}.bin"
                    handle = files.open_output_stream(draft)
                    writer = ShardWriter(handle, width, block)
                writer.add(k, unpack_bits(packed, width, count))
                documents += 1
        if writer is not None:
            writer.close()
            handle.close()
            files.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((shard, pa.int64()), (f"{target}/shard-{shard:07d}.bin", pa.string()), (writer.ids, pa.int64()), (documents, pa.int64()))],
                                             ["shard", "path", "ids", "documents"])

    name = encoder.__qualname__ + repr([c.cell_contents for c in encoder.__closure__ or ()])
    packed = batches(inner, encoded, "shard int, id long, tie long, count long, packed binary")
    dealt = packed.repartitionById(max(1, len(starts)), "shard").sortWithinPartitions("id", "tie").select("id", "count", "packed")
    return cut(batches(dealt, work, "shard long, path string, ids long, documents long"))


def read_shards(files: DataFrame) -> DataFrame:
    """The documents of written shards: key, start (ids of all documents before it) and ids (unsigned 32 bit, binary).

    `files` is what `write_shards` returned. Each task opens its files and reads
    block after block.
    """
    totals = files.withColumn("base", F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids"))

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = _place(path)
                with store.open_input_file(place) as file:
                    reader = ShardReader(file)
                    for at in range(0, len(reader.keys), 256):
                        some = range(at, min(at + 256, len(reader.keys)))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.keys[d] for d in some], pa.int64()), pa.array([base + int(reader.starts[d]) for d in some], pa.int64()),
                                pa.array([reader.document(d).astype("<u4").tobytes() for d in some], pa.binary()),
                            ],
                            ["id", "start", "ids"],
                        )

    spread = totals.select("path", "base").repartition(F.col("path"))
    return batches(spread, work, "id long, start long, ids binary")


def write_and_read(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 2) -> DataFrame:
    """Write documents with the ids of a byte-level tokenizer file under the shared folder, and read them back: doc_id, start, ids."""
    target = f"{checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    target = target if "://" in target else "file://" + target
    folder, files = hadoop_folder(docs.sparkSession, target)
    files.deleteOnExit(folder)

    def make() -> Callable[[str], bytes]:
        return ByteEncoder(tokenizer).encode

    return read_shards(write_shards(docs, make, vocabulary, end_id, target)).withColumnRenamed("id", "doc_id")

"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that its BPE encoding can
end with. A string automaton over the vocabulary lists the tokens that end at
each position; a token is the last one of the prefix if it survives next to the
last token of the prefix in front of it. Back-pointers from the end give the ids.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import batches, worker_keep

# Marks the end of a word inside the automaton, in place of the suffix string of the vocabulary.
WORD_END = "\ue000"
LONG = float("inf")
# White space of the split pattern.
BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class PrefixBpe:
    """Exact BPE of single words from the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self._letters = byte_letters()
        vocab = model["vocab"]
        self._pairs: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[left + right]
            self._pairs[vocab[left], vocab[right]] = rank
            self._parts.setdefault(token, (vocab[left], vocab[right], rank))
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], tuple[list[int], list[float]]] = {}
        self._automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            inner = token[: -len(self.suffix)] + WORD_END if self.suffix and token.endswith(self.suffix) else token
            symbols = len(inner) - inner.endswith(WORD_END)
            if (symbols == 1 or i in self._parts) and self.whole(i):  # others never come out of merges
                self._automaton.add_word(inner, (i, len(inner)))
        self._automaton.make_automaton()

    def _edge(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """What stands at one edge (0 left, 1 right) of a token as it is merged together, and the rank of the merge that ends each."""
        if (found := self._edges.get((token, side))) is None:
            chain, ends = [token], [LONG]
            while (parts := self._parts.get(chain[-1])) is not None:
                chain.append(parts[side])
                ends.append(parts[2])
            found = self._edges[token, side] = chain[::-1], ends[::-1]
        return found

    def _apart(self, a: int, b: int, grown: bool) -> bool:
        """Whether no merge crosses the seam of two neighbours while each grows (and, without `grown`, afterwards)."""
        left, left_ends = self._edge(a, 1)
        right, right_ends = self._edge(b, 0)
        i = j = 0
        while True:
            done = i == len(left) - 1 and j == len(right) - 1
            if done and grown:
                return True
            rank = self._pairs.get((left[i], right[j]))
            # Of equal ranks the leftmost merge comes first.
            if rank is not None and rank < left_ends[i] and rank <= right_ends[j]:
                return False
            if done:
                return True
            if left_ends[i] <= right_ends[j]:
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the text of a token is encoded as that one token."""
        if (known := self._whole.get(token)) is None:
            parts = self._parts.get(token)
            known = parts is None or (self.whole(parts[0]) and self.whole(parts[1]) and self._apart(parts[0], parts[1], True))
            self._whole[token] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens can stand side by side."""
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._apart(a, b, False)
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word (one piece of the pre-tokenizer)."""
        letters = self._letters
        plain = word.isascii() and word.isalnum()  # printable ASCII stands for itself
        text = (word if plain else "".join([letters[b] for b in word.encode()])) + (WORD_END if self.suffix else "")
        last: list[int | None] = [None] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        known = self._fits
        for end, (token, size) in self._automaton.iter(text):
            stop = end + 1
            start = stop - size
            if last[stop] is not None:
                continue
            if start:
                before = last[start]
                if before is None:
                    continue
                fits = known.get((before, token))
                if not (self.fits(before, token) if fits is None else fits):
                    continue
            last[stop], back[stop] = token, start
        out, at = [], len(text)
        while at:
            if (token := last[at]) is None:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token)
            at = back[at]
        return out[::-1]


class WordSplitter:
    """Normalizer and pre-tokenizer of a tokenizer file, chunk by chunk.

    Characters below U+0250 take a pattern here; others go through the library's
    own two steps, so that Unicode tables are the library's.
    """

    # The split pattern of the vocabulary.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self._bytes = {c: b for b, c in enumerate(byte_letters())}

    def words(self, chunk: str) -> list[str]:
        if chunk.isascii() or (max(chunk) < "\u0250" and "\x85" not in chunk and "\xa0" not in chunk):
            return self.PATTERN.findall(chunk.lower())
        pieces = self._split(self._normalize(chunk))
        return [bytes([self._bytes[c] for c in piece]).decode() for piece, _ in pieces]


# Marks that end a word and are a piece of the pattern on their own.
MARKS = frozenset(".,;:!?")


def is_word(text: str) -> bool:
    """Whether a text of letters below U+0250 is one piece of the pattern."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250") and len(text) <= 40


class Recent:
    """A bounded memory in two generations: what is asked for again outlives what is not."""

    def __init__(self, most: int):
        self._half = max(1, most // 2)
        self.new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def older(self, key: str) -> bytes | None:
        """What is not in `new`, brought forward."""
        if (found := self.new.get(key)) is None and (found := self._old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(self.new) >= self._half:
            self._old, self.new = self.new, {}
        self.new[key] = value


class TextEncoder:
    """Ids of whole texts for a vocabulary that drops white space; chunks between white space are remembered up to a bound.

    `encode_word` turns one piece of the pre-tokenizer into ids.
    """

    def __init__(self, path: str, encode_word: Callable[[str], list[int]], added: dict[str, int], remember: int = 600_000):
        self._encode_word, self._added = encode_word, added
        self._splitter = WordSplitter(path)
        self._at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._chunks = Recent(remember)

    def _chunk(self, chunk: str) -> bytes:
        if (found := self._chunks.older(chunk)) is not None:
            return found
        low = chunk.lower()
        if is_word(low):
            ids = self._encode_word(low)
        elif len(chunk) > 1 and chunk[-1] in MARKS and is_word(low[:-1]):
            found = (self._chunks.new.get(chunk[:-1]) or self._chunk(chunk[:-1])) + self._chunk(chunk[-1])
            self._chunks.keep(chunk, found)
            return found
        else:
            ids = []
            for part in self._at_added.split(chunk) if self._at_added and "<" in chunk else (chunk,):
                if part in self._added:
                    ids.append(self._added[part])
                elif part:
                    for word in self._splitter.words(part):
                        ids += self._encode_word(word)
        found = array("I", ids).tobytes()
        if len(chunk) <= 48:
            self._chunks.keep(chunk, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, chunk = self._chunks.new.get, self._chunk
        # The library's white space lacks U+001C to U+001F, which str.split takes for white space.
        pieces = BLANKS.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join([get(c) or chunk(c) for c in pieces])


def prefix_encoder(path: str) -> TextEncoder:
    """Whole texts through the dynamic program."""
    bpe = PrefixBpe(path)
    return TextEncoder(path, bpe.encode_word, bpe.added)


def library_encoder(path: str) -> TextEncoder:
    """Whole texts through the library's own BPE model, word by word."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    tokenize, letters = library.model.tokenize, byte_letters()
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}

    def encode_word(word: str) -> list[int]:
        # Printable ASCII stands for itself.
        return [t.id for t in tokenize(word if word.isascii() and word.isalnum() else "".join([letters[b] for b in word.encode()]))]

    return TextEncoder(path, encode_word, added)


def decode(names: np.ndarray, ids: bytes) -> str:
    """The tokens of ids joined by blanks, as for a vocabulary without a decoder."""
    return " ".join(names[np.frombuffer(ids, "<u4")].tolist())


def token_names(path: str) -> np.ndarray:
    """Token strings by id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    return np.array([names.get(i, "") for i in range(max(names) + 1)], object)


def encode_and_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text and the text decoded from them: key, ids (binary, little-endian unsigned 32 bit), decoded.

    A null text counts as empty; it has no ids and decodes to the empty string.
    Rows stay as they are, repeated ones included; other columns are not kept.
    No shuffle: each task encodes the rows it has read.
    """

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_keep(("prefix bpe", tokenizer), lambda: prefix_encoder(tokenizer))
        names = worker_keep(("token names", tokenizer), lambda: token_names(tokenizer))
        for batch in rows:
            ids = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([decode(names, i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    inner = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    return batches(inner, work, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", key)

"""The Python functions of the package: the sequence-matcher ratio and the bounds on it.

They run in Arrow batches: the ratio on candidate pairs only, the bounds on whole
blocks of titles in `operators.linkage`.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=20_000)
def _places(text: str) -> dict[str, int]:
    """Per character the set of its places in the text, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence; one step on whole bit sets for each character of `b`."""
    places, every = _places(a), (1 << len(a)) - 1
    unmatched = every
    for c in b:
        if hit := unmatched & places.get(c, 0):
            unmatched = ((unmatched + hit) | (unmatched - hit)) & every
    return len(a) - unmatched.bit_count()


# Characters are told apart by their code modulo this: two that fall together only let more pairs through.
CLASSES = 64
# Rows and columns of two blocks whose shared characters are counted at once, and pairs whose subsequences are.
TILE, WIDTH, PAIRS = 64, 1 << 11, 1 << 17
# Titles that differ in more characters than this are compared one pair at a time.
WIDEST = 127
# With fewer partners a title's halves are not looked at.
FEW = 64


class TitleBlock:
    """Titles as arrays with a row each, by rising length: their character classes, how often each occurs in all and by halves, and as bits where."""

    def __init__(self, titles: list[str]):
        self.titles = titles
        self.places_of_rows = sorted(range(len(titles)), key=lambda n: len(titles[n]))
        titles = [titles[n] for n in self.places_of_rows]
        self.lengths = np.array([len(t) for t in titles], dtype=np.int64)
        longest = int(self.lengths.max(initial=0))
        self.codes = np.full((longest, len(titles)), CLASSES, dtype=np.int64)
        for n, title in enumerate(titles):
            self.codes[: len(title), n] = np.frombuffer(title.encode("utf-32-le"), dtype=np.uint32) % CLASSES
        halves = np.arange(longest)[:, None] < self.lengths // 2
        found = [((at := self.codes == c).sum(axis=0, dtype=np.uint16), (at & halves).sum(axis=0, dtype=np.uint16)) for c in range(CLASSES)]
        self.counts, self.in_half = (np.stack([f[k] for f in found]) for k in (0, 1))
        self.behind_half = self.counts - self.in_half

    def places(self, rows: np.ndarray, front: int, behind: int) -> np.ndarray:
        """(row, class, word): a bit for each place of a class, `front` words of nothing before and `behind` after them; the last class is nowhere."""
        longest = int(self.lengths[rows].max(initial=0))
        words = front + (longest + 63) // 64 + behind
        bits = np.zeros((len(rows), CLASSES + 1, words), dtype=np.uint64)
        every = np.arange(len(rows))
        for i in range(longest):
            bits[every, self.codes[i, rows], front + i // 64] |= np.uint64(1 << i % 64)
        bits[:, CLASSES] = 0
        return bits


def _needed(total: np.ndarray, least: float) -> np.ndarray:
    """The characters that two titles of this length together must have in common."""
    return np.ceil(least * total / 2 - 1e-9).astype(np.int64)


def _sharing(a: TitleBlock, b: TitleBlock, least: float, rising: bool):
    """Pairs (rows of a, rows of b) of like length that share enough characters; of a block with itself each pair once."""
    used = [c for c in range(CLASSES) if a.counts[c].any() and b.counts[c].any()]
    longest = int(max(a.lengths.max(initial=0), b.lengths.max(initial=0)))
    kind = np.uint8 if longest < 256 else np.uint16
    of_a, of_b = a.counts.astype(kind), b.counts.astype(kind)
    enough = _needed(np.arange(2 * longest + 1), least).astype(kind)
    for start in range(0, len(a.titles), TILE):
        rows = slice(start, start + TILE)
        lengths = a.lengths[rows]
        low, high = np.searchsorted(b.lengths, (lengths[0] * least / (2 - least) - 1e-6, lengths[-1] * (2 - least) / least + 1e-6)).tolist()
        some, row = np.unique(lengths, return_inverse=True)
        for first in range(max(low, start + 1) if rising else low, high, WIDTH):
            near = slice(first, min(first + WIDTH, high))
            shared = np.zeros((len(lengths), near.stop - first), dtype=kind)
            least_of = np.empty_like(shared)
            for c in used:
                np.minimum(of_a[c, rows, None], of_b[c, None, near], out=least_of)
                shared += least_of
            i, j = np.divmod(np.flatnonzero(shared >= enough[some[:, None] + b.lengths[None, near]][row]), shared.shape[1])
            i, j = i + start, j + first
            if rising:
                i, j = i[i < j], j[i < j]
            yield i, j


def _by_halves(a: TitleBlock, b: TitleBlock, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (in order of i) share enough characters if b is cut in the middle.

    Wherever a common subsequence leaves the first half of b, it leaves a part of
    a behind. So some place in a must divide it into a part that shares with b's
    first half and one that shares with the second, together as many characters
    as needed. From one place to the next one character changes sides.
    """
    kept = np.ones(len(i), dtype=bool)
    starts = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
    for start, stop in zip(starts, [*starts[1:], len(i)], strict=True):
        if stop - start < FEW:
            continue
        n, others = int(a.lengths[i[start]]), j[start:stop]
        m, codes = b.lengths[others], a.codes[:n, i[start]]
        need, middle = _needed(n + m, least), m // 2
        first, last = max(0, int((middle + need - m).min())), min(n, int((middle + n - need).max()))
        letters, where = np.unique(codes, return_inverse=True)
        upto = np.cumsum(where[:, None] == np.arange(len(letters)), axis=0, dtype=np.uint16)
        before = upto[first - 1] if first else np.zeros_like(upto[0])
        one, two = (x[letters].take(others, axis=1) for x in (b.in_half, b.behind_half))
        shared = np.minimum(one, before[:, None]).sum(axis=0, dtype=np.int16) + np.minimum(two, (upto[-1] - before)[:, None]).sum(axis=0, dtype=np.int16)
        if first < last:
            moved = where[first:last]
            so_far = upto[np.arange(first, last), moved][:, None]
            left = upto[-1][moved][:, None] - so_far
            gained = (one[moved] >= so_far).view(np.int8) - (two[moved] > left).view(np.int8)
            shared = shared + np.maximum(np.cumsum(gained, axis=0, dtype=np.int16).max(axis=0), 0)
        kept[start:stop] = shared >= need
    return kept


def _reaching(a: TitleBlock, b: TitleBlock, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs may have a common subsequence that is long enough.

    One step on bit sets for each character of b, for all pairs at once. With d
    characters unmatched in both titles a match lies on one of d + 1 diagonals, so a
    window that moves along holds all that can still change; what it leaves
    behind is counted. Pairs that cannot get there any more drop out.
    """
    n, m = a.lengths[i], b.lengths[j]
    lost = np.floor((n + m) * (1 - least) + 1e-9).astype(np.int64)
    size = int(lost.max()) // 64 + 1
    low = -((lost - n + m) // 2)
    width = (n - m + lost) // 2 - low + 1
    rows, at = np.unique(i, return_inverse=True)
    places = a.places(rows, size, 2 * size + 1)
    words = places.shape[2]
    flat = places.reshape(-1)
    base, start = at * ((CLASSES + 1) * words), low + 64 * size
    need = least * (n + m) / 2 - 1e-9
    one, top, full = np.uint64(1), np.uint64(1 << 63), np.uint64(2**64 - 1)
    inside = [np.where(width >= 64 * (k + 1), full, (one << np.clip(width - 64 * k, 0, 63).astype(np.uint64)) - one) for k in range(size)]
    window = [np.full(len(i), full) for _ in range(size)]
    behind = np.zeros(len(i), dtype=np.int64)
    alive = np.arange(len(i))
    for step in range(int(m.max())):
        offset = start + step
        where = base + b.codes[step][j] * words + np.minimum(offset >> 6, words - size - 1)
        right = (offset & 63).astype(np.uint64)
        left = np.uint64(63) - right
        carry = None
        following = flat.take(where)
        for k in range(size):
            here, following = following, flat.take(where + (k + 1))
            v = window[k]
            hit = ((here >> right) | ((following << one) << left)) & inside[k] & v
            total = v + hit
            if size > 1:
                over = total < v
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            window[k] = total | (v ^ hit)
        behind += (~window[0] & one).astype(np.int64)
        for k in range(size):
            window[k] = (window[k] >> one) | ((window[k + 1] << np.uint64(63)) if k + 1 < size else top)
        if step % 8 == 7:
            ahead = sum((np.bitwise_count(~w).astype(np.int64) for w in window), np.zeros(len(i), dtype=np.int64))
            most = behind + np.minimum(ahead + np.maximum(m - step - 1, 0), n - np.clip(step + 1 + low, 0, n))
            kept = np.flatnonzero(most >= need)
            if len(kept) < 0.8 * len(i):
                i, j, n, m, low, need, base, start, behind, alive = (x[kept] for x in (i, j, n, m, low, need, base, start, behind, alive))
                inside, window = [x[kept] for x in inside], [x[kept] for x in window]
            if not len(i):
                return alive
    found = behind + sum(np.bitwise_count(~w).astype(np.int64) for w in window)
    return alive[found >= need]


def matching_pairs(a: TitleBlock, b: TitleBlock, least: float) -> list[tuple[int, int]]:
    """Places of titles whose longest common subsequence lets them reach the ratio; if `a is b`, each pair once in rising order and none of a title with itself."""
    out = []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        by_row = np.argsort(i, kind="stable")
        i, j = i[by_row], j[by_row]
        shared = _by_halves(a, b, i, j, least)
        i, j = i[shared], j[shared]
        lost = np.floor((a.lengths[i] + b.lengths[j]) * (1 - least) + 1e-9)
        for picked in ((lost < 64) & (lost >= 0), (lost >= 64) & (lost <= WIDEST)):
            x, y = i[picked], j[picked]
            if len(x):
                kept = _reaching(a, b, x, y, least)
                out.extend(zip(x[kept].tolist(), y[kept].tolist(), strict=True))
        wide = lost > WIDEST
        out.extend(zip(i[wide].tolist(), j[wide].tolist(), strict=True))

    held, count = [], 0
    for i, j in _sharing(a, b, least, a is b):
        held.append((i, j))
        count += len(i)
        if count >= PAIRS:
            settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if count:
        settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
    reaches = lambda x, y: 2 * common_length(x, y) >= (least - 1e-12) * (len(x) + len(y))
    found = [(a.places_of_rows[x], b.places_of_rows[y]) for x, y in out]
    return [(min(x, y), max(x, y)) if a is b else (x, y) for x, y in found if reaches(a.titles[x], b.titles[y])]


def sequence_ratio(left: str, right: str) -> Column:
    """2 * matching characters / total length; argument order matters.

    Declared non-deterministic only so that the optimizer neither moves it ahead
    of a `distinct` nor runs it twice.
    """

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio.asNondeterministic()(left, right)

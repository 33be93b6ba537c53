"""Chat formatting in windows of bounded length."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.bpe import library_encoder
from folioframe.llm.common import BATCH_ROWS, batches, cut, numbered, worker_keep

# A turn reads OPEN role BODY text CLOSE.
OPEN, BODY, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
# Strings that must not come out of a text as they are: the template's own and the usual ones of chat models.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# Turns that one task formats together.
SEGMENT = 256

_LONGEST = sorted(CONTROL, key=len, reverse=True)
# The first character of a control string, backslashes, and the rest.
_PLAIN = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in _LONGEST))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in _LONGEST))
# Without one of their first characters no control string is in a text.
_STARTS = sorted({c[0] for c in CONTROL})
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: str) -> str:
    """A backslash more behind the first character of each control string, however many are there already."""
    return _PLAIN.sub(r"\\", text) if any(c in text for c in _STARTS) else text


def unescape(text: str) -> str:
    """What `escape` was given."""
    return _ESCAPED.sub("", text) if any(c in text for c in _STARTS) else text


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn; the places are those of the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def choose_windows(tokens: np.ndarray, budget: int, system: int, history: int, start: int = 0) -> list[tuple[int, int, int]]:
    """(first history turn, first new turn, end) of each window over turns of the given token counts, new from turn `start` on.

    Prefix sums give the longest span of new turns that fits beside a system
    turn of `system` tokens and up to `history` earlier turns; history gives way
    to the first new turn. A turn that does not fit alone is a window of its own.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    room = budget - system
    out, at = [], start
    while at < len(tokens):
        back = at
        while back > 0 and at - back < history and total[at + 1] - total[back - 1] <= room:
            back -= 1
        end = max(at + 1, int(np.searchsorted(total, total[back] + room, side="right")) - 1)
        out.append((back, at, end))
        at = end
    return out


def format_windows(turns: DataFrame, counter: Callable[[], Callable[[str], int]], budget: int = 1024, history: int = 2) -> DataFrame:
    """Training windows of conversations: conv_id, segment, window, formatted, repeated, n_new, loss_spans, over_budget.

    `turns` has conv_id, turn, role and text; `counter` makes, in a worker, the
    function from a text to its tokens (the template's own strings count one
    each, three a turn). A conversation's turns are taken in order of turn, role and text
    (nulls first); a null text or role is empty. Each window starts with the
    conversation's first turn if that is a system turn, repeats up to `history`
    turns and goes on with new ones up to `budget` tokens; over_budget marks a
    single turn that is longer. `repeated` counts the turns at the front that an
    earlier window had. loss_spans are the character places (start, stop) of the
    new assistant texts in `formatted`, so each counts once. Control strings
    inside texts are escaped, see `escape`. Conversations with a null id are
    taken as one. Repeated rows are turns like others; other columns are ignored.

    Turns are numbered within their conversation and dealt by SEGMENT of them, so a
    conversation of any length, gaps or repeats in its turn numbers, or with a null id is
    formatted by many tasks; a segment starts a window of its own, with its
    system turn and the last `history` turns in front of it brought along.
    """
    if not 0 <= history < SEGMENT:
        raise ValueError("the history must be shorter than a segment")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = cut(numbered(rows, ["conv_id"], ["turn", "role", "text"]).withColumn("segment", F.floor(F.col("number") / SEGMENT)))
    columns = ["conv_id", "role", "text", "number"]
    later = F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("count") - 1) / SEGMENT)))
    openings = rows.where(f"number = 0 and count > {SEGMENT}").select(*columns, later.alias("segment"), F.lit(0).alias("kind"))
    brought_on = rows.where((F.pmod("number", F.lit(SEGMENT)) >= SEGMENT - history) & ((F.col("segment") + 1) * SEGMENT < F.col("count")))
    earlier = brought_on.select(*columns, F.col("segment") + 1, F.lit(1).alias("kind"))
    everything = rows.select(*columns, "segment", F.lit(2).alias("kind")).union(openings).union(earlier)

    name = counter.__qualname__ + repr([c.cell_contents for c in counter.__closure__ or ()])
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(span), pa.bool_()]
    names = ["conv_id", "segment", "window", "formatted", "repeated", "n_new", "loss_spans", "over_budget"]

    def windows_of(place: tuple, turns_: list[tuple], count: Callable[[str], int]) -> Iterator[tuple]:
        """The windows of one segment, its turns in order of kind and number."""
        kind, roles, texts = np.array([t[0] for t in turns_]), [t[1] for t in turns_], [t[2] for t in turns_]
        written, masks = [], []
        for role, text in zip(roles, texts, strict=True):
            head, body = OPEN + escape(role) + BODY, escape(text)
            written.append(head + body + CLOSE)
            masks.append((len(head), len(head) + len(body)))
        tokens = np.array([count(r) + count(t) + 3 for r, t in zip(roles, texts, strict=True)], np.int64)
        order = np.flatnonzero(kind > 0)  # history, then new turns
        brought = kind[0] == 0  # a later segment: its conversation's first turn comes first
        opener = 0 if brought else int(order[0])
        system = [opener] if roles[opener] == "system" else []
        new_system = int(bool(system) and not brought)
        order = order[new_system:]
        spans = choose_windows(tokens[order], budget, int(tokens[system].sum()), history, int((kind == 1).sum()))
        for number, (back, at, end) in enumerate(spans or [(0, 0, 0)]):
            items = [*system, *order[back:end].tolist()]
            fresh = end - at + (new_system if number == 0 else 0)
            repeated = len(items) - fresh
            place_of = np.cumsum([0, *[len(written[i]) for i in items]]).tolist()
            loss = [{"start": place_of[n] + masks[i][0], "stop": place_of[n] + masks[i][1]} for n, i in enumerate(items) if n >= repeated and roles[i] == "assistant"]
            yield *place, number, "".join([written[i] for i in items]), repeated, fresh, loss, bool(tokens[items].sum() > budget)

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_keep(("chat counter", name), counter)

        def segments() -> Iterator[tuple[tuple, list[tuple]]]:
            now, group = None, []
            for batch in rows:
                for conv, segment, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group and (conv, segment) != now:
                        yield now, group
                        group = []
                    now = (conv, segment)
                    group.append(tuple(turn))
            if group:
                yield now, group

        found = (window for place, group in segments() for window in windows_of(place, group, count))
        while some := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    dealt = everything.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "number")
    return batches(dealt.select("conv_id", "segment", "kind", "role", "text"), work,
                   "conv_id long, segment long, window int, formatted string, repeated int, n_new int, loss_spans array<struct<start int, stop int>>, over_budget boolean")


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations out of their windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The first digest is over role, line feed, text, line feed of every turn; the
    second over the code points (UTF-8) of all text under the loss mask. A task streams over its
    conversations window by window and holds one window at a time.
    """

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, open_, done = None, False, []
        n = chars = written = 0
        turns = loss = None
        for batch in rows:
            for conv, formatted, repeated, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or conv != now:
                    if open_:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), written))
                    now, open_, n, chars, written, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in read_turns(formatted)[repeated:]:
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["stop"]])
                    chars += len(text)
                    loss.update(text.encode())
                written += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if open_:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), written))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    dealt = windows.select("conv_id", "segment", "window", "formatted", "repeated", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return batches(dealt.select("conv_id", "formatted", "repeated", "loss_spans"), work,
                   "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_with_tokenizer(turns: DataFrame, tokenizer: str, budget: int = 1024, history: int = 2) -> DataFrame:
    """`format_windows` with tokens counted by a tokenizer file that drops white space."""

    def counter() -> Callable[[str], int]:
        encoder = library_encoder(tokenizer)
        return lambda text: len(encoder.encode(text)) // 4

    return format_windows(turns, counter, budget, history)

"""Chat formatting in budgeted windows.

A turn becomes ``<s>[INST]role[/INST]text</s>``, control strings in roles and texts escaped with a backslash that
reading back takes out. Its tokens are those of all of that; turns side by side have no more. Prefix sums of the turns' tokens choose windows of whole
turns within ``budget`` tokens: each later window starts with the system turn, if the conversation opens with one, and
with as many of the last turns as fit in ``history`` tokens, then goes on with new turns. Texts of assistant turns are
under the loss mask where they are new; where a later window repeats them they are not. A turn over the budget has a
window with nothing but the system turn.

Turns are sorted by ranges over all tasks; sums by conversation and task give each turn its place among the tokens of
its conversation. A conversation is cut where its tokens pass a multiple of ``span``, and each of these spans is
formatted by itself: it gets the system turn and the last turns of the span before. So a conversation that a third
of all turns belong to goes over all tasks too, and a task holds the system turn, the history and one window. Only
``digest``, which hashes a conversation's turns one after the other, reads a conversation in one task; it holds a
window at a time.

Defined results: null roles and texts are empty; turns without a number come first, ties go by role and a hash of
the text; a null conv_id is a conversation of its own; repeated rows are repeated turns; a very long text is one turn;
an empty table gives no rows; other columns are ignored. Windows are numbered in order, with gaps between spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, write_table
from .tokens import encoder

BUDGET, HISTORY, TARGET, SYSTEM = 1024, 256, "assistant", "system"
#: Tokens of a conversation that are formatted together, and windows that they make at most.
SPAN, MOST_WINDOWS = 64 * BUDGET, 1 << 24

# The template and its control strings.
BEGIN, BODY, STOP = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(re.escape(x) for x in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(STOP), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]]  # code points
    repeated: int  # turns at the start that an earlier window has
    tokens: int


def render(role: str, text: str) -> str:
    return BEGIN + escape(role) + BODY + escape(text) + STOP


def _window(repeated: list[Turn], new: list[Turn], target: str) -> Formatted:
    parts, loss, at = [], [], 0
    for k, turn in enumerate([*repeated, *new]):
        parts.append(render(turn.role, turn.text))
        if k >= len(repeated) and turn.role == target and turn.text:
            first = at + len(BEGIN + escape(turn.role) + BODY)
            loss.append((first, at + len(parts[-1]) - len(STOP)))
        at += len(parts[-1])
    return Formatted("".join(parts), loss, len(repeated), sum(x.tokens for x in [*repeated, *new]))


def windows(turns: Iterator[Turn], budget: int = BUDGET, history: int = HISTORY, target: str = TARGET, system: str = SYSTEM, lead: list[Turn] | None = None, past: list[Turn] | None = None) -> Iterator[Formatted]:
    """Windows of one conversation; holds no more than two windows' turns. ``lead`` and ``past`` are its system turn and
    its last turns, where what comes before these turns is formatted elsewhere."""
    first = lead is None
    lead, past = lead or [], past or []  # history is taken from the last turns
    open_: list[Turn] = []
    kept: list[Turn] = []  # repeated at the start of the open window
    room = budget
    for turn in turns:
        if first and turn.role == system:
            lead = [turn]
        if open_ and turn.tokens > room:
            yield _window(kept, open_, target)
            past = _tail([x for x in [*past, *open_] if not (lead and x is lead[0])], history)
        if not first and (not open_ or turn.tokens > room):
            lead_tokens = sum(x.tokens for x in lead)
            kept = [*lead, *_tail(past, min(history, budget - lead_tokens - turn.tokens))]
            room, open_ = budget - sum(x.tokens for x in kept), []
        open_.append(turn)
        room -= turn.tokens
        first = False
    if open_:
        yield _window(kept, open_, target)


def _tail(turns: list[Turn], most: int) -> list[Turn]:
    """The last whole turns within ``most`` tokens, by prefix sums from the end."""
    sums = list(accumulate(x.tokens for x in reversed(turns)))
    n = bisect_right(sums, most) if most > 0 else 0
    return turns[len(turns) - n :]


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


FORMATTED = "conv_id long, window long, text string, loss array<struct<first long, stop long>>, repeated long, tokens long"
#: none: whether conv_id is null. before: tokens of the conversation's turns before this one in the same task.
PLACED = "none int, conv long, role string, text string, tokens long, part int, before long"
#: Kinds of a span's rows.
LEAD, PAST, OWN = 0, 1, 2


def placed_turns(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Turns in order over the tasks, with their tokens and their conversation's tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, part = encoder(tokenizer_path).count, TaskContext.get().partitionId()
        now, before = None, 0
        for batch in batches:
            tokens, places = [], []
            for none, conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (none, conv) != now:
                    now, before = (none, conv), 0
                tokens.append(count(render(role, text)))
                places.append(before)
                before += tokens[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array([part] * len(tokens), pa.int32()), pa.array(places, pa.int64())], names=[x.split()[0] for x in PLACED.split(", ")])

    conv, spark = F.col("conv_id").cast("long"), conversations.sparkSession
    turns = conversations.select(conv.isNull().cast("int").alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # the row's number only tells equal turns apart, so that ranges can be cut between them
    order = ["none", "conv", "turn", "role", "hash", "row"]
    turns = turns.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    placed = write_table(turns.select("none", "conv", "role", "text").mapInArrow(run, PLACED), "chat-turns")
    sums = placed.groupBy("none", "conv", "part").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("none", "conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    # turns are in order over the tasks, so only the first conversation of a task can have turns in earlier ones: a row for each task at most
    bases = sums.select("none", "conv", "part", F.sum("n").over(earlier).alias("base")).where("base > 0")
    start = F.coalesce("base", F.lit(0)) + F.col("before")
    return placed.join(F.broadcast(bases), ["none", "conv", "part"], "left").select("none", "conv", start.alias("start"), "role", "text", "tokens")


def format_chats(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY, target: str = TARGET, system: str = SYSTEM, span: int = SPAN) -> DataFrame:
    """A row per window: conv_id, window, text, loss (spans of code points), repeated, tokens."""
    turns = placed_turns(conversations, tokenizer_path).withColumn("span", F.floor(F.col("start") / span).cast("long"))
    opens = (F.col("start") == 0) & (F.col("role") == system)
    passed = F.when(~opens & ((F.col("span") + 1) * span - F.col("start") <= history), F.array(F.struct((F.col("span") + 1).alias("span"), F.lit(PAST).alias("kind"))))
    here = F.array(F.struct(F.col("span").alias("span"), F.lit(OWN).alias("kind")))
    rows = turns.select("none", "conv", F.explode(F.concat(here, F.coalesce(passed, F.array().cast("array<struct<span bigint, kind int>>")))).alias("x"), "start", "role", "text", "tokens")
    rows = rows.select("none", "conv", "x.span", "x.kind", "start", "role", "text", "tokens")
    last = turns.groupBy("none", "conv").agg(F.max("span").alias("last")).where("last > 0")
    leads = turns.where(opens).join(last, ["none", "conv"]).select("none", "conv", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("span"), F.lit(LEAD).alias("kind"), "start", "role", "text", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for batch in batches:
                for none, conv, own, kind, role, text, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield (none, conv, own), kind, Turn(role, text, tokens)

        source = turns()
        pending = next(source, None)

        def of(key: tuple, kind: int) -> Iterator[Turn]:
            nonlocal pending
            while pending is not None and pending[:2] == (key, kind):
                yield pending[2]
                pending = next(source, None)

        rows: list[tuple] = []
        size = 0
        while pending is not None:
            none, conv, own = key = pending[0]
            lead, past = list(of(key, LEAD)), list(of(key, PAST))
            for k, w in enumerate(windows(of(key, OWN), budget, history, target, system, lead if own else None, past)):
                rows.append((None if none else conv, own * MOST_WINDOWS + k, w.text, [{"first": a, "stop": b} for a, b in w.loss], w.repeated, w.tokens))
                size += len(w.text)
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    dealt = rows.unionByName(leads).repartition(parallelism(conversations.sparkSession), "none", "conv", "span").sortWithinPartitions("none", "conv", "span", "kind", "start")
    return dealt.select("none", "conv", "span", "kind", "role", "text", "tokens").mapInArrow(run, FORMATTED)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), _SPANS, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "window", "text", "loss", "repeated", "tokens"])


def digest(formatted: DataFrame) -> DataFrame:
    """What the windows say, read back from them: a row per conversation."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in schema.split(", ")]

        def results() -> Iterator[tuple]:
            now, started = None, False
            for batch in batches:
                for conv, _, text, loss, repeated, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not started or conv != now[0]:
                        if started:
                            yield _closed(now)
                        now, started = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], True
                    for role, said in read_back(text)[repeated:]:
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode())
                    for span in loss:
                        said = unescape(text[span["first"] : span["stop"]])
                        now[3] += len(said)
                        now[4].update(said.encode())
                    now[5] += len(text)
                    now[6] += 1
            if started:
                yield _closed(now)

        rows: list[tuple] = []
        for row in results():
            rows.append(row)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return formatted.repartition(parallelism(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, schema)


def _closed(now: list) -> tuple:
    return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])

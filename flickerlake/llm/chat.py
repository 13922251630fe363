"""Chat formatting in budgeted windows.

A turn is ``<turn ROLE>``, its text and ``</turn>``, on lines of their own; in roles and texts a
backslash goes before each backslash, ``<`` and ``>``, so no control string survives inside and the
output can be read back exactly. Prefix sums of the turns' token counts choose, for each window, the
longest run of whole turns that fits ``budget`` beside what is repeated: the system turn that opens
the conversation, and the last turns before the window, ``history_turns`` and ``history_tokens`` at most. Only new assistant texts are under the loss mask; repeated ones are masked. A turn that alone
exceeds the budget is kept whole in a window of its own, with over_budget set.

Turns are numbered by their rank, whatever numbers they carry, and dealt by conversation and by blocks
of ``BLOCK_TURNS`` of them, so a conversation of any length is split over tasks; the opening system turn
and the last turns before a block are dealt to it as well, to be repeated. A window doesn't cross blocks.

Defined results: null roles and texts are empty; turns are ordered by number (nulls first), then
role, then text, and repeated rows are turns of their own; a null conv_id is a conversation like any
other; a very long turn is a window of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .packing import encoder, tokenizer_path

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
BLOCK_TURNS = 256
TARGET, SYSTEM = "assistant", "system"
SCHEMA = "conv_id long, block long, window long, text string, n_repeated int, n_new int, n_tokens long, over_budget boolean, loss_start array<int>, loss_end array<int>"
_special = re.compile(r"[\\<>]")
_escaped = re.compile(r"\\(.)", re.DOTALL)
_turn = re.compile(r"<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)\n</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where in it the text begins and ends."""
    head, body = f"<turn {escape(role)}>\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; the inverse of rendering turns one after the other."""
    at, out = 0, []
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def windows(turns: list[tuple[str, str]], count: Callable[[str], int], ready: list[tuple[str, str]] = (), opening: tuple[str, str] | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> Iterator[tuple]:
    """Windows over ``turns``; ``ready`` are earlier turns and ``opening`` the system turn before them, if any."""
    whole = [*ready, *turns]
    if opening is None and not ready and turns and turns[0][0] == SYSTEM:
        opening = turns[0]
    written = [render(*t) for t in whole]
    sums = [0, *accumulate(count(w[0]) for w in written)]
    lead = render(*opening) if opening else None
    lead_tokens = count(lead[0]) if lead else 0
    system_at = 0 if not ready and opening and turns and turns[0] == opening else -1
    at = len(ready)
    while at < len(whole):
        # as many of the turns before as both limits allow, the system turn aside
        first = max(at - history_turns, 0, system_at + 1 if at > system_at else 0)
        while first < at and sums[at] - sums[first] > history_tokens:
            first += 1
        leads = lead is not None and at != system_at
        spare = budget - (lead_tokens if leads else 0) - (sums[at] - sums[first])
        end = max(at + 1, bisect_right(sums, sums[at] + spare) - 1)
        if sums[end] - sums[at] > spare and first < at:
            first, spare = at, spare + sums[at] - sums[first]  # room goes to the new turn before history
            end = max(at + 1, bisect_right(sums, sums[at] + spare) - 1)
        parts = ([lead[0]] if leads else []) + [w[0] for w in written[first:at]]
        place, starts, ends = sum(map(len, parts)), [], []
        for (role, _), (text, a, b) in zip(whole[at:end], written[at:end]):
            if role == TARGET:
                starts.append(place + a)
                ends.append(place + b)
            parts.append(text)
            place += len(text)
        tokens = sums[end] - sums[first] + (lead_tokens if leads else 0)
        yield "".join(parts), leads + at - first, end - at, tokens, tokens > budget, starts, ends
        at = end


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with ``rank``, a turn's number from 0 in its conversation, and (conv_id, total).

    Turns are sorted in ranges, so a conversation of any length is numbered by several tasks: each counts
    its own stretch, and the stretches before it, of which a task begins at most one, add what is missing.
    """
    order = ["conv_id", "turn", "role", "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), -1
        current: tuple = ()
        for batch in batches:
            ranks = []
            for conv in batch.column("conv_id").to_pylist():
                n = n + 1 if current == (conv,) else 0
                current = (conv,)
                ranks.append(n)
            columns = [batch.column(c) for c in ("conv_id", "role", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(ranks), pa.int64()), pa.array(ranks, pa.int64())], ["conv_id", "role", "text", "part", "rank"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ordered.mapInArrow(task, "conv_id long, role string, text string, part long, rank long"), "turns")
    stretches = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a task that begins within a conversation has one such stretch, so there are at most as many as tasks
    shifts = stretches.select(F.col("conv_id").alias("sid"), F.col("part").alias("spart"), before.alias("shift")).where("shift > 0")
    joined = local.join(F.broadcast(shifts), F.col("conv_id").eqNullSafe(F.col("sid")) & (F.col("part") == F.col("spart")), "left")
    return joined.select("conv_id", "role", "text", (F.col("rank") + F.coalesce("shift", F.lit(0))).alias("rank")), stretches.groupBy("conv_id").agg(F.sum("n").alias("total"))


def format_conversations(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows of turns(conv_id, turn, role, text), in order by (block, window) within a conversation."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    numbered, sizes = _numbered(rows)
    block = F.floor(F.col("rank") / BLOCK_TURNS)
    rows = numbered.withColumn("block", block)
    # kind: 2 a turn of the block, 1 one of the last before it, 0 the system turn that opens the conversation
    own = F.struct("block", F.lit(2).alias("kind"))
    later = F.when(F.col("rank") % BLOCK_TURNS >= BLOCK_TURNS - history_turns, F.struct((F.col("block") + 1).alias("block"), F.lit(1).alias("kind")))
    dealt = rows.select("conv_id", "rank", "role", "text", F.explode(F.array_compact(F.array(own, later))).alias("to")).select("conv_id", "rank", "role", "text", "to.block", "to.kind")
    long = sizes.where(F.col("total") > BLOCK_TURNS).select(F.col("conv_id").alias("lid"), F.floor((F.col("total") - 1) / BLOCK_TURNS).alias("hi"))
    openings = rows.where((F.col("rank") == 0) & (F.col("role") == SYSTEM)).join(long, F.col("conv_id").eqNullSafe(F.col("lid")))
    opened = openings.select("conv_id", "rank", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "hi")).alias("block"), F.lit(0).alias("kind"))
    sorted_rows = dealt.unionByName(opened).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "rank")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        count = lambda text: len(encode(text))
        out: list[tuple] = []
        group: list[list] = [[], [], []]
        current = None

        def close() -> None:
            opening = group[0][0] if group[0] else None
            for k, w in enumerate(windows(group[2], count, group[1], opening, budget, history_turns, history_tokens)):
                out.append((*current, k, *w))

        for batch in batches:
            for conv, block, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "kind", "role", "text"))):
                if current != (conv, block):
                    if current:
                        close()
                    current, group = (conv, block), [[], [], []]
                    if len(out) >= 1000:
                        yield _batch(out)
                        out = []
                group[kind].append((role, text))
        if current:
            close()
        yield _batch(out)

    return sorted_rows.mapInArrow(task, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), ints, ints)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * len(kinds), kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests by conversation, parsed from the windows' texts and loss masks.

    A conversation's windows stream through one task in order, a hash state at a time.
    """
    source = formatted.select("conv_id", "block", "window", "text", "n_repeated", "loss_start", "loss_end")
    source = source.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss_start", "loss_end"))
            for conv, text, repeated, starts, ends in zip(*columns):
                if state is None or state[0] != conv:
                    if state:
                        out.append(_digest(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                new = parse(text)[repeated:]
                state[1] += len(new)
                state[2].update("".join(chain.from_iterable((r, "\n", t, "\n") for r, t in new)).encode())
                for a, b in zip(starts, ends):
                    target = unescape(text[a:b])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
        if state:
            out.append(_digest(state))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out)] or [[]] * 6, kinds)], names)

    return source.mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(state: list) -> tuple:
    conv, turns, turns_hash, chars, loss_hash, formatted = state
    return conv, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted

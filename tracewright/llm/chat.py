"""Chat formatting: roles of a raw transcript by a hidden Markov model, and canonical turns.

A transcript is the lines of a conversation. It is stored in chunks, in order
of ``turn``; where a chunk ends means nothing to the model. Lines may carry
speaker markers in many fashions (``User:``, ``### Assistant``, ``[bot]``,
``<|system|>``), some may be missing, and marker-like words may stand in prose.
The model's states are a role and whether the line begins a turn of it; it sees
a line's marker, whether the line before it is blank, its length and its end.
Transitions and observations are counted on labelled transcripts (by
distributed counts) on top of pseudo-counts. Viterbi gives the most likely
roles, and every turn is rendered as ``<|role|>``, a line break, its text
without blank lines around it, and ``<|end|>``.

A conversation of any length is split into blocks of ``BLOCK_TURNS`` turn
numbers, and one with more than ``BLOCK_ROWS`` chunks further by turn and hash
of the text. For conversations of several blocks, each block first gives its
matrix of best scores from every state to every state; chaining these small
matrices gives the states at the block ends, and every block is then decoded
between them. That is the same as decoding the conversation whole; counting is
carried across the blocks in the same way.

Nulls and odd rows: a null conversation is a conversation; a null turn comes
first; a null or empty text is a blank line; chunks of one turn number are
ordered by a hash of their text, and chunks repeated in full stay together in
one block; a very long text is as many lines as it has; of equally likely
states the first in the order of ``ROLES`` wins; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ROLES = ("system", "user", "assistant", "tool")
STATES = 2 * len(ROLES)  # 2 r: a line that begins a turn of role r; 2 r + 1: a later line of it
BLOCK_TURNS = 2048
#: Chunks of a block beyond which it is split.
BLOCK_ROWS = 8192
#: Leading bits of a text's hash by which the chunks of one turn of a heavy block are counted: 2^32 chunks of one turn are some 65,000 to a count.
TIE_BITS = 16
#: Names that speakers are marked by.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "prompter", "question", "q", "me", "client"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "answer", "a", "agent"),
    "tool": ("tool", "function", "observation", "output"),
}
_ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(rf"\s{{0,8}}(?:#{{1,4}}\s*(?P<h>{_NAME})\s*:?|\[(?P<b>{_NAME})\]\s*:?|<\|?(?P<t>{_NAME})\|?>|\*\*(?P<s>{_NAME})\s*:?\*\*\s*:?|(?P<c>{_NAME})\s*[:>])[ \t]?", re.IGNORECASE)
#: Values of the observed features: marker (none, system, user, assistant, tool), after a blank line, length class, end class.
FEATURES = (5, 2, 4, 4)


def marker(line: str) -> tuple[int, int]:
    """Feature value of a line's speaker marker, and where its text begins."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    return 1 + ROLES.index(_ROLE_OF[m.group(m.lastgroup).lower()]), m.end()


def observe(line: str, after_blank: bool) -> tuple[int, ...]:
    n = len(line)
    last = line.rstrip()[-1:]
    return marker(line)[0], int(after_blank), 0 if not n else 1 if n < 60 else 2 if n < 300 else 3, 0 if not last else 1 if last == "?" else 2 if last in ".!" else 3


class Model:
    """Log probabilities of starts, transitions and features."""

    def __init__(self, counts: dict[str, float] | None = None):
        """``counts``: numbers of ``s:state``, ``t:from:to`` and ``f:feature:state:value``."""
        got = counts or {}
        start, moves = np.full(STATES, 1e-6), np.full((STATES, STATES), 1e-6)
        for r in range(len(ROLES)):
            start[2 * r] = (2.0, 4.0, 1.0, 0.1)[r]
            for now in (2 * r, 2 * r + 1):
                moves[now, 2 * r + 1] = 4.0
                for to in range(len(ROLES)):
                    moves[now, 2 * to] = 0.05 if to == r else 1.0
                moves[now, 0] = 0.05
        for role, to, n in ((0, 1, 2.0), (1, 2, 4.0), (2, 1, 4.0), (3, 2, 2.0)):
            moves[[2 * role, 2 * role + 1], 2 * to] = n
        seen = [np.full((STATES, k), 0.5) for k in FEATURES]
        for s in range(STATES):
            begins = s % 2 == 0
            seen[0][s] = (4.0 if begins else 60.0, *(24.0 if begins and r == s // 2 else 0.25 for r in range(len(ROLES))))
            seen[1][s] = (2.0, 4.0) if begins else (12.0, 1.0)
        seen[3][2, 1] = 3.0
        for key, n in got.items():
            kind, *at = key.split(":")
            at = list(map(int, at))
            if kind == "s":
                start[at[0]] += n
            elif kind == "t":
                moves[at[0], at[1]] += n
            else:
                seen[at[0]][at[1], at[2]] += n
        self.start = np.log(start / start.sum())
        self.moves = np.log(moves / moves.sum(axis=1, keepdims=True))
        self.seen = [np.log(x / x.sum(axis=1, keepdims=True)) for x in seen]

    def emission(self, observed: tuple[int, ...]) -> np.ndarray:
        return sum(table[:, value] for table, value in zip(self.seen, observed, strict=True))

    def scores(self, observed: list[tuple[int, ...]], first: bool) -> np.ndarray:
        """Best score from every state before the lines to every state at the last of them."""
        out = None
        for o in observed:
            step = (np.broadcast_to(self.start, (STATES, STATES)) if first and out is None else self.moves) + self.emission(o)
            out = step if out is None else (out[:, :, None] + step[None]).max(axis=1)
        return out

    def path(self, observed: list[tuple[int, ...]], entry: int | None = None, leave: int | None = None) -> list[int]:
        """Viterbi path, from a state before the lines and to a state at the last line where given."""
        now = (self.start if entry is None else self.moves[entry]) + self.emission(observed[0])
        back = np.zeros((len(observed), STATES), dtype=np.int8)
        for k, o in enumerate(observed[1:], 1):
            step = now[:, None] + self.moves
            back[k] = step.argmax(axis=0)
            now = step.max(axis=0) + self.emission(o)
        state = int(now.argmax()) if leave is None else leave
        out = [state]
        for k in range(len(observed) - 1, 0, -1):
            state = int(back[k, state])
            out.append(state)
        return out[::-1]


def lines_of(chunks: list[str | None], after_blank: bool = True) -> list[tuple[int, str, tuple[int, ...]]]:
    """``(chunk, line, features)`` of every line; ``after_blank`` tells of the line before them (a transcript's start counts as one)."""
    out = []
    for k, text in enumerate(chunks):
        for line in (text or "").split("\n"):
            out.append((k, line, observe(line, after_blank)))
            after_blank = not line.strip()
    return out


def turns(model: Model, chunks: list[str | None], entry: int | None = None, leave: int | None = None, after_blank: bool = True) -> list[tuple[int, str, str, bool]]:
    """Recovered turns ``(chunk it begins in, role, text, goes on from before)``."""
    lines = lines_of(chunks, after_blank)
    if not lines:
        return []
    path = model.path([o for _, _, o in lines], entry, leave)
    out: list[list] = []
    for at, ((k, line, _), state) in enumerate(zip(lines, path, strict=True)):
        begins = state % 2 == 0
        if begins or not at:
            value, text_at = marker(line)
            cut = text_at if begins and value == 1 + state // 2 else 0
            out.append([k, ROLES[state // 2], [line[cut:]], not begins])
        else:
            out[-1][2].append(line)
    return [(k, role, "\n".join(text), on) for k, role, text, on in out]


def rendered(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip(chr(10))}<|end|>"


def label_counts(chunks: list[str | None], roles: list[str | None], first: bool = True, before: int | None = None, after_blank: bool = True) -> dict[str, int]:
    """Counts of (a block of) a labelled conversation whose every chunk is one turn; unknown roles break the chain.

    ``first`` tells whether the conversation begins here; ``before`` is the
    state of the line before.
    """
    got: dict[str, int] = {}
    chunk = -1
    for at, (k, _, seen) in enumerate(lines_of(chunks, after_blank)):
        r = ROLES.index(roles[k]) if roles[k] in ROLES else None
        state = None if r is None else 2 * r + (k == chunk)
        if state is not None:
            keys = [f"f:{f}:{state}:{v}" for f, v in enumerate(seen)] + ([f"s:{state}"] if first and not at else []) + ([f"t:{before}:{state}"] if before is not None else [])
            for key in keys:
                got[key] = got.get(key, 0) + 1
        before, chunk = state, k
    return got


def _groups(batches, columns: int):
    """Rows of each run of equal ``conv_id, block`` (the first two columns) of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:columns]), strict=True):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield key, rows


def _blocks(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``block`` and ``tie``: a conversation's chunks in order are its blocks in order."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)).cast("long") * F.lit(1 << 24)
    rows = chunks.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    rows = rows.withColumns({"block": block, "tie": F.xxhash64("text")})
    heavy = written(rows.groupBy("conv_id", "block").count().filter(F.col("count") > BLOCK_ROWS).drop("count"), "heavy-blocks")
    if heavy.isEmpty():
        return rows
    # the chunks of a heavy block are counted by turn and hash range, and cut where these counts add up
    rows = rows.withColumn("bin", F.shiftright("tie", 64 - TIE_BITS))
    h = heavy.select(F.col("conv_id").alias("c"), F.col("block").alias("b"))
    counts = rows.join(h, rows["conv_id"].eqNullSafe(h["c"]) & (rows["block"] == h["b"]), "left_semi").groupBy("conv_id", "block", "turn", "bin").count()
    before = F.sum("count").over(Window.partitionBy("conv_id", "block").orderBy("turn", "bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    pieces = counts.select(*(F.col(k).alias(f"p_{k}") for k in ("conv_id", "block", "turn", "bin")), F.floor(before / BLOCK_ROWS).cast("long").alias("piece"))
    pieces = written(pieces, "block-pieces")
    same = rows["conv_id"].eqNullSafe(pieces["p_conv_id"]) & (rows["block"] == pieces["p_block"]) & rows["turn"].eqNullSafe(pieces["p_turn"]) & (rows["bin"] == pieces["p_bin"])
    cut = rows.join(pieces, same, "left").withColumn("block", F.col("block") + F.coalesce("piece", F.lit(0)))
    return cut.drop("bin", "piece", *(c for c in pieces.columns if c.startswith("p_")))


def _dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "tie", "text")


def _befores(rows: DataFrame) -> DataFrame:
    """For every block of conversations that have several: ``conv, b``, whether it is the ``first``, and of the line before it ``after_blank``, ``role_before`` and ``lines_before``."""
    last = F.struct(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"(^|\n)\s*$")).alias("blank"), "role", F.coalesce("text", F.lit("")).contains("\n").alias("several"))
    ends = rows.groupBy("conv_id", "block").agg(F.max_by(last, F.struct("turn", "tie", "text")).alias("last"))
    order = Window.partitionBy("conv_id").orderBy("block")
    out = ends.select(F.col("conv_id").alias("conv"), F.col("block").alias("b"), F.lag("last").over(order).alias("before"), F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("blocks"))
    out = out.filter("blocks > 1").select("conv", "b", (F.col("k") == 1).alias("first"), F.coalesce("before.blank", F.lit(True)).alias("after_blank"), F.col("before.role").alias("role_before"), F.col("before.several").alias("several_before"))
    return written(out, "blocks-before")


def _with_befores(rows: DataFrame, befores: DataFrame) -> DataFrame:
    if befores.isEmpty():
        return rows.withColumns({"first": F.lit(True), "after_blank": F.lit(True), "role_before": F.lit(None).cast("string"), "several_before": F.lit(None).cast("boolean")})
    same = rows["conv_id"].eqNullSafe(befores["conv"]) & (rows["block"] == befores["b"])
    out = rows.join(befores, same, "left").drop("conv", "b")
    return out.withColumns({"first": F.coalesce("first", F.lit(True)), "after_blank": F.coalesce("after_blank", F.lit(True))})


def fitted(chunks: DataFrame) -> Model:
    """The model counted over labelled chunks ``conv_id, turn, text, role``; a few hundred counts reach the driver."""

    def run(batches):
        total: dict[str, int] = {}
        for _, rows in _groups(batches, 8):
            _, _, _, _, first, after_blank, role, several = rows[0]
            before = 2 * ROLES.index(role) + bool(several) if role in ROLES else None
            for key, n in label_counts([r[2] for r in rows], [r[3] for r in rows], first, before, after_blank).items():
                total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    blocks = _blocks(chunks.select("conv_id", "turn", "text", "role"))
    rows = _dealt(_with_befores(blocks, _befores(blocks))).select("conv_id", "block", "text", "role", "first", "after_blank", "role_before", "several_before")
    counts = rows.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Model({r["key"]: r["n"] for r in counts.collect()})


def _ends(model: Model, rows: DataFrame) -> DataFrame:
    """``conv_id, block, entry, leave`` for the blocks of conversations that have several."""

    def matrices(batches):
        for (conv, block), group in _groups(batches, 5):
            scores = model.scores([o for _, _, o in lines_of([r[2] for r in group], group[0][4])], group[0][3])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([json.dumps(scores.tolist())])], names=["conv_id", "block", "scores"])

    parts = rows.select("conv_id", "block", "text", "first", "after_blank").mapInArrow(matrices, "conv_id long, block long, scores string")

    def chain(pdf):
        pdf = pdf.sort_values("block")
        steps = [np.array(json.loads(s)) for s in pdf["scores"]]
        reach = [steps[0].max(axis=0)]
        for m in steps[1:]:
            reach.append((reach[-1][:, None] + m).max(axis=0))
        leave = [int(reach[-1].argmax())]
        for k in range(len(steps) - 1, 0, -1):
            leave.append(int((reach[k - 1] + steps[k][:, leave[-1]]).argmax()))
        leave.reverse()
        return pdf.assign(entry=[-1, *leave[:-1]], leave=leave)[["conv_id", "block", "entry", "leave"]]

    return parts.groupBy("conv_id").applyInPandas(chain, "conv_id long, block long, entry int, leave int")


def formatted(chunks: DataFrame, model: Model) -> DataFrame:
    """Canonical turns of chunks ``conv_id, turn, text``: ``conv_id, turn, part, role, text, rendered``.

    ``turn`` is that of the chunk a turn begins in, ``part`` counts the turns
    that begin in one chunk, or is -1 for the end of a turn that began in the
    block before (its ``rendered`` is then of that end alone).
    """
    names = ["conv_id", "turn", "part", "role", "text", "rendered"]

    def run(batches):
        for (conv, _), group in _groups(batches, 7):
            entry, leave, after_blank = group[0][4:]
            found = turns(model, [r[3] for r in group], None if entry is None or entry < 0 else entry, leave, after_blank)
            cols: list[list] = [[] for _ in names]
            part, at = 0, None
            for k, role, text, on in found:
                part = part + 1 if at == k else 0
                at = k
                for col, value in zip(cols, (conv, group[k][2], -1 if on else part, role, text, rendered(role, text)), strict=True):
                    col.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    blocks = _blocks(chunks.select("conv_id", "turn", "text").withColumn("role", F.lit(None).cast("string")))
    befores = _befores(blocks)
    rows = _with_befores(blocks, befores)
    if befores.isEmpty():
        ready = rows.withColumns({"entry": F.lit(None).cast("int"), "leave": F.lit(None).cast("int")})
    else:
        several = rows.join(befores, rows["conv_id"].eqNullSafe(befores["conv"]) & (rows["block"] == befores["b"]), "left_semi")
        ends = written(_ends(model, _dealt(several)), "block-ends").withColumnsRenamed({"conv_id": "c", "block": "b"})
        ready = rows.join(ends, rows["conv_id"].eqNullSafe(ends["c"]) & (rows["block"] == ends["b"]), "left")
    out = _dealt(ready).select("conv_id", "block", "turn", "text", "entry", "leave", "after_blank")
    return out.mapInArrow(run, "conv_id long, turn long, part int, role string, text string, rendered string")

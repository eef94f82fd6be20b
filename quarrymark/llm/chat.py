"""Chat formatting: recover who speaks in a raw transcript, then render canonical turns.

A transcript is lines. Each line shows a speaker marker or none, a length class, and whether it
asks something. A hidden Markov model has a state for the first and for a further line of each
role's turns; its tables, markers included, are counted from marked transcripts of turns with known
roles (smoothed), and Viterbi finds the likeliest states. A first-line state begins a turn; markers
are cut from its text.

Transcripts are taken in parts of ``PART`` turn numbers, so no conversation becomes one huge group.
Parts don't change what is recovered: for conversations of several parts, each part gives the best
score between every state before it and every state at its end; these small tables are chained
per conversation, which fixes the states at the parts' edges, and the parts are then decoded
between them. Joined in order, the parts' renderings are the conversation's: a turn that reaches
over an edge goes on in the next part, and each turn is closed where the next begins.

Defined results: null texts count as empty; roles beyond the known ones, and null, count as user;
turns of the same number go by role and text; rows without a turn number come before the numbered
ones, in parts by hash of their text; exact repeats of a row count once; rows without conv_id form
conversations by hash of their text (null conv_id, numbered by ``stray``); lines of a text that look
like markers are read as markers; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1024
STRAYS = 4096
ROLES = ("system", "user", "assistant")
#: Names under which speakers appear.
ALIASES = {"system": ("system", "instructions", "note"), "user": ("user", "human", "customer", "me", "q"), "assistant": ("assistant", "bot", "ai", "agent", "a")}
#: How raw transcripts mark speakers; {} is the speaker's name.
STYLES = (("{}:", ("System", "User", "Assistant")), ("### {}:", ("Instructions", "Human", "Assistant")), ("[{}]", ("system", "customer", "agent")), ("<{}>", ("SYSTEM", "USER", "BOT")), ("{}:", ("Note", "Q", "A")))
_MARKER = re.compile(r"^\s*(?:#+\s*|\*+|[\[<(])?\s*(" + "|".join(a for names in ALIASES.values() for a in names) + r")\s*(?:[\]>)]|\*+)?\s*(:|\]|>|$)[:*]*\s?", re.IGNORECASE)
_CLOSED = re.compile(r"^\s*[\[<(#]")
_ROLE_OF = {a: ROLES.index(r) for r, names in ALIASES.items() for a in names}
SIZES, MARKS, ASKS = 5, len(ROLES) + 1, 2
STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, str]:
    """The role index of a line's marker (or ``len(ROLES)``) and the line without it."""
    m = _MARKER.match(line)
    if not m or not (m.group(2) == ":" or _CLOSED.match(line)):
        return len(ROLES), line
    return _ROLE_OF[m.group(1).lower()], line[m.end() :]


def observe(line: str) -> tuple[int, int, int]:
    n = len(line)
    size = 0 if not line.strip() else 1 if n < 60 else 2 if n < 200 else 3 if n < 500 else 4
    return marker(line)[0], size, int("?" in line)


def marked_turns(turns: list[tuple[str, str]], style: int, bare: int = 0) -> list[tuple[str, str]]:
    """Turns with speaker markers before their texts; with ``bare`` > 0, every so-many-th turn has none."""
    form, names = STYLES[style % len(STYLES)]
    return [(role, ("" if bare and k % bare == bare - 1 else form.format(names[ROLES.index(role)]) + " ") + (text or "")) for k, (role, text) in enumerate(turns)]


def raw_transcript(turns: list[tuple[str, str]], style: int, bare: int = 0) -> str:
    return "\n".join(text for _, text in marked_turns(turns, style, bare))


@dataclass
class RoleModel:
    start: np.ndarray
    step: np.ndarray
    mark: np.ndarray
    size: np.ndarray
    asks: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> RoleModel:
        """Smoothed log tables from the flat count vector of ``count_lines``."""
        shapes = [(STATES,), (STATES, STATES), (STATES, MARKS), (STATES, SIZES), (STATES, ASKS)]
        at, tables = 0, []
        for shape in shapes:
            n = int(np.prod(shape))
            table = counts[at : at + n].reshape(shape).astype(float)
            at += n
            table = table + 0.5
            tables.append(np.log(table / table.sum(axis=-1, keepdims=True)))
        start, step, mark, size, asks = tables
        start = start.copy()
        start[1::2] = -50.0
        step = step.copy()
        for s in range(STATES):
            for t in range(1, STATES, 2):
                if s // 2 != t // 2:
                    step[s, t] = -50.0
        return cls(start, step, mark, size, asks)

    def _emissions(self, lines: list[str]) -> np.ndarray:
        m, z, a = np.array([observe(x) for x in lines]).T
        return (self.mark[:, m] + self.size[:, z] + self.asks[:, a]).T

    def spans(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best scores over the lines from a conversation's start, and from each state before them, to each state at their end."""
        emit = self._emissions(lines)
        first, inner = self.start + emit[0], self.step + emit[0]
        for e in emit[1:]:
            first = (first[:, None] + self.step).max(axis=0) + e
            inner = (inner[:, :, None] + self.step).max(axis=1) + e
        return first, inner

    def states(self, lines: list[str], before: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states by Viterbi, where given between the state before the lines and that of the last one."""
        emit = self._emissions(lines)
        best, back = (self.start if before is None else self.step[before]) + emit[0], []
        for e in emit[1:]:
            total = best[:, None] + self.step
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + e
        path = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def parse(self, transcript: str, before: int | None = None, last: int | None = None) -> list[tuple[str | None, str]]:
        """(role, text) of each recovered turn; the role is None for the rest of a turn begun before."""
        lines = transcript.split("\n")
        turns: list[tuple[str | None, list[str]]] = []
        for line, s in zip(lines, self.states(lines, before, last), strict=True):
            if s % 2 == 0:
                turns.append((ROLES[s // 2], [marker(line)[1]]))
            elif not turns:
                turns.append((None, [line]))
            else:
                turns[-1][1].append(line)
        return [(r, "\n".join(x)) for r, x in turns]


def render(turns: list[tuple[str | None, str]], opens: bool, closes: bool) -> str:
    """Canonical turns of a part: ``opens`` and ``closes`` say whether the conversation begins and ends with it."""
    out = [("" if k == 0 and opens else "\n" if role is None else "\n<|end|>\n") + ("" if role is None else f"<|{role}|>\n") + text for k, (role, text) in enumerate(turns)]
    return "".join(out) + ("\n<|end|>\n" if closes else "")


COUNTS = STATES + STATES * STATES + STATES * (MARKS + SIZES + ASKS)


def count_lines(turns: list[tuple[str, str]], counts: np.ndarray) -> None:
    """Adds the starts, steps and line features of turns with known roles."""
    before = None
    for role, text in turns:
        for k, line in enumerate((text or "").split("\n")):
            s = 2 * ROLES.index(role) + (k > 0)
            m, z, a = observe(line)
            if before is None:
                counts[s] += 1
            else:
                counts[STATES + before * STATES + s] += 1
            at = STATES + STATES * STATES
            counts[at + s * MARKS + m] += 1
            counts[at + STATES * MARKS + s * SIZES + z] += 1
            counts[at + STATES * (MARKS + SIZES) + s * ASKS + a] += 1
            before = s


def parts(conversations: DataFrame) -> DataFrame:
    """conv_id, stray, part and the ordered turns (role, text) of each part of each conversation."""
    role = F.lower(F.col("role"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(role.isin(*ROLES), role).otherwise("user").alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    dealt = F.pmod(F.xxhash64("text"), F.lit(STRAYS))
    part = F.when(F.col("turn").isNotNull(), F.floor(F.col("turn") / PART)).otherwise(F.lit(-(2**62)) + dealt).cast("long")
    # rows without a conversation may be any number: they are dealt by their text as well
    stray = F.when(F.col("conv_id").isNull(), dealt).otherwise(F.lit(0)).cast("int")
    grouped = rows.groupBy("conv_id", stray.alias("stray"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.select("conv_id", "stray", "part", "turns")


def _marked(batch: pa.RecordBatch, bare: int) -> Iterator[list[tuple[str, str]]]:
    """Of each row (conv_id, turns), the turns with markers in the conversation's style."""
    for k in range(batch.num_rows):
        conv, turns = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
        yield marked_turns([(t["role"], t["text"]) for t in turns], conv or 0, bare)


def fit(grouped: DataFrame, bare: int = 7) -> RoleModel:
    """Counts over all turns as marked transcripts, summed in each task and then over tasks (``COUNTS`` numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTS, np.int64)
        for batch in batches:
            for turns in _marked(batch, bare):
                count_lines(turns, counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTS), pa.int32()), pa.array(counts)], names=["slot", "n"])

    total = np.zeros(COUNTS, np.int64)
    for row in grouped.select("conv_id", "turns").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[row["slot"]] = row["n"]
    return RoleModel.from_counts(total)


def as_transcripts(grouped: DataFrame, bare: int = 7) -> DataFrame:
    """conv_id, stray, part, transcript: each part as a raw transcript in one of the marking styles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n".join(text for _, text in turns) for turns in _marked(batch, bare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.string())], names=["conv_id", "stray", "part", "transcript"])

    return grouped.select("conv_id", "turns", "stray", "part").mapInArrow(run, "conv_id long, stray int, part long, transcript string")


def _edges(several: DataFrame, model: RoleModel) -> DataFrame:
    """Of each part, the states before it (null: the first) and at its end that the whole conversation's best path takes."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate([x.ravel() for x in model.spans((t or "").split("\n"))]).tolist() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "stray", "part", "scores"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        scores = np.array(table["scores"].to_pylist())
        inner = scores[:, STATES:].reshape(-1, STATES, STATES)
        best, back = scores[0, :STATES], []
        for x in inner[1:]:
            total = best[:, None] + x
            back.append(total.argmax(axis=0))
            best = total.max(axis=0)
        last = [int(best.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return table.drop(["scores"]).append_column("before", pa.array([None, *last[:-1]], pa.int32())).append_column("last", pa.array(last, pa.int32())).append_column("closes", pa.array([False] * (len(last) - 1) + [True]))

    scored = several.select("conv_id", "stray", "part", "transcript").mapInArrow(tables, "conv_id long, stray int, part long, scores array<double>")
    return scored.groupBy("conv_id", "stray").applyInArrow(chain, "conv_id long, stray int, part long, before int, last int, closes boolean")


def format_transcripts(transcripts: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, stray, part, n_turns (begun in the part), roles and rendered (the canonical turns) of each part of a transcript."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, before, last, closes in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                turns = model.parse(t or "", before, last)
                roles = [r for r, _ in turns if r]
                rows.append((len(roles), ",".join(roles), render(turns, before is None, closes is not False)))
            n, roles, rendered = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(roles, pa.string()), pa.array(rendered, pa.string())], names=["conv_id", "stray", "part", "n_turns", "roles", "rendered"])

    key = ["conv_id", "stray"]
    counted = transcripts.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"m_{c}") for c in key])
    same = F.col("conv_id").eqNullSafe(F.col("m_conv_id")) & (F.col("stray") == F.col("m_stray"))
    edges = _edges(transcripts.join(counted, same, "left_semi"), model)
    t, e = transcripts.alias("t"), edges.alias("e")
    placed = t.join(e, F.expr("t.conv_id <=> e.conv_id and t.stray = e.stray and t.part = e.part"), "left")
    placed = placed.select("t.conv_id", "t.stray", "t.part", "transcript", "before", "last", "closes")
    return placed.mapInArrow(run, "conv_id long, stray int, part long, n_turns long, roles string, rendered string")

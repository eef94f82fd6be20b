"""Repair of conversations whose turns were damaged: the cheapest edits that restore their grammar.

A repaired conversation is an optional system turn and then pairs of user and assistant turns, or
nothing. Each turn is kept (0), given the role user or assistant (2) or deleted (3), which blank and
repeated turns must be; empty user or assistant turns may be inserted anywhere (2 each); a truncated turn
that stays costs 1. Of the cheapest edits the string of initials (K, R, D, I) least in ASCII is taken.

Forward Viterbi over four states (nothing yet, after the system, user, assistant turn) carries the
least (cost, audit string) of each. No turn needs more than two insertions before it, so a step is at
most two insertions and one edit. Strings are not copied at each step: those of the states end in an
edit of the same turn and differ, so their order is kept as a rank and the letters as links back.
States that can't be part of a cheapest path any more are left out; what remains is one of a few layers,
whose steps are remembered.

Conversations come sorted, whole and one after the other, from a shuffle by their id; a turn's text is
held until its conversation ends, up to ``buffer`` bytes of them. Longer conversations get their audit in the
first pass and are read once more, sorted again, to apply it; so memory grows by some bytes a turn (the audit is
one string) and never by texts. SHA-256 of the whole repaired conversation is sequential by its nature, so
the last step of one conversation is one task's. First occurrences of repeated turns are found by a grouped
table, not inside the conversation.

Defined results: null roles and texts are one space, null conv_ids and turns one space in the damage's
key; turns sort by turn (null first), role and text; a null conv_id is a conversation; a role's initial is its first
character (none in an empty role: such a turn is given a role or deleted); gaps ignore null turns. A conversation
without rows has zeros, an empty audit and the empty string's hash; an empty table has no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CHARS, Scratch, broadcast_if_small, join_groups

#: Bytes of texts that a task holds for one conversation before it leaves it to the second pass.
BUFFER = 8 << 20
SMALL_ROWS = 100_000
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURN = ("conv_id", "turn", "role", "text", "gone", "key", "again", "blank", "cut")

# ---- the grammar ------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, RENAME, DELETE, INSERT = 0, 2, 3, 2
_NAMES = {USER: b"user", ASSISTANT: b"assistant"}
#: The state after a turn of the initial, and the states after 0, 1, 2 insertions.
_AFTER = {(START, b"s"): SYSTEM, (START, b"u"): USER, (SYSTEM, b"u"): USER, (USER, b"a"): ASSISTANT, (ASSISTANT, b"u"): USER}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_CHAINS = {p: (p, _NEXT[p], _NEXT[_NEXT[p]]) for p in _NEXT}
#: Insertions from each state to each other one, where there are any.
_INSERTIONS = {(p, q): chain.index(q) for p, chain in _CHAINS.items() for q in range(4) if q in chain}
#: By how much a conversation may go on cheaper from the first state than from ASSISTANT.
_LEEWAY = {START: 3}


class Step(NamedTuple):
    layer: tuple[tuple[int, int], ...]  # states in the order of their strings, with their costs above the least
    more: int  # the least cost above the previous layer's least
    links: dict[int, tuple[int, str]]  # per state: the previous one and the letters since


FIRST = ((START, 0),)


def _pruned(costs: dict[int, int]) -> dict[int, int]:
    """Without states that are dearer than the same state by insertions, or than any way to go on from ASSISTANT."""
    reach = lambda q, own: min((c + INSERT * _INSERTIONS[p, q] for p, c in costs.items() if (p, q) in _INSERTIONS and (own or p != q)), default=None)
    end = reach(ASSISTANT, True)
    kept = {}
    for q, c in costs.items():
        other = reach(q, False)
        if (other is None or c <= other) and (q not in (START, SYSTEM) or end is None or c <= end + _LEEWAY.get(q, 0)):
            kept[q] = c
    return kept


@cache
def step(layer: tuple[tuple[int, int], ...], initial: bytes, forced: bool, cut: bool) -> Step:
    """The layer after one more turn: forced ones must go, cut ones cost 1 where they stay."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for rank, (state, cost) in enumerate(layer):
        for n, at in enumerate(_CHAINS[state]):
            edits = [("D", at, DELETE)]
            if not forced:
                kept = _AFTER.get((at, initial))
                edits += [("R", _NEXT[at], RENAME + cut)] + ([("K", kept, KEEP + cut)] if kept is not None else [])
            for letter, to, price in edits:
                way = (cost + INSERT * n + price, rank, "I" * n + letter, state)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
    costs = _pruned({q: way[0] for q, way in best.items()})
    least = min(costs.values())
    order = sorted(costs, key=lambda q: best[q][1:3])
    return Step(tuple((q, costs[q] - least) for q in order), least, {q: (best[q][3], best[q][2]) for q in order})


def closing(layer: tuple[tuple[int, int], ...]) -> tuple[int, int, str]:
    """The least (cost above the layer's least, rank, insertions) that ends in a whole conversation."""
    ways = []
    for rank, (state, cost) in enumerate(layer):
        if state == START:
            ways.append((cost, rank, ""))
        elif (state, ASSISTANT) in _INSERTIONS:
            n = _INSERTIONS[state, ASSISTANT]
            ways.append((cost + INSERT * n, rank, "I" * n))
    return min(ways)


def audit_of(layer: tuple[tuple[int, int], ...], links: list[dict[int, tuple[int, str]]]) -> tuple[int, str]:
    """The cost above the layer's least and the audit string of the cheapest whole conversation."""
    cost, rank, letters = closing(layer)
    state, parts = layer[rank][0], [letters]
    for link in reversed(links):
        state, letters = link[state]
        parts.append(letters)
    return cost, "".join(reversed(parts))


class Application:
    """Applies an audit to a conversation's turns and hashes the outcome as it goes."""

    def __init__(self, audit: str):
        self.letters, self.at, self.state, self.hash, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, role: bytes, text: bytes) -> None:
        if not self.first:
            self.hash.update(b"\n")
        self.first = False
        self.hash.update(role + b":" + text)

    def _insertions(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            self._put(_NAMES[self.state], b"")

    def turn(self, role: bytes, text: bytes) -> None:
        self._insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = _AFTER[self.state, role[:1]]
            self._put(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self._put(_NAMES[self.state], text)

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


class Conversation:
    """The turns of one conversation, fed in order."""

    def __init__(self, conv_id: int | None, buffer: int):
        self.conv_id, self.left = conv_id, buffer
        self.layer, self.cost, self.links = FIRST, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.initial = self.before = None
        self.held: list[tuple[bytes, bytes]] | None = []

    def turn(self, turn: int | None, role: bytes, text: bytes, key: bytes, again: bool, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        repeated = again or self.before == (turn, key)
        self.before = (turn, key)
        initial = role.decode("utf-8", "replace")[:1].encode()
        if self.initial is not None and self.initial + initial not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.initial = initial
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        forced = blank or repeated
        found = step(self.layer, initial if initial in (b"s", b"u", b"a") else b"", forced, cut and not forced)
        self.layer, self.cost = found.layer, self.cost + found.more
        self.links.append(found.links)
        if self.held is not None:
            self.left -= len(text)
            if self.left >= 0:
                self.held.append((role, text))
            else:
                self.held = None

    def result(self) -> tuple:
        more, audit = audit_of(self.layer, self.links)
        digest = None
        if self.held is not None:
            applied = Application(audit)
            for role, text in self.held:
                applied.turn(role, text)
            digest = applied.digest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + more, audit, digest


# ---- the tables -------------------------------------------------------------------------------


def _filled(c) -> F.Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def clean_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations as they are, none of them ``gone``."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled(F.col("role")).alias("role"), _filled(F.col("text")).alias("text"), F.lit(False).alias("gone"))


def damage(conversations: DataFrame) -> DataFrame:
    """The same, damaged by a hash of conv_id and turn; dropped rows stay, marked ``gone``."""
    chance = F.crc32(F.concat(_filled(F.col("conv_id")), F.lit(":"), _filled(F.col("turn"))).cast("binary")) % 20
    rows = clean_turns(conversations).drop("gone").withColumn("chance", chance)
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("chance") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("chance") == 0).alias("gone"), F.explode(times).alias("time")).drop("time")


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with what can be said of each: ``again`` (same role and text in an earlier turn number), ``blank``, ``cut``."""
    trimmed = F.rtrim(F.col("text"), F.lit(SEPARATOR_CHARS))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    known = rows.withColumns({"key": F.unhex(F.sha2(whole, 256)), "blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # null turns first
    groups = known.where("not gone").groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("last > first").drop("last")
    joined = join_groups(known, scratch.write(groups, "repeated"), "key", "n", spread=F.struct("turn", "conv_id"))
    return joined.withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).select(*_TURN)


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _bytes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("binary") for c in ("role", "text")})


def _batch(found: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def repair(turns: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """A row per conv_id of the turns (as ``damage`` and ``clean_turns`` give them): its faults, the cheapest
    edits and the hash of what they make of it."""
    scratch = Scratch(turns.sparkSession, "turn-repair")
    rows = faults(turns, scratch)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found, size = None, [], 0
        for batch in batches:
            for conv_id, turn, role, text, gone, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        found.append(current.result())
                        size += len(found[-1][7]) + 100
                    current = Conversation(conv_id, buffer)
                    if size > 1 << 20:
                        yield _batch(found)
                        found, size = [], 0
                if not gone:
                    current.turn(turn, role, text, *facts)
        if current is not None:
            found.append(current.result())
        if found:
            yield _batch(found)

    result = scratch.write(_bytes(_sorted(rows)).mapInArrow(decode, RESULT), "result")
    long = result.where("repaired_sha256 is null")
    if long.isEmpty():
        return result
    return result.where("repaired_sha256 is not null").unionByName(_applied(rows.where("not gone"), long))


def _applied(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The results of long conversations, their audits applied to turns that stream past."""
    same = lambda c: F.struct(F.coalesce(F.col(c), F.lit(0)), F.col(c).isNull())
    ids = broadcast_if_small(long.select(F.col("conv_id").alias("long_id")), SMALL_ROWS)
    theirs = rows.join(ids, same("conv_id") == same("long_id"), "left_semi").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    audits = long.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")

    def hash_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = conv = None
        for batch in batches:
            for conv_id, kind, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if current is not None:
                        yield pa.RecordBatch.from_pydict({"long_id": pa.array([conv], pa.int64()), "repaired_sha256": [current.digest()]})
                    current, conv = Application(audit), conv_id
                else:
                    current.turn(role, text)
        if current is not None:
            yield pa.RecordBatch.from_pydict({"long_id": pa.array([conv], pa.int64()), "repaired_sha256": [current.digest()]})

    hashed = _bytes(_sorted(theirs.unionByName(audits), "kind")).mapInArrow(hash_up, "long_id long, repaired_sha256 string")
    return long.drop("repaired_sha256").join(hashed, same("conv_id") == same("long_id")).select(*(f.split()[0] for f in RESULT.split(", ")))

"""Shared parts of the training-data operators: joins with groups, words and byte-level hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, clean_scratch, shared_folder

__all__ = ["Scratch", "clean_scratch", "shared_folder"]

#: The word separators of every contract: space and the ASCII controls 09 to 0D.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"

def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``most_rows`` the join shuffles instead."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread, most_rows: int = 500_000, hot: int = 10_000) -> DataFrame:
    """Left join of rows with a written table of groups (one per key, never null; ``size`` counts its rows),
    without a task for a hot key. Up to ``most_rows`` groups are broadcast. Beyond, those with at least a
    ``hot``-th of all grouped rows, of which there are ``hot`` at most, are broadcast, and a shuffle joins
    the rest, where the rows already served are dealt by ``spread`` instead of their key."""
    if groups.limit(most_rows + 1).count() <= most_rows:
        return rows.join(F.broadcast(groups), key, "left")
    total = groups.agg(F.sum(size)).first()[0]
    values = [c for c in groups.columns if c != key]
    large = groups.where(F.col(size) * hot >= total).select(key, *(F.col(c).alias(f"__large_{c}") for c in values))
    small = groups.where(F.col(size) * hot < total).select(F.col(key).alias("__key"), F.lit(0).alias("__at"), *values)
    served = F.col(f"__large_{size}").isNotNull()
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("__spread", F.when(served, 1 + F.pmod(F.xxhash64(spread), F.lit(100_000))).otherwise(F.lit(0)))
    # the spread comes with the key into the shuffle, so that a served key's rows lie in many tasks
    joined = dealt.join(small, (F.col(key) == F.col("__key")) & (F.col("__spread") == F.col("__at")), "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"__large_{c}"), F.col(c)).alias(c) for c in values))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def native_words(text):
    """Column: the words of a text (null: no words), split at the ASCII separators."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python copies of whole texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- vectorised hashing of words and shingles -------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges of the data, A-Z as a-z."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each closed by a line feed, and where each begins (plus the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), offsets


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the index of each text's first word (plus the end)."""
    data, offsets = joined(texts)
    inside = np.diff(np.concatenate(([True], _IS_SPACE[data])).astype(np.int8))
    starts, ends = np.flatnonzero(inside == -1), np.flatnonzero(inside == 1)
    return byte_range_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one of none is empty."""
    words, first = word_hashes(texts)
    rows = max(0, len(words) - width + 1)
    combined = np.zeros(rows, np.uint64)
    for k in range(width):
        combined += words[k : k + rows] * _PLACE[k]
    combined = mix(combined)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = int(b - a)
        if n >= width:
            yield np.unique(combined[a : b - width + 1])
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    short = short + words[a + k] * _PLACE[k]
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Consecutive runs of texts of about ``most`` bytes, so that hashing needs bounded memory."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part

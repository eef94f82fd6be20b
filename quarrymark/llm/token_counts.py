"""Exact token counts at every prefix of a text by dynamic programming.

A byte-pair encoding is a chain of tokens in which each neighbouring pair is stable: encoded
alone, the pair's text gives the same two tokens. So the encoding of a prefix ending at i is the
encoding of a shorter prefix plus the one token that ends at i and is stable after the last token
there, and the count at i is one more than the count there. An automaton of the vocabulary tells
which tokens end at i. The table of counts answers what any truncation or budget leaves without
encoding again.

No piece of the vocabulary holds a word mark after another character, nor a line feed, so chunks
that begin at those are independent: their tables are computed once, remembered, and laid end to
end for a text. Null and empty texts have 0 tokens. Other columns pass unchanged.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CHUNKS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
_counters: dict[str, PrefixCounter] = {}


class PrefixCounter:
    #: Chunks remembered in each of two generations, and the longest that is; beginnings whose state is kept;
    #: remembered steps of the automaton, the others are followed anew.
    MOST_KNOWN, LONGEST, MOST_HEADS, HEAD, MOST_STEPS = 750_000, 64, 300_000, 6, 500_000

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        #: Piece -> score; a higher score merges first.
        self.pieces = {model.id_to_piece(i): model.get_score(i) for i in range(size) if not special(i)}
        inner = [p for p in self.pieces if "\n" in p or MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError("the vocabulary has pieces across words")
        self.names = list(self.pieces)
        self._link()
        #: (number of the piece before, or -1) * vocabulary + number of the piece -> whether the two are stable.
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, tuple[list[int], list[int], int]] = {}

    def _link(self) -> None:
        """An Aho-Corasick automaton of the pieces: steps by state and character, and what ends in each state."""
        step: dict[int, int] = {}
        origin = [(0, 0)]
        own: dict[int, int] = {}
        for number, piece in enumerate(self.names):
            state = 0
            for c in map(ord, piece):
                key = state << 21 | c
                if key not in step:
                    step[key] = len(origin)
                    origin.append((state, c))
                state = step[key]
            own[state] = number
        depth = [0] * len(origin)
        for state, (parent, _) in enumerate(origin[1:], 1):
            depth[state] = depth[parent] + 1
        self.step, self.fails = step, [0] * len(origin)
        #: Length and number of each piece that ends in a state, the longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(origin)
        for state in sorted(range(1, len(origin)), key=depth.__getitem__):
            parent, c = origin[state]
            back = self._follow(self.fails[parent], c) if parent else 0
            self.fails[state] = back
            self.ends[state] = ((depth[state], own[state]), *self.ends[back]) if state in own else self.ends[back]

    def _follow(self, state: int, c: int) -> int:
        while (found := self.step.get(state << 21 | c)) is None:
            if not state:
                return 0
            state = self.fails[state]
        return found

    def merged(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.pieces.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_stable(self, before: int, token: int) -> bool:
        if len(self.stable) >= 1_000_000:
            self.stable.clear()
        pair = [self.names[k] for k in (before, token) if k >= 0]
        found = self.stable[before * len(self.names) + token] = self.merged("".join(pair)) == pair
        return found

    def table(self, chunk: str) -> list[int]:
        """Token counts of chunk[:1], chunk[:2], ... ; characters outside the vocabulary count their bytes."""
        head = chunk[: self.HEAD]
        state = self.heads.get(head)
        if state is None:
            if len(self.heads) >= self.MOST_HEADS:
                self.heads.clear()
            state = self.heads[head] = self._extend(head, [0], [-1], 0)
        if len(chunk) == len(head):
            return state[0][1:]
        return self._extend(chunk, state[0][:], state[1][:], state[2])[0][1:]

    def _extend(self, chunk: str, counts: list[int], last: list[int], state: int) -> tuple[list[int], list[int], int]:
        """Carries counts, numbers of last tokens and the automaton's state on to the end of the chunk."""
        step, ends, stable, size = self.step, self.ends, self.stable, len(self.names)
        i = len(last)
        for c in chunk[i - 1 :]:
            key = state << 21 | ord(c)
            found = step.get(key)
            if found is None:
                found = self._follow(state, ord(c))
                if len(step) < self.MOST_STEPS:
                    step[key] = found
            state = found
            for n, token in ends[state]:
                before = last[i - n]
                ok = stable.get(before * size + token)
                if ok is None:
                    ok = self._is_stable(before, token)
                if ok:
                    counts.append(counts[i - n] + 1)
                    last.append(token)
                    break
            else:
                counts.append(counts[i - 1] + len(c.encode()))
                last.append(-1)
            i += 1
        return counts, last, state

    def _chunk(self, chunk: str) -> bytes:
        """The table of a chunk not among the known ones, which it joins."""
        data = self.older.get(chunk) or array("i", self.table(chunk)).tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self.known) >= self.MOST_KNOWN:
                self.older, self.known = self.known, {}
            self.known[chunk] = data
        return data

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of the first i characters; counts[-1]: of the whole text."""
        if not text:
            return np.zeros(1, np.int64)
        chunks = _CHUNKS.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.known.get, chunks))
        if not all(found):
            found = [self.known.get(c) or self._chunk(c) if d is None else d for c, d in zip(chunks, found, strict=True)]
        inside = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ends = np.cumsum(sizes)
        totals = inside[ends - 1].astype(np.int64)
        counts = inside + np.repeat(np.cumsum(totals) - totals, sizes)
        counts[0] = 0  # the word mark that stands before the text, alone, is no text yet
        return counts


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_tables(docs: DataFrame, model: str, text: str = "text", into: str = "prefix_counts") -> DataFrame:
    """Adds the whole table, counts after 0, 1, 2 ... characters, as an array column."""

    @F.pandas_udf("array<long>")
    def tables(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(model)
        for part in parts:
            yield pd.Series([own.prefix_counts(t or "") for t in part])

    return docs.withColumn(into, tables(F.col(text)))


def token_counts(docs: DataFrame, model: str, limit: int, text: str = "text", into: str = "tokens") -> DataFrame:
    """Adds a struct: n_tokens of the text and fits, the length of its longest prefix with at most ``limit`` tokens."""

    @F.pandas_udf("n_tokens long, fits long")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(model)
        for part in parts:
            rows = []
            for t in part:
                table = own.prefix_counts(t or "")
                rows.append((int(table[-1]), int(np.flatnonzero(table <= limit)[-1])))
            yield pd.DataFrame(rows, columns=["n_tokens", "fits"])

    return docs.withColumn(into, counts(F.col(text)))

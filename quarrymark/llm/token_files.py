"""Token ids as fixed-width bit-packed blocks.

Documents are dealt by range of doc_id and sorted, encoded, and packed with the least number of
bits that holds the vocabulary. A file is Parquet (so any store that Spark reaches can hold it)
with one row per block: shard, block number, first token in the shard, the documents of the block
with their token offsets, the width and the packed payload. A block is found by shard and offset,
and unpacked with numpy alone, so any token or document can be read without its neighbours.

Defined results: null text encodes as empty, so its ids are the end id alone; documents without
doc_id sort first; repeated doc_ids follow each other, ordered by a hash of the text; an empty table
gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_range_hashes, chunks, joined, slices

END_ID = 2
BLOCK_TOKENS = 1 << 16
PIECE_BYTES = 1 << 19
BLOCKS = "shard int, block int, first_token long, doc_ids array<long>, offsets array<int>, bits int, payload binary"

_encoders: dict[str, WordEncoder] = {}


_SPACE, _ALPHA, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[ord("'")] = _OTHER  # begins the pattern's contractions
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _ALPHA
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of the data that the tokenizer treats apart from each other.

    It drops white space and cuts letters, single digits and signs from each other. Beyond ASCII
    only the letters of the block that begins with byte C3 are told from other characters; those,
    the apostrophe and control characters stay with what stands beside them.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _ALPHA
    a, b = kind[:-1], kind[1:]
    known = (a < _OTHER) & (b < _OTHER)
    cut = (known & ((a != b) | (a == _DIGIT))) | (a == _SPACE) | (b == _SPACE)
    starts = np.concatenate(([0], np.flatnonzero(cut) + 1))
    ends = np.append(starts[1:], len(data))
    full = kind[starts] != _SPACE
    return starts[full], ends[full]


class WordEncoder:
    """Encodes whole texts through the tokenizers library, remembering the ids of each segment.

    The ids of a text are those of its segments in order. Segments are known by a 64-bit hash of
    their lower-case bytes; of those not yet known, many are encoded together as one text, and the
    offsets of the tokens tell which segment each belongs to. Texts that may hold a special token,
    whose case counts, are encoded whole.
    """

    #: Segments and ids remembered; beyond either the memory starts anew.
    MOST_KNOWN, MOST_IDS = 500_000, 1 << 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # in order, beside each segment's number
        self.numbers = np.empty(0, np.int64)
        self.begins = np.zeros(1, np.int64)  # of each segment's ids, by number, plus the end
        self.ids = np.empty(0, np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        begins, ids = [self.begins], [self.ids]
        for at in range(0, len(new), 4096):
            words = [w.decode() for w in new[at : at + 4096]]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            first = np.zeros(len(words), np.int64)
            np.cumsum([len(w) + 1 for w in words[:-1]], out=first[1:])
            owner = np.searchsorted(first, [o[0] for o in found.offsets], side="right") - 1
            begins.append(begins[-1][-1] + np.searchsorted(owner, np.arange(1, len(words) + 1)))
            ids.append(np.array(found.ids, np.uint32))
        self.begins, self.ids = np.concatenate(begins), np.concatenate(ids)

    def _numbers(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lowered: bytes) -> np.ndarray:
        """The number of each segment, given in the order of their hashes."""
        if len(self.hashes) > self.MOST_KNOWN or len(self.ids) > self.MOST_IDS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(self.hashes[at.clip(max=len(self.hashes) - 1)] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            first = len(self.begins) - 1
            self._learn([lowered[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            self.numbers = np.insert(self.numbers, at[new], first + np.arange(len(new)))
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            at = np.searchsorted(self.hashes, hashes)
        return self.numbers[at]

    def _encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data, offsets = joined(texts)
        starts, ends = segments(data)
        hashes, at, inverse = np.unique(byte_range_hashes(data, starts, ends), return_index=True, return_inverse=True)
        entry = self._numbers(hashes, starts[at], ends[at], data.tobytes().lower())[inverse]
        first = self.begins[entry]
        size = self.begins[entry + 1] - first
        to = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        ids = self.ids[np.repeat(first - to[:-1], size) + np.arange(to[-1])]
        cuts = to[np.searchsorted(starts, offsets)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield ids[a:b]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for part in chunks(texts, PIECE_BYTES):
            for text, found in zip(part, self._encode([b"" if b"<|" in t else t for t in part]), strict=True):
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if b"<|" in text else found


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of each id, in order, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    flags = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, reading only the bytes that hold them."""
    if bits in (16, 32):
        kind = np.dtype("<u2" if bits == 16 else "<u4")
        return np.frombuffer(payload, kind, count, first * kind.itemsize).astype(np.uint32)
    begin, end = first * bits, (first + count) * bits
    flags = np.unpackbits(np.frombuffer(payload, np.uint8)[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: count * bits]
    return (flags.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_blocks(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id order; returns the written blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        bits = max(1, (max(own.vocabulary, end_id + 1) - 1).bit_length())
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            nonlocal block, first
            offsets = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            row = {"shard": shard, "block": block, "first_token": first, "doc_ids": names, "offsets": offsets.tolist(), "bits": bits, "payload": pack(np.concatenate(ids), bits)}
            block, first = block + 1, first + int(offsets[-1])
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        pending = 0
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for key, found in zip(keys, own.encode(texts), strict=True):
                ids.append(np.concatenate((found, end)))
                names.append(key)
                pending += len(found) + 1
                if pending >= BLOCK_TOKENS:
                    yield close()
                    ids, names, pending = [], [], 0
        if ids:
            yield close()

    # the hash parts documents of the same doc_id, or of none, over tasks
    dealt = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*dealt).sortWithinPartitions(*dealt, "text")
    return scratch.write(ordered.mapInArrow(run, BLOCKS), "tokens", compression="uncompressed")


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("bits", pa.int32()), ("payload", pa.binary())])


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, shard, start (in its shard), n_tokens and the crc32 of the ids of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                offsets = row["offsets"]
                ids = unpack(row["payload"], row["bits"], 0, offsets[-1]).astype("<u4")
                n = len(row["doc_ids"])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["first_token"] + o for o in offsets[:-1]], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """The first token of each shard in the whole order; as many rows as the write had tasks."""
    spark = blocks.sparkSession
    totals = blocks.groupBy("shard").agg(F.sum(F.element_at("offsets", -1).cast("long")).alias("n")).collect()
    starts, total = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in totals):
        starts.append((shard, total))
        total += n
    return spark.createDataFrame(starts, "shard int, shard_start long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids to block files and reads back doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(docs.sparkSession, "token-files")
    blocks = write_blocks(docs, scratch, tokenizer, end_id)
    starts = F.broadcast(shard_starts(blocks))  # a row per write task
    return read_documents(blocks).join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")

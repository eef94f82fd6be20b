"""Media columns: texts' bytes as WAV audio, and spectral-peak fingerprints of the audio.

``encode_wav`` stores a payload losslessly as 8-bit mono PCM in a RIFF/WAVE file (a binary
column); ``fingerprints`` reads the stored bytes back with the ``wave`` module, takes a
short-time Fourier transform, keeps the strongest peaks of each frame and pairs each anchor peak
with one in each of three frames of the target zone behind it, the one nearest in frequency (of two
as near the lower). The pairs are returned as time-coded arrays: frame times and packed (frequency,
frequency, gap) codes. Frames overlap by half, so that no sample stands only
where windows are near zero, and an excerpt shares codes with the whole.

Defined results: a null text counts as empty; the payload of an empty text is 64 zero bytes;
silent audio has no peaks and so empty arrays. Equal texts give equal values whatever their batch;
each row has its own media, those that repeat a doc_id or have none as well; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RATE, UNIT = 8000, 64
FRAME, HOP, PEAKS = 256, 128, 3
#: Frames of the target zone in which an anchor finds a partner.
GAPS = (1, 3, 8)
_WINDOW = np.hanning(FRAME).astype(np.float32)
_FRAMES_AT_ONCE = 2048


def to_wav(data: bytes) -> bytes:
    """The WAV file whose 8-bit samples are the data, zero-padded to a positive multiple of 64 bytes."""
    padded = data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame number and frequency bin of the strongest local maxima of each short-time spectrum."""
    samples = np.frombuffer(payload, np.uint8)
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, bins = [], []
    for at in range(0, frames, _FRAMES_AT_ONCE):
        n = min(_FRAMES_AT_ONCE, frames - at)
        block = np.zeros((n - 1) * HOP + FRAME, np.float32)
        part = samples[at * HOP : at * HOP + len(block)]
        block[: len(part)] = part
        view = np.lib.stride_tricks.sliding_window_view(block, FRAME)[::HOP]
        view = (view - view.mean(axis=1, keepdims=True)) * _WINDOW
        power = np.abs(np.fft.rfft(view, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        top = (inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1)
        masked = np.where(top, inner, 0)
        best = np.argpartition(-masked, PEAKS, axis=1)[:, :PEAKS]
        best.sort(axis=1)
        kept = np.take_along_axis(masked, best, axis=1) > 0
        row, col = np.nonzero(kept)
        times.append(row + at)
        bins.append(best[row, col] + 1)
    return np.concatenate(times), np.concatenate(bins)


def pair_codes(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor times and codes of each peak paired with the nearest one in the zone's frames; peaks come by time and bin."""
    if not len(times):
        return np.empty(0, np.int32), np.empty(0, np.int32)
    frames = int(times[-1]) + 1
    place = np.arange(len(times)) - np.searchsorted(times, times)
    held = np.full((frames + GAPS[-1], PEAKS), 1 << 20, np.int64)  # by frame: its peaks, then bins out of reach
    held[times, place] = bins
    found_t, found_c = [], []
    for gap in GAPS:
        others = held[times + gap]
        nearest = np.take_along_axis(others, np.abs(others - bins[:, None]).argmin(axis=1)[:, None], axis=1)[:, 0]
        there = nearest < 1 << 20
        found_t.append(times[there])
        found_c.append((bins[there] << 16) | (nearest[there] << 8) | gap)
    t, c = np.concatenate(found_t), np.concatenate(found_c)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def encode_wav(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (unpadded) and media (the WAV file) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(d) for d in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """Adds to each media row what its stored bytes hold: payload length and digests, times and codes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, at = batch.column(2), 0
            while at < len(stored):
                rows, times, codes, size = [], [], [], 0
                first = at
                while at < len(stored) and size < 8 << 20:
                    media = stored[at].as_py()
                    payload = from_wav(media)
                    t, c = pair_codes(*peaks(payload))
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
                    times.append(t)
                    codes.append(c)
                    size += len(media)
                    at += 1
                n, sha, crc, m, msha = zip(*rows, strict=True)
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(t) for t in times], out=offsets[1:])
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x), pa.int32())) for x in (times, codes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), batch.column(1).slice(first, at - first), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(m, pa.int64()), pa.array(msha), *lists],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def digest(prints: DataFrame) -> DataFrame:
    """Adds the fingerprint arrays as one comparable string: pair count, last time and a hash of both arrays."""
    joined = F.concat_ws(";", F.array_join(F.transform("times", lambda x: x.cast("string")), ","), F.array_join(F.transform("codes", lambda x: x.cast("string")), ","))
    feature = F.concat(F.size("codes").cast("string"), F.lit(":"), F.coalesce(F.array_max("times"), F.lit(0)).cast("string"), F.lit(":"), F.substring(F.sha2(joined, 256), 1, 32))
    return prints.select(*[c for c in prints.columns if c not in ("times", "codes")], feature.alias("feature"), "times", "codes")

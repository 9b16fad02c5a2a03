"""Media columns: texts as 8-bit WAV sound, and spectral-peak pair fingerprints.

The payload is the text in UTF-8, filled up with blanks to a positive multiple of ``FRAME`` bytes,
and stored as 8-bit mono samples. Features are computed from what the ``wave`` module reads back:
short-time Fourier transforms, the strongest local maxima of each frame, and pairs of a peak with
the peaks of the next frames, each coded in one integer with the frame where it starts.

Defined cases: null and empty texts are one frame of blanks; equal texts give equal bytes and equal
fingerprints; silence has no peaks and so an empty array; long texts are transformed in chunks of
``CHUNK`` frames; an empty table gives an empty result.
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

RATE, FRAME, HOP = 8000, 192, 192
#: Peaks of a frame, frames ahead that are paired, frames of one transform.
PEAKS, AHEAD, CHUNK = 2, 2, 4096
#: Layout of a code: first bin, second bin (7 bits each), frames between (2 bits).
BIN_BITS, GAP_BITS = 7, 2


def payload(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:FRAME]


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest local maxima of every frame, by frame, strongest first."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    at, bins = [], []
    for start in range(0, len(frames), CHUNK):
        block = frames[start:start + CHUNK].astype(np.float64) - 128.0
        block -= block.mean(axis=1, keepdims=True)
        # whole numbers, so that equal sounds have equal ties; ties go to the lower bin
        level = np.rint(np.abs(np.fft.rfft(block * _WINDOW, axis=1)) * 16.0).astype(np.int64)
        level[:, 0] = 0
        inner = level[:, 1:-1]
        top = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]), inner, 0)
        ranked = np.argpartition(-top * 128 + np.arange(top.shape[1]), PEAKS, axis=1)[:, :PEAKS]
        strength = np.take_along_axis(top, ranked, axis=1)
        order = np.argsort(-strength * 128 + ranked, axis=1)
        ranked, strength = np.take_along_axis(ranked, order, axis=1), np.take_along_axis(strength, order, axis=1)
        rows, cols = np.nonzero(strength > 0)
        at.append(rows + start)
        bins.append(ranked[rows, cols] + 1)
    return np.concatenate(at), np.concatenate(bins)


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all peak pairs and the frame each starts at, in order."""
    at, bins = peaks(samples)
    codes, times = [], []
    for step in range(1, PEAKS * (AHEAD + 1)):
        gap = at[step:] - at[:-step]
        near = (gap >= 1) & (gap <= AHEAD)
        first, second = bins[:-step][near], bins[step:][near]
        codes.append((first << (BIN_BITS + GAP_BITS)) | (second << GAP_BITS) | gap[near])
        times.append(at[:-step][near])
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    time = np.concatenate(times) if times else np.zeros(0, np.int64)
    order = np.lexsort((code, time))
    return code[order].astype(np.int32), time[order].astype(np.int32)


OUTPUT = ("n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
          "codes array<int>, times array<int>")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows, held = [], 0
        for i in range(len(batch)):
            text = texts[i].as_py() or ""
            stored = to_wav(payload(text))
            sound = from_wav(stored)
            code, time = fingerprints(np.frombuffer(sound, np.uint8))
            rows.append((i, len(text.encode("utf-8")), stored, len(sound), hashlib.sha256(sound).hexdigest(),
                         zlib.crc32(sound[-16:]), code, time))
            held += len(stored)
            if held > 8_000_000 or i == len(batch) - 1:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0]))] + [pa.array(c, t) for c, t in zip(cols[1:], (
                        pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
                    names=[batch.schema.names[0], "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "codes", "times"])
                rows, held = [], 0


def media_column(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Per row: its id, the WAV file, checks of the samples read back, and the fingerprint arrays.

    ``codes`` and ``times`` are parallel arrays: pair code and frame number.
    """
    kind = docs.schema[row_id].dataType.simpleString()
    return docs.select(row_id, text).mapInArrow(_encode, f"`{row_id}` {kind}, {OUTPUT}")


def digest_columns(media: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """Digests in place of files and arrays."""
    digest = F.lpad(F.lower(F.hex(F.xxhash64("codes", "times"))), 16, "0")
    feature = F.concat_ws(":", F.size("codes").cast("string"), digest)
    return media.select(row_id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                        F.octet_length("media").cast("long").alias("media_bytes"),
                        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))

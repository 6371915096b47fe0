"""Media columns: audio kept as WAV bytes, with spectral-peak fingerprints.

A payload is a run of 8-bit unsigned mono samples in a WAV container, written and read
by the wave module.  The features are short-time Fourier transforms over overlapping frames of
`FRAME` samples, their strongest local peaks, and pairs of peaks of near frames; each pair is
one 64-bit code (frame, first band, second band, distance), so a row's fingerprint is a
time-coded array, stored with the row.
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

from .common import materialize

FRAME = 576
RATE = 8000
PEAKS = 3
_BLOCK = 1 << 10  # frames transformed at a time


def pad(payload: bytes, unit: int = FRAME) -> bytes:
    """`payload` plus bytes 255 up to a positive multiple of `unit`."""
    want = max(1, -(-len(payload) // unit)) * unit
    return payload + b"\xff" * (want - len(payload))


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def decode_wav(data: bytes) -> bytes:
    """The samples; rejects what isn't 8-bit mono."""
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def spectra(samples: bytes, frame: int = FRAME, hop: int | None = None) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, in blocks of frames.

    Frames of `frame` samples begin `hop` samples apart (half a frame), are freed of their mean and weighted by a
    Hann window; magnitudes are rounded to a tenth, so that near-equal bands tie.  Payloads
    are whole frames, so every sample is in a frame.
    """
    x, hop = np.frombuffer(samples, np.uint8), hop or frame // 2
    window = np.hanning(frame).astype(np.float32)
    starts = np.arange(0, len(x) - frame + 1, hop)
    for at in range(0, len(starts), _BLOCK):
        part = x[starts[at : at + _BLOCK, None] + np.arange(frame)].astype(np.float32)
        part = (part - part.mean(axis=1, keepdims=True)) * window
        yield np.round(np.abs(np.fft.rfft(part, axis=1)), 1)


def frame_peaks(power: np.ndarray, peaks: int = PEAKS) -> np.ndarray:
    """Bands of each frame's strongest local maxima, strongest first; -1 where there are fewer.

    A band is one if it exceeds the band below and is not under the band above; the constant
    band and the last are none, and of equals the lower goes first.
    """
    inner = power[:, 1:-1]
    high = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
    # two keys in one: the magnitude, then the lower band
    rank = np.round(high * 10).astype(np.int64) * 4096 + (4095 - np.arange(high.shape[1]))
    rank[high == 0] = -1
    top = -np.sort(-np.partition(rank, -peaks, axis=1)[:, -peaks:], axis=1)
    return np.where(top < 0, -1, 4096 - top % 4096)


def peak_pairs(samples: bytes, fan_out: int = 2, frame: int = FRAME, peaks: int = PEAKS) -> np.ndarray:
    """Codes of spectral-peak pairs: frame << 24 | band a << 14 | band b << 4 | distance, sorted.

    Each of a frame's `peaks` peaks pairs with those of the next `fan_out` frames, and with the
    weaker ones of its own (distance 0), so that a text of one frame has a fingerprint too.
    A silent frame has no peak.
    """
    if frame > 2048 or fan_out > 15:
        raise ValueError("a code holds bands up to 1023 and distances up to 15")
    blocks = [frame_peaks(power, peaks) for power in spectra(samples, frame)]
    found = np.concatenate(blocks) if blocks else np.zeros((0, peaks), np.int64)
    codes = []
    for d in range(fan_out + 1):
        first, second = found[: len(found) - d], found[d:]
        for i in range(peaks):
            for j in range(peaks) if d else range(i + 1, peaks):
                t = np.flatnonzero((first[:, i] >= 0) & (second[:, j] >= 0))
                codes.append(t << 24 | first[t, i] << 14 | second[t, j] << 4 | d)
    return np.unique(np.concatenate(codes))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = FRAME) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a WAV file.

    Null text: empty, as is an empty one: a frame of padding.  Repeated rows each return a row,
    null ids stay null, an empty table gives an empty result, other columns aren't read.
    Long texts come in batches of bounded size; a text itself is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):  # bounded: long texts come in small batches
                part = batch.slice(at, 256)
                raw = [t.as_py() or b"" for t in part.column(1)]
                media = [encode_wav(pad(r, unit)) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    return cols.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def features(media: DataFrame, fan_out: int = 2, frame: int = FRAME, with_codes: bool = True) -> DataFrame:
    """Per row of to_media(): sizes and digests of the samples read back, and the codes.

    `feature` names the codes: how many, and their CRC-32 as little-endian 64-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, codes, part = [], [], batch.slice(at, 256)
                for d, n, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    data = m.as_buffer().to_pybytes()
                    samples = decode_wav(data)
                    pairs = peak_pairs(samples, fan_out, frame)
                    rows.append((d, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(pairs)}:{zlib.crc32(pairs.astype('<i8').tobytes()):08x}"))
                    codes.append(pairs)
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                if with_codes:
                    cols.append(pa.array(codes, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names + ["codes"] * with_codes)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + (", codes array<bigint>" if with_codes else ""))


def store(media: DataFrame) -> DataFrame:
    """Write the media column to a table in the shared folder and read it again."""
    return materialize(media, "media")

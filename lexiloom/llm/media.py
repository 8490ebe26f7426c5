"""Media columns: WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload of bytes is stored as unsigned 8-bit mono samples of a WAV file by the ``wave`` module and read back with it.
Frames of ``frame`` samples under a Hann window, each begun half a frame after the last, give spectra; the strongest bins
of a frame that exceed their neighbours are its peaks, and each peak is paired with the peaks of the next frames. A pair
is a code (first bin, second bin, frames between) at a time: two arrays of equal length, ``times`` and ``codes``, in order
of time. Of bins that tie, the lower is the peak; of peaks that tie for the last place, any.

Defined results: null and empty texts are one block of padding; equal texts give equal values; a payload shorter than a
frame is one frame, filled up with silence; silence has no peaks; texts are never cut (features are made in bounded
runs of frames); repeated rows are made each; columns other than doc_id and text are dropped; an empty table gives an
empty one.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.common import bounded_batches, slices

BLOCK = 576
RATE = 8000


def payload_of(data: bytes, block: int = BLOCK) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``block``."""
    return data + b"\xff" * (block if not data else -len(data) % block)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def spectra(samples: bytes, frame: int, hop: int) -> Iterator[tuple[int, np.ndarray]]:
    """Magnitudes by frame, in runs of at most 512 frames: (number of the first, frames x bins)."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, 1 + -(-(len(x) - frame) // hop)) if len(x) > frame else 1
    window = np.hanning(frame + 1)[:-1].astype(np.float32)
    for first in range(0, n, 512):
        last = min(n, first + 512)
        part = x[first * hop : (last - 1) * hop + frame].astype(np.float32) - 128
        part = np.pad(part, (0, max(0, (last - first - 1) * hop + frame - len(part))))
        frames = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop]
        yield first, np.abs(np.fft.rfft(frames * window, axis=1)).astype(np.float32)


def peaks(samples: bytes, frame: int, hop: int, per_frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and bins of the strongest local maxima, ``per_frame`` at most by frame."""
    times, bins = [], []
    for first, mag in spectra(samples, frame, hop):
        inner = mag[:, 1:-1]
        top = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]), inner, 0)
        k = min(per_frame, top.shape[1])
        at = np.sort(np.argpartition(-top, k - 1, axis=1)[:, :k], axis=1)
        strong = np.take_along_axis(top, at, 1) > 1e-3 * frame
        rows, cols = np.nonzero(strong)
        times.append(first + rows)
        bins.append(at[rows, cols] + 1)
    return np.concatenate(times), np.concatenate(bins)


def pair_codes(times: np.ndarray, bins: np.ndarray, reach: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with its next ``fan`` later peaks, up to ``reach`` frames on: times and codes, in order of time."""
    out_t, out_c = [], []
    start = np.searchsorted(times, times, side="right")
    for step in range(fan):
        j = start + step
        i = np.flatnonzero(j < len(times))
        j = j[i]
        near = times[j] - times[i] <= reach
        i, j = i[near], j[near]
        out_t.append(times[i])
        out_c.append((bins[i].astype(np.int64) << 24) | (bins[j].astype(np.int64) << 8) | (times[j] - times[i]))
    t, c = np.concatenate(out_t), np.concatenate(out_c)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order]


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<long>"


def media_columns(docs: DataFrame, *, frame: int = 128, hop: int = 64, per_frame: int = 3, reach: int = 4, fan: int = 3) -> DataFrame:
    """doc_id, n_bytes, media (WAV), payload (as read back), times and codes (the fingerprint)."""
    bounded_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):  # what is made is several times as long as what is read
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            media = [to_wav(payload_of(x)) for x in raw]
            back = [from_wav(m) for m in media]
            prints = [pair_codes(*peaks(p, frame, hop, per_frame), reach, fan) for p in back]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array(back, pa.binary()),
                    pa.array([p[0] for p in prints], pa.list_(pa.int32())),
                    pa.array([p[1] for p in prints], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "media", "payload", "times", "codes"],
            )

    return docs.select("doc_id", "text").mapInArrow(make, MEDIA_SCHEMA)

"""Media columns: texts kept as WAV samples and fingerprinted by spectral peaks.

A payload is stored as 8-bit mono samples by the ``wave`` module and read back
from the stored bytes.  The samples are cut into frames of ``FRAME``, one
every ``HOP`` = a quarter frame, so that every sample stands near the middle of
one and a shifted excerpt finds its frames again.  A short-time Fourier
transform (Hann window) gives a spectrum a frame, its strongest local maxima
are peaks, and each peak is paired with the first peaks of this and the next
frames.  A pair is one integer (both frequencies and the distance in time) at
the time of its first peak; both stand in arrays, so a fingerprint is a column
like any other.

Edge cases: a null text is the empty payload, which is padded to one frame of
255; equal texts give equal columns, so repeated rows do; of equally strong
maxima the lower frequency counts; a constant frame has no peak and gives no
pair; long payloads are worked on in blocks, so memory does not follow a
text's length times the spectrum's width; other columns, whatever their names,
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = 576
HOP = FRAME // 4
PAD = 255
RATE = 8000
PEAKS = 2
#: Frames ahead in which a peak finds partners: one frame length.
REACH = 4
#: Frames transformed at once; 2048 spectra take about 10 MB.
BLOCK = 2048

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, landmark_time array<int>, landmark_code array<int>"
)


def pad(data: bytes) -> bytes:
    """To a positive multiple of FRAME bytes."""
    short = -len(data) % FRAME if data else FRAME
    return data + bytes([PAD]) * short


def store(payload: bytes) -> bytes:
    """The WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    """The samples of a stored file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(frames: np.ndarray) -> np.ndarray:
    """The ``PEAKS`` strongest local maxima of each frame's spectrum, -1 where there are fewer."""
    wave_form = (frames.astype(np.float32) - 128.0) * _WINDOW
    power = np.abs(np.fft.rfft(wave_form, axis=1)).astype(np.float32)
    inner = power[:, 1:-1]
    top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1.0), inner, 0.0)
    found = np.empty((len(frames), PEAKS), dtype=np.int32)
    rows = np.arange(len(frames))
    for k in range(PEAKS):
        best = top.argmax(axis=1)
        strong = top[rows, best] > 0
        found[:, k] = np.where(strong, best + 1, -1)
        top[rows, best] = 0.0
    return found


def landmarks(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs: each peak with the strongest of the next frames, and the peaks of a frame with each other."""
    n = len(found)
    first, second, time, dt = [found[:, 0]], [found[:, 1]], [np.arange(n)], [np.zeros(n, dtype=np.int64)]
    for step in range(1, REACH + 1):
        if n > step:
            for k in range(PEAKS):
                first.append(found[:-step, k])
                second.append(found[step:, 0])
                time.append(np.arange(n - step))
                dt.append(np.full(n - step, step))
    f1, f2, t, d = (np.concatenate(x) for x in (first, second, time, dt))
    ok = (f1 >= 0) & (f2 >= 0)
    code = (f1[ok].astype(np.int32) << 13) | (f2[ok].astype(np.int32) << 3) | d[ok].astype(np.int32)
    order = np.lexsort((code, t[ok]))
    return t[ok][order].astype(np.int32), code[order]


def frames_of(payload: bytes) -> np.ndarray:
    """The overlapping frames of a payload, as a view."""
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(payload, dtype=np.uint8), FRAME)[::HOP]


def batch_peaks(payloads: list[bytes]) -> Iterator[np.ndarray]:
    """Peaks of each payload; frames of many payloads are transformed together, at most ``BLOCK`` at once."""
    waiting: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        found = peaks(np.concatenate(waiting))
        at = 0
        for f in waiting:
            yield found[at : at + len(f)]
            at += len(f)

    for p in payloads:
        frames = frames_of(p)
        n = len(frames)
        if held and held + n > BLOCK:
            yield from flush()
            waiting, held = [], 0
        if n > BLOCK:
            yield np.concatenate([peaks(frames[i : i + BLOCK]) for i in range(0, n, BLOCK)])
        else:
            waiting.append(frames)
            held += n
    if held:
        yield from flush()


def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows: dict[str, list] = {k: [] for k in ("n", "p", "ps", "crc", "m", "ms", "f", "lt", "lc")}
            payloads = []
            for data in batch.column(1).to_pylist():
                media = store(pad(data or b""))
                payload = load(media)
                payloads.append(payload)
                for k, v in (("n", len(data or b"")), ("p", len(payload)), ("ps", hashlib.sha256(payload).hexdigest()), ("crc", zlib.crc32(payload[-32:])), ("m", len(media)), ("ms", hashlib.sha256(media).hexdigest())):
                    rows[k].append(v)
            for found in batch_peaks(payloads):
                t, c = landmarks(found)
                rows["f"].append(f"peaks:{len(found)}:{len(t)}:{hashlib.sha256(t.astype('<i4').tobytes() + c.astype('<i4').tobytes()).hexdigest()}")
                rows["lt"].append(t)
                rows["lc"].append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(rows[k], pa.int64()) for k in ("n", "p")], pa.array(rows["ps"]), pa.array(rows["crc"], pa.int64()), pa.array(rows["m"], pa.int64()), pa.array(rows["ms"]), pa.array(rows["f"]), pa.array(rows["lt"], pa.list_(pa.int32())), pa.array(rows["lc"], pa.list_(pa.int32()))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmark_time", "landmark_code"],
            )


def _store_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            media = [store(pad(x or b"")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the WAV file as a binary column."""
    return docs.select(F.col("doc_id").cast("long"), F.encode(F.col(text), "UTF-8").alias("data")).mapInArrow(_store_batches, "doc_id bigint, media binary")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back, checks and fingerprints them; no shuffle, a pass over the input."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("data")).mapInArrow(describe, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Audio features of 8-bit recordings, stored as fixed-shape Arrow tensors with time spans.

A recording is a WAVE file of 8-bit mono samples. Its samples are resampled by a
polyphase filter, cut into overlapped frames, and turned into log-mel energies.
Voiced spans come from frame energies with hysteresis: a span begins above the
upper threshold and ends below the lower. The energies are cut into clips of one
shape, the last one filled up with the floor, so that each clip is a tensor.

Every recording is worked on by itself, in pieces of bounded length, so equal
recordings have equal features. Defined results: null and empty texts are a
payload of filler bytes only; recordings shorter than a frame have one frame,
filled up with silence; repeated rows are each done; further columns stay.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.scan import extend, utf8
from tessera.runtime import ship, table

RATE, TARGET = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
TAPS = 16  # of each phase
CLIP = 100  # frames
UNIT, FILLER = 576, 255
FLOOR = np.float32(np.log(1e-6))
#: Thresholds of frame energy, in nats above the recording's quietest tenth.
UPPER, LOWER = 0.5, 0.2
PIECE = 1 << 15  # frames worked on at once


def payload(text: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of UNIT."""
    return text + bytes([FILLER]) * ((-len(text)) % UNIT if text else UNIT)


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A WAVE file of 8-bit mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    odd = b"\0" * (len(samples) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + len(odd), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + odd


def from_wave(wave: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a WAVE file of 8-bit mono samples."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(wave):
        name, size = struct.unpack_from("<4sI", wave, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", wave, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono samples are supported")
        elif name == b"data" and rate is not None:
            return wave[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(8)
def _phases(up: int, down: int) -> np.ndarray:
    """(up, TAPS) filter phases: a windowed sinc at the lower of the two Nyquist rates."""
    n = up * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    h = (h / h.sum() * up).astype(np.float32)
    return np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1])


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up/down times its rate: each output is one phase of the filter over the samples around it."""
    phases = _phases(up, down)
    n = -(-len(x) * up // down)
    windows = sliding_window_view(np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)]), TAPS)
    out = np.empty(n, np.float32)
    for p in range(min(up, n)):
        at = np.arange(p, n, up, dtype=np.int64) * down
        begin, step = int(at[0]) // up, down
        for k in range(0, len(at), PIECE):
            m = min(PIECE, len(at) - k)
            rows = windows[begin + k * step : begin + (k + m - 1) * step + 1 : step]
            out[p + k * up : p + (k + m - 1) * up + 1 : up] = rows @ phases[int(at[0]) % up]
    return out


@lru_cache(4)
def _mel_bank(rate: int) -> np.ndarray:
    def mel(f):
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies, and the log power of each frame."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), _mel_bank(rate)
    mels, power = [], []
    for k in range(0, len(frames), PIECE):
        part = frames[k : k + PIECE]
        part = part - part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * window, FFT, axis=1)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(np.maximum(energy @ bank, np.float32(1e-6))))
        power.append(np.log(np.maximum(np.einsum("ij,ij->i", part, part) / FRAME, np.float32(1e-6))))
    return np.concatenate(mels), np.concatenate(power)


def voiced(power: np.ndarray, upper: float = UPPER, lower: float = LOWER) -> list[tuple[int, int]]:
    """(first, end) frames of spans that begin above the upper threshold and last until below the lower."""
    quiet = float(np.partition(power, len(power) // 10)[len(power) // 10])
    mark = np.where(power >= quiet + upper, 1, np.where(power < quiet + lower, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))
    on = np.concatenate([[False], mark[last] == 1, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(frames, MELS) log energies at TARGET samples a second, and the voiced spans in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    g = int(np.gcd(rate, TARGET))
    mel, power = log_mel(resample(x, TARGET // g, rate // g), TARGET)
    return mel, [(a * HOP / TARGET, ((b - 1) * HOP + FRAME) / TARGET) for a, b in voiced(power)]


def tensors(mel: np.ndarray, spans: list[tuple[float, float]]) -> pa.Table:
    """A row for each clip: its time span, the voiced seconds in it, and a fixed-shape tensor of CLIP frames.

    The schema's metadata has the number of frames, without the last clip's filling, and the voiced spans.
    """
    n = -(-len(mel) // CLIP)
    full = np.full((n * CLIP, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    begin = np.arange(n) * CLIP * HOP / TARGET
    end = np.minimum(begin + CLIP * HOP / TARGET, ((len(mel) - 1) * HOP + FRAME) / TARGET)
    a, b = (np.array([s[i] for s in spans]) for i in (0, 1))
    inside = np.clip(np.minimum(end[:, None], b) - np.maximum(begin[:, None], a), 0, None).sum(axis=1) if len(spans) else np.zeros(n)
    t = pa.table({"start_s": begin, "end_s": end, "voiced_s": inside, "mel": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, CLIP, MELS))})
    return t.replace_schema_metadata({"frames": str(len(mel)), "spans": json.dumps(spans)})


def from_tensors(t: pa.Table) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """What tensors() was given."""
    mel = t["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, MELS)
    return mel[: int(t.schema.metadata[b"frames"])], [tuple(s) for s in json.loads(t.schema.metadata[b"spans"])]


def to_ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def describe(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """The features in short: frames, spans, voiced time, mean energy, and a digest of the rounded energies."""
    return f"frames={len(mel)};clips={-(-len(mel) // CLIP)};spans={len(spans)};voiced={sum(b - a for a, b in spans):.3f};mean={float(mel.mean(dtype=np.float64)):.3f};mel={zlib.crc32(np.round(mel * 64).astype('<i2').tobytes()):08x}"


def with_waves(docs: DataFrame, text: str = "text", out: str = "wave") -> DataFrame:
    """``docs`` with each text's bytes as a WAVE file."""
    ship(docs.sparkSession)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array((to_wave(payload(t.as_py().encode())) for t in utf8(b.column(b.schema.get_field_index(text)))), pa.binary())]

    return extend(docs, [T.StructField(out, T.BinaryType(), False)], one)


def with_features(df: DataFrame, wave: str = "wave", out: str = "tensors") -> DataFrame:
    """``df`` with an Arrow stream of each recording's clips: a fixed-shape tensor and a time span each."""
    ship(df.sparkSession)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        rows = (from_wave(w.as_py()) for w in b.column(b.schema.get_field_index(wave)))
        return [pa.array((to_ipc(tensors(*features(*r))) for r in rows), pa.binary())]

    return extend(df, [T.StructField(out, T.BinaryType(), False)], one)


FIELDS = [
    T.StructField("n_bytes", T.LongType(), False),
    T.StructField("payload_bytes", T.LongType(), False),
    T.StructField("payload_sha256", T.StringType(), False),
    T.StructField("tail_crc32", T.LongType(), False),
    T.StructField("media_bytes", T.LongType(), False),
    T.StructField("media_sha256", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
]


def digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with digests of the stored recording, of what is read back from it, and of its features as read back from their tensor stream."""
    ship(docs.sparkSession)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for t in utf8(b.column(b.schema.get_field_index(text))):
            raw = t.as_py().encode()
            wave = to_wave(payload(raw))
            samples, rate = from_wave(wave)
            stored = to_ipc(tensors(*features(samples, rate)))
            rows.append((len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(wave), hashlib.sha256(wave).hexdigest(), describe(*from_tensors(from_ipc(stored)))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return extend(docs, FIELDS, one, keep)


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a recording, stored, read back and described."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

"""Audio features against direct formulas, and the stored form's round trip."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import audio


def test_round_trip():
    for t in (b"", b"a", b"x" * 576, b"x" * 577, bytes(range(256)) * 9):
        p = audio.payload(t)
        assert len(p) % 576 == 0 and len(p) > 0 and p[: len(t)] == t and set(p[len(t) :]) <= {255}
        assert audio.from_wave(audio.to_wave(p)) == (p, audio.RATE)
    assert audio.from_wave(audio.to_wave(b"abc", 8000)) == (b"abc", 8000)
    with pytest.raises(ValueError):
        audio.from_wave(b"RIFX" + b"\0" * 60)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (3, 2), (2, 3), (1, 1), (160, 147)])
def test_resampling_is_zero_stuffing_and_filtering(up, down):
    x = np.random.default_rng(1).normal(size=400).astype(np.float32)
    taps = audio._phases(up, down)[:, ::-1].T.reshape(-1).astype(float)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, taps)
    want = [full[k] if 0 <= (k := n * down + up * (audio.TAPS // 2 - 1)) < len(full) else 0 for n in range(-(-len(x) * up // down))]
    assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)


def test_a_tone_keeps_its_pitch():
    t = np.arange(16_000) / 16_000
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    mel, _ = audio.features(tone)
    bank = audio._mel_bank(audio.TARGET)
    assert len(mel) == (8000 - audio.FRAME) // audio.HOP + 1
    assert abs(int(mel.mean(axis=0).argmax()) - int(bank[round(1000 * audio.FFT / 8000)].argmax())) <= 1


def test_log_mel_by_its_formula():
    """Frame by frame and frequency by frequency: mean taken off, Hann window, discrete Fourier transform, triangles on the mel scale, log."""
    x = np.random.default_rng(3).normal(size=1500).astype(np.float32)
    rate, n, hop, size, mels = audio.TARGET, audio.FRAME, audio.HOP, audio.FFT, audio.MELS
    low, high = (2595 * np.log10(1 + f / 700) for f in (20.0, rate / 2))
    corners = [700 * (10 ** ((low + (high - low) * i / (mels + 1)) / 2595) - 1) for i in range(mels + 2)]
    got, power = audio.log_mel(x, rate)
    starts = range(0, len(x) - n + 1, hop)
    assert got.shape == (len(starts), mels)
    for row, at in enumerate(starts):
        frame = x[at : at + n].astype(float)
        frame -= frame.mean()
        assert abs(power[row] - np.log((frame**2).mean())) < 1e-3
        shaped = frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
        energy = [abs(sum(shaped * np.exp(-2j * np.pi * k * np.arange(n) / size))) ** 2 for k in range(size // 2 + 1)]
        for m in range(mels):
            a, b, c = corners[m : m + 3]
            total = sum(e * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for k, e in enumerate(energy) for f in [k * rate / size])
            assert abs(got[row, m] - np.log(max(total, 1e-6))) < 1e-3


def test_hysteresis():
    p = np.array([0, 0, 0.3, 0.6, 0.3, 0.3, 0.1, 0.4, 0.1, 0.7, 0.6] + [0] * 9)
    assert audio.voiced(p, 0.5, 0.2) == [(3, 6), (9, 11)]
    assert audio.voiced(np.zeros(5)) == []


def test_tensors():
    mel, spans = audio.features(audio.payload(b"some words and 128 more \x10\xf0" * 9000))
    t = audio.from_ipc(audio.to_ipc(audio.tensors(mel, spans)))
    assert t.schema.field("mel").type.shape == [audio.CLIP, audio.MELS]
    back = t["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    assert np.array_equal(back[: len(mel)], mel) and (back[len(mel) :] == audio.FLOOR).all()
    assert abs(sum(t["voiced_s"].to_pylist()) - sum(b - a for a, b in spans)) < 0.02 * t.num_rows + 1e-6


def test_query(spark, sf, tmp_path):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = audio.op8_audio(spark, sf).collect()
    assert len(got) == len(texts)
    same = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        p = audio.payload(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert same.setdefault(raw, r.feature) == r.feature and r.media_bytes == len(p) + 44
    rows = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "é" * 40_000, 3), (3, "é" * 40_000, 3), (None, "a", 1)], "doc_id long, text string, n_bytes int")
    d = {r.doc_id: r for r in audio.digests(rows, keep=["doc_id"]).collect()}
    assert d[1].payload_bytes == d[2].payload_bytes == 576 and d[1].feature == d[2].feature and d[3].n_bytes == 80_000
    out = audio.with_features(audio.with_waves(rows)).collect()
    assert audio.from_ipc(out[2].tensors).num_rows >= 1 and out[0].n_bytes == 1
    assert audio.with_features(audio.with_waves(rows.limit(0))).count() == 0


def test_features_are_read_back_from_the_stream(spark, monkeypatch):
    raw = b"some words and 128 more \x10\xf0" * 9000
    for clip in (raw, b"", b"x" * 100_000):
        mel, spans = audio.features(audio.payload(clip))
        back, again = audio.from_tensors(audio.from_ipc(audio.to_ipc(audio.tensors(mel, spans))))
        assert np.array_equal(back, mel) and again == spans
        assert audio.describe(back, again) == audio.describe(mel, spans)
    seen = []

    def one(b, fields, run, keep):
        monkeypatch.setattr(audio, "from_ipc", lambda raw, read=audio.from_ipc: seen.append(len(raw)) or read(raw))
        return run(pa.RecordBatch.from_pydict({"text": pa.array(["a text", None], pa.string())}))

    monkeypatch.setattr(audio, "extend", one)
    got = audio.digests(spark.range(1))
    assert len(seen) == len(got[-1]) == 2

import hashlib
import io
import wave
import zlib

import numpy as np
import pytest
from latticelu.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000])
def test_wav_round_trip(n):
    raw = bytes(k * 7 % 256 for k in range(n))
    samples = media.pad(raw)
    assert len(samples) % 576 == 0 and len(samples) >= max(n, 576) and samples[:n] == raw and set(samples[n:]) <= {255}
    data = media.encode_wav(samples)
    assert media.decode_wav(data) == samples
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE)


def test_peaks_of_tones():
    t = np.arange(576 * 4)
    tone = np.round(127.5 + 100 * np.sin(2 * np.pi * t * np.where(t < 1152, 40, 90) / 576)).astype(np.uint8).tobytes()
    pairs = {(c >> 24, c >> 14 & 1023, c >> 4 & 1023, c & 15) for c in media.peak_pairs(tone, fan_out=2, peaks=1).tolist()}
    # frames begin 288 samples apart; the fourth holds half of either tone
    assert {p for p in pairs if 3 not in (p[0], p[0] + p[3])} == {(0, 40, 40, 1), (1, 40, 40, 1), (0, 40, 40, 2), (4, 90, 90, 1), (5, 90, 90, 1), (4, 90, 90, 2), (2, 40, 90, 2)}
    assert len(media.peak_pairs(bytes(576 * 3))) == 0 and len(media.peak_pairs(b"")) == 0


@pytest.mark.parametrize("n", [576, 1152, 576 * 5])
def test_codes_are_those_of_a_plain_transform(n):
    """A discrete Fourier transform by its sum, peaks and pairs by loops."""
    samples = bytes(np.random.default_rng(n).integers(0, 256, n).tolist())
    turn = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / 575) for k in range(576)]
    frames = []
    for at in range(0, n - 575, 288):
        own = np.array(list(samples[at : at + 576]), float)
        power = np.round(np.abs(turn @ ((own - own.mean()) * window)), 1)
        high = [k for k in range(1, 288) if power[k] > power[k - 1] and power[k] >= power[k + 1]]
        frames.append(sorted(high, key=lambda k: (-power[k], k))[:3])
    want = set()
    for t, first in enumerate(frames):
        for d in range(3):
            for i, a in enumerate(first):
                for j, b in enumerate(frames[t + d] if t + d < len(frames) else []):
                    if d or j > i:
                        want.add(t << 24 | a << 14 | b << 4 | d)
    got = set(media.peak_pairs(samples).tolist())
    assert len(want & got) >= 0.98 * len(want | got) > 0  # single precision may round a tie the other way


def test_blocks_change_nothing(monkeypatch):
    samples = media.pad(bytes(np.random.default_rng(1).integers(0, 256, 20_000).tolist()))
    whole = media.peak_pairs(samples)
    monkeypatch.setattr(media, "_BLOCK", 5)
    assert (media.peak_pairs(samples) == whole).all()


def test_rejects_other_formats():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
    with pytest.raises(ValueError):
        media.decode_wav(out.getvalue())


def test_query(spark, sf_dir):
    from latticelu.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op8_media(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    by_text = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        samples = media.pad(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]))
        data = media.encode_wav(samples)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, b"m"), (1, None, b"m"), (None, "", None), (2, "é" * 4000, b"")], "doc_id bigint, text string, media binary")
    rows = media.features(media.store(media.to_media(df))).collect()
    assert sorted(r.payload_bytes for r in rows) == [576, 576, 576, 8064]
    assert all(list(r.codes) == sorted(r.codes) for r in rows)
    assert media.features(media.to_media(df.limit(0))).count() == 0

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nuggetry.functions import rules
from nuggetry.sources import images, prosody


def wav(x, rate=16000, bits=16, code=1, channels=1, extensible=False):
    x = np.repeat(np.asarray(x, float)[:, None], channels, axis=1).ravel()
    if code == 3:
        body = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        body = (np.rint(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = np.rint(x * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        body = np.rint(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    head = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    head += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14 if extensible else b""
    chunks = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def tone(hz, seconds, rate=16000, strength=0.5):
    t = np.arange(int(seconds * rate)) / rate
    return strength * (np.sin(2 * np.pi * hz * t) + 0.5 * np.sin(4 * np.pi * hz * t)) / 1.5


@pytest.mark.parametrize("how", [{}, {"bits": 8}, {"bits": 24}, {"bits": 32}, {"bits": 32, "code": 3}, {"bits": 64, "code": 3}, {"channels": 2}, {"extensible": True}])
def test_wav_files_are_read(how):
    x = tone(200, 0.2)
    got, rate = prosody.read_wav(wav(x, **how))
    assert rate == 16000 and len(got) == len(x) and np.abs(got - x).max() < (0.01 if how.get("bits") == 8 else 1e-3)


def test_what_is_no_wav_file():
    good = wav(tone(200, 0.1))
    for bad in (b"", b"RIFF", b"x" * 100, good[:20], good.replace(b"WAVE", b"AVI "), wav(tone(100, 0.1), bits=16, code=7)):
        assert prosody.read_wav(bad) is None
    assert len(prosody.read_wav(good[:-101])[0]) == 1600 - 51


@pytest.mark.parametrize("hz", [80, 110, 220, 443, 880])
@pytest.mark.parametrize("rate", [8000, 16000, 44100])
def test_pitch_of_tones(hz, rate):
    f0 = prosody.pitches(tone(hz, 0.6, rate), rate)
    voiced = f0[~np.isnan(f0)]
    assert len(voiced) > 0.6 * len(f0) and abs(np.median(voiced) - hz) < 0.01 * hz


def test_noise_and_silence_have_no_pitch():
    noise = np.random.default_rng(1).normal(0, 0.1, 16000)
    assert np.isnan(prosody.pitches(noise, 16000)).mean() > 0.9 and np.isnan(prosody.pitches(np.zeros(8000), 16000)).all()


def test_gaps_are_pauses_and_loud_words_are_stressed(spark):
    hush = np.random.default_rng(2).normal(0, 1e-4, 8000)
    x = np.concatenate([tone(150, 3), hush, tone(150, 3), hush[:1600], tone(150, 1, strength=1.0), tone(150, 2)])
    words = [{"start": 0.0, "end": 1.0}, {"start": 6.65, "end": 7.55}, {"start": 8.0, "end": 9.0}]
    df = spark.createDataFrame([(1, bytearray(wav(x)), words), (2, bytearray(b"no"), None), (3, None, None), (4, bytearray(wav([])), [])], "id int, content binary, words array<struct<start: double, end: double>>")
    got = {r.id: r.prosody for r in prosody.prosody(df, words="words").collect()}
    p = got[1]
    assert p.pause_count == 1 and 0.3 < p.longest_pause_seconds == p.total_pause_seconds < 0.6
    assert abs(p.duration_seconds - 9.6) < 1e-6 and abs(p.speaking_rate_wpm - 3 / 9.6 * 60) < 1e-6 and p.emphasis_count == 1
    assert abs(p.avg_pitch_hz - 150) < 5 and -40 < p.avg_energy_db < 0 and p.energy_variability > 1 and 140 < p.spectral_centroid_hz < 400
    assert got[2] is None and got[3] is None and got[4].duration_seconds == 0.0
    a = prosody.prosody(df, words="words").where("prosody IS NOT NULL").select(rules.tone(F.col("prosody"))["tone"].alias("tone"))
    assert all(r.tone for r in a.collect())


def test_recordings_in_a_folder(spark, tmp_path):
    (tmp_path / "a.WAV").write_bytes(wav(tone(220, 0.5)))
    (tmp_path / "b.mp3").write_bytes(b"x")
    got = prosody.prosody(prosody.read_recordings(spark, f"file://{tmp_path}")).collect()
    assert len(got) == 1 and abs(got[0].prosody.avg_pitch_hz - 220) < 3


def read_png(data):
    at, parts, size = 8, b"", None
    while at < len(data):
        n, name = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert zlib.crc32(name + body) == struct.unpack_from(">I", data, at + 8 + n)[0]
        if name == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        parts += body if name == b"IDAT" else b""
        at += 12 + n
    width, height, _, colour, *_ = size
    lines = np.frombuffer(zlib.decompress(parts), np.uint8).reshape(height, -1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, {0: 1, 2: 3, 6: 4}[colour])


def test_shrinking_keeps_the_mean():
    rng = np.random.default_rng(3)
    for h, w, c in ((100, 37, 3), (37, 100, 1), (64, 64, 4), (301, 2, 3)):
        x = rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        y = images.shrunk(x, 16)
        assert max(y.shape[:2]) == 16 and y.shape[2] == c and np.abs(y.mean(axis=(0, 1)) - x.mean(axis=(0, 1))).max() < 1
        assert (read_png(images.png(y)) == y).all()
    assert images.shrunk(x, 400) is x


def test_large_images_are_sent_smaller(spark, tmp_path):
    rng = np.random.default_rng(4)
    big, little = rng.integers(0, 256, (90, 200, 3)).astype(np.uint8), rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
    (tmp_path / "big.png").write_bytes(images.png(big))
    (tmp_path / "little.png").write_bytes(images.png(little))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG" + b"x" * 30_000)
    (tmp_path / "note.txt").write_bytes(b"x" * 30_000)
    got = {r.path.rpartition("/")[2]: r for r in images.sendable(spark, f"file://{tmp_path}", largest=20_000, longest=50).collect()}
    assert set(got) == {"big.png", "little.png"} and bytes(got["little.png"].content) == images.png(little)
    small = read_png(bytes(got["big.png"].content))
    assert small.shape == (22, 50, 3) or small.shape == (23, 50, 3)
    assert np.abs(small.mean(axis=(0, 1)) - big.mean(axis=(0, 1))).max() < 1 and got["big.png"].mime_type == "image/png"

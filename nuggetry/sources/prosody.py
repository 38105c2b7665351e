"""Prosody of recordings: pitch, energy, pauses, stress and rate from uncompressed WAV files, in Arrow batches.

Frames and their distance are fixed in time, whatever the rate of a file. Pitch is found by the difference function of a
frame with itself (autocorrelation by FFT), normalised by its running mean; the first dip below ``VOICED`` is the period.
Recognition of speech needs a model and stays outside: words with their times come as a column, if they are known.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Length of a frame and distance of frames in seconds, range of pitch in Hz, share of quiet frames, shortest
# pause in seconds, loudness of a stressed word against the mean, range of decibels.
FRAME, HOP = 2048 / 22050, 512 / 22050
PITCH = (65.40639132514966, 2093.004522404789)
QUIET, PAUSE, STRESS, RANGE_DB = 10, 0.3, 1.4, 80.0
# End of the fixed values.
#: Depth of a dip from which a frame counts as voiced.
VOICED = 0.15
#: Frames that are transformed at a time.
AT_ONCE = 256


def read_wav(data: bytes) -> tuple[np.ndarray, int] | None:
    """Samples from -1 to 1, channels averaged, and their rate; None where the bytes are no WAV file of whole or floating
    point numbers. A file that ends early gives what is there."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, kind, samples = 12, None, None
    while at + 8 <= len(data) and samples is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            code = struct.unpack_from("<H", body, 24)[0] if code == 0xFFFE and len(body) >= 26 else code  # the first field of the subformat
            kind = (code, channels, rate, bits)
        elif name == b"data" and kind:
            samples = body
        at += 8 + size + size % 2
    if samples is None or not kind[1] or not kind[2]:
        return None
    code, channels, rate, bits = kind
    width = bits // 8 * channels
    if not width:
        return None
    samples = samples[: len(samples) // width * width]
    if code == 1 and bits == 24:
        raw = np.frombuffer(samples, np.uint8).reshape(-1, 3)
        x = (np.pad(raw, ((0, 0), (1, 0))).copy().view("<i4").ravel() >> 8) / float(1 << 23)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    elif (code, bits) in ((1, 16), (1, 32)):
        x = np.frombuffer(samples, f"<i{bits // 8}") / float(1 << (bits - 1))
    elif (code, bits) in ((3, 32), (3, 64)):
        x = np.frombuffer(samples, f"<f{bits // 8}").astype(float)
    else:
        return None
    return x.reshape(-1, channels).mean(axis=1), rate


def _frames(x: np.ndarray, rate: int) -> tuple[np.ndarray, int]:
    """Starts of the frames, centred on multiples of the distance, in ``x`` padded by half a frame; and their length."""
    length, hop = max(2, round(FRAME * rate)), max(1, round(HOP * rate))
    return np.arange(1 + len(x) // hop) * hop, length


def loudness(x: np.ndarray, rate: int) -> np.ndarray:
    """Root mean square of every frame."""
    starts, length = _frames(x, rate)
    total = np.concatenate(([0.0], np.cumsum(np.pad(x, length // 2) ** 2)))
    return np.sqrt(np.maximum(total[np.minimum(starts + length, len(total) - 1)] - total[starts], 0) / length)


def pitches(x: np.ndarray, rate: int) -> np.ndarray:
    """Pitch of every frame in Hz, NaN where it is not voiced."""
    starts, length = _frames(x, rate)
    padded = np.pad(x, (length // 2, length))
    shortest, longest = max(2, int(rate / PITCH[1])), min(length // 2, int(rate / PITCH[0]) + 1)
    out = np.full(len(starts), np.nan)
    if longest <= shortest + 1:
        return out
    half, size = length - longest, 1 << (2 * length - 1).bit_length()
    for at in range(0, len(starts), AT_ONCE):
        rows = padded[starts[at : at + AT_ONCE, None] + np.arange(length)]
        rows = rows - rows.mean(axis=1, keepdims=True)
        both = np.fft.rfft(rows, size) * np.conj(np.fft.rfft(rows[:, :half], size))
        matched = np.fft.irfft(both, size)[:, : longest + 1]
        power = np.concatenate((np.zeros((len(rows), 1)), np.cumsum(rows**2, axis=1)), axis=1)
        own = power[:, half : half + longest + 1] - power[:, : longest + 1]
        differs = np.maximum(own[:, :1] + own - 2 * matched, 0)
        mean = np.cumsum(differs[:, 1:], axis=1) / np.arange(1, longest + 1)
        depth = np.ones_like(differs)
        np.divide(differs[:, 1:], mean, out=depth[:, 1:], where=mean > 1e-12)
        d = depth[:, shortest:longest]
        dip = (d < VOICED) & (d <= depth[:, shortest + 1 : longest + 1])
        voiced = dip.any(axis=1) & (own[:, 0] > 1e-8 * half)
        lag = dip.argmax(axis=1) + shortest
        r = np.arange(len(rows))
        a, b, c = depth[r, lag - 1], depth[r, lag], depth[r, np.minimum(lag + 1, longest)]
        bend = a - 2 * b + c
        shift = np.divide(a - c, 2 * bend, out=np.zeros_like(b), where=np.abs(bend) > 1e-12)  # the vertex of the parabola through the dip
        out[at : at + AT_ONCE] = np.where(voiced, rate / (lag + np.clip(shift, -1, 1)), np.nan)
    return out


def pauses(quiet: np.ndarray, step: float) -> np.ndarray:
    """Seconds of the runs of quiet frames that end before the recording does and last longer than ``PAUSE``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], quiet))))
    seconds = (edges[1::2] - edges[: len(edges) // 2 * 2 : 2]) * step
    return seconds[seconds > PAUSE]


@dataclass
class Prosody:
    """What is heard; names as the rules of tone take them."""

    duration_seconds: float = 0.0
    speaking_rate_wpm: float = 0.0
    avg_pitch_hz: float = 0.0
    pitch_range_hz: float = 0.0
    pitch_variability: float = 0.0
    avg_energy_db: float = 0.0
    energy_variability: float = 0.0
    pause_count: int = 0
    longest_pause_seconds: float = 0.0
    total_pause_seconds: float = 0.0
    emphasis_count: int = 0
    spectral_centroid_hz: float = 0.0
    zero_crossing_rate: float = 0.0


def analyse(x: np.ndarray, rate: int, words: list[tuple[float, float]] = ()) -> Prosody:
    """The prosody of samples; ``words`` are the times at which each starts and ends, in seconds."""
    if not len(x):
        return Prosody()
    out = Prosody(duration_seconds=len(x) / rate, speaking_rate_wpm=len(words) * 60 * rate / len(x))
    f0 = pitches(x, rate)
    if len(f0 := f0[~np.isnan(f0)]):
        out.avg_pitch_hz, out.pitch_range_hz, out.pitch_variability = float(f0.mean()), float(np.ptp(f0)), float(f0.std())
    rms, step = loudness(x, rate), max(1, round(HOP * rate)) / rate
    db = 20 * np.log10(np.maximum(rms, 1e-5) / max(rms.max(), 1e-5))
    db = np.maximum(db, db.max() - RANGE_DB)
    out.avg_energy_db, out.energy_variability = float(db.mean()), float(db.std())
    gaps = pauses(rms < np.percentile(rms, QUIET), step)
    if len(gaps):
        out.pause_count, out.longest_pause_seconds, out.total_pause_seconds = len(gaps), float(gaps.max()), float(gaps.sum())
    for start, end in words:
        a = min(max(0, int(start / step)), len(rms) - 1)
        b = max(a + 1, min(int(end / step), len(rms)))
        out.emphasis_count += bool(rms.mean() > 0 and rms[a:b].mean() / rms.mean() > STRESS)
    starts, length = _frames(x, rate)
    padded, window, centroids = np.pad(x, length // 2), np.hanning(length), []
    hz = np.fft.rfftfreq(length, 1 / rate)
    for at in range(0, len(starts), AT_ONCE):
        rows = np.pad(padded, (0, length))[starts[at : at + AT_ONCE, None] + np.arange(length)]
        strength = np.abs(np.fft.rfft(rows * window))
        centroids.append((strength * hz).sum(axis=1) / np.maximum(strength.sum(axis=1), 1e-12))
    out.spectral_centroid_hz = float(np.concatenate(centroids).mean())
    out.zero_crossing_rate = float(np.mean(np.diff(np.signbit(x)))) if len(x) > 1 else 0.0
    return out


_SCHEMA = ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in asdict(Prosody()).items())


def prosody(recordings: DataFrame, content: str = "content", words: str | None = None) -> DataFrame:
    """``recordings`` with ``prosody``, a struct, in place of the content; null where that is null or no WAV file.
    ``words``, a column, is an array of structs with start and end in seconds. A recording at a time is held."""
    kept = [c for c in recordings.columns if c not in (content, words)]
    types = [pa.int32() if isinstance(v, int) else pa.float64() for v in asdict(Prosody()).values()]
    kind = pa.struct(list(zip(asdict(Prosody()), types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row.column("_content")[0].as_py()
                sound = read_wav(data) if data else None
                times = [(w["start"], w["end"]) for w in (row.column("_words")[0].as_py() or [])]
                heard = asdict(analyse(*sound, times)) if sound else None
                yield pa.RecordBatch.from_arrays([row.column("_row"), pa.array([heard], kind)], names=["_row", "prosody"])

    none = F.expr("cast(null as array<struct<start: double, end: double>>)")
    spans = none if words is None else F.transform(words, lambda w: F.struct(w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end")))
    rows = recordings.select(F.struct(*kept).alias("_row"), F.col(content).alias("_content"), spans.alias("_words"))
    return rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, prosody struct<{_SCHEMA.replace(' ', ': ').replace(',:', ',')}>").select("_row.*", "prosody")


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the WAV files below ``folder``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(folder).select("path", "content")

"""Signal measurements on frames of samples (Arrow functions around numpy where an FFT is needed).

A frame is an array column; frames come from chunk rows by `framed`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.functions.scalar import clamp, dbfs
from ordina.operators.series import Key

EPS = 1e-12
RATE, FRAME, FPS = 44_100, 2_048, 100


def framed(chunks: DataFrame, key: Key, size: int, hop: int, centred: bool = False) -> DataFrame:
    """(key, frame_idx, start, frame) of every whole frame of size samples, hop apart, from chunk rows (start_sample, samples).

    Centred frames have their middle at frame_idx * hop for every such place inside the signal, and zeros beyond its ends.
    Each chunk gives its part of every frame it touches; a frame is put together from its parts.
    """
    half = size // 2 if centred else 0
    spans = chunks.select(*key, "start_sample", "samples", F.size("samples").alias("_n"))
    total = spans.groupBy(*key).agg(F.max(F.col("start_sample") + F.col("_n")).alias("_total"))
    first = F.greatest(F.lit(0), F.ceil((F.col("start_sample") + half - size + 1) / hop))
    last = F.floor((F.col("start_sample") + half + F.col("_n") - 1) / hop)
    parts = spans.withColumn("frame_idx", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("start", F.col("frame_idx") * hop - half)
    a = F.greatest(F.lit(0), F.col("start") - F.col("start_sample"))
    b = F.least(F.col("_n").cast("long"), F.col("start") + size - F.col("start_sample"))
    parts = parts.select(*key, "frame_idx", "start", F.struct("start_sample", F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("x")).alias("p"))
    whole = parts.groupBy(*key, "frame_idx", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"])).alias("frame"))
    whole = whole.join(total, list(key))
    if not centred:
        return whole.where(F.col("start") + size <= F.col("_total")).drop("_total")
    before = F.greatest(F.lit(0), -F.col("start")).cast("int")
    zero = F.get("frame", F.lit(0)) * 0
    padded = F.concat(F.array_repeat(zero, before), "frame", F.array_repeat(zero, F.lit(size) - before - F.size("frame")))
    return whole.where(F.col("frame_idx") * hop < F.col("_total")).withColumn("frame", padded).drop("_total")


def rms(frame: Column) -> Column:
    return F.sqrt(F.aggregate(frame, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(frame))


def rms_dbfs(frame: Column) -> Column:
    """Level of a frame in dB below full scale; null for an empty frame."""
    return F.when(F.size(frame) > 0, dbfs(rms(frame)))


def zero_crossing_rate(frame: Column) -> Column:
    """Changes of sign (0 counts as positive) over the number of samples."""
    moved = F.zip_with(F.slice(frame, F.lit(1), F.size(frame) - 1), F.slice(frame, F.lit(2), F.size(frame) - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    return F.aggregate(moved, F.lit(0), lambda s, v: s + v) / F.size(frame)


def roughness(frame: Column) -> Column:
    """RMS of the first difference."""
    d = F.zip_with(F.slice(frame, F.lit(1), F.size(frame) - 1), F.slice(frame, F.lit(2), F.size(frame) - 1), lambda a, b: (b - a).cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / F.size(frame))


def _near_lags(n: int, rate: int, f0: float, share: float) -> tuple[int, int]:
    return max(1, int(np.floor(rate / (f0 * (1 + share))))), min(n - 1, int(np.ceil(rate / (f0 * (1 - share)))))


def autocorrelation_peak(x: np.ndarray, rate: int, f0: float, share: float = 0.15) -> float | None:
    """The greatest normalised autocorrelation of the windowed frame near one period, 0..1; None for a short, silent or unpitched frame."""
    if x.size < 8 or not np.isfinite(f0) or f0 <= 0:
        return None
    y = (x - x.mean()) * np.hanning(x.size)
    energy = float(y @ y)
    low, high = _near_lags(x.size, rate, f0, share)
    if energy <= EPS or high < low:
        return None
    return float(np.clip(max(y[:-k] @ y[k:] for k in range(low, high + 1)) / energy, 0.0, 1 - 1e-9))


def local_hnr(x: np.ndarray, rate: int, f0: float, share: float = 0.15) -> float | None:
    """HNR of the autocorrelation peak near one period, a peak at or below 0 counting as 1e-9."""
    peak = autocorrelation_peak(x, rate, f0, share)
    if peak is None:
        return None
    r = min(max(peak, 1e-9), 1 - 1e-9)
    return float(10 * np.log10(r / (1 - r)))


def spectral_tilt(x: np.ndarray, rate: int, low_hz: float = 200.0, high_hz: float = 5000.0, range_db: float = 50.0) -> float | None:
    """Slope of dB over octaves of the bins within range_db of the band's peak; needs eight."""
    if x.size < 16:
        return None
    size = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(x.size)))
    hz = np.fft.rfftfreq(x.size, 1 / rate)
    band = (hz >= low_hz) & (hz <= min(high_hz, rate * 0.49))
    size, hz = size[band], hz[band]
    if size.size < 8 or size.max() <= EPS:
        return None
    keep = size >= max(size.max() * 10 ** (-range_db / 20), EPS)
    if keep.sum() < 8:
        return None
    octave, db = np.log2(hz[keep] / 1000), 20 * np.log10(size[keep])
    octave = octave - octave.mean()
    return float(octave @ (db - db.mean()) / (octave @ octave))


def voice_measures(rate: int, share: float = 0.15):
    """A function of (frame, f0) columns to rms_dbfs, autocorrelation_hnr_db, spectral_tilt_db_per_octave."""

    @F.pandas_udf("autocorrelation_peak double, autocorrelation_hnr_db double, spectral_tilt_db_per_octave double")
    def measure(frame: pd.Series, f0: pd.Series) -> pd.DataFrame:
        rows = []
        for x, hz in zip(frame, f0, strict=True):
            x, hz = np.asarray(x, float), float(hz) if hz is not None else np.nan
            rows.append((autocorrelation_peak(x, rate, hz, share), local_hnr(x, rate, hz, share), spectral_tilt(x, rate)))
        return pd.DataFrame(rows, columns=["autocorrelation_peak", "autocorrelation_hnr_db", "spectral_tilt_db_per_octave"], dtype=float)

    return measure


def voice_series(frames: DataFrame, rate: int, least_db: float = -70.0) -> DataFrame:
    """Measures of frames (frame, f0_hz) that aren't too quiet."""
    loud = frames.withColumn("rms_dbfs", rms_dbfs(F.col("frame"))).where(F.col("rms_dbfs") >= least_db)
    return loud.withColumn("_m", voice_measures(rate)("frame", "f0_hz")).select("*", "_m.*").drop("_m", "frame")


def segment_voice_quality(frames: DataFrame, key: Key, rate: int) -> DataFrame:
    """Medians over the measurable frames of each segment, with counts."""
    rows = frames.groupBy(*key).agg(F.count("*").alias("frame_count"))
    found = voice_series(frames, rate).groupBy(*key).agg(F.count("*").alias("usable_frame_count"), *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("rms_dbfs", "autocorrelation_peak", "autocorrelation_hnr_db", "spectral_tilt_db_per_octave")])
    return rows.join(found, list(key), "left").withColumn("usable_frame_count", F.coalesce("usable_frame_count", F.lit(0)))


def frames_at(points: DataFrame, chunks: DataFrame, key: Key, rate: int, length_ms: float = 60.0) -> DataFrame:
    """The frame around each point's time_s; points whose frame would leave the signal are dropped."""
    size = max(16, round(rate * length_ms / 1000))
    spans = chunks.select(*key, F.col("start_sample").alias("_s"), "samples")
    width = spans.groupBy(*key).agg(F.max(F.size("samples")).alias("_w"), F.max(F.col("_s") + F.size("samples")).alias("_total"))
    at = points.withColumn("_a", (F.rint(F.col("time_s") * rate) - size // 2).cast("long")).join(width, list(key)).where((F.col("_a") >= 0) & (F.col("_a") + size <= F.col("_total")))
    at = at.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / F.col("_w")), F.floor((F.col("_a") + size - 1) / F.col("_w")))))
    spans = spans.join(width, list(key)).withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("_s") / F.col("_w")), F.floor((F.col("_s") + F.size("samples") - 1) / F.col("_w")))))).drop("_w", "_total")
    both = at.join(spans, [*key, "_b"]).dropDuplicates([*key, "time_s", "_s"])
    a = F.greatest(F.lit(0), F.col("_a") - F.col("_s"))
    b = F.least(F.size("samples").cast("long"), F.col("_a") + size - F.col("_s"))
    both = both.where(b > a).withColumn("_p", F.struct("_s", F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("x")))
    keep = [c for c in points.columns if c not in key]
    return both.groupBy(*key, *keep).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["x"])).alias("frame"))


def vibrato_rate(times: np.ndarray, residual: np.ndarray, low: float = 3.0, high: float = 9.0, least: int = 12) -> float | None:
    """The strongest rate of evenly resampled residuals; None if they are too short or still."""
    if times[-1] - times[0] < max(0.45, 2 / low):
        return None
    dt = float(np.median(np.diff(times)))
    grid = np.arange(times[0], times[-1] + dt / 2, dt) if dt > 0 else np.zeros(0)
    if grid.size < least:
        return None
    y = np.interp(grid, times, residual)
    size, hz = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(y.size))), np.fft.rfftfreq(y.size, dt)
    band = (hz >= low) & (hz <= high)
    return float(hz[band][size[band].argmax()]) if band.any() and size[band].max() > 1e-9 else None


@F.pandas_udf(T.DoubleType())
def modulation_rate(times: pd.Series, residuals: pd.Series) -> pd.Series:
    return pd.Series([vibrato_rate(np.asarray(t, float), np.asarray(r, float)) if len(t) > 1 else None for t, r in zip(times, residuals, strict=True)], dtype=float)


def browser_metrics(x: np.ndarray, rate: int) -> dict[str, float]:
    """Level, pitch and confidence by normalised difference, HNR, tilt and cepstral prominence of one power-of-two frame."""
    n = len(x)
    x = x - x.mean()
    level = 20 * np.log10(np.sqrt(np.mean(x * x)) + 1e-12)
    spectrum = np.abs(np.fft.fft(x * np.hanning(n))) ** 2
    ac = np.fft.ifft(spectrum).real
    zero = max(EPS, ac[0])
    low, high = max(2, rate // 1200), min(rate // 55, n // 2 - 2)
    d = np.maximum(0, 2 * (zero - ac[: high + 1]))
    d[0] = 0
    lag = np.arange(high + 1)
    cmnd = d * lag / np.maximum(np.cumsum(d), 1e-12)
    cmnd[0] = 1
    inner = np.arange(low + 1, high - 1)
    dips = inner[(cmnd[inner] < 0.18) & (cmnd[inner] <= cmnd[inner - 1]) & (cmnd[inner] <= cmnd[inner + 1])]
    chosen = int(dips[0]) if len(dips) else int(inner[cmnd[inner].argmin()]) if len(inner) else -1
    refined = float(chosen)
    if low < chosen < high:
        a, b, c = cmnd[chosen - 1 : chosen + 2]
        if abs(a - 2 * b + c) > 1e-9:
            refined = chosen + 0.5 * (a - c) / (a - 2 * b + c)
    confidence = float(np.clip(1 - cmnd[chosen], 0, 1)) if chosen > 0 else 0.0
    if level < -55:
        confidence *= float(np.clip((level + 70) / 15, 0, 1))
    r = float(np.clip(ac[int(np.clip(np.floor(refined + 0.5), 1, high))] / zero, 0.0001, 0.9999))
    k = np.arange(max(1, int(np.ceil(200 * n / rate))), min(n // 2 - 1, int(min(5000, rate * 0.45) * n / rate)) + 1)
    tilt = np.polyfit(np.log2(k * rate / n / 1000), 10 * np.log10(spectrum[k] + 1e-18), 1)[0] if len(k) > 1 else 0.0
    cepstrum = np.fft.ifft(np.log(spectrum + 1e-18)).real
    q_low, q_high = max(1, int(rate * 0.001)), min(n // 2 - 2, int(np.ceil(rate * 0.020)))
    p = np.arange(max(q_low + 1, rate // 500), min(q_high - 1, int(np.ceil(rate / 60))) + 1)
    q = np.arange(q_low, q_high + 1)
    slope, base = np.polyfit(q / rate, cepstrum[q], 1)
    top = int(p[cepstrum[p].argmax()])
    prominence = max(0.0, (cepstrum[top] - base - slope * top / rate) * 20 / np.log(10))
    return {"rms_db": float(level), "f0": rate / refined if confidence > 0.15 and refined > 0 else np.nan, "confidence": confidence, "hnr": float(10 * np.log10(r / (1 - r))), "tilt": float(tilt), "cpps": float(prominence)}


def browser_frames(frames: DataFrame, rate: int) -> DataFrame:
    """browser_metrics of each frame; f0 is null where there is none."""
    names = ("rms_db", "f0", "confidence", "hnr", "tilt", "cpps")

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def measure(frame: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([browser_metrics(np.asarray(x, float), rate) for x in frame], columns=list(names))

    rows = frames.withColumn("_m", measure("frame")).select("*", "_m.*").drop("_m", "frame")
    return rows.withColumn("f0", F.nanvl("f0", F.lit(None).cast("double")))


def log_filterbank(rate: int = RATE, frame: int = FRAME, per_octave: int = 12, low: float = 30.0, high: float = 17_000.0, reference: float = 440.0) -> np.ndarray:
    """Triangular filters (bands x bins) of unit sum around the bins nearest to a logarithmic scale; equal bins count once."""
    steps = np.arange(np.floor(np.log2(low / reference) * per_octave), np.ceil(np.log2(high / reference) * per_octave))
    wanted = reference * 2 ** (steps / per_octave)
    wanted = wanted[(wanted >= low) & (wanted <= high)]
    hz = np.arange(frame // 2) * rate / frame
    right = np.clip(np.searchsorted(hz, wanted), 1, len(hz) - 1)
    bins = np.unique(np.where(wanted - hz[right - 1] < hz[right] - wanted, right - 1, right))
    bank = np.zeros((len(bins) - 2, len(hz)), np.float32)
    for band, (a, b, c) in enumerate(zip(bins, bins[1:], bins[2:], strict=False)):
        if c - a < 2:
            b, c = a, a + 1
        bank[band, a:b] = np.arange(b - a) / max(1, b - a)
        bank[band, b:c] = 1 - np.arange(c - b) / max(1, c - b)
        bank[band] /= bank[band].sum()
    return bank


def quantize_stem(interleaved: np.ndarray) -> np.ndarray:
    """Stereo floats to mono 16-bit: scaled below full scale if need be, rounded half to even per channel, mean toward zero."""
    scale = max(1.01 * float(np.abs(interleaved).max(initial=0)), 1.0)
    both = np.clip(np.rint(np.clip(interleaved.reshape(-1, 2) / scale, -1, 1) * 32768), -32768, 32767)
    return np.trunc(both.sum(axis=1) / 2).astype(np.int16)


def log_spectrogram(mono: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x bands: log10 of the filtered magnitude plus 1, frames centred FPS a second apart."""
    hop, bank = rate / FPS, log_filterbank(rate)
    n = int(np.ceil(len(mono) / hop))
    padded = np.concatenate([np.zeros(FRAME // 2), mono / 32767, np.zeros(FRAME)])
    window = np.hanning(FRAME)
    out = np.empty((n, len(bank)), np.float32)
    for k in range(n):
        a = int(k * hop)
        out[k] = np.log10(bank @ np.abs(np.fft.rfft(padded[a : a + FRAME] * window))[:-1].astype(np.float32) + 1)
    return out


def log_bands(chunks: DataFrame, key: Key, rate: int = RATE) -> DataFrame:
    """(key, frame_idx, bands): log_spectrogram of mono 16-bit chunk rows (start_sample, samples), by frames. The rate is a multiple of FPS."""
    if rate % FPS:
        raise ValueError(f"{rate} samples a second aren't a multiple of {FPS}")
    bank, window = log_filterbank(rate).T, np.hanning(FRAME)

    @F.pandas_udf("array<float>")
    def bands(frame: pd.Series) -> pd.Series:
        if not len(frame):
            return pd.Series([], dtype=object)
        size = np.abs(np.fft.rfft(np.stack(frame.to_numpy()) / 32767 * window))[:, :-1].astype(np.float32)
        return pd.Series(list(np.log10(size @ bank + 1).astype(np.float32)))

    return framed(chunks, key, FRAME, rate // FPS, centred=True).select(*key, "frame_idx", bands("frame").alias("bands"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum_db(frame: pd.Series) -> pd.Series:
    """Levels of the bins of a frame under a Hann window, -200 dB at least."""
    return pd.Series([20 * np.log10(np.maximum(1e-10, np.abs(np.fft.rfft(np.asarray(x, float) * np.hanning(len(x)))))) for x in frame], dtype=object)


def stft(chunks: DataFrame, key: Key, size: int = 1_024, hop: int = 256) -> DataFrame:
    """(key, frame_idx, bins): levels of each whole frame of a signal in chunk rows."""
    return framed(chunks, key, size, hop).select(*key, "frame_idx", spectrum_db("frame").alias("bins"))


def dominance_map(frames: DataFrame) -> DataFrame:
    """(bin, vocals_db, instr_db) rows of frames with arrays vocals and instrumental."""
    keep = [c for c in frames.columns if c not in ("vocals", "instrumental")]
    both = F.arrays_zip(spectrum_db("vocals").alias("vocals_db"), spectrum_db("instrumental").alias("instr_db"))
    return frames.select(*keep, F.posexplode(both).alias("bin", "_c")).select(*keep, "bin", F.col("_c")["vocals_db"].alias("vocals_db"), F.col("_c")["instr_db"].alias("instr_db"))


def repetition_features(frames: DataFrame, key: Key) -> DataFrame:
    """Vectors [level / 20, 8 * zero crossings, brightness, change of level / 12] of frames (frame_idx, frame)."""
    energy = F.aggregate("frame", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = frames.withColumns({"db": 20 * F.log10(rms(F.col("frame")) + 1e-8), "zcr": zero_crossing_rate(F.col("frame")), "brightness": roughness(F.col("frame")) * F.sqrt(F.size("frame")) / F.sqrt(F.greatest(energy, F.lit(EPS)))})
    w = Window.partitionBy(*key).orderBy("frame_idx")
    delta = F.coalesce(F.col("db") - F.lag("db").over(w), F.lit(0.0))
    return rows.select(*key, "frame_idx", F.array(F.col("db") / 20, F.col("zcr") * 8, F.col("brightness"), delta / 12).alias("features"))


def envelope(samples: DataFrame, key: Key, bins: int = 1500) -> DataFrame:
    """Peak of |sample| in each of so many equal bins of a signal."""
    total = samples.groupBy(*key).agg((F.max("sample_idx") + 1).alias("_n"))
    at = F.floor(F.col("sample_idx") * bins / F.col("_n"))
    return samples.join(total, list(key)).groupBy(*key, at.alias("bin")).agg(F.max(F.abs("sample")).alias("peak"))


def stem_profile(samples: DataFrame, key: Key, bins: int = 1400) -> DataFrame:
    """Square root of the bin's RMS over the largest bin's, from (sample_idx, left, right)."""
    total = samples.groupBy(*key).agg((F.max("sample_idx") + 1).alias("_n"))
    energy = (F.col("left") * F.col("left") + F.col("right") * F.col("right")) * 0.5
    level = samples.join(total, list(key)).groupBy(*key, F.floor(F.col("sample_idx") * bins / F.col("_n")).alias("bin")).agg(F.sqrt(F.avg(energy)).alias("_r"))
    peak = F.greatest(F.lit(1e-6), F.max("_r").over(Window.partitionBy(*key)))
    return level.select(*key, "bin", F.sqrt(clamp(F.col("_r") / peak, 0.0, 1.0)).alias("level"))


def band_energy(bins: DataFrame, key: Key) -> DataFrame:
    """Shares of power below 300 Hz, to 1 kHz, to 4 kHz and above, from (hz, power); 0 in silence."""
    hz, total = F.col("hz"), F.sum("power")
    bands = {"energy_lt_300_ratio": hz < 300, "energy_300_1000_ratio": (hz >= 300) & (hz < 1000), "energy_1000_4000_ratio": (hz >= 1000) & (hz < 4000), "energy_ge_4000_ratio": hz >= 4000}
    return bins.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(c, F.col("power"))) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(n) for n, c in bands.items()])


def active_end(levels: DataFrame, key: Key, range_db: float = 50.0) -> DataFrame:
    """Time of the last frame (time_s, rms) within range_db of the loudest."""
    top = F.max("rms").over(Window.partitionBy(*key))
    return levels.withColumn("_t", top).where((F.col("rms") > 0) & (20 * F.log10(F.col("rms") / F.col("_t")) > -range_db)).groupBy(*key).agg(F.max("time_s").alias("active_end_s"))


def prominent_peaks(frames: DataFrame, key: Key, value: str, distance: int, prominence: float | None = None, top: int | None = None) -> DataFrame:
    """Local maxima at least distance frames apart (higher ones win) whose prominence over the higher of both side minima is large enough.

    Without a prominence: max(0.1, 0.15 * p75) of the series.
    """
    names = list(key)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*names).schema), f"frame_idx long, {value} double, prominence double"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        y = pdf[value].to_numpy(float)
        least = prominence if prominence is not None else max(0.1, 0.15 * float(np.percentile(y, 75)))
        # the middle of each plateau that is higher than both sides
        edge = np.flatnonzero(np.diff(y) != 0)
        a, b = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(y) - 1]])
        inner = [(s + e) // 2 for s, e in zip(a, b, strict=True) if s > 0 and e < len(y) - 1 and y[s - 1] < y[s] and y[e + 1] < y[s]]
        kept: list[int] = []
        for k in sorted(inner, key=lambda k: (-y[k], -k)):
            if all(abs(k - j) >= distance for j in kept):
                kept.append(k)
        out = []
        for k in kept:
            higher = np.flatnonzero(y > y[k])
            low, high = higher[higher < k], higher[higher > k]
            left, right = y[(low[-1] + 1 if len(low) else 0) : k + 1].min(), y[k : (high[0] if len(high) else len(y))].min()
            if (rise := y[k] - max(left, right)) >= least:
                out.append((*(pdf[c].iloc[0] for c in names), int(pdf.frame_idx.iloc[k]), y[k], rise))
        out = sorted(out, key=lambda r: -r[-2])[:top] if top else out
        return pd.DataFrame(sorted(out, key=lambda r: r[-3]), columns=[*names, "frame_idx", value, "prominence"])

    return frames.select(*names, "frame_idx", value).groupBy(*names).applyInPandas(pick, schema)

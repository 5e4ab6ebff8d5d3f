"""Deterministic signals and feature matrices with known answers, as native expressions over spark.range."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, AMPLITUDE = 16_000, 0.35


def _signal(spark: SparkSession, track: str, seconds: float, value: Column, rate: int) -> DataFrame:
    """value is a function of t (seconds)."""
    rows = spark.range(round(seconds * rate)).withColumn("t", F.col("id") / rate)
    return rows.select(F.lit(track).alias("track"), F.col("id").alias("sample_idx"), value.cast("float").alias("sample"))


def sine(spark: SparkSession, track: str, hz: float, seconds: float, rate: int = RATE) -> DataFrame:
    return _signal(spark, track, seconds, AMPLITUDE * F.sin(2 * pi * hz * F.col("t")), rate)


def chirp(spark: SparkSession, track: str, low: float, high: float, seconds: float, rate: int = RATE) -> DataFrame:
    t = F.col("t")
    return _signal(spark, track, seconds, AMPLITUDE * F.sin(2 * pi * (low * t + (high - low) / (2 * seconds) * t * t)), rate)


def vibrato(spark: SparkSession, track: str, hz: float, speed: float, cents: float, seconds: float, rate: int = RATE) -> DataFrame:
    """A tone whose pitch swings by so many cents."""
    swing = hz * (2 ** (cents / 1200) - 1)
    t = F.col("t")
    return _signal(spark, track, seconds, AMPLITUDE * F.sin(2 * pi * hz * t - swing / speed * F.cos(2 * pi * speed * t)), rate)


def scale(spark: SparkSession, track: str, steps: int, divisions: int, root: float = 220.0, note_s: float = 0.25, rate: int = RATE) -> DataFrame:
    """Steps of an equal division of the octave, each from phase 0."""
    step = F.floor(F.col("t") / note_s)
    hz = root * F.pow(F.lit(2.0), step / divisions)
    return _signal(spark, track, steps * note_s, AMPLITUDE * F.sin(2 * pi * hz * (F.col("t") - step * note_s)), rate)


def regular_times(bpm: float, seconds: float, subdivision: int = 1) -> list[float]:
    gap = 60 / bpm / subdivision
    return [k * gap for k in range(int(seconds / gap) + 1) if k * gap < seconds]


def drift_times(start_bpm: float, end_bpm: float, seconds: float) -> list[float]:
    """Beats whose tempo goes evenly from one to the other."""
    times, t = [], 0.0
    while t < seconds:
        times.append(t)
        t += 60 / (start_bpm + (end_bpm - start_bpm) * t / seconds)
    return times


def clicks(spark: SparkSession, track: str, times: list[float], seconds: float, rate: int = RATE) -> DataFrame:
    """Decaying 1 kHz clicks of 30 ms at each time."""
    marks = F.array(*[F.lit(float(t)) for t in times])
    ago = F.col("t") - F.array_max(F.filter(marks, lambda m: m <= F.col("t")))
    tone = F.when(ago < 0.03, AMPLITUDE * F.exp(-ago * 120) * F.sin(2 * pi * 1000 * ago)).otherwise(0.0)
    return _signal(spark, track, seconds, tone, rate)


def glide(spark: SparkSession, track: str = "demo", hz: float = 220.0, cents: float = 18.0, speed: float = 5.2, seconds: float = 2.8, rate: int = RATE) -> DataFrame:
    """The browser demo tone."""
    return vibrato(spark, track, hz, speed, cents, seconds, rate)


def phases(spark: SparkSession, track: str = "phases", rate: int = RATE) -> DataFrame:
    """Six seconds of silence, tone, noise-like clicks, and tones that glide and jump."""
    t = F.col("t")
    tone = lambda hz, a=AMPLITUDE: a * F.sin(2 * pi * hz * t)
    noise = AMPLITUDE * (2 * (F.pmod(F.hash("id"), F.lit(10_000)) / 10_000) - 1)
    value = F.when(t < 0.5, 0.0).when(t < 1.5, tone(220.0)).when(t < 2.0, noise).when(t < 3.0, tone(330.0)).when(t < 4.0, AMPLITUDE * F.sin(2 * pi * (330 * t + 55 * (t - 3) * (t - 3)))).when(t < 5.0, tone(660.0)).otherwise(tone(110.0, AMPLITUDE / 4))
    return _signal(spark, track, 6.0, value, rate)


def chunks(samples: DataFrame, size: int = 65_536) -> DataFrame:
    """Sample rows to chunk rows."""
    rows = samples.groupBy("track", F.floor(F.col("sample_idx") / size).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "sample"))).alias("_s"))
    return rows.select("track", F.col("_s")[0]["sample_idx"].alias("start_sample"), F.transform("_s", lambda s: s["sample"]).alias("samples"))


#: A motif: (a, b, c, d) by place in 0..1.
def motif(p: Column, kind: str) -> Column:
    a = [F.sin(2 * pi * p), F.cos(2 * pi * p), F.sin(4 * pi * p), p]
    b = [F.cos(6 * pi * p), 1 - 2 * p, F.sin(10 * pi * p), F.cos(2 * pi * p) * p]
    return F.array(*(a if kind == "A" else b))


def motif_sequence(spark: SparkSession, track: str, layout: list[tuple[str, int]], frames: int = 32) -> DataFrame:
    """Features of motifs in order, each ("A" or "B", its number of frames; ("pad", n) is a quiet gap)."""
    out, at = None, 0
    for kind, n in layout:
        p = F.col("id") / F.lit(float(max(1, n - 1)))
        values = F.array(*[F.lit(0.01)] * 4) if kind == "pad" else motif(p, kind)
        part = spark.range(n).select(F.lit(track).alias("track"), (F.col("id") + at).alias("frame_idx"), values.alias("features"))
        out, at = (part if out is None else out.union(part)), at + n
    return out


def views(sequence: DataFrame) -> DataFrame:
    """mfcc (all four), chroma (three) and rhythm (two dimensions) of a feature sequence."""
    parts = {"mfcc": F.col("features"), "chroma": F.slice("features", 1, 3), "rhythm": F.slice("features", 2, 2)}
    out = None
    for name, f in parts.items():
        rows = sequence.select("track", F.lit(name).alias("view"), "frame_idx", f.alias("features"))
        out = rows if out is None else out.union(rows)
    return out

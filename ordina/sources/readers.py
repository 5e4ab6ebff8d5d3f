"""Scans: audio files, CSV/TSV/JSON/text tables, aligner output, track configurations."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.functions.scalar import finite

TRACK_KEYS = ("id", "source", "expected_sha256", "language")
CHUNK = 65_536
CHUNKS = "path string, rate int, channels int, channel int, start_sample long, samples array<float>"


def binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def verify(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks with the file they name, and whether digest (and size, if expected) agree; a missing file doesn't."""
    found = tracks.join(files.select(F.col("path").alias("_p"), "length", "sha256"), F.endswith(F.col("_p"), F.col("source")), "left")
    size = F.col("expected_size_bytes").isNull() | (F.col("length") == F.col("expected_size_bytes"))
    return found.withColumn("verified", F.coalesce((F.col("sha256") == F.col("expected_sha256")) & size, F.lit(False))).drop("_p")


def _samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and float samples (frames x channels) of PCM WAV bytes of 8 to 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    return rate, x.reshape(-1, channels)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = round(len(x) * target / rate)
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x).astype(np.float32) if len(x) else x


def decode(files: DataFrame, target: int | None = 16_000, mono: bool = True) -> DataFrame:
    """Chunk rows of PCM WAV files: path, rate, channels, channel (0), start_sample, samples; at the target rate, mono by the mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                rate, x = _samples(content)
                for k, y in enumerate([x.mean(axis=1)] if mono else x.T):
                    if target and target != rate:
                        y = resample(y, rate, target)
                    for a in range(0, len(y), CHUNK):
                        yield pd.DataFrame({"path": [path], "rate": [target or rate], "channels": [x.shape[1]], "channel": [k], "start_sample": [a], "samples": [y[a : a + CHUNK]]})

    return files.select("path", "content").mapInPandas(run, CHUNKS)


def clip(chunks: DataFrame, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """The samples in [start_s, end_s) of chunk rows; either end may be open. start_sample keeps counting from the original start."""
    a = F.ceil(F.lit(start_s or 0.0) * F.col("rate")).cast("long")
    b = F.lit(1 << 62) if end_s is None else F.ceil(F.lit(end_s) * F.col("rate")).cast("long")
    first = F.greatest(F.col("start_sample"), a)
    last = F.least(F.col("start_sample") + F.size("samples"), b)
    return chunks.withColumns({"_a": first, "_b": last}).where("_b > _a").withColumn("samples", F.slice("samples", (F.col("_a") - F.col("start_sample") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))).withColumn("start_sample", F.col("_a")).drop("_a", "_b")


def deinterleave(chunks: DataFrame) -> DataFrame:
    """[L, R, L, R, ...] chunks to a row per channel."""
    n = F.floor(F.size("samples") / 2).cast("int")

    def side(k: int) -> Column:
        return F.struct(F.lit(k).alias("channel"), F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("samples", 2 * i - 1 + k)).alias("samples"))

    sides = F.explode(F.array(side(0), side(1)))
    keep = [c for c in chunks.columns if c not in ("samples", "channel", "start_sample")]
    return chunks.where(n > 0).select(*keep, F.floor(F.col("start_sample") / 2).alias("start_sample"), sides.alias("_s")).select(*keep, "start_sample", "_s.*")


def csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", required: tuple[str, ...] = ()) -> DataFrame:
    """A table with a header read as text and cast leniently: a number that can't be read, or isn't finite, is null. Missing required columns raise."""
    raw = spark.read.csv(path, header=True, sep=sep)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")

    def value(f: T.StructField) -> Column:
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType)
        c = F.col(f"`{f.name}`")
        return finite(c) if isinstance(f.dataType, T.DoubleType) else c.try_cast(f.dataType)

    return raw.select(*[value(f).alias(f.name) for f in schema])


def tsv(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    return csv(spark, path, schema, "\t", required)


def json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def text(spark: SparkSession, path: str) -> DataFrame:
    """path and stripped text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\s+|\\s+$", "").alias("text"))


def lyrics(frames: DataFrame, language: str | None = "eng", any_language: bool = True) -> DataFrame:
    """Per track the lyrics frame (track, language, position, text) of the language, else the first if any will do, else empty."""
    preferred = F.when(F.col("language") == language, 0).otherwise(1)
    rows = frames if any_language else frames.where(F.col("language") == language)
    best = rows.groupBy("track").agg(F.trim(F.min_by("text", F.struct(preferred, "position"))).alias("text"))
    return frames.select("track").distinct().join(best, "track", "left").withColumn("text", F.coalesce("text", F.lit("")))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Aligner output {"tiers": {name: {"entries": [[start, end, label], ...]}}}, keyed by file stem: segment_id, kind (word, phone), start_s, end_s, label.

    A tier counts by what its name contains, in any case; entries of fewer than three items are skipped.
    """
    entries = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([T.StructField("tiers", T.MapType(T.StringType(), T.StructType([T.StructField("entries", entries)])))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(?:\\.[^.]*)?$", 1).alias("segment_id"), F.explode("tiers").alias("tier", "t"))
    kind = F.when(F.lower("tier").contains("word"), "word").when(F.lower("tier").contains("phone"), "phone")
    rows = raw.select("segment_id", kind.alias("kind"), F.explode("t.entries").alias("e")).where(F.col("kind").isNotNull() & (F.size("e") >= 3))
    return rows.select("segment_id", "kind", F.col("e")[0].try_cast("double").alias("start_s"), F.col("e")[1].try_cast("double").alias("end_s"), F.trim(F.col("e")[2]).alias("label"))


def tracks(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """Track rows from parsed configurations; the required keys must be there and ids distinct. Other keys stay as JSON in config."""
    import json as js

    rows = []
    for c in configs:
        if missing := [k for k in TRACK_KEYS if not c.get(k)]:
            raise ValueError(f"{c.get('id')}: missing {', '.join(missing)}")
        rows.append((*(str(c[k]) for k in TRACK_KEYS), c.get("expected_size_bytes"), js.dumps({k: v for k, v in c.items() if k not in TRACK_KEYS}, ensure_ascii=False)))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("track ids are not distinct")
    return spark.createDataFrame(rows, "id string, source string, expected_sha256 string, language string, expected_size_bytes long, config string")


def track(rows: DataFrame, id: str) -> DataFrame:
    """One track; an unknown id raises and names those there are."""
    found = rows.where(F.col("id") == id)
    if found.isEmpty():
        known = ", ".join(r[0] for r in rows.select("id").orderBy("id").limit(50).collect())
        raise KeyError(f"{id}; available: {known}")
    return found


def source_path(track_dir: Column, source: Column, mix: Column) -> Column:
    """The mix itself, or the vocals stem under the track's folder."""
    return F.when(source == "vocals", F.concat(track_dir, F.lit("/separation/vocals.wav"))).otherwise(mix)


def timeline_pitch(frames: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pitch rows for a timeline (t, f0, confidence rounded half to even; null confidence is 0; rows without f0 dropped) and each key's running duration."""
    t = finite(F.col("time_s"))
    rows = frames.where(finite(F.col("selected_f0_hz")).isNotNull() & t.isNotNull()).select(*key, F.bround(t, 3).alias("t"), F.bround(finite(F.col("selected_f0_hz")), 2).alias("f0"), F.bround(F.coalesce(finite(F.col("selected_confidence")), F.lit(0.0)), 3).alias("confidence"))
    return rows, frames.groupBy(*key).agg(F.coalesce(F.max(t), F.lit(0.0)).alias("duration_s"))


def timeline_spans(spans: DataFrame, key: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Segments or movements for a timeline: start and end to three digits, other columns by {column: (name, digits)}; numbers that can't be used are null."""
    ends = {"start_s": ("start_s", 3), "end_s": ("end_s", 3)}
    return spans.select(*key, *[F.bround(finite(F.col(c)), digits).alias(name) for c, (name, digits) in (ends | columns).items()])


#: What a container's probe says of it, as far as it is read.
PROBE = "streams array<struct<codec_type string, codec_name string, sample_rate string, channels int>>, format struct<format_name string, duration string, bit_rate string>"


def probe(json: Column) -> Column:
    """A container's probe output (JSON) as a struct: format, duration_s, bit_rate, and codec, sample_rate, channels of the first audio stream; what is missing is null."""
    found = F.from_json(json, PROBE)
    audio = F.get(F.filter(found["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    about = found["format"]
    return F.struct(
        about["format_name"].alias("format"), finite(about["duration"]).alias("duration_s"), about["bit_rate"].try_cast("long").alias("bit_rate"),
        audio["codec_name"].alias("codec"), audio["sample_rate"].try_cast("int").alias("sample_rate"), audio["channels"].alias("channels"))


def timeline_register(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Register candidates with their numeric deltas only, rounded."""
    return candidates.select(*key, F.bround("time_s", 3).alias("t"), F.transform_values(F.map_filter("deltas", lambda _, v: v.isNotNull()), lambda _, v: F.bround(v, 3)).alias("deltas"), "changed_features")

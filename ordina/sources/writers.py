"""Sinks: JSON, CSV, TSV, pivoted tables, arrays, WAV bytes, reports."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.functions.scalar import cents_to_nearest_semitone, hz_to_midi


def json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included, UTF-8 as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With header; null is an empty field."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="", emptyValue="")


def estimator_table(frames: DataFrame, confidence_name: str) -> DataFrame:
    """time_s, f0_hz, midi, cents_to_nearest_12tet and the confidence under the estimator's own name."""
    midi = hz_to_midi(F.col("f0_hz"))
    return frames.select("time_s", "f0_hz", midi.alias("midi"), cents_to_nearest_semitone(midi).alias("cents_to_nearest_12tet"), F.col("confidence").alias(confidence_name))


#: The columns of the consensus table in order.
CONSENSUS = ("time_s", "pyin_f0_hz", "crepe_f0_hz", "consensus_f0_hz", "selected_f0_hz", "selected_confidence", "selected_source", "disagreement_cents", "agreement", "pyin_confidence", "crepe_periodicity", "crepe_reliable")


def consensus_table(frames: DataFrame) -> DataFrame:
    return frames.select(*CONSENSUS)


def lag_profile_table(profile: DataFrame, key: list[str], step_s: float, views: list[str]) -> DataFrame:
    """Lags with one column per view, in order of name."""
    return profile.select(*key, "lag_frames", (F.col("lag_frames") * step_s).alias("lag_s"), "combined_similarity", "support", *[F.col("views")[v].alias(v) for v in sorted(views)])


def matrix_table(cells: DataFrame, key: list[str], size: int, value: str = "distance") -> DataFrame:
    """A labelled square matrix: one row per i, one column per j below size."""
    return cells.groupBy(*key, "i").pivot("j", list(range(size))).agg(F.first(value))


def alignment_table(words: DataFrame, phones: DataFrame, morae: DataFrame) -> DataFrame:
    """Three levels in one table, each with its own running index from 1. Inputs: segment_id, start_s, end_s, label, timing_method."""
    from pyspark.sql import Window

    out = None
    for level, rows in (("word", words), ("phone", phones), ("morae", morae)):
        w = Window.partitionBy("segment_id").orderBy("start_s", "end_s", "label")
        part = rows.select(F.lit(level).alias("level"), "segment_id", F.row_number().over(w).alias("unit_index"), "start_s", "end_s", "label", "timing_method")
        out = part if out is None else out.union(part)
    return out


def edit_table(rows: DataFrame, alignment: str, keep: list[str]) -> DataFrame:
    """One row per alignment step: op, ref, hyp."""
    return rows.select(*keep, F.posexplode(alignment).alias("position", "_r")).select(*keep, "position", "_r.*")


def long_map(cells: DataFrame, hop_s: float, rate: int, size: int) -> DataFrame:
    """Time-frequency cells as time_s, freq_hz, levels, dominance and overlap."""
    from pyspark.sql import Window

    from ordina.functions.scalar import overlap

    top = F.max(F.greatest("vocals_db", "instr_db")).over(Window.partitionBy(*[c for c in cells.columns if c not in ("frame_idx", "bin", "vocals_db", "instr_db")] or [F.lit(0)]))
    rows = cells.withColumn("_top", top)
    return rows.select((F.col("frame_idx") * hop_s).alias("time_s"), (F.col("bin") * rate / size).alias("freq_hz"), "vocals_db", F.col("instr_db").alias("instrumental_db"), (F.col("vocals_db") - F.col("instr_db")).alias("dominance_db"), overlap(F.col("vocals_db"), F.col("instr_db"), F.col("_top")).alias("overlap"))


def pcm16(samples: np.ndarray) -> bytes:
    """Floats clipped to -1..1, negative ones scaled by 32768 and others by 32767, little-endian."""
    x = np.clip(samples, -1, 1)
    return np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()


def wav_bytes(rate: int):
    """A function of stem columns (float arrays of equal meaning, 1 to 3 of them) to the bytes of a 16-bit mono WAV of their sum."""

    @F.pandas_udf("binary")
    def write(*stems: pd.Series) -> pd.Series:
        out = []
        for parts in zip(*stems, strict=True):
            n = min(len(p) for p in parts)
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(rate)
                f.writeframes(pcm16(sum(np.asarray(p[:n], float) for p in parts)))
            out.append(buffer.getvalue())
        return pd.Series(out)

    return write


def stem_sum(samples: DataFrame, key: list[str]) -> DataFrame:
    """Sample-wise sum over stems."""
    return samples.groupBy(*key, "sample_idx").agg(F.sum("sample").alias("sample"))


def compact_timeline(rows: DataFrame, key: list[str], columns: list[str], name: str, order: str) -> DataFrame:
    """Per key a JSON text of rows as arrays in order (values already rounded)."""
    row = F.struct(F.col(order).alias("_o"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    packed = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))
    return packed.select(*key, F.to_json(F.struct(name)).alias("json"))


def track_document(lists: dict[str, DataFrame], key: list[str], layout: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Per key one JSON text that holds each list by its name, rows as arrays; layout: {name: (order, columns)}. A key that a list lacks has an empty one there."""
    keys = None
    packed = {}
    for name, (order, columns) in layout.items():
        row = F.struct(F.col(order).alias("_o"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
        packed[name] = lists[name].groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias(name))
        keys = packed[name].select(*key) if keys is None else keys.union(packed[name].select(*key))
    out = keys.distinct()
    for name, rows in packed.items():
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<array<double>>)")))
    return out.select(*key, F.to_json(F.struct(*layout)).alias("json"))


def document(rows: list[dict] | dict, path: str, spark) -> None:
    """One pretty JSON document (a report or a status, small by nature) as a single text file in the folder `path`, letters as they are."""
    import json as js

    spark.createDataFrame([(js.dumps(rows, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def arrays(frames: DataFrame, path: str, key: list[str]) -> None:
    """Matrices, a row of theirs per row (key, frame_idx, array columns), as Parquet in order within each file."""
    frames.repartitionByRange(*key, "frame_idx").sortWithinPartitions(*key, "frame_idx").write.mode("overwrite").parquet(path)


def analysis_export(entries: DataFrame, key: list[str], about: DataFrame) -> DataFrame:
    """Per key the JSON text of what is known of it (`about`, one row per key) and its chronicle's entries (column entry gives their order)."""
    columns = [c for c in entries.columns if c not in key]
    listed = entries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("entry", *[c for c in columns if c != "entry"]))).alias("entries"))
    both = about.join(listed, key, "left").withColumn("entries", F.coalesce("entries", F.array()))
    return both.select(*key, F.to_json(F.struct(*[c for c in about.columns if c not in key], "entries")).alias("json"))


def number(value: Column, digits: int = 4) -> Column:
    """A number for people; a dash for null."""
    return F.coalesce(F.format_number(value, digits), F.lit("—"))


def comparison_report(track: str, deltas: DataFrame, models: DataFrame) -> str:
    """Markdown of metric deltas (metric, a, b, delta) and tuning models; both are small by nature."""
    lines = [f"# {track}: mix and vocals", "", "| metric | mix | vocals | difference |", "| --- | --- | --- | --- |"]
    for r in deltas.orderBy("metric").select("metric", *[number(F.col(c)).alias(c) for c in ("a", "b", "delta")]).collect():
        lines.append(f"| {r['metric']} | {r['a']} | {r['b']} | {r['delta']} |")
    lines += ["", "| EDO | mix RMSE | vocals RMSE | difference |", "| --- | --- | --- | --- |"]
    v = "weighted_rmse_cents"
    for r in models.orderBy("edo").select("edo", *[number(F.col(f"{p}_{v}")).alias(p) for p in ("mix", "vocals", "delta")]).collect():
        lines.append(f"| {r['edo']} | {r['mix']} | {r['vocals']} | {r['delta']} |")
    return "\n".join(lines) + "\n"

"""Selections, contexts, mixes and small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import clamp, hz_to_midi
from ordina.operators.matching import nearest_within
from ordina.operators.series import Key


def normalized(start: Column, end: Column, duration: Column, least: float = 0.05) -> tuple[Column, Column]:
    """A selection in order, within [0, duration], at least `least` long where the duration allows."""
    a, b = clamp(F.least(start, end), 0.0, duration), clamp(F.greatest(start, end), 0.0, duration)
    b = F.greatest(b, F.least(duration, a + least))
    return F.greatest(F.lit(0.0), F.least(a, b - least)), b


def context(rows: DataFrame, key: Key, order: str, chosen: Column, radius: int = 2) -> DataFrame:
    """Rows within radius places of a chosen one, with their distance to it (the smallest, 0 for the chosen)."""
    w = Window.partitionBy(*key).orderBy(order)
    at = rows.withColumns({"_i": F.row_number().over(w), "_c": F.coalesce(chosen, F.lit(False))})
    near = [F.when(F.lag("_c", k, False).over(w) | F.lead("_c", k, False).over(w), k) for k in range(1, radius + 1)]
    return at.withColumn("distance", F.coalesce(F.when(F.col("_c"), 0), *near)).where("distance is not null").drop("_i", "_c")


def window_of(rows: DataFrame, key: Key, order: str, first: int, span: int, step: int = 1) -> DataFrame:
    """Rows first, first + step, ... below first + span (places from 0 in each key)."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    at = rows.withColumn("_i", place)
    return at.where((F.col("_i") >= first) & (F.col("_i") < first + span) & (F.pmod(F.col("_i") - first, F.lit(step)) == 0)).drop("_i")


def downmix(samples: DataFrame, key: Key) -> DataFrame:
    """Mean over the channels of each sample."""
    return samples.groupBy(*key, "sample_idx").agg(F.avg("sample").alias("sample"))


def resampled(samples: DataFrame, key: Key, rate: int, target: int) -> DataFrame:
    """Linear interpolation of (sample_idx, sample) to another rate; each target sample joins its two neighbours by index."""
    n = samples.groupBy(*key).agg((F.max("sample_idx") + 1).alias("_n"))
    total = F.floor(F.col("_n") * target / rate + 0.5).cast("long")
    places = n.where(total > 0).select(*key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("_k")).withColumn("_p", F.col("_k") * rate / target)
    places = places.withColumns({"_a": F.least(F.floor("_p"), F.col("_n") - 1), "_b": F.least(F.floor("_p") + 1, F.col("_n") - 1)})
    a, b = (samples.select(*key, F.col("sample_idx").alias(i), F.col("sample").alias(x)) for i, x in (("_a", "_x"), ("_b", "_y")))
    both = places.join(a, [*key, "_a"]).join(b, [*key, "_b"])
    return both.select(*key, F.col("_k").alias("sample_idx"), (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_p") - F.floor("_p"))).alias("sample"))


def reconstruction(original: DataFrame, first: DataFrame, second: DataFrame, key: Key) -> DataFrame:
    """Sum of two stems and what is left of the original, over the samples all three have."""
    by = [*key, "sample_idx"]
    rows = original.select(*by, F.col("sample").alias("_o")).join(first.select(*by, F.col("sample").alias("_a")), by).join(second.select(*by, F.col("sample").alias("_b")), by)
    return rows.select(*by, (F.col("_a") + F.col("_b")).alias("sum"), (F.col("_o") - (F.col("_a") + F.col("_b"))).alias("residual"))


def labelled(boundaries: DataFrame, sections: DataFrame, key: Key, within: float = 0.02) -> DataFrame:
    """Boundaries (t) with the label of the section that starts within so many seconds."""
    return nearest_within(boundaries, sections.select(*key, F.col("start_s").alias("_start"), "label"), key, "t", "_start", within, ["label"]).drop("_start", "distance")


def merged_levels(level1: DataFrame, level2: DataFrame, key: Key) -> DataFrame:
    """Timelines of both levels by key; a key without a second level keeps nulls."""
    return level1.join(level2, list(key), "left")


def voicing(frames: DataFrame, key: Key) -> DataFrame:
    """Share of frames with a pitch, and the median absolute distance of pitches from the nearest semitone in cents."""
    midi = hz_to_midi(F.col("f0_hz"))
    return frames.groupBy(*key).agg(F.avg(F.coalesce(F.col("f0_hz") > 0, F.lit(False)).cast("int")).alias("voiced_fraction"), F.percentile(100 * F.abs(midi - F.rint(midi)), F.lit(0.5)).alias("median_abs_cents"))


def median_or(value: str, empty: float | None) -> Column:
    """Median of a group by linear interpolation; `empty` for none (zero, or null for not-a-number)."""
    m = F.percentile(value, F.lit(0.5))
    return m if empty is None else F.coalesce(m, F.lit(empty))


def template_similarity(features: DataFrame, key: Key, anchor: int, length: int) -> DataFrame:
    """Mean cosine of the template (length frames from anchor) with each shift that fits whole."""
    from ordina.operators.structure import dot, unit

    rows = unit(features)
    template = rows.where(F.col("frame_idx").between(anchor, anchor + length - 1)).select(*key, (F.col("frame_idx") - anchor).alias("_k"), F.col("features").alias("_t"))
    shifts = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")))).withColumn("start", F.col("frame_idx") - F.col("_k"))
    each = shifts.join(template, [*key, "_k"]).groupBy(*key, "start").agg(F.avg(dot(F.col("_t"), F.col("features"))).alias("similarity"), F.count("*").alias("_n"))
    return each.where(F.col("_n") == length).drop("_n")

"""Boundaries and labels out of per-frame section logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import libm_sigmoid, softmax
from ordina.operators.series import Key, islands

#: Section labels in class order.
LABELS = ("start", "end", "intro", "outro", "break", "bridge", "inst", "solo", "verse", "chorus")


def local_maxima_filter(frames: DataFrame, key: Key, value: str, size: int = 97) -> DataFrame:
    """value where it is the largest within size // 2 frames (ties stay), else 0."""
    if size % 2 != 1:
        raise ValueError("size must be odd")
    w = Window.partitionBy(*key).orderBy("frame_idx").rowsBetween(-(size // 2), size // 2)
    return frames.withColumn(value, F.when(F.max(value).over(w) <= F.col(value), F.col(value)).otherwise(0.0))


def peak_strength(frames: DataFrame, key: Key, value: str, past: int = 1200, future: int = 1200) -> DataFrame:
    """Positive values that are the largest of their window, less the mean of both sides (frames beyond the ends count as 0); else 0."""
    if (past + future) % 2:
        raise ValueError("past + future must be even")
    w = Window.partitionBy(*key).orderBy("frame_idx")
    before = F.coalesce(F.sum(value).over(w.rowsBetween(-past, -1)), F.lit(0.0)) / max(1, past) if past else F.lit(0.0)
    after = F.coalesce(F.sum(value).over(w.rowsBetween(1, future)), F.lit(0.0)) / max(1, future) if future else F.lit(0.0)
    top = F.max(value).over(w.rowsBetween(-past, future)) <= F.col(value)
    return frames.withColumn("strength", F.when((F.col(value) > 0) & top, F.col(value) - (before + after) * 0.5).otherwise(0.0))


def section_boundaries(frames: DataFrame, key: Key, size: int = 97, past: int = 1200, future: int = 1200) -> DataFrame:
    """(key, frame_idx) of frames whose section logit peaks."""
    rows = frames.select(*key, "frame_idx", libm_sigmoid(F.col("section_logit")).alias("p"))  # where nearly equal ones tie, the last digit decides
    return peak_strength(local_maxima_filter(rows, key, "p", size), key, "p", past, future).where("strength > 0").select(*key, "frame_idx", "strength")


def boundary_times(boundaries: DataFrame, totals: DataFrame, key: Key, hop: int = 441, rate: int = 44100) -> DataFrame:
    """Times of the boundaries with 0 and the duration added. totals: frames per key."""
    t = boundaries.select(*key, (F.col("frame_idx") * hop / rate).alias("t"))
    ends = totals.select(*key, F.explode(F.array(F.lit(0.0), F.col("frames") * hop / rate)).alias("t"))
    return t.union(ends).distinct()


def label_sections(frames: DataFrame, boundaries: DataFrame, key: Key, hop: int = 441, rate: int = 44100, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Sections between boundaries (beyond frame 0) with the label of the greatest summed softmax; ties: the first class.

    frames: frame_idx, function_logits (array in class order).
    """
    cuts = boundaries.where("frame_idx > 0").select(*key, "frame_idx", F.lit(True).alias("_cut"))
    rows = frames.join(cuts, [*key, "frame_idx"], "left")
    rows = islands(rows, key, ["frame_idx"], F.coalesce(F.col("_cut"), F.lit(False)), "section")
    each = rows.select(*key, "section", "frame_idx", F.posexplode(softmax(F.col("function_logits"))).alias("class", "p"))
    sums = each.groupBy(*key, "section", "class").agg(F.sum("p").alias("p"), F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    best = sums.groupBy(*key, "section").agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("label_index"), F.min("a").alias("_a"), F.max("b").alias("_b"))
    label = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("label_index") + 1)
    return best.select(*key, "section", (F.col("_a") * hop / rate).alias("start_s"), ((F.col("_b") + 1) * hop / rate).alias("end_s"), label.alias("label"), "label_index")


def pad_frames(frames: DataFrame, totals: DataFrame, key: Key, width: int, low: int = 10_240, high: int = 66_000) -> DataFrame:
    """frames (frame_idx, bands) with rows of zeros up to low frames, cut at high."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    missing = totals.where(F.col("frames") < low).select(*key, F.explode(F.sequence(F.col("frames").cast("long"), F.lit(low - 1).cast("long"))).alias("frame_idx"))
    return frames.where(F.col("frame_idx") < high).select(*key, "frame_idx", "bands").union(missing.select(*key, "frame_idx", zero))

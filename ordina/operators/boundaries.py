"""Change points and the consensus of boundaries from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import clamp
from ordina.operators.series import Key, clusters, robust_threshold, suppress

KINDS = ("mix", "stem", "repetition", "section")


def mix_change(frames: DataFrame, key: Key) -> DataFrame:
    """(t, score): |change of db| / 9 + 5 |change of zcr| of neighbouring frames."""
    w = Window.partitionBy(*key).orderBy("t")
    rows = frames.withColumns({"_db": F.lag("db").over(w), "_z": F.lag("zcr").over(w)}).where("_db is not null")
    return rows.select(*key, "t", (F.abs(F.col("db") - F.col("_db")) / 9 + F.abs(F.col("zcr") - F.col("_z")) * 5).alias("score"))


def stem_change(frames: DataFrame, key: Key) -> DataFrame:
    """(t, score): 1.35 times the summed change of the shares (array) + |change of db| / 13."""
    w = Window.partitionBy(*key).orderBy("t")
    rows = frames.withColumns({"_db": F.lag("db").over(w), "_s": F.lag("shares").over(w)}).where("_db is not null")
    moved = F.aggregate(F.zip_with("shares", "_s", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return rows.select(*key, "t", (moved * 1.35 + F.abs(F.col("db") - F.col("_db")) / 13).alias("score"))


def stem_shares(energy: DataFrame, key: Key) -> DataFrame:
    """From (t, stem, energy) each frame's shares of energy in order of stem name (0 in silence) and its level."""
    frames = energy.groupBy(*key, "t").agg(F.sum("energy").alias("_total"), F.array_sort(F.collect_list(F.struct("stem", "energy"))).alias("_e"))
    share = F.transform("_e", lambda e: F.when(F.col("_total") > 1e-12, e["energy"] / F.col("_total")).otherwise(0.0))
    return frames.select(*key, "t", share.alias("shares"), (10 * F.log10(F.col("_total") + 1e-12)).alias("db"))


def change_points(scores: DataFrame, key: Key, duration: Column, source: str, floor: float, factor: float, default_mad: float, separation_s: float, top: int) -> DataFrame:
    """Scores over a robust threshold, 3 s from both ends, apart from better ones, at most top, in order of time."""
    limit = robust_threshold(scores, key, "score", floor, factor, default_mad)
    rows = scores.join(limit, list(key)).where((F.col("score") >= F.col("threshold")) & (F.col("t") >= 3) & (F.col("t") <= duration - 3))
    chosen = suppress(rows, key, "score", "t", separation_s, [], top)
    most = F.greatest(F.lit(0.001), F.max("score").over(Window.partitionBy(*key)))
    c = clamp(F.col("score") / most, 0.25, 1.0)
    return chosen.select(*key, "t", "score", c.alias("confidence"), F.lit(source).alias("source"))


def mix_change_points(frames: DataFrame, key: Key, duration: Column) -> DataFrame:
    return change_points(mix_change(frames, key), key, duration, "mix", 0.38, 2.4, 0.05, 5.5, 11)


def stem_change_points(frames: DataFrame, key: Key, duration: Column) -> DataFrame:
    return change_points(stem_change(frames, key), key, duration, "stem", 0.22, 2.25, 0.03, 4.5, 14)


def boundary_union(**streams: DataFrame) -> DataFrame:
    """Boundary streams in one, each tagged by its kind."""
    out = None
    for kind, rows in streams.items():
        tagged = rows.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def consensus_boundaries(events: DataFrame, key: Key, duration: Column, tolerance_s: float = 1.5) -> DataFrame:
    """Chains of events (t, confidence, kind) at most tolerance_s apart: weighted time, greatest confidence of each kind, and joint confidence."""
    chained = clusters(events, key, "t", tolerance_s)
    w = F.greatest(F.lit(0.1), F.col("confidence"))
    best = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("confidence"))), F.lit(0.0)).alias(k) for k in KINDS]
    rows = chained.groupBy(*key, "cluster").agg((F.sum(F.col("t") * w) / F.sum(w)).alias("t"), *best)
    active = [F.when(F.col(k) > 0, F.col(k)) for k in KINDS]
    n = sum((F.when(a.isNotNull(), 1).otherwise(0) for a in active), F.lit(0))
    mean = F.coalesce(sum((F.coalesce(a, F.lit(0.0)) for a in active), F.lit(0.0)) / F.nullif(n, F.lit(0)), F.lit(0.0))
    more = F.greatest(F.lit(0), n - 1)
    rows = rows.withColumn("confidence", clamp(mean * (0.58 + 0.14 * more) + 0.08 * more, 0.18, 1.0))
    return rows.where((F.col("t") >= 3) & (F.col("t") <= duration - 3)).drop("cluster")


def repetition_boundaries(raw: DataFrame, key: Key, tolerance_s: float = 1.2) -> DataFrame:
    """Chains at most tolerance_s apart: time weighted by confidence (0.05 at least), greatest confidence."""
    w = F.greatest(F.lit(0.05), F.col("confidence"))
    rows = clusters(raw, key, "t", tolerance_s)
    return rows.groupBy(*key, "cluster").agg((F.sum(F.col("t") * w) / F.sum(w)).alias("t"), F.max("confidence").alias("confidence")).drop("cluster")


def reviewed_or_automatic(reviewed: DataFrame, automatic: DataFrame, key: Key, end: Column, top: int = 2) -> DataFrame:
    """Reviewed boundaries inside (0, end); a series without any gets its best automatic ones."""
    inside = reviewed.where((F.col("t") > 0) & (F.col("t") < end)).select(*key, "t")
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), "t")
    best = automatic.join(inside, list(key), "left_anti").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    return inside.union(best.select(*key, "t"))


def sections(boundaries: DataFrame, key: Key, duration: Column) -> DataFrame:
    """Half-open sections between 0, the boundaries and the end; a first one below 24 s is the opening, a last one below 28 s the ending."""
    edges = boundaries.where((F.col("t") > 0) & (F.col("t") < duration)).withColumn("_end", duration)
    edges = edges.select(*key, "t", "_end").union(edges.select(*key, F.lit(0.0), "_end").distinct())
    w = Window.partitionBy(*key).orderBy("t")
    rows = edges.select(*key, F.col("t").alias("start_s"), F.coalesce(F.lead("t").over(w), F.col("_end")).alias("end_s"), F.row_number().over(w).alias("section"), F.count("*").over(Window.partitionBy(*key)).alias("_n"))
    size = F.col("end_s") - F.col("start_s")
    label = F.when((F.col("section") == 1) & (size < 24), "Opening").when((F.col("section") == F.col("_n")) & (size < 28), "Ending").otherwise(F.concat(F.lit("Section "), F.col("section").cast("string")))
    return rows.withColumn("label", label).drop("_n")


def evidence_mode(consensus: DataFrame, mix: DataFrame, chosen: DataFrame | None, key: Key) -> DataFrame:
    """Per key the chosen mode's boundaries, else consensus, else mix."""
    out = None
    for rows in (chosen, consensus, mix):
        if rows is not None:
            rows = rows.select(*key, "t", "confidence")
            out = rows if out is None else out.union(rows.join(out.select(*key).distinct(), list(key), "left_anti"))
    return out


def novelty(frames: DataFrame, key: Key, values: str | Sequence[str], smooth: int, lag: int, after: int) -> DataFrame:
    """MAD-normalised values, moving averages of `smooth` rows (zeros beyond the ends), length of their change over `lag` rows, smoothed again."""
    values = [values] if isinstance(values, str) else list(values)
    middle = frames.groupBy(*key).agg(*[F.percentile(v, F.lit(0.5)).alias(f"_m_{v}") for v in values])
    rows = frames.join(middle, list(key))
    spread = rows.groupBy(*key).agg(*[F.percentile(F.abs(F.col(v) - F.col(f"_m_{v}")), F.lit(0.5)).alias(f"_mad_{v}") for v in values])
    rows = rows.join(spread, list(key)).withColumns({f"_x_{v}": (F.col(v) - F.col(f"_m_{v}")) / (F.col(f"_mad_{v}") + 1e-9) for v in values})
    w = Window.partitionBy(*key).orderBy("frame_idx")

    def average(column: str, n: int) -> Column:
        return F.sum(column).over(w.rowsBetween(-(n // 2), (n - 1) // 2)) / n

    rows = rows.withColumns({f"_a_{v}": average(f"_x_{v}", smooth) for v in values})
    moved = [F.col(f"_a_{v}") - F.lag(f"_a_{v}", lag).over(w) for v in values]
    rows = rows.withColumn("_d", F.coalesce(F.sqrt(sum((m * m for m in moved[1:]), moved[0] * moved[0])), F.lit(0.0)))
    return rows.select(*key, "frame_idx", average("_d", after).alias("novelty"))


def cycle_gaps(starts: DataFrame, key: Key, time: str) -> DataFrame:
    """Median and mean distance of successive starts."""
    w = Window.partitionBy(*key).orderBy(time)
    gaps = starts.select(*key, (F.lead(time).over(w) - F.col(time)).alias("gap"))
    return gaps.groupBy(*key).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap_s"), F.avg("gap").alias("mean_gap_s"), F.count("gap").alias("gaps"))

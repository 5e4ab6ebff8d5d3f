"""Fusion of two pitch estimators, stable segments, tuning models and movements."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import cents_to_nearest_semitone, finite, hz_to_cents, hz_to_midi, libm_cents_between, positive, wrap_residual
from ordina.operators.series import gap_islands, haloed, islands, Key

ESTIMATES = ("time_s", "pyin_hz", "crepe_hz", "pyin_confidence", "crepe_periodicity")


def join_estimators(pyin: DataFrame, crepe: DataFrame, key: Key) -> DataFrame:
    """Two estimators frame by frame; frames of one alone are dropped."""
    return pyin.join(crepe, [*key, "frame_idx"])


def consensus(frames: DataFrame, *, min_periodicity: float = 0.21, fallback_confidence: float = 0.80, strong_cents: float = 25.0, weak_cents: float = 50.0) -> DataFrame:
    """Adds per frame: usable estimates, their agreement, the consensus and the selected pitch with confidence and source.

    Agreement of two usable estimates needs a reliable second one (periodicity); consensus is their geometric mean. Without
    consensus the first is selected if confident, else the second if reliable.
    """
    p, c = positive(F.col("pyin_hz")), positive(F.col("crepe_hz"))
    out = frames.withColumns({"pyin_f0_hz": p, "crepe_f0_hz": c, "pyin_confidence": finite(F.col("pyin_confidence")), "crepe_periodicity": finite(F.col("crepe_periodicity"))})
    p, c = F.col("pyin_f0_hz"), F.col("crepe_f0_hz")
    out = out.withColumn("crepe_reliable", c.isNotNull() & F.coalesce(F.col("crepe_periodicity") >= min_periodicity, F.lit(False)))
    out = out.withColumn("disagreement_cents", F.abs(libm_cents_between(p, c)))
    d, reliable = F.col("disagreement_cents"), F.col("crepe_reliable")
    both = F.when(~reliable, "low-confidence-crepe").when(d <= strong_cents, "strong").when(d <= weak_cents, "weak").otherwise("disagreement")
    alone = F.when(p.isNotNull(), "pyin-only").when(c.isNotNull() & reliable, "crepe-only").when(c.isNotNull(), "crepe-only-low-confidence").otherwise("none")
    out = out.withColumn("agreement", F.when(p.isNotNull() & c.isNotNull(), both).otherwise(alone))
    out = out.withColumn("consensus_f0_hz", F.when(F.col("agreement").isin("strong", "weak"), F.sqrt(p * c)))
    source = F.when(F.col("consensus_f0_hz").isNotNull(), "consensus").when(p.isNotNull() & (F.col("pyin_confidence") >= fallback_confidence), "pyin-fallback").when(reliable, "crepe-only").otherwise("none")
    out = out.withColumn("selected_source", source)
    s = F.col("selected_source")
    return out.withColumns({
        "selected_f0_hz": F.when(s == "consensus", F.col("consensus_f0_hz")).when(s == "pyin-fallback", p).when(s == "crepe-only", c),
        "selected_confidence": F.when(s == "consensus", F.least("pyin_confidence", "crepe_periodicity")).when(s == "pyin-fallback", F.col("pyin_confidence")).when(s == "crepe-only", F.col("crepe_periodicity")),
    })


def _counts(df: DataFrame, key: Key, category: str, name: str) -> DataFrame:
    pairs = df.groupBy(*key, category).agg(F.count("*").alias("n"))
    return pairs.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias(name))


def consensus_summary(frames: DataFrame, key: Key) -> DataFrame:
    """Per key: frames, coverage, agreement fractions, and counts per agreement and source as sorted maps."""
    both = F.col("disagreement_cents").isNotNull()
    out = frames.groupBy(*key).agg(
        F.count("*").alias("frames"),
        F.count("consensus_f0_hz").alias("consensus_frames"),
        F.count("selected_f0_hz").alias("selected_frames"),
        F.count_if(both).alias("both_estimator_frames"),
        F.count_if(both & F.col("crepe_reliable")).alias("reliable_both_estimator_frames"),
        *[F.coalesce(F.count_if(F.col("disagreement_cents") <= c) / F.nullif(F.count_if(both), F.lit(0)), F.lit(0.0)).alias(f"raw_within_{c}c_fraction_of_both") for c in (25, 50)],
    )
    out = out.withColumns({"consensus_coverage": F.col("consensus_frames") / F.col("frames"), "selected_coverage": F.col("selected_frames") / F.col("frames")})
    return out.join(_counts(frames, key, "agreement", "agreement_counts"), list(key)).join(_counts(frames, key, "selected_source", "selected_source_counts"), list(key))


def quantiles(df: DataFrame, key: Key, value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of the finite values; null where there are none."""
    q = F.percentile(finite(F.col(value)), F.array(*[F.lit(p) for p in points.values()]))
    return df.groupBy(*key).agg(F.count(finite(F.col(value))).alias("count"), q.alias("_q")).select(*key, "count", *[F.col("_q")[k].alias(name) for k, name in enumerate(points)])


def quantile_summary(df: DataFrame, key: Key, value: str) -> DataFrame:
    return quantiles(df, key, value, {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "max": 1.0})


def finite_summary(df: DataFrame, key: Key, value: str) -> DataFrame:
    return quantiles(df, key, value, {"min": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "max": 1.0})


def local_linear(frames: DataFrame, key: Key, time: str, value: str, window_s: float = 0.5, least: int = 5, piece_s: float = 60.0) -> DataFrame:
    """Slope and RMS residual of a line through the non-null values within window_s / 2 of each row; null with fewer than least.

    Rows without a value get both as well. Series are split in pieces with overlap.
    """
    half = window_s / 2
    parts = haloed(frames, time, piece_s, half * 1.01)
    frame = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in (*key, 'piece'))} ORDER BY `{time}` RANGE BETWEEN {half!r}D PRECEDING AND {half!r}D FOLLOWING)"
    n = F.expr(f"count(`{value}`) {frame}")
    xx, xy, yy = (F.expr(f"{f}(`{value}`, `{time}`) {frame}") for f in ("regr_sxx", "regr_sxy", "regr_syy"))
    out = parts.withColumns({"_n": n, "_xx": xx, "_xy": xy, "_yy": yy}).where("own")
    slope = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    rest = F.greatest(F.lit(0.0), F.col("_yy") - slope * F.col("_xy"))
    enough = F.col("_n") >= least
    return out.withColumns({"slope": F.when(enough, slope), "residual_std": F.when(enough, F.sqrt(rest / F.col("_n")))}).drop("_n", "_xx", "_xy", "_yy", "piece", "own")


def median_step(frames: DataFrame, key: Key, time: str) -> DataFrame:
    """Median distance of neighbouring rows per key, 0 for a single row."""
    w = Window.partitionBy(*key).orderBy(time)
    steps = frames.select(*key, (F.col(time) - F.lag(time).over(w)).alias("_d"))
    return steps.groupBy(*key).agg(F.coalesce(F.percentile("_d", F.lit(0.5)), F.lit(0.0)).alias("step"))


def stable_candidates(frames: DataFrame, key: Key, *, window_s: float = 0.5, max_slope: float = 100.0, max_std: float = 40.0, min_confidence: float = 0.5) -> DataFrame:
    """Adds cents, slope, residual_std and candidate to rows of time_s, f0_hz, confidence."""
    rows = frames.withColumns({"f0_hz": positive(F.col("f0_hz")), "confidence": finite(F.col("confidence"))})
    rows = local_linear(rows.withColumn("cents", hz_to_cents(F.col("f0_hz"))), key, "time_s", "cents", window_s)
    good = F.col("cents").isNotNull() & (F.col("confidence") >= min_confidence) & (F.abs("slope") <= max_slope) & (F.col("residual_std") <= max_std)
    return rows.withColumn("candidate", F.coalesce(good, F.lit(False)))


def stable_segments(frames: DataFrame, key: Key, *, window_s: float = 0.5, max_slope: float = 100.0, max_std: float = 40.0, min_duration_s: float = 0.15, min_confidence: float = 0.5, max_gap_s: float = 0.04, max_drift_cents: float = 50.0) -> DataFrame:
    """Runs of candidate frames (time_s, f0_hz, confidence, evidence) long and level enough, with their statistics.

    A run breaks where candidates are further apart than the series' median step and max_gap_s.
    """
    rows = stable_candidates(frames, key, window_s=window_s, max_slope=max_slope, max_std=max_std, min_confidence=min_confidence)
    rows = rows.join(median_step(frames, key, "time_s"), list(key)).where("candidate")
    runs = gap_islands(rows, key, "time_s", F.col("step") + max_gap_s + 1e-12)
    by = [*key, "island"]
    runs = runs.join(runs.groupBy(*by).agg(F.percentile("cents", F.lit(0.5)).alias("_middle")), by)
    kinds = runs.groupBy(*by, "evidence").agg(F.count("*").alias("_n"), F.min("time_s").alias("_t"))
    major = kinds.groupBy(*by).agg(F.max_by("evidence", F.struct("_n", -F.col("_t"))).alias("evidence"))
    centred = F.col("cents") - F.col("_middle")
    median = lambda c: F.percentile(c, F.lit(0.5))
    out = runs.groupBy(*by).agg(
        F.min("time_s").alias("start_s"), F.max("time_s").alias("_last"), F.first("step").alias("step"), F.count("*").cast("long").alias("frames"),
        F.regr_slope("cents", "time_s").alias("_slope"), median("f0_hz").alias("median_f0_hz"),
        (F.percentile(centred, F.lit(0.95)) - F.percentile(centred, F.lit(0.05))).alias("vibrato_extent_cents_p95_p05"),
        median("confidence").alias("median_confidence"), median(F.abs("slope")).alias("median_abs_slope_cents_per_s"), median("residual_std").alias("median_detrended_std_cents"),
        *[(F.count_if(F.col("evidence") == k) / F.count("*")).alias(f"{k.replace('-', '_')}_fraction") for k in ("consensus", "pyin-fallback", "crepe-only")],
    )
    out = out.withColumns({"end_s": F.col("_last") + F.col("step"), "duration_s": F.col("_last") - F.col("start_s") + F.col("step")})
    level = (F.col("frames") == 1) | F.coalesce(F.abs(F.col("_slope") * F.col("duration_s")) <= max_drift_cents, F.lit(True))
    out = out.where((F.col("duration_s") >= min_duration_s) & level)
    out = out.withColumn("median_midi", hz_to_midi(F.col("median_f0_hz"))).withColumn("cents_to_nearest_12tet", cents_to_nearest_semitone(F.col("median_midi")))
    return out.join(major, by).drop("island", "_last", "step", "_slope")


def stable_total(segments: DataFrame, key: Key) -> DataFrame:
    return segments.groupBy(*key).agg(F.count("*").alias("target_count"), F.sum("duration_s").alias("stable_duration_s"))


def weighted_median(df: DataFrame, key: Key, value: str, weight: str) -> DataFrame:
    """The first value (ascending) at which the running weight reaches half of the total."""
    w = Window.partitionBy(*key).orderBy(value)
    rows = df.withColumns({"_c": F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum(weight).over(Window.partitionBy(*key))})
    return rows.where(F.col("_c") >= F.col("_t") / 2).groupBy(*key).agg(F.min(value).alias("weighted_median"))


def tuning_targets(segments: DataFrame, key: Key) -> DataFrame:
    """Segments with positive finite frequency, duration and confidence (missing ones count as 1), with weight and absolute cents."""
    f = positive(F.col("median_f0_hz"))
    d, c = (positive(F.coalesce(F.col(k), F.lit(1.0))) for k in ("duration_s", "median_confidence"))
    return segments.select(*key, hz_to_cents(f).alias("cents"), (d * c).alias("weight")).where("cents is not null and weight is not null")


def tuning_models(segments: DataFrame, key: Key, divisions: Sequence[int] = (12, 19, 24, 31)) -> DataFrame:
    """Per key and equal division: the offset (weighted circular mean, or weighted median where that is degenerate) and weighted residuals."""
    targets = tuning_targets(segments, key)
    rows = targets.withColumn("edo", F.explode(F.array(*[F.lit(d) for d in divisions]))).withColumn("step_cents", 1200.0 / F.col("edo"))
    by = [*key, "edo", "step_cents"]
    angle = F.col("cents") * (2 * pi / F.col("step_cents"))
    mean = rows.groupBy(*by).agg((F.sum(F.col("weight") * F.sin(angle)) / F.sum("weight")).alias("_s"), (F.sum(F.col("weight") * F.cos(angle)) / F.sum("weight")).alias("_c"))
    fallback = weighted_median(rows.withColumn("_raw", wrap_residual(F.col("cents"), F.col("step_cents"))), by, "_raw", "weight")
    around = F.atan2("_s", "_c") * (F.col("step_cents") / (2 * pi))
    offset = mean.join(fallback, by).select(*by, F.when(F.hypot("_s", "_c") > 1e-12, around).otherwise(F.col("weighted_median")).alias("estimated_global_offset_cents"))
    rest = rows.join(offset, by).withColumn("_r", wrap_residual(F.col("cents") - F.col("estimated_global_offset_cents"), F.col("step_cents")))
    return rest.groupBy(*by, "estimated_global_offset_cents").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("_r") * F.col("_r")) / F.sum("weight")).alias("weighted_rmse_cents"),
        (F.sum(F.col("weight") * F.abs("_r")) / F.sum("weight")).alias("weighted_mae_cents"),
        F.count("*").alias("target_count"), F.sum("weight").alias("weighted_duration_confidence"),
    )


def tuning_ambiguity(models: DataFrame, key: Key) -> DataFrame:
    """Per key the division of least residual and the gap to the second; keys with one model are absent."""
    w = Window.partitionBy(*key).orderBy("weighted_rmse_cents", "edo")
    two = models.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    out = two.groupBy(*key).agg(F.min_by("edo", "_k").alias("lowest_residual_edo"), (F.max("weighted_rmse_cents") - F.min("weighted_rmse_cents")).alias("rmse_gap_to_second_cents"), F.count("*").alias("_n"))
    return out.where("_n = 2").drop("_n")


def compare_sources(mix: DataFrame, vocals: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer join; delta (vocals - mix) is null where either is missing."""
    a, b = mix.select(*on, F.col(value).alias(f"mix_{value}")), vocals.select(*on, F.col(value).alias(f"vocals_{value}"))
    return a.join(b, list(on), "full").withColumn(f"delta_{value}", F.col(f"vocals_{value}") - F.col(f"mix_{value}"))


def _fit(columns: dict[str, str]) -> list[Column]:
    """Aggregates of a line of cents over time_s."""
    n, xx, xy, yy = F.count("cents"), F.regr_sxx("cents", "time_s"), F.regr_sxy("cents", "time_s"), F.regr_syy("cents", "time_s")
    return [n.alias("_n"), xx.alias("_xx"), xy.alias("_xy"), yy.alias("_yy"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence")]


def _fitted(df: DataFrame, min_slope: float, min_change: float, min_r2: float, min_confidence: float) -> DataFrame:
    out = df.withColumn("slope_cents_per_s", F.col("_xy") / F.col("_xx")).withColumn("duration_s", F.col("end_s") - F.col("start_s"))
    out = out.withColumns({"total_change_cents": F.col("slope_cents_per_s") * F.col("duration_s"), "linear_fit_r2": F.when(F.col("_yy") > 1e-12, F.col("_xy") * F.col("_xy") / F.col("_xx") / F.col("_yy")).otherwise(0.0)})
    good = (F.col("_n") >= 5) & (F.abs("slope_cents_per_s") >= min_slope) & (F.abs("total_change_cents") >= min_change) & (F.col("linear_fit_r2") >= min_r2) & (F.col("median_confidence") >= min_confidence)
    return out.where(good)


def pitch_points(frames: DataFrame, key: Key, missing_confidence: float | None = None) -> DataFrame:
    """time_s, f0_hz, confidence of usable selected frames; a missing confidence stays null or gets a default."""
    c = finite(F.col("selected_confidence"))
    c = c if missing_confidence is None else F.coalesce(c, F.lit(missing_confidence))
    return frames.select(*key, finite(F.col("time_s")).alias("time_s"), positive(F.col("selected_f0_hz")).alias("f0_hz"), c.alias("confidence")).where("time_s is not null and f0_hz is not null")


def movements(frames: DataFrame, key: Key, *, window_s: float = 0.30, min_slope: float = 200.0, min_change: float = 60.0, min_r2: float = 0.80, min_confidence: float = 0.50, max_gap_s: float = 0.05) -> DataFrame:
    """Sustained monotonic movements of the selected pitch.

    From each frame a window runs to the first frame window_s or more later (that one included); windows without large gaps
    that a line fits are merged in order of time when they have one direction and meet, then fitted and tested again.
    """
    points = pitch_points(frames, key).withColumn("cents", hz_to_cents(F.col("f0_hz")))
    w = Window.partitionBy(*key).orderBy("time_s")
    points = points.withColumns({"_i": F.row_number().over(w), "_gap": F.coalesce(F.col("time_s") - F.lag("time_s").over(w), F.lit(0.0))})
    # the first frame at or after each window's end: in falling order, the last frame passed
    ends = points.select(*key, F.col("_i").alias("_from"), F.col("time_s").alias("_start"), (F.col("time_s") + window_s).alias("_t"), F.lit(None).cast("double").alias("_at"))
    ends = ends.unionByName(points.select(*key, F.lit(None).cast("int").alias("_from"), F.lit(None).cast("double").alias("_start"), F.col("time_s").alias("_t"), F.col("time_s").alias("_at")))
    passed = F.last("_at", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    starts = ends.withColumn("_end", passed).where("_from is not null and _end is not null").drop("_t", "_at")
    # windows cover their own second of time and the next: an equi join on it keeps the range join local
    bucket = max(1.0, 2 * window_s)
    starts = starts.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_start") / bucket), F.floor(F.col("_end") / bucket))))
    inside = starts.join(points.withColumn("_b", F.floor(F.col("time_s") / bucket)), [*key, "_b"]).where(F.col("time_s").between(F.col("_start"), F.col("_end")))
    inner_gap = F.max(F.when(F.col("_i") > F.col("_from"), F.col("_gap")))
    windows = inside.groupBy(*key, "_from").agg(*_fit({}), inner_gap.alias("_most")).where(F.col("_most") <= max_gap_s)
    windows = _fitted(windows, min_slope, min_change, min_r2, min_confidence).select(*key, "start_s", "end_s", F.when(F.col("slope_cents_per_s") > 0, 1).otherwise(-1).alias("direction"))
    order = Window.partitionBy(*key).orderBy("start_s")
    turned = islands(windows, key, ["start_s"], F.col("direction") != F.lag("direction").over(order), "_turn")
    reach = F.max("end_s").over(Window.partitionBy(*key, "_turn").orderBy("start_s").rowsBetween(Window.unboundedPreceding, -1))
    merged = islands(turned.withColumn("_reach", reach), [*key, "_turn"], ["start_s"], F.col("start_s") > F.col("_reach") + max_gap_s, "_part")
    merged = merged.groupBy(*key, "_turn", "_part").agg(F.min("start_s").alias("_start"), F.max("end_s").alias("_end"), F.first("direction").alias("direction"))
    merged = merged.withColumn("_b", F.explode(F.sequence(F.floor("_start"), F.floor("_end"))))
    again = merged.join(points.withColumn("_b", F.floor("time_s")), [*key, "_b"]).where(F.col("time_s").between(F.col("_start"), F.col("_end")))
    events = again.groupBy(*key, "_start", "direction").agg(*_fit({}))
    events = _fitted(events, min_slope, min_change, min_r2, min_confidence)
    return events.select(*key, "start_s", "end_s", "duration_s", F.when(F.col("direction") > 0, "ascending").otherwise("descending").alias("direction"), "slope_cents_per_s", "total_change_cents", "linear_fit_r2", "median_confidence")

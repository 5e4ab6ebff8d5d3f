"""Voice quality: register changes, modulation, activity, frame classes, signal and separation statistics."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import clamp, finite, hz_to_cents, libm_cents_between
from ordina.operators.series import fill_gaps, gap_islands, haloed, hysteresis, islands, Key, suppress

#: Least change of each feature between neighbouring segments.
LIMITS = {
    "f0_cents": 180.0, "praat_cpps_db": 3.0, "praat_hnr_cc_db": 3.0, "autocorrelation_hnr_db": 3.0, "spectral_tilt_db_per_octave": 2.0,
    "rms_dbfs": 4.0, "praat_f1_hz": 150.0, "praat_f2_hz": 250.0, "praat_f3_hz": 300.0, "vibrato_extent_cents": 50.0,
}
#: The segment column behind each feature that has another name.
FIELDS = {"autocorrelation_hnr_db": "median_autocorrelation_hnr_db", "spectral_tilt_db_per_octave": "median_spectral_tilt_db_per_octave", "rms_dbfs": "median_rms_dbfs", "vibrato_extent_cents": "vibrato_extent_cents_p95_p05"}
VOICE = ("praat_cpps_db", "praat_hnr_cc_db", "autocorrelation_hnr_db", "spectral_tilt_db_per_octave")


def register_candidates(segments: DataFrame, key: Key, max_gap_s: float = 1.0, limits: dict[str, float] | None = None) -> DataFrame:
    """Neighbouring stable segments with a jump of pitch and of two voice qualities or more; columns a table lacks count as null."""
    limit = LIMITS | (limits or {})
    w = Window.partitionBy(*key).orderBy("start_s")
    have = set(segments.columns)

    def pair(column: str) -> tuple[Column, Column]:
        x = finite(F.col(column)) if column in have else F.lit(None).cast("double")
        return F.lag(x).over(w), x

    rows = segments.withColumns({"_end": F.lag("end_s").over(w), "_before": F.lag(F.struct("start_s", "end_s", "median_f0_hz")).over(w)})
    deltas = {}
    for name in limit:
        a, b = pair("median_f0_hz" if name == "f0_cents" else FIELDS.get(name, name))
        deltas[f"_d_{name}"] = F.when((a > 0) & (b > 0), 1200 * F.log2(b / a)) if name == "f0_cents" else b - a
    rows = rows.withColumns(deltas).withColumn("gap_s", F.col("start_s") - F.col("_end")).where(F.col("gap_s").between(-1e-6, max_gap_s))
    changed = F.array_compact(F.array(*[F.when(F.abs(F.col(f"_d_{n}")) >= v, F.lit(n)) for n, v in limit.items()]))
    rows = rows.withColumn("changed_features", changed)
    voiced = F.size(F.array_intersect("changed_features", F.array(*[F.lit(v) for v in VOICE])))
    rows = rows.where(F.array_contains("changed_features", "f0_cents") & (voiced >= 2))
    pairs = F.create_map(*[x for n in limit for x in (F.lit(n), F.col(f"_d_{n}"))])
    return rows.select(*key, ((F.col("_end") + F.col("start_s")) / 2).alias("time_s"), "gap_s", "changed_features", F.size("changed_features").alias("changed_feature_count"), pairs.alias("deltas"), F.col("_before").alias("before"), F.struct("start_s", "end_s", "median_f0_hz").alias("after"), F.lit("register_transition_candidate").alias("interpretation"))


def browser_movements(frames: DataFrame, key: Key) -> DataFrame:
    """Lines through 9 rows, every third row: 7 confident points, 90 cents, r2 0.72; merged within 0.12 s by direction, the largest change wins.

    frames: idx, t, f0, confidence.
    """
    w = Window.partitionBy(*key).orderBy("idx").rowsBetween(0, 8)
    good = F.when((F.col("confidence") >= 0.55) & (F.col("f0") > 0), hz_to_cents(F.col("f0")))
    rows = frames.withColumn("_c", good)
    stats = {"_n": F.count("_c").over(w), "_xx": F.regr_sxx("_c", "t").over(w), "_xy": F.regr_sxy("_c", "t").over(w), "_yy": F.regr_syy("_c", "t").over(w), "start_s": F.min(F.when(F.col("_c").isNotNull(), F.col("t"))).over(w), "end_s": F.max(F.when(F.col("_c").isNotNull(), F.col("t"))).over(w), "_all": F.count("*").over(w)}
    rows = rows.withColumns(stats).where((F.pmod(F.col("idx"), F.lit(3)) == 0) & (F.col("_all") == 9) & (F.col("_n") >= 7) & (F.col("_xx") > 0))
    rows = rows.withColumn("slope", F.col("_xy") / F.col("_xx")).withColumns({"change": F.col("slope") * (F.col("end_s") - F.col("start_s")), "r2": F.when(F.col("_yy") > 0, F.col("_xy") * F.col("_xy") / F.col("_xx") / F.col("_yy")).otherwise(0.0)})
    rows = rows.where((F.abs("change") >= 90) & (F.col("r2") >= 0.72)).withColumn("direction", F.signum("change").cast("int"))
    order = Window.partitionBy(*key).orderBy("start_s")
    merged = islands(rows, key, ["start_s"], (F.col("direction") != F.lag("direction").over(order)) | (F.col("start_s") > F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 0.12))
    return merged.groupBy(*key, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("direction").alias("direction"), F.max_by("change", F.abs("change")).alias("change_cents"), F.max_by("r2", F.abs("change")).alias("r2")).drop("island")


def browser_register(frames: DataFrame, key: Key) -> DataFrame:
    """Rows where the medians of the four before and the four after (confident rows) jump 250 cents, and two of four features move.

    In order of time, a candidate within 0.35 s of the last one replaces it if its jump is larger, and is dropped otherwise.
    """
    order = Window.partitionBy(*key).orderBy("t")
    before, after = order.rowsBetween(-4, -1), order.rowsBetween(1, 4)

    def median(column: str, w) -> Column:
        return F.percentile(F.when(F.col("confidence") >= 0.5, finite(F.col(column))), F.lit(0.5)).over(w)

    limit = {"cpps": 1.5, "hnr": 3.0, "tilt": 1.5, "rms_db": 6.0}
    rows = frames.withColumns({f"_a_{c}": median(c, before) for c in ("f0", *limit)} | {f"_b_{c}": median(c, after) for c in ("f0", *limit)})
    rows = rows.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy(*key))}).where((F.col("_i") > 4) & (F.col("_i") <= F.col("_n") - 4))
    moved = F.array_compact(F.array(*[F.when(F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}")) >= v, F.lit(c)) for c, v in limit.items()]))
    rows = rows.withColumn("features", moved).where(F.size("features") >= 2)
    # a jump and its way back are equal but for the last digit, which decides
    rows = rows.withColumn("jump_cents", libm_cents_between(F.col("_b_f0"), F.col("_a_f0"))).where(F.abs("jump_cents") >= 250)
    found = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "jump_cents", "features"))).alias("_rows"))

    def step(done: Column, row: Column) -> Column:
        last = F.element_at(done, -1)
        new = (F.size(done) == 0) | (row["t"] - last["t"] >= 0.35)
        larger = F.abs(row["jump_cents"]) > F.abs(last["jump_cents"])
        return F.when(new, F.concat(done, F.array(row))).when(larger, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(row))).otherwise(done)

    return found.select(*key, F.explode(F.aggregate("_rows", F.slice("_rows", 1, 0), step)).alias("r")).select(*key, "r.*")


def modulation(points: DataFrame, key: Key, *, window_s: float = 0.8, min_confidence: float = 0.5, max_gap_s: float = 0.05, least: int = 12, piece_s: float = 30.0, rate: bool = True) -> DataFrame:
    """Around each point (time_s, f0_hz, confidence): extent p95 - p05 and deviation of the detrended cents of confident points within window_s / 2,
    and (with `rate`, by an Arrow function) rate_hz, the strongest rate of the residuals; nulls where there are too few points.

    Two passes over the window: the line, then the residuals; long series are split in pieces with overlap.
    """
    half = window_s / 2
    sure = points.where(F.col("confidence") >= min_confidence).withColumn("cents", hz_to_cents(F.col("f0_hz")))
    guests = haloed(sure, "time_s", piece_s, half * 1.01).select(*key, "piece", F.col("time_s").alias("_t"), "cents", "confidence")
    centres = points.select(*key, "time_s").withColumn("piece", F.floor(F.col("time_s") / piece_s))
    # within a piece, halves of a second as buckets keep the join local
    cell = half
    left = centres.withColumn("_b", F.explode(F.sequence(F.floor((F.col("time_s") - half) / cell), F.floor((F.col("time_s") + half) / cell))))
    near = left.join(guests.withColumn("_b", F.floor(F.col("_t") / cell)), [*key, "piece", "_b"]).where(F.col("_t").between(F.col("time_s") - half, F.col("time_s") + half))
    by = [*key, "time_s"]
    gap = F.col("_t") - F.lag("_t").over(Window.partitionBy(*by).orderBy("_t"))
    near = near.withColumn("_gap", F.coalesce(gap, F.lit(0.0)))
    line = near.groupBy(*by).agg(F.count("*").alias("_n"), F.max("_gap").alias("_most"), F.regr_slope("cents", "_t").alias("_m"), F.regr_intercept("cents", "_t").alias("_k"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"))
    line = line.where((F.col("_n") >= least) & (F.col("_most") <= max_gap_s))
    rest = near.join(line, by).withColumn("_r", F.col("cents") - (F.col("_m") * F.col("_t") + F.col("_k")))
    found = rest.groupBy(*by).agg((F.percentile("_r", F.lit(0.95)) - F.percentile("_r", F.lit(0.05))).alias("extent_cents_p95_p05"), F.stddev_pop("_r").alias("detrended_std_cents"), F.first("median_confidence").alias("median_confidence"), *([F.array_sort(F.collect_list(F.struct("_t", "_r"))).alias("_points")] if rate else []))
    if rate:
        from ordina.operators.dsp import modulation_rate

        found = found.withColumn("rate_hz", modulation_rate("_points._t", "_points._r")).drop("_points")
    return points.select(*key, "time_s").join(found, by, "left")


def vibrato_rate_grid(residuals: DataFrame, key: Key, low: float = 3.0, high: float = 9.0, step: float = 0.25, least: int = 14, min_amplitude: float = 2.0, min_std: float = 2.5) -> DataFrame:
    """The rate of a fixed grid with the largest amplitude of residuals (t, r); null if there are too few points or too little movement. Ties: the lower rate."""
    rates = F.explode(F.transform(F.sequence(F.lit(0), F.lit(round((high - low) / step))), lambda k: F.lit(low) + k * step))
    each = residuals.withColumn("rate", rates).withColumn("_w", 2 * pi * F.col("rate") * F.col("t"))
    sums = each.groupBy(*key, "rate").agg(F.count("*").alias("_n"), (2 * F.hypot(F.sum(F.col("r") * F.cos("_w")), F.sum(F.col("r") * F.sin("_w"))) / F.count("*")).alias("amplitude"), F.stddev_pop("r").alias("_s"))
    best = sums.groupBy(*key).agg(F.max_by(F.struct("rate", "amplitude", "_n", "_s"), F.struct("amplitude", -F.col("rate"))).alias("b"))
    good = (F.col("b._n") >= least) & (F.col("b.amplitude") >= min_amplitude) & (F.col("b._s") >= min_std)
    return best.select(*key, F.when(good, F.col("b.rate")).alias("rate_hz"), F.col("b.amplitude").alias("amplitude"))


def activity_threshold(frames: DataFrame, key: Key, value: str = "db", margin: float = 10.0, span: float = 28.0) -> DataFrame:
    """max(p20 + margin, p95 - span) per key."""
    q = F.percentile(value, F.array(F.lit(0.2), F.lit(0.95)))
    return frames.groupBy(*key).agg(q.alias("_q")).select(*key, F.greatest(F.col("_q")[0] + margin, F.col("_q")[1] - span).alias("threshold"))


def phrases(frames: DataFrame, key: Key, *, frame_s: float = 0.10, hop_s: float = 0.05, fill_s: float = 0.22, min_phrase_s: float = 0.35, min_gap_s: float = 0.38) -> DataFrame:
    """Phrases of activity from (t, db, duration): hysteresis around the threshold, inner gaps filled, short runs dropped, near ones merged."""
    rows = frames.join(activity_threshold(frames, key), list(key))
    rows = hysteresis(rows, key, "t", "db", F.col("threshold") + 1.5, F.col("threshold") - 2.5)
    rows = fill_gaps(rows, key, "t", "active", max(1, int(fill_s / hop_s + 0.5)))
    w = Window.partitionBy(*key).orderBy("t")
    runs = islands(rows, key, ["t"], F.col("active") != F.lag("active").over(w)).where("active")
    raw = runs.groupBy(*key, "island").agg(F.greatest(F.lit(0.0), F.min("t") - frame_s / 2).alias("start_s"), F.least(F.max("duration"), F.max("t") + frame_s / 2).alias("end_s"))
    raw = raw.where(F.col("end_s") - F.col("start_s") >= min_phrase_s)
    order = Window.partitionBy(*key).orderBy("start_s")
    merged = islands(raw.drop("island"), key, ["start_s"], F.col("start_s") - F.lag("end_s").over(order) >= min_gap_s)
    spans = merged.groupBy(*key, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    inside = spans.withColumn("_b", F.explode(F.sequence(F.floor("start_s"), F.floor("end_s")))).join(rows.select(*key, "t", "db", "threshold", F.floor("t").alias("_b")), [*key, "_b"]).where(F.col("t").between(F.col("start_s"), F.col("end_s")))
    found = inside.groupBy(*key, "island", "start_s", "end_s").agg(clamp((F.max("db") - F.first("threshold")) / 18, 0.25, 1.0).alias("confidence"))
    return found.select(*key, F.row_number().over(order).alias("phrase_id"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "confidence")


def phrase_boundaries(phrases: DataFrame, key: Key) -> DataFrame:
    """Start and end of each phrase as boundaries."""
    edges = F.explode(F.array(F.struct(F.col("start_s").alias("t"), F.lit("start").alias("edge")), F.struct(F.col("end_s").alias("t"), F.lit("end").alias("edge"))))
    return phrases.select(*key, "phrase_id", "confidence", edges.alias("e")).select(*key, "e.t", "confidence", F.lit("vocal").alias("source"), "e.edge", "phrase_id")


def _true(rule: Column) -> Column:
    """A rule on a missing number doesn't hold."""
    return F.coalesce(rule, F.lit(False))


def frame_class(rms_db: Column, confidence: Column, hnr_db: Column, tilt: Column, f0: Column) -> Column:
    """quiet, transient, periodic or mixed, by ordered rules."""
    noisy = _true((rms_db > -38) & (confidence < 0.45) & (hnr_db < 4)) | _true((tilt > -3) & (confidence < 0.4) & (rms_db > -48))
    periodic = _true(f0.isNotNull() & (confidence >= 0.6) & (hnr_db >= 5))
    return F.when(_true(rms_db < -55), "quiet").when(noisy, "transient").when(periodic, "periodic").otherwise("mixed")


def sound_summary(rms_db: Column, confidence: Column, hnr_db: Column, f0: Column) -> Column:
    """The class of a single moment: quiet, attack, periodic, unstable or mixed, by its own ordered rules."""
    attack = _true((rms_db > -38) & (confidence < 0.45) & (hnr_db < 4))
    periodic = _true(f0.isNotNull() & (confidence >= 0.6) & (hnr_db >= 5))
    return F.when(_true(rms_db < -55), "quiet").when(attack, "attack").when(periodic, "periodic").when(_true(confidence < 0.45), "unstable").otherwise("mixed")


def level_band(rms_db: Column) -> Column:
    return F.when(rms_db < -55, "near silence").when(rms_db < -38, "soft").when(rms_db < -20, "medium").when(rms_db.isNotNull(), "loud")


def brightness_band(tilt: Column) -> Column:
    return F.when(tilt > -3, "bright").when(tilt < -9, "dark").when(tilt.isNotNull(), "balanced")


def extent_band(cents: Column) -> Column:
    return F.when(cents < 30, "steady").when(cents < 100, "moving").when(cents.isNotNull(), "wide")


def pitch_reading(kind: Column, f0: Column, confidence: Column) -> Column:
    """How far a state's pitch can be read."""
    return F.when(kind == "quiet", "not applicable").when(f0.isNull() | _true(confidence < 0.45), "unstable").when(_true(confidence >= 0.7), "clear").otherwise("tentative")


def harmonic_reading(kind: Column, hnr_db: Column, cpps_db: Column) -> Column:
    return F.when(kind == "quiet", "not applicable").when(_true((hnr_db >= 10) & (cpps_db >= 7)), "harmonic").when(_true((hnr_db < 3) | (cpps_db < 3)), "noisy").otherwise("moderate")


#: The frame metrics besides the pitch of which intervals and runs take medians, as far as a table has them.
METRICS = ("confidence", "rms_db", "hnr", "cpps", "tilt", "vib_extent", "vib_rate")


def _metric_medians(frames: DataFrame) -> list[Column]:
    return [F.percentile(finite(F.col(c)), F.lit(0.5)).alias(f"median_{c}") for c in METRICS if c in frames.columns]


def interval_medians(intervals: DataFrame, frames: DataFrame, key: Key) -> DataFrame:
    """Medians of the frame metrics per interval (start_s, end_s); f0 only over confident voiced frames."""
    from ordina.operators.matching import points_in

    inside = points_in(intervals, frames, key, "start_s", "end_s", "t")
    voiced = F.when((F.col("f0") > 0) & (F.col("confidence") >= 0.5), F.col("f0"))
    return inside.groupBy(*key, "start_s", "end_s").agg(F.percentile(voiced, F.lit(0.5)).alias("median_f0_hz"), *_metric_medians(frames))


def interval_changes(intervals: DataFrame, key: Key) -> DataFrame:
    """What moved since the interval before: level 3 dB, pitch 80 cents, tilt 3 dB per octave."""
    w = Window.partitionBy(*key).orderBy("start_s")
    db, tilt = F.col("median_rms_db") - F.lag("median_rms_db").over(w), F.col("median_tilt") - F.lag("median_tilt").over(w)
    before = F.lag("median_f0_hz").over(w)
    cents = F.when((before > 0) & (F.col("median_f0_hz") > 0), 1200 * F.log2(F.col("median_f0_hz") / before))
    rows = intervals.withColumns({"_db": db, "_cents": cents, "_tilt": tilt})
    changes = F.array_compact(F.array(*[F.when(F.abs(c) >= v, F.lit(n)) for n, c, v in (("level", F.col("_db"), 3), ("pitch", F.col("_cents"), 80), ("brightness", F.col("_tilt"), 3))]))
    return rows.withColumn("changes", changes).drop("_db", "_cents", "_tilt")


def stable_runs(frames: DataFrame, key: Key, stable: Column, least: int = 12) -> DataFrame:
    """Runs of least or more stable rows, with the medians of their metrics."""
    w = Window.partitionBy(*key).orderBy("t")
    runs = islands(frames.withColumn("_s", F.coalesce(stable, F.lit(False))), key, ["t"], F.col("_s") != F.lag("_s").over(w)).where("_s")
    return runs.groupBy(*key, "island").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("frames"), F.percentile("f0", F.lit(0.5)).alias("median_f0_hz"), *_metric_medians(frames)).where(F.col("frames") >= least).drop("island")


def chronicle(states: DataFrame, movements: DataFrame, registers: DataFrame, key: Key) -> DataFrame:
    """States, movements and register changes in one list by start, states first."""
    def tagged(df: DataFrame, kind: str, rank: int) -> DataFrame:
        return df.select(*key, F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.lit(kind).alias("kind"), F.lit(rank).alias("_r"))

    every = tagged(states, "state", 0).union(tagged(movements, "movement", 1)).union(tagged(registers, "register", 1))
    w = Window.partitionBy(*key).orderBy("start_s", "_r", "kind", "end_s")
    return every.withColumn("entry", F.row_number().over(w)).drop("_r")


def signal_stats(samples: DataFrame, key: Key) -> DataFrame:
    """RMS, peak, clipping fraction (0.999 or more) and finiteness from (sample) rows."""
    x = F.col("sample").cast("double")
    good = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    y = F.when(good, x)
    return samples.groupBy(*key).agg(F.count("*").alias("samples"), F.sqrt(F.avg(y * y)).alias("rms"), F.max(F.abs(y)).alias("peak"), F.avg((F.abs(y) >= 0.999).cast("int")).alias("clipping_fraction"), F.bool_and(good).alias("finite"))


def separation_report(samples: DataFrame, key: Key, rate: int = 44_100) -> DataFrame:
    """From rows (sample_idx, source, vocals, accompaniment; null beyond a signal's end): residual RMS ratio over the common length, warnings and valid."""
    signals = ("source", "vocals", "accompaniment")
    all_ = F.col("source").isNotNull() & F.col("vocals").isNotNull() & F.col("accompaniment").isNotNull()
    common = samples.where(all_).withColumn("_rest", F.col("source") - (F.col("vocals") + F.col("accompaniment")))

    def rms(c: str) -> Column:
        return F.sqrt(F.avg(F.col(c) * F.col(c)))

    good = F.bool_and(F.greatest(*[F.abs(F.nanvl(s, F.lit(float("inf")))) for s in signals]) < float("inf"))
    found = common.groupBy(*key).agg((rms("_rest") / F.nullif(rms("source"), F.lit(0.0))).alias("residual_rms_ratio"), rms("vocals").alias("_v"), rms("accompaniment").alias("_a"), good.alias("_finite"))
    lengths = samples.groupBy(*key).agg(*[F.count(s).alias(f"_n_{s}") for s in signals])
    n = [F.col(f"_n_{s}") for s in signals]
    spread = (F.greatest(*n) - F.least(*n)) / float(rate)
    out = lengths.join(found, list(key), "left")
    warnings = F.array_compact(F.array(F.when(_true(F.col("_v") <= 1e-7), "vocal stem is silent"), F.when(_true(F.col("_a") <= 1e-7), "accompaniment stem is silent"), F.when(~F.coalesce("_finite", F.lit(False)), "samples are not finite"), F.when(spread > 0.1, "durations differ")))
    return out.withColumn("warnings", warnings).select(*key, "residual_rms_ratio", spread.alias("duration_spread_s"), "warnings", (F.size("warnings") == 0).alias("valid"))


def waveform_comparison(samples: DataFrame, key: Key) -> DataFrame:
    """Uncentred correlation of columns a and b, with RMS and peak of both and the zero crossing rate of a."""
    w = Window.partitionBy(*key).orderBy("sample_idx")
    rows = samples.withColumn("_z", ((F.col("a") >= 0) != (F.lag("a").over(w) >= 0)).cast("int"))
    ab, aa, bb = F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b"))
    return rows.groupBy(*key).agg(F.coalesce(ab / F.nullif(F.sqrt(aa * bb), F.lit(0.0)), F.lit(0.0)).alias("correlation"), F.sqrt(aa / F.count("*")).alias("rms_a"), F.sqrt(bb / F.count("*")).alias("rms_b"), F.max(F.abs("a")).alias("peak_a"), F.max(F.abs("b")).alias("peak_b"), (F.coalesce(F.sum("_z"), F.lit(0)) / F.count("*")).alias("zcr_a"))


def dominance_summary(cells: DataFrame, key: Key, active_db: float = 55.0) -> DataFrame:
    """From (bin, vocals_db, instr_db), without bin 0: shares of active cells where one leads by more than 6 dB, where neither does, and the mean lead."""
    rows = cells.where("bin > 0").withColumns({"_top": F.greatest("vocals_db", "instr_db"), "_d": F.col("vocals_db") - F.col("instr_db")})
    top = rows.groupBy(*key).agg(F.max("_top").alias("_max"))
    live = rows.join(top, list(key)).where(F.col("_top") >= F.col("_max") - active_db)
    return live.groupBy(*key).agg(F.count("*").alias("active_cells"), *[(100 * F.count_if(c) / F.count("*")).alias(n) for n, c in (("vocals_percent", F.col("_d") > 6), ("instrumental_percent", F.col("_d") < -6), ("shared_percent", F.abs("_d") <= 6))], F.avg(F.abs("_d")).alias("mean_abs_dominance_db"))

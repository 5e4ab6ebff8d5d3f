"""Onset envelopes, tempo, beat and bar phase, and snapping of cuts.

Envelope rows are (key..., frame_idx, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions.scalar import clamp, round_half_up
from ordina.operators.matching import lagged_pairs, nearest_within
from ordina.operators.series import Key, suppress

EPS = 1e-12


def onset_envelope(frames: DataFrame, key: Key) -> DataFrame:
    """From rms and hf per frame_idx: 3.5 * rise of rms + 0.8 * hf, less its upper median, scaled by the peak to 0..1."""
    w = Window.partitionBy(*key).orderBy("frame_idx")
    rise = F.greatest(F.lit(0.0), F.col("rms") - F.lag("rms", 1, 0.0).over(w))
    raw = frames.select(*key, "frame_idx", (rise * 3.5 + F.col("hf") * 0.8).alias("raw"))
    rank = Window.partitionBy(*key).orderBy("raw", "frame_idx")
    ranked = raw.withColumns({"_k": F.row_number().over(rank) - 1, "_n": F.count("*").over(Window.partitionBy(*key))})
    floor = ranked.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*key, F.col("raw").alias("_floor"))
    above = raw.join(floor, list(key))
    peak = above.groupBy(*key).agg(F.greatest(F.lit(EPS), F.max(F.greatest(F.lit(0.0), F.col("raw") - F.col("_floor")))).alias("_peak"))
    return above.join(peak, list(key)).select(*key, "frame_idx", clamp((F.col("raw") - F.col("_floor")) / F.col("_peak"), 0.0, 1.0).alias("value"))


def autocorrelation(envelope: DataFrame, key: Key, low: int, high: int) -> DataFrame:
    """Normalised autocorrelation of the values at each lag, 0 where either side has no energy."""
    pairs = lagged_pairs(envelope, key, "frame_idx", "value", low, high)
    sums = pairs.groupBy(*key, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("_ab"), F.sum(F.col("a") * F.col("a")).alias("_aa"), F.sum(F.col("b") * F.col("b")).alias("_bb"))
    return sums.select(*key, "lag", F.when((F.col("_aa") > EPS) & (F.col("_bb") > EPS), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).otherwise(0.0).alias("autocorrelation"))


def tempo_candidates(envelope: DataFrame, key: Key, hop_s: float = 0.02, min_bpm: float = 60.0, max_bpm: float = 200.0, top: int = 5) -> DataFrame:
    """Lags scored by autocorrelation, that of double and half the lag, and nearness to 120 BPM; none within 3 BPM of a better one."""
    from math import ceil, floor

    low, high = max(1, floor(60 / max_bpm / hop_s)), ceil(60 / min_bpm / hop_s)
    n = envelope.groupBy(*key).agg((F.count("*") - 2).alias("_most"))
    ac = autocorrelation(envelope, key, low, high).join(n, list(key)).where(F.col("lag") <= F.col("_most")).withColumn("_most", F.least("_most", F.lit(high)))
    other = ac.select(*key, F.col("lag").alias("_l"), F.col("autocorrelation").alias("_v"))
    double = other.withColumnsRenamed({"_l": "_l2", "_v": "_v2"})
    out = ac.withColumns({"_l2": F.col("lag") * 2, "_l": round_half_up(F.col("lag") / 2).cast("int")})
    out = out.join(double, [*key, "_l2"], "left").join(other, [*key, "_l"], "left").withColumn("bpm", 60 / (F.col("lag") * hop_s))
    score = F.col("autocorrelation") + F.coalesce("_v2", F.lit(0.0)) * 0.16 + F.coalesce("_v", F.lit(0.0)) * 0.06 + F.exp(-F.pow((F.col("bpm") - 120) / 95, F.lit(2))) * 0.025
    return suppress(out.withColumn("score", score), key, "score", "bpm", 3.0, ["lag", "autocorrelation"], top, best_first=[F.abs(F.col("bpm") - 120)])


def strength(envelope: DataFrame, key: Key, radius: int) -> DataFrame:
    """The largest value within radius frames, at least 0."""
    w = Window.partitionBy(*key).orderBy("frame_idx").rangeBetween(-radius, radius)
    return envelope.withColumn("strength", F.greatest(F.lit(0.0), F.max("value").over(w)))


def beat_phase(envelope: DataFrame, periods: DataFrame, key: Key) -> DataFrame:
    """Per key the offset below the period (column lag) with the greatest total strength / sqrt(count); ties (equal to nine digits): the smaller."""
    rows = strength(envelope, key, 1).join(periods.select(*key, "lag"), list(key)).withColumn("offset", F.pmod(F.col("frame_idx"), F.col("lag")))
    each = rows.groupBy(*key, "lag", "offset").agg((F.sum("strength") / F.sqrt(F.count("*"))).alias("score"))
    return each.groupBy(*key, "lag").agg(F.max_by(F.struct("offset", "score"), F.struct(F.round("score", 9), -F.col("offset"))).alias("_b")).select(*key, "lag", "_b.offset", "_b.score")


def beats(envelope: DataFrame, phase: DataFrame, key: Key, hop_s: float = 0.02) -> DataFrame:
    """Beat times: every lag frames from the offset to the end of the envelope."""
    n = envelope.groupBy(*key).agg((F.count("*") - 1).alias("_last"))
    grid = phase.join(n, list(key)).where("offset <= _last").select(*key, F.posexplode(F.sequence("offset", F.col("_last"), F.col("lag").cast("long"))).alias("beat", "frame_idx"))
    return grid.withColumn("time_s", F.col("frame_idx") * hop_s)


def bar_phase(beats: DataFrame, envelope: DataFrame, key: Key, per_bar: int = 4) -> DataFrame:
    """The phase of beats with the greatest mean strength within two frames; ties: the smaller."""
    strong = strength(envelope, key, 2).select(*key, "frame_idx", "strength")
    each = beats.join(strong, [*key, "frame_idx"]).groupBy(*key, F.pmod(F.col("beat"), F.lit(per_bar)).alias("phase")).agg(F.avg("strength").alias("score"))
    return each.groupBy(*key).agg(F.max_by("phase", F.struct("score", -F.col("phase"))).alias("bar_phase"))


def bars(beats: DataFrame, phase: DataFrame, key: Key, per_bar: int = 4) -> DataFrame:
    return beats.join(phase, list(key)).where(F.pmod(F.col("beat"), F.lit(per_bar)) == F.col("bar_phase")).drop("bar_phase")


def beat_boundaries(bars: DataFrame, key: Key, duration: Column, confidence: Column) -> DataFrame:
    """Bar times at least a second from both ends as boundaries with evidence `beat`."""
    c = clamp(confidence, 0.0, 1.0)
    return bars.where((F.col("time_s") >= 1) & (F.col("time_s") <= duration - 1)).select(*key, F.col("time_s").alias("t"), c.alias("score"), c.alias("confidence"), F.lit("beat").alias("source"), F.create_map(F.lit("beat"), c).alias("evidence"))


def beat_grid(envelope: DataFrame, key: Key, hop_s: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best tempo, beats and bars of each envelope."""
    best = tempo_candidates(envelope, key, hop_s).where("pick = 0")
    phase = beat_phase(envelope, best.withColumn("lag", F.col("lag").cast("long")), key)
    found = beats(envelope, phase, key, hop_s)
    return best, found, bars(found, bar_phase(found, envelope, key), key)


def _snap(cuts: DataFrame, key: Key, edge: str, grids: dict[str, tuple[DataFrame, float]], ids: list[str]) -> DataFrame:
    out = cuts
    for kind, (grid, most) in grids.items():
        hit = nearest_within(out.select(*key, *ids, edge), grid.select(*key, F.col("time_s").alias(f"_{kind}")), key, edge, f"_{kind}", most, ids=ids)
        out = out.join(hit.select(*key, *ids, F.col(f"_{kind}").alias(f"_{edge}_{kind}")), [*key, *ids], "left")
    return out


def align_cuts(cuts: DataFrame, beats: DataFrame, bars: DataFrame, key: Key, bpm: float | None, mode: str = "recommended", low_energy: bool = False, phrases: DataFrame | None = None) -> DataFrame:
    """Cuts (cut_id, start, end) moved to the nearest bar, else beat ("bar", "beat" alone), vocal phrase boundary ("vocal", phrases: time_s) or quiet place ("low-energy"); or "exact".

    An alignment whose end would not follow its start by 0.02 s is no alignment. With low_energy (and in its own mode) cut rows bring
    the two quiet places: start_low, start_drop_db, end_low, end_drop_db. "recommended" takes one for an edge that stayed exact if it is more
    than 5 ms away and the level drops 4 dB, and if the range stays valid; else the range of bars and beats stays.
    """
    period = 60 / bpm if bpm else 0.5
    grids = {"bar": (bars, max(0.35, period * 1.4)), "beat": (beats, max(0.12, period * 0.42))}
    grids = {k: v for k, v in grids.items() if mode in (k, "recommended")} | ({"vocal": (phrases, 0.9)} if mode == "vocal" and phrases is not None else {})
    out, edges = cuts, ("start", "end")
    for edge in edges:
        out = _snap(out, key, edge, grids, ["cut_id"])
    follows = lambda name: F.col(f"_end{name}") > F.col(f"_start{name}") + 0.02

    def settle(out: DataFrame, name: str, times: dict[str, Column], kinds: dict[str, Column], before: dict[str, tuple[Column, Column]]) -> DataFrame:
        """Columns _<edge><name> and _<edge><name>_kind: the new range if it is valid, else the one before."""
        out = out.withColumns({f"_{e}{name}": times[e] for e in edges} | {f"_{e}{name}_kind": kinds[e] for e in edges}).withColumn("_good", F.coalesce(follows(name), F.lit(False)))
        return out.withColumns({f"_{e}{name}{k}": F.when(F.col("_good"), F.col(f"_{e}{name}{k}")).otherwise(before[e][j]) for e in edges for j, k in enumerate(("", "_kind"))})

    raw = {e: (F.col(e), F.lit("exact")) for e in edges}
    hits = {e: [(F.col(f"_{e}_{k}"), k) for k in grids] for e in edges}
    out = settle(out, "_grid", {e: F.coalesce(*[c for c, _ in hits[e]], F.col(e)) for e in edges}, {e: F.coalesce(*[F.when(c.isNotNull(), k) for c, k in hits[e]], F.lit("exact")) for e in edges}, raw)
    last = "_grid"
    if mode == "low-energy" or (low_energy and mode == "recommended"):
        quiet = {e: F.when(F.abs(F.col(f"{e}_low") - F.col(e)) > 0.005, "low-energy").otherwise("exact") for e in edges}
        out = settle(out, "_low", {e: F.col(f"{e}_low") for e in edges}, quiet, raw)
        last = "_low"
    if mode == "recommended" and low_energy:
        taken = {e: (F.col(f"_{e}_grid_kind") == "exact") & (F.col(f"_{e}_low_kind") == "low-energy") & (F.col(f"{e}_drop_db") >= 4) for e in edges}
        out = settle(out, "_best", {e: F.when(taken[e], F.col(f"_{e}_low")).otherwise(F.col(f"_{e}_grid")) for e in edges}, {e: F.when(taken[e], "low-energy").otherwise(F.col(f"_{e}_grid_kind")) for e in edges}, {e: (F.col(f"_{e}_grid"), F.col(f"_{e}_grid_kind")) for e in edges})
        last = "_best"
    return out.select(*key, "cut_id", *[F.col(f"_{e}{last}").alias(e) for e in edges], *[F.col(f"_{e}{last}_kind").alias(f"{e}_kind") for e in edges])


def low_energy_time(cuts: DataFrame, levels: DataFrame, key: Key, time: str, radius_s: float = 0.35) -> DataFrame:
    """For each cut the time of least rms within radius_s on a grid of levels (t, rms); the cut's own level wins ties, then the earlier.

    cuts bring raw_rms, the level at the time itself.
    """
    left = cuts.withColumn("_b", F.explode(F.sequence(F.floor(F.col(time) - radius_s), F.floor(F.col(time) + radius_s))))
    near = left.join(levels.select(*key, "t", "rms", F.floor("t").alias("_b")), [*key, "_b"]).where(F.abs(F.col("t") - F.col(time)) <= radius_s + 1e-9)
    best = near.where(F.col("rms") < F.col("raw_rms")).groupBy(*key, "cut_id").agg(F.min_by(F.struct("t", "rms"), F.struct("rms", "t")).alias("_m"))
    out = cuts.join(best, [*key, "cut_id"], "left")
    t, rms = F.coalesce("_m.t", F.col(time)), F.coalesce("_m.rms", F.col("raw_rms"))
    return out.select(*[F.col(c) for c in cuts.columns], t.alias("low_time"), F.abs(t - F.col(time)).alias("low_distance"), rms.alias("low_rms"), (20 * F.log10((F.col("raw_rms") + 1e-8) / (rms + 1e-8))).alias("drop_db"))

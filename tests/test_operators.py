"""Known answers of the series operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordina.functions import scalar, text
from ordina.operators import alignment, boundaries, dsp, matching, pitch, rhythm, sections, series, structure, voice
from ordina.sources import generators

KEY = ["track"]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame({"track": "t", **columns}))


def one(df):
    (row,) = df.collect()
    return row


# --- fusion


def test_consensus_classes(spark):
    hz = [440.0] * 3
    other = [440 * 2 ** (c / 1200) for c in (10, 35, 80)]
    df = frame(spark, time_s=[0.0, 0.1, 0.2], pyin_hz=hz, crepe_hz=other, pyin_confidence=[0.9] * 3, crepe_periodicity=[0.9] * 3)
    rows = pitch.consensus(df).orderBy("time_s").collect()
    assert [r.agreement for r in rows] == ["strong", "weak", "disagreement"]
    assert math.isclose(rows[0].consensus_f0_hz, math.sqrt(440 * other[0]))


def test_consensus_fallback_and_missing(spark):
    nan = float("nan")
    df = frame(spark, time_s=[0.0, 1.0, 2.0, 3.0, 4.0], pyin_hz=[440.0, 440.0, nan, nan, 0.0], crepe_hz=[441.0, 441.0, 300.0, 300.0, -1.0], pyin_confidence=[0.95, 0.5, nan, nan, 0.9], crepe_periodicity=[0.05, 0.05, 0.5, 0.1, 0.9])
    rows = pitch.consensus(df).orderBy("time_s").collect()
    assert [r.agreement for r in rows] == ["low-confidence-crepe", "low-confidence-crepe", "crepe-only", "crepe-only-low-confidence", "none"]
    assert [r.selected_source for r in rows] == ["pyin-fallback", "none", "crepe-only", "none", "none"]
    s = one(pitch.consensus_summary(pitch.consensus(df), KEY))
    assert s.frames == 5 and s.consensus_coverage == 0.0 and s.agreement_counts["none"] == 1


T = np.arange(0, 2, 0.01)


@pytest.mark.parametrize("cents, count", [(0 * T, 1), (600 * T, 0), (40 * T, 0), (30 * np.sin(2 * np.pi * 6 * T), 1)])
def test_stable_segments(spark, cents, count):
    df = frame(spark, time_s=T, f0_hz=440 * 2 ** (cents / 1200), confidence=np.full(len(T), 0.9), evidence=["consensus"] * len(T))
    rows = pitch.stable_segments(df, KEY).collect()
    assert len(rows) == count
    if count:
        assert rows[0].consensus_fraction == 1.0 and math.isclose(rows[0].duration_s, 2.0, abs_tol=0.02)
        assert (rows[0].vibrato_extent_cents_p95_p05 > 40) == bool(np.ptp(cents))


def test_local_linear_across_pieces(spark):
    t = np.arange(0, 30, 0.05)
    y = np.cumsum(np.random.default_rng(0).normal(size=len(t)))
    got = pitch.local_linear(frame(spark, time_s=t, y=y), KEY, "time_s", "y", 0.5, piece_s=7.0).orderBy("time_s").toPandas()
    for k in (0, 5, 139, 140, 141, 300, len(t) - 1):
        near = np.abs(t - t[k]) <= 0.25 + 1e-12
        m, b = np.polyfit(t[near], y[near], 1)
        assert math.isclose(got.slope[k], m, abs_tol=1e-6)
        assert math.isclose(got.residual_std[k], np.sqrt(np.mean((y[near] - m * t[near] - b) ** 2)), abs_tol=1e-6)


def test_tuning(spark):
    near = frame(spark, median_f0_hz=[440 * 2 ** (c / 1200) for c in (49, -49)], duration_s=[1.0, 1.0], median_confidence=[1.0, 1.0])
    m = one(pitch.tuning_models(near, KEY, (12,)))
    assert math.isclose(abs(m.estimated_global_offset_cents), 50, abs_tol=1e-6) and math.isclose(m.weighted_rmse_cents, 1, abs_tol=1e-6)
    ladder = frame(spark, median_f0_hz=[220 * 2 ** (k / 19) for k in range(20)], duration_s=[0.25] * 20, median_confidence=[1.0] * 20)
    best = one(pitch.tuning_ambiguity(pitch.tuning_models(ladder, KEY), KEY))
    assert best.lowest_residual_edo == 19 and best.rmse_gap_to_second_cents > 1
    assert pitch.tuning_models(near.where("false"), KEY).count() == 0


def test_weighted_median(spark):
    assert one(pitch.weighted_median(frame(spark, v=[3.0, 1.0, 2.0], w=[1.0, 1.0, 5.0]), KEY, "v", "w")).weighted_median == 2.0


@pytest.mark.parametrize("cents, conf, least", [(500 * T, 0.9, 1), (40 * np.sin(2 * np.pi * 6 * T), 0.9, 0), (500 * T, 0.2, 0), (500 * T, None, 0)])
def test_movements(spark, cents, conf, least):
    df = frame(spark, time_s=T, selected_f0_hz=220 * 2 ** (cents / 1200), selected_confidence=np.full(len(T), np.nan if conf is None else conf))
    rows = pitch.movements(df, KEY).collect()
    assert len(rows) >= least if least else not rows
    if rows:
        assert rows[0].direction == "ascending" and math.isclose(rows[0].slope_cents_per_s, 500, abs_tol=1e-3)


# --- series primitives


def test_decimate(spark):
    got = series.decimate(frame(spark, time_s=np.arange(11) * 0.01), KEY, "time_s", [], 0.02).orderBy("time_s").toPandas()
    assert np.allclose(got.time_s, np.arange(6) * 0.02)


def test_hysteresis_and_gaps(spark):
    df = frame(spark, t=np.arange(8.0), v=[0.0, 5.0, 3.0, 1.0, 3.0, 5.0, 0.0, 0.0])
    on = series.hysteresis(df, KEY, "t", "v", F.lit(4.0), F.lit(2.0))
    assert [r.active for r in on.orderBy("t").collect()] == [False, True, True, False, False, True, False, False]
    assert [r.active for r in series.fill_gaps(on, KEY, "t", "active", 2).orderBy("t").collect()] == [False, True, True, True, True, True, False, False]


def test_suppression_ties_and_top(spark):
    df = frame(spark, p=[1.0, 2.0, 5.0, 6.0, 9.0], s=[1.0, 1.0, 3.0, 2.0, 1.0])
    assert [r.p for r in series.suppress(df, KEY, "s", "p", 2.0, []).orderBy("pick").collect()] == [5.0, 1.0, 9.0]
    assert series.suppress(df, KEY, "s", "p", 2.0, [], top=1).count() == 1


def test_run_lengths(spark):
    df = frame(spark, t=[0.0, 1.0, 2.0, 3.0], kind=["a", "a", "b", "a"])
    rows = series.run_lengths(df, KEY, "t", "kind", 1.0, F.lit(3.2)).orderBy("start_s").collect()
    assert [(r.kind, r.start_s, r.end_s, r.frames) for r in rows] == [("a", 0.0, 1.5, 2), ("b", 1.5, 2.5, 1), ("a", 2.5, 3.2, 1)]


# --- matching


def test_ranges_intersect(spark):
    a = frame(spark, start=[1.23, 8.1], end=[4.56, 9.2])
    b = frame(spark, start=[2.34, 8.6], end=[5.67, 10.0])
    got = sorted((r.start, r.end) for r in matching.intersect_ranges(a, b, KEY).collect())
    assert np.allclose(got, [(2.34, 4.56), (8.6, 9.2)])


def test_nearest_ties(spark):
    q, g = frame(spark, time_s=[1.0, 7.0]), frame(spark, place=[0.0, 2.0])
    assert [r.place for r in matching.nearest(q, g, KEY, "time_s", "place").orderBy("time_s").collect()] == [2.0, 2.0]
    assert [r.place for r in matching.nearest(q, g, KEY, "time_s", "place", later_on_tie=False).orderBy("time_s").collect()] == [0.0, 2.0]
    assert [r.place for r in matching.nearest_within(q, g, KEY, "time_s", "place", 1.5).orderBy("time_s").collect()] == [0.0, None]


def test_facets(spark):
    items = spark.createDataFrame([(1, "s", "a"), (1, "v", "x"), (2, "s", "b"), (3, "v", "x")], "item int, tree string, label string")
    wanted = spark.createDataFrame([("s", "a"), ("s", "b"), ("v", "x")], "tree string, label string")
    assert [r.item for r in matching.facet_filter(items, wanted).collect()] == [1]
    assert matching.facet_filter(items, wanted.where("false")).count() == 3


def test_morae_over_phones(spark):
    words = spark.createDataFrame([("t", 1, 1.0, 2.0, "w", ["a", "b", "c"]), ("t", 2, 1.0, 5.0, "v", ["x"])], "track string, word_id int, start_s double, end_s double, label string, morae array<string>")
    phones = spark.createDataFrame([("t", 1.2, 1.5), ("t", 1.5, 1.8)], "track string, phone_start double, phone_end double")
    placed, failed = matching.phone_supported_morae(words.where("word_id = 1"), phones, KEY)
    rows = placed.orderBy("mora_idx").collect()
    assert len(rows) == 3 and math.isclose(rows[0].start_s, 1.2) and math.isclose(rows[2].end_s, 1.8)
    late = spark.createDataFrame([("t", 5.0, 5.1)], "track string, phone_start double, phone_end double")
    placed, failed = matching.phone_supported_morae(words.where("word_id = 2"), late, KEY)
    assert placed.count() == 0 and one(failed).reason == "no_phone_support"


# --- structure


def test_periods(spark):
    for layout, period in (([("A", 32)] * 4, 32), ([("A", 32), ("B", 32)] * 2, 64)):
        views = generators.views(generators.motif_sequence(spark, "t", layout))
        profile = structure.lag_profile(views, ["track", "view"], 8, 80)
        best = structure.period_candidates(structure.combine_views(profile, KEY), KEY, separation=4).where("pick = 0")
        assert one(best).lag_frames == period and one(best).combined_similarity > 0.98


def test_dtw_of_stretched_motif(spark):
    seq = generators.motif_sequence(spark, "t", [("A", 32), ("A", 40), ("B", 32)])
    edges = frame(spark, boundary=[0, 1, 2, 3], frame_idx=[0, 32, 72, 104])
    d = {(r.i, r.j): r.distance for r in structure.cycle_distances(structure.cycles(seq, edges, KEY), KEY).collect()}
    assert d[0, 1] < 0.08 and d[0, 1] < d[0, 2]
    cells = {(r.i, r.j): r.distance for r in structure.symmetric(structure.cycle_distances(structure.cycles(seq, edges, KEY), KEY), KEY).collect()}
    assert cells[1, 0] == d[0, 1] and cells[2, 2] == 0.0


def test_dtw_ties_prefer_fewer_steps():
    cost, steps = structure.dtw(np.eye(3), np.eye(3))
    assert abs(cost) < 1e-12 and steps == 3


def test_cycle_distances_in_blocks(spark, monkeypatch):
    """Cycles of unequal lengths in several blocks, aligned many at a time, against one by one."""
    rng = np.random.default_rng(8)
    x = [rng.integers(-2, 3, (int(n), 3)).astype(float) for n in rng.integers(1, 7, 11)]
    want = {(i, j): cost / steps for i in range(11) for j in range(i + 1, 11) for cost, steps in [structure.dtw(x[i], x[j])]}
    rows = spark.createDataFrame([(t, k, m.tolist()) for t in "ab" for k, m in enumerate(x)], "track string, cycle int, frames array<array<double>>").repartition(3)
    got = [(r.track, (r.i, r.j), r.distance) for r in structure.cycle_distances(rows, KEY, block=4).collect()]
    assert len(got) == 2 * len(want) and len({(t, p) for t, p, _ in got}) == len(got) and all(np.isclose(d, want[p]) for _, p, d in got)
    monkeypatch.setattr(structure, "CELLS", 40)  # a few matrices at once
    i, j, d = structure._distances(np.arange(11), pa.array([m.tolist() for m in x]), np.arange(11), np.arange(11))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want) and all(np.isclose(v, want[p, q]) for p, q, v in zip(i.tolist(), j.tolist(), d))


def test_beat_phase_ties(spark):
    """Equal in all but rounding: 0.3 + 0 + 0 and 0.1 + 0.1 + 0.1; the smaller offset stands."""
    value = [0.0] * 24
    value[2], value[5], value[13], value[21] = 0.3, 0.1, 0.1, 0.1
    env = frame(spark, frame_idx=list(range(24)), value=value)
    got = one(rhythm.beat_phase(env, env.select("track").distinct().withColumn("lag", F.lit(8)), KEY))
    assert got.offset == 1 and np.isclose(got.score, 0.3 / 3**0.5)


def test_section_peaks_to_the_last_digit(spark):
    """Logits that differ in the last digits peak, or tie, as the C library's exp (and so the SQL) has it."""
    x = np.unique([(k / 100) % 9.0 - 4.0 for k in range(60000)])
    p = [1 / (1 + math.exp(-v)) for v in x.tolist()]
    pairs = [k for k in range(len(x) - 1) if x[k + 1] - x[k] < 1e-9]
    rows = [(k, f, float(v)) for k in pairs for f, v in enumerate((x[k], x[k + 1]))]
    df = spark.createDataFrame(rows, "track int, frame_idx int, section_logit double")
    got = sections.section_boundaries(df, KEY, 3, 1, 1).collect()
    want = {(k, 1) for k in pairs} | {(k, 0) for k in pairs if p[k] >= p[k + 1]}
    assert {(r.track, r.frame_idx) for r in got} == want


def test_browser_register_jump_and_back(spark):
    """A jump and its way back within 0.35 s are equal but for the last digit; which is larger is as the C library's log2 has it."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for track in range(150):
        a, b = (round(float(v), 2) for v in rng.uniform((100, 200), (150, 400)))
        want[track] = math.copysign(1, abs(1200 * math.log2(b / a)) - abs(1200 * math.log2(a / b)))
        for i, high in enumerate([0] * 6 + [1] * 5 + [0] * 8):
            rows.append((track, i * 0.05, b if high else a, 9.0 * high, 9.0 * high, 0.0, -20.0, 1.0))
    df = spark.createDataFrame(rows, "track int, t double, f0 double, cpps double, hnr double, tilt double, rms_db double, confidence double")
    got = {}
    for r in sorted(voice.browser_register(df, KEY).collect(), key=lambda r: -r.t):
        got[r.track] = math.copysign(1, r.jump_cents)  # the first of each track stands
    assert got == want


def test_view_agreement(spark):
    rows = spark.createDataFrame([("t", lag, v) for v, lags in {"a": (32, 64), "b": (33, 65), "c": (31, 96)}.items() for lag in lags], "track string, lag_frames int, view string")
    got = structure.view_agreement(rows, KEY).orderBy("group").collect()
    assert (got[0].period_frames, got[0].view_count, got[0].views) == (32, 3, ["a", "b", "c"]) and len(got) == 3


def test_template_alignment(spark):
    seq = generators.views(generators.motif_sequence(spark, "t", [("A", 32), ("pad", 4), ("A", 32), ("A", 32)]))
    rows = structure.template_alignment(seq, KEY, anchor=0, period=32, length=32, radius=6).orderBy("index").collect()
    assert [(r.expected_frame, r.aligned_frame, r.offset_frames) for r in rows] == [(0, 0, 0), (32, 36, 4), (64, 68, 4)]


def test_cycle_grid_and_tempo(spark):
    n = frame(spark, n=[70])
    assert [r.frame_idx for r in structure.cycle_grid(n, KEY, F.col("n"), F.lit(32).cast("long"), F.lit(0).cast("long")).orderBy("boundary").collect()] == [0, 32, 64]
    assert [r.frame_idx for r in structure.cycle_grid(n, KEY, F.col("n"), F.lit(32).cast("long"), F.lit(0).cast("long"), True).orderBy("boundary").collect()] == [0, 32, 64, 70]
    tempo = one(structure.tempo_set(frame(spark, t=np.arange(10) * 0.6, bpm=[100.0] * 10), KEY, "bpm", "t"))
    assert (tempo.half_bpm, tempo.primary_bpm, tempo.double_bpm) == (50, 100, 200) and tempo.confidence > 0.99


def test_repetition(spark):
    rng = np.random.default_rng(1)
    parts = {c: rng.normal(size=(16, 4)) for c in "ABC"}
    x = np.concatenate([parts[c] for c in "ABAC"]).tolist()
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate(x)], "track string, frame_idx long, features array<double>")
    profile = structure.lag_profile(df, KEY, 11, 48)
    best = structure.period_candidates(profile, KEY, "similarity", 5, 4)
    pairs = structure.repetition_pairs(structure.zscore(df, KEY), best, KEY, step_s=0.5, block=11).collect()
    assert pairs and max(pairs, key=lambda r: r.similarity).lag_s == 16.0
    first = min(pairs, key=lambda r: r.a_start)
    # a frame's time is the middle of a window of two steps, less half a step
    assert all(math.isclose((r.a_start / 0.5) % 1, 0.5) and math.isclose(r.b_start - r.a_start, r.lag_s) and math.isclose(r.a_end - r.a_start, 5.5) and r.b_end <= 32.5 for r in pairs) and first.a_start >= 0.25
    blocks = structure.block_similarity(df, KEY, 32, 8).orderBy("i").collect()
    assert math.isclose(blocks[0].similarity, 1.0) and blocks[-1].similarity == -1.0


# --- rhythm


def clicks(bpm: float, seconds: float, hop: float = 0.02) -> np.ndarray:
    y = np.zeros(int(seconds / hop))
    y[np.rint(np.arange(0, seconds, 60 / bpm) / hop).astype(int)[:-1]] = 1.0
    return y


def test_beat_grid(spark):
    env = frame(spark, frame_idx=np.arange(1200), value=clicks(120, 24))
    best, beats, bars = rhythm.beat_grid(env, KEY)
    assert abs(one(best).bpm - 120) < 4
    cut = frame(spark, cut_id=[1], start=[3.08], end=[9.02])
    got = one(rhythm.align_cuts(cut, beats, bars, KEY, 120.0, "beat"))
    assert math.isclose(got.start, 3.0) and got.start_kind == "beat" and math.isclose(got.end, 9.0)
    kept = one(rhythm.align_cuts(frame(spark, cut_id=[1], start=[3.08], end=[3.09]), beats, bars, KEY, 120.0, "beat"))
    assert (kept.start, kept.end, kept.start_kind) == (3.08, 3.09, "exact")


def test_cut_modes(spark):
    """The quiet place is taken edge by edge, and never at the price of the range of bars and beats."""
    grid = lambda *t: frame(spark, time_s=list(t))
    low = dict(start_low=[3.2], start_drop_db=[9.0], end_low=[9.3], end_drop_db=[9.0])
    cut = lambda start, end, **more: frame(spark, cut_id=[1], start=[start], end=[end], **(low | more))
    edges = lambda r: (round(r.start, 6), round(r.end, 6), r.start_kind, r.end_kind)
    run = lambda c, beats, mode, **more: edges(one(rhythm.align_cuts(c, beats, grid(100.0), KEY, 120.0, mode, **more)))
    assert run(cut(3.08, 9.02), grid(3.0), "recommended", low_energy=True) == (3.0, 9.3, "beat", "low-energy")
    assert run(cut(3.08, 9.02, end_drop_db=[3.9]), grid(3.0), "recommended", low_energy=True) == (3.0, 9.02, "beat", "exact")
    # the quiet end lies before the start that the beat gives: the beat stays
    assert run(cut(3.08, 3.3, start_low=[2.9], end_low=[2.95]), grid(3.0), "recommended", low_energy=True) == (3.0, 3.3, "beat", "exact")
    # 4 ms away is no other place
    assert run(cut(3.08, 9.02, end_low=[9.024]), grid(50.0), "recommended", low_energy=True) == (3.2, 9.02, "low-energy", "exact")
    assert run(cut(3.08, 9.02), grid(3.0), "low-energy") == (3.2, 9.3, "low-energy", "low-energy")
    assert run(cut(3.08, 9.02, end_low=[3.21]), grid(3.0), "low-energy") == (3.08, 9.02, "exact", "exact")
    assert run(cut(3.08, 9.02), grid(3.0), "vocal", phrases=grid(2.5, 9.5, 11.0)) == (2.5, 9.5, "vocal", "vocal")
    assert run(cut(3.08, 9.02), grid(3.0), "vocal", phrases=grid(6.0)) == (3.08, 9.02, "exact", "exact")


def test_long_series(spark):
    """30,000 rows in one series: work in proportion, not with the square."""
    import time

    n = 30_000
    rows = spark.range(n).select(F.lit("t").alias("track"), (F.col("id") * 0.01).alias("time_s"), F.col("id").alias("frame_idx"), F.lit(220.0).alias("selected_f0_hz"), F.lit(0.9).alias("selected_confidence"))
    began = time.time()
    hit = matching.nearest(rows.select("track", "time_s"), rows.where("frame_idx % 10 = 0").select("track", F.col("time_s").alias("at")), KEY, "time_s", "at")
    assert hit.where("abs(at - time_s) <= 0.0901").count() == n
    kept = series.decimate(rows, KEY, "time_s", ["frame_idx"], 0.05)
    assert kept.count() == n // 5 and kept.agg(F.max("frame_idx")).first()[0] == n - 5
    assert pitch.movements(rows, KEY).count() == 0
    assert time.time() - began < 60


def test_low_energy(spark):
    t = np.round(np.arange(0, 6, 0.01), 2)
    rms = np.where((np.abs(t - 2) < 0.08) | (np.abs(t - 4.1) < 0.08), 0.01, 0.5)
    got = one(rhythm.low_energy_time(frame(spark, cut_id=[1], time=[2.2], raw_rms=[0.5]), frame(spark, t=t, rms=rms), KEY, "time"))
    assert abs(got.low_time - 2) < 0.09 and got.drop_db > 10


# --- boundaries and sections


def test_consensus_boundaries(spark):
    df = frame(spark, t=[10.0, 11.0, 30.0, 1.0], confidence=[0.5, 0.7, 0.9, 0.9], kind=["mix", "stem", "mix", "mix"])
    rows = boundaries.consensus_boundaries(df, KEY, F.lit(60.0)).orderBy("t").collect()
    assert len(rows) == 2 and math.isclose(rows[0].t, (10 * 0.5 + 11 * 0.7) / 1.2) and math.isclose(rows[0].confidence, 0.6 * 0.72 + 0.08)


def test_change_points(spark):
    t = np.arange(0, 60, 0.55)
    db = np.where(t < 20, -40.0, np.where(t < 40, -10.0, -30.0)) + 0.05 * np.sin(t)
    rows = boundaries.mix_change_points(frame(spark, t=t, db=db, zcr=0.1 * np.ones(len(t))), KEY, F.lit(60.0)).orderBy("t").collect()
    assert len(rows) == 2 and abs(rows[0].t - 20) < 0.6 and rows[0].confidence == 1.0


def test_section_labels(spark):
    n = 4500
    logit = np.full(n, -800.0)
    logit[[1500, 3000]] = 8.0
    fl = np.zeros((n, 10))
    fl[:1500, 2] = fl[1500:3000, 8] = fl[3000:, 9] = 5.0
    df = spark.createDataFrame([("t", k, float(logit[k]), fl[k].tolist()) for k in range(n)], "track string, frame_idx long, section_logit double, function_logits array<double>")
    cuts = sections.section_boundaries(df, KEY)
    assert sorted(r.frame_idx for r in cuts.collect()) == [1500, 3000]
    rows = sections.label_sections(df, cuts, KEY).orderBy("section").collect()
    assert [r.label for r in rows] == ["intro", "verse", "chorus"] and math.isclose(rows[-1].end_s, 45.0)


def test_local_maxima_filter(spark):
    df = frame(spark, frame_idx=np.arange(5), v=[0.0, 1.0, 0.2, 2.0, 0.1])
    assert [r.v for r in sections.local_maxima_filter(df, KEY, "v", 3).orderBy("frame_idx").collect()] == [0, 1, 0, 2, 0]
    with pytest.raises(ValueError):
        sections.local_maxima_filter(df, KEY, "v", 4)


def test_padding(spark):
    df = spark.createDataFrame([("t", k, [1.0, 2.0]) for k in range(3)], "track string, frame_idx long, bands array<float>")
    got = sections.pad_frames(df, df.groupBy("track").agg(F.count("*").alias("frames")), KEY, 2, 5, 10).orderBy("frame_idx").collect()
    assert [r.bands[0] for r in got] == [1, 1, 1, 0, 0]


# --- voice


def test_phrases(spark):
    t = np.arange(0.05, 18, 0.05)
    on = ((t > 2) & (t < 5)) | ((t > 7) & (t < 10)) | ((t > 12) & (t < 16))
    rows = voice.phrases(frame(spark, t=t, db=np.where(on, -10.0, -70.0), duration=np.full(len(t), 18.0)), KEY)
    assert rows.count() == 3 and voice.phrase_boundaries(rows, KEY).count() == 6


def test_register(spark):
    base = dict(start_s=[0.0, 1.0], end_s=[0.9, 2.0])
    jump = frame(spark, **base, median_f0_hz=[200.0, 260.0], praat_cpps_db=[10.0, 5.0], praat_hnr_cc_db=[20.0, 12.0])
    got = one(voice.register_candidates(jump, KEY))
    assert got.changed_feature_count == 3 and math.isclose(got.time_s, 0.95)
    assert voice.register_candidates(frame(spark, **base, median_f0_hz=[200.0, 260.0]), KEY).count() == 0
    assert voice.register_candidates(frame(spark, **base, median_f0_hz=[200.0, 200.0], praat_f1_hz=[400.0, 900.0]), KEY).count() == 0


def test_modulation(spark):
    cents = 35 * np.sin(2 * np.pi * 6 * T)
    df = frame(spark, time_s=T, f0_hz=220 * 2 ** (cents / 1200), confidence=np.full(len(T), 0.9))
    rows = {round(r.time_s, 2): r for r in voice.modulation(df, KEY).collect()}
    assert rows[1.0].extent_cents_p95_p05 > 55
    assert abs(dsp.vibrato_rate(T, cents) - 6) <= 1
    grid = one(voice.vibrato_rate_grid(frame(spark, t=T, r=cents), KEY))
    assert grid.rate_hz == 6.0 and abs(grid.amplitude - 35) < 1


def test_separation(spark):
    x = np.sin(np.arange(1000) / 7)
    good = frame(spark, sample_idx=np.arange(1000), source=x, vocals=0.6 * x, accompaniment=0.4 * x)
    assert one(voice.separation_report(good, KEY)).valid
    silent = one(voice.separation_report(good.withColumn("vocals", F.lit(0.0)), KEY))
    assert not silent.valid and silent.warnings == ["vocal stem is silent"]


def test_chronicle_states_first(spark):
    span = lambda a: frame(spark, start_s=[a], end_s=[a + 1])
    rows = voice.chronicle(span(1.0), span(1.0), span(0.5), KEY).orderBy("entry").collect()
    assert [r.kind for r in rows] == ["register", "state", "movement"]


# --- alignment and text


def test_edit_alignment(spark):
    assert [o for o, _, _ in alignment.aligned(list("abc"), list("axc"))] == ["=", "S", "="]
    df = spark.createDataFrame([("じゅげむ", "じゅけむ"), ("", "あ")], "r string, h string")
    rows = df.select(alignment.mora_alignment(F.col("r"), F.col("h")).alias("a"))
    m = alignment.error_metrics(F.col("a"))
    got = rows.select("a", *[c.alias(n) for n, c in m.items()]).collect()
    assert [x.op for x in got[0].a] == ["=", "S", "="] and math.isclose(got[0].error_rate, 1 / 3)
    assert got[1].error_rate is None and got[1].insertions == 1


def slow_alignment(ref, hyp):
    cost = {(0, 0): (0, None)}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            if i and j and ref[i - 1] == hyp[j - 1]:
                cost[i, j] = cost[i - 1, j - 1][0], "="
            elif i or j:
                cost[i, j] = min((cost[p][0] + 1, o) for p, o in (((i - 1, j), "D"), ((i, j - 1), "I"), ((i - 1, j - 1), "S")) if min(p) >= 0)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        o = cost[i, j][1]
        out.append(o)
        i, j = i - (o != "I"), j - (o != "D")
    return out[::-1]


def test_edit_alignment_ties():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.choice(list("ab"), rng.integers(0, 7)).tolist() for _ in range(2))
        assert [o for o, _, _ in alignment.aligned(a, b)] == slow_alignment(a, b)


def test_lines_keep_their_digits(spark):
    """Each line loses the spaces around it, and none of its characters."""
    df = spark.createDataFrame([("0 a \n 1\u00a0\n\n12 b\u3000\r\n3",)], "t string")
    got = one(df.select(text.lines(F.col("t")).alias("x"), text.lines(F.col("t"), "\n").alias("y")))
    assert got.x == ["0 a", "1", "12 b", "3"] and got.y == ["0 a", "1", "12 b\u3000\r", "3"]


def test_partition(spark):
    lines = ["あ", "い", "う"] * 2 + ["あ", "う"]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    got = one(alignment.partition_lines(df, "text", 3, 3))
    assert [len(c.split("\n")) for c in got.chunks] == [3, 3, 2]
    with pytest.raises(ValueError):
        alignment.partitioned(["a"], ["a"], 2, 3, 3)


def test_kana(spark):
    df = spark.createDataFrame([("ジュゲム、じゅげむ！", 6), ("きょう", 2), ("がっこう", 4), ("スーパー", 4), ("ティファ", 2)], "t string, n int")
    rows = df.select("n", text.normalize_kana(F.col("t")).alias("k")).select("n", "k", text.morae(F.col("k")).alias("m")).collect()
    assert rows[0].k == "じゅげむじゅげむ" and all(len(r.m) == r.n for r in rows)


def test_tokens_versions_times(spark):
    df = spark.createDataFrame([("Don’t stop 日本語 now’s", "tool 6.3.10 (x)", 75.256)], "t string, v string, s double")
    got = one(df.select(text.tokens(F.col("t")).alias("t"), text.version_at_least(F.col("v"), F.lit("6.3.9")).alias("v"), text.time_code(F.col("s")).alias("s"), text.named_number(F.lit("cpps = 7.5 dB"), "cpps").alias("c")))
    assert got.t == ["don't", "stop", "日本語", "now's"] and got.v and got.s == "01:15.26" and got.c == 7.5


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, -0.5, float("nan"), "x")], "a double, b double, c double, d string")
    got = one(df.select(scalar.round_half_even(F.col("a")).alias("even"), scalar.round_half_up(F.col("a")).alias("up"), scalar.wrap_residual(F.lit(-60.0), F.lit(100.0)).alias("wrap"), scalar.finite(F.col("c")).alias("nan"), scalar.finite(F.col("d")).alias("text"), scalar.or_default(F.lit(0.0), 0.05).alias("default"), scalar.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))).alias("cos"), scalar.truncate(F.lit(-1.7)).alias("trunc")))
    assert (got.even, got.up, got.wrap, got["nan"], got.text, got.default, got.cos, got.trunc) == (2.0, 3, 40.0, None, None, 0.05, 0.0, -1)


# --- signals


def test_voice_measures_of_a_tone(spark):
    tone = generators.chunks(generators.sine(spark, "t", 220.0, 0.5), 1000)
    frames = dsp.framed(tone, KEY, 960, 320)
    assert frames.count() == (8000 - 960) // 320 + 1
    row = dsp.voice_series(frames.withColumn("f0_hz", F.lit(220.0)), 16_000).first()
    assert math.isclose(row.rms_dbfs, 20 * math.log10(0.35 / math.sqrt(2)), abs_tol=0.2) and row.autocorrelation_hnr_db > 10
    points = frame(spark, time_s=[0.01, 0.1, 0.2])
    at = dsp.frames_at(points, tone, KEY, 16_000).orderBy("time_s").collect()
    assert [round(r.time_s, 2) for r in at] == [0.1, 0.2] and len(at[0].frame) == 960


def test_browser_metrics():
    t = np.arange(2048) / 16_000
    m = dsp.browser_metrics(0.35 * sum(np.sin(2 * np.pi * 200 * k * t) / k for k in range(1, 6)), 16_000)
    assert abs(m["f0"] - 200) < 3 and m["confidence"] > 0.6


def test_filterbank_and_quantizer():
    bank = dsp.log_filterbank()
    assert bank.shape[0] == 81 and np.allclose(bank.sum(axis=1), 1, atol=1e-5)
    assert dsp.quantize_stem(np.array([0.5, -0.5, 1.0, 1.0])).tolist() == [0, 32444]
    assert dsp.log_spectrogram(np.zeros(4410, np.int16)).shape == (10, 81)


def test_prominent_peaks(spark):
    y = np.array([0, 1, 0, 3, 0, 0.1, 0, 2, 2, 0.0])
    rows = dsp.prominent_peaks(frame(spark, frame_idx=np.arange(10), v=y), KEY, "v", 2, 0.5).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == [1, 3, 7]


def test_template_alignment_brute(spark):
    """Places nearer than the radius to two places of the grid, against the choice step by step."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([("t", "v", k, [float(v) for v in r]) for k, r in enumerate(x)], "track string, view string, frame_idx long, features array<double>")
    z = (x - x.mean(0)) / x.std(0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    score = [float(np.mean(np.sum(z[2:6] * z[s : s + 4], axis=1))) for s in range(57)]
    want, before = [], -99
    for k in range(100):
        place = 2 + 7 * k
        near = [s for s in range(57) if abs(s - place) <= 5 and s >= before + 4]
        if not near:
            break
        before = min(near, key=lambda s: (-score[s], abs(s - place), s))
        want.append((k, place, before, before - place, round(score[before], 9)))
    got = structure.template_alignment(df, KEY, anchor=2, period=7, length=4, radius=5).orderBy("index").collect()
    assert [(r["index"], r.expected_frame, r.aligned_frame, r.offset_frames, round(r.combined_similarity, 9)) for r in got] == want and len(want) > 5


def test_log_bands_and_stft(spark):
    """Frames put together from chunks equal those of the whole signal."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=5_000) * 3_000).astype(np.int16)
    chunks = spark.createDataFrame([("t", a, x[a : a + 1_500].tolist()) for a in range(0, 5_000, 1_500)], "track string, start_sample long, samples array<int>")
    got = np.stack([r.bands for r in dsp.log_bands(chunks, KEY).orderBy("frame_idx").collect()])
    want = dsp.log_spectrogram(x.astype(float))
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)
    levels = dsp.stft(chunks, KEY, 512, 200).orderBy("frame_idx").collect()
    assert len(levels) == (5_000 - 512) // 200 + 1
    assert np.allclose(levels[3].bins, 20 * np.log10(np.maximum(1e-10, np.abs(np.fft.rfft(x[600:1_112] * np.hanning(512))))))


def test_partition_of_uncuttable(spark):
    """A text that can't be cut has a reason and doesn't end the job; others are cut."""
    df = spark.createDataFrame([(1, "ア\nイ\nあ\nい"), (2, "ア"), (3, None)], "id int, text string")
    got = {r.id: r for r in alignment.partition_lines(df, "text", 2, 2, 1).collect()}
    assert got[1].chunks == ["ア\nイ", "あ\nい"] and got[1].chunks_error is None
    assert got[2].chunks is None and got[2].chunks_error and got[3].chunks is None


def test_modulation_rate(spark):
    t = np.arange(0, 3, 0.01)
    f0 = 440 * 2 ** (40 * np.sin(2 * np.pi * 5 * t) / 1200)
    df = spark.createDataFrame([("t", float(a), float(b), 0.9) for a, b in zip(t, f0, strict=True)], "track string, time_s double, f0_hz double, confidence double")
    rates = [r.rate_hz for r in voice.modulation(df, KEY).where("time_s between 0.6 and 2.4").collect()]
    assert len(rates) > 150 and all(abs(r - 5) < 1.3 for r in rates)

"""Queries over whole series, against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from ordina.operators import alignment, pitch, structure
from ordina.plans import inputs, queries


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Two tracks of 70 and 45 vectors of 64 components."""
    rng = np.random.default_rng(3)
    x = {0: rng.normal(size=(70, 64)).astype(np.float32), 1: rng.normal(size=(45, 64)).astype(np.float32)}
    x[0][35:] += x[0][:35]
    rows = [(1000 * k + i, [float(v) for v in r], k) for k, m in x.items() for i, r in enumerate(m)]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, {k: m.astype(np.float64) for k, m in x.items()}


def rows_of(spark, path: str, name: str) -> list:
    return queries.QUERIES[name].frame(spark, path).collect()


def cosines(x: np.ndarray) -> np.ndarray:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def profile(x: np.ndarray, lag: int) -> float:
    return float(np.diag(cosines((x - x.mean(0)) / x.std(0)), lag).mean())


def test_all_frames_and_components(spark, vectors):
    path, x = vectors
    got = {(r.track, r.frame_idx): r["first"] for r in rows_of(spark, path, "agg12_zscore")}
    assert len(got) == 115 and np.isclose(got[0, 69], (x[0][69, 0] - x[0][:, 0].mean()) / x[0][:, 0].std(), atol=1e-4)
    got = {(r.track, r.lag_frames): r for r in rows_of(spark, path, "agg10_lag_profile")}
    assert all(r.support == len(x[t]) - lag and np.isclose(r.similarity, profile(x[t], lag), atol=1e-4) for (t, lag), r in got.items()) and len(got) == 24
    table = {(r.track, r.lag_frames): r.combined_similarity for r in rows_of(spark, path, "snk04_lag_table")}
    assert np.isclose(table[0, 12], profile(x[0], 12), atol=1e-4)
    views = {(r.track, r.lag_frames): r.combined_similarity for r in rows_of(spark, path, "agg11_combined_views")}
    assert np.isclose(views[1, 7], (2 * profile(x[1][:, :6], 7) + profile(x[1][:, 6:], 7)) / 3, atol=1e-4)
    pairs = {(r.track, r.i, r.lag): r.similarity for r in rows_of(spark, path, "jn11_similarity_pairs")}
    assert len(pairs) == sum(len(m) - lag for m in x.values() for lag in range(1, 6)) and np.isclose(pairs[0, 60, 5], cosines(x[0])[60, 65], atol=1e-4)
    blocks = {(r.track, r.i): r.similarity for r in rows_of(spark, path, "agg29_block_similarity")}
    assert len(blocks) == 115 and np.isclose(blocks[0, 50], np.diag(cosines(x[0]), 5)[50:54].mean(), atol=1e-4)
    shifts = {(r.track, r.start): r.similarity for r in rows_of(spark, path, "dsp16_template_similarity")}
    assert max(s for t, s in shifts if t == 0) == 66 and np.isclose(shifts[0, 66], np.mean([cosines(x[0])[3 + k, 66 + k] for k in range(4)]), atol=1e-4)
    dtw = {(r.track, r.i, r.j): r.distance for r in rows_of(spark, path, "dp05_cycle_distances")}
    cost, steps = structure.dtw(x[0][:10], x[0][60:])
    assert len(dtw) == 21 + 6 and np.isclose(dtw[0, 0, 6], cost / steps, atol=1e-4)
    places = {(r.track, r["index"]): r.expected_frame for r in rows_of(spark, path, "top09_template_alignment")}
    assert places[0, 6] == 60
    periods = {(r.track, r.lag_frames): r.combined_similarity for r in rows_of(spark, path, "top01_period_candidates")}
    assert periods and all(np.isclose(v, profile(x[t], lag), atol=1e-4) for (t, lag), v in periods.items())


@pytest.mark.parametrize("block", [512, 16])
def test_all_pairs(spark, vectors, block):
    path, x = vectors
    if block == 512:
        got = rows_of(spark, path, "agg13_triangle_summary")
    else:
        got = structure.cosine_summary(spark.createDataFrame([(t, i, r.tolist()) for t, m in x.items() for i, r in enumerate(m)], "track long, frame_idx long, features array<double>"), ["track"], block).collect()
    for r in got:
        s = cosines(x[r.track])[np.triu_indices(len(x[r.track]), 1)]
        assert r.pairs == len(s) and np.allclose([r["mean"], r["median"], r["max"]], [s.mean(), np.median(s), s.max()], atol=1e-4)
    assert len(got) == 2


def test_whole_turns(spark, tmp_path):
    long = "a word of a turn that goes on for more than forty characters "
    turns = [long + "and ends so", long + "but ends otherwise", "déjà vu\nà la carte", "deja vu\n\U0001f600 la carte", "", None]
    spark.createDataFrame([(1, k, "user", x) for k, x in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.errors, r.reference_units) for r in rows_of(spark, str(tmp_path), "dp01_edit_errors")}
    brute = lambda a, b: sum(op != "=" for op, _, _ in alignment.aligned(list(a), list(b)))
    assert got == {k: (brute(a, b), len(a)) for k, (a, b) in enumerate(zip(turns[:4], turns[1:5], strict=True))}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """40 events of user 1 and 120 of user 2."""
    rows = [(1000 * u + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), u, LABELS[(u + i) % 5], float(i), f'{{"k": {(3 * i + u) % 10}}}') for u, n in ((1, 40), (2, 120)) for i in range(n)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


LABELS = ["view", "click", "error", "errorless", "errors"]


def test_disagreement_to_the_last_digit(spark, events):
    """Estimates and their distance are those of the C library (and so of the SQL), bit for bit: at 25 cents the last digit decides."""
    rows = pitch.consensus(inputs.series(spark, events, "estimates")).collect()
    assert len(rows) == 160
    for r in rows:
        value, k = float(r.frame_idx), (3 * r.frame_idx + r.track) % 10
        p = None if LABELS[(r.track + r.frame_idx) % 5] == "error" else 220.0 * math.pow(2.0, ((r.track % 12) * 1e2 + value % 37.0) / 12e2)
        c = 220.0 * math.pow(2.0, ((r.track % 12) * 1e2 + (k % 9) * 9.0) / 12e2)
        assert (r.pyin_hz, r.crepe_hz) == (p, c) and r.disagreement_cents == (p and abs(1200 * math.log2(p / c)))


def test_all_spans(spark, events):
    got = {(r.track, r.i, r.j): r.distance for r in rows_of(spark, events, "jn10_mora_distances")}
    assert len(got) == 40 * 39 // 2 + 120 * 119 // 2
    for (u, i, j), distance in got.items():
        a, b = LABELS[(u + i) % 5], LABELS[(u + j) % 5]
        assert np.isclose(distance, sum(op != "=" for op, _, _ in alignment.aligned(list(a), list(b))) / max(len(a), len(b)), atol=1e-4)


def test_whole_tracks(spark, events):
    """User 2 has 120 events: 37.2 s."""
    t = {u: [i * 0.31 + ((3 * i + u) % 10 % 7) / 100 for i in range(n) if (3 * i + u) % 10 % 5 < 3] for u, n in ((1, 40), (2, 120))}
    got = {u: sorted(r.t for r in rows_of(spark, events, "prj05_reviewed_boundaries") if r.track == u) for u in t}
    assert np.allclose(got[2], [x for x in t[2] if x > 0], atol=1e-4) and len(got[1]) == 2
    rows = rows_of(spark, events, "prj06_sections")
    for u, end in ((1, 12.4), (2, 37.2)):
        found = sorted((r.start_s, r.end_s) for r in rows if r.track == u)
        assert np.allclose([a for a, _ in found], sorted({0.0, *t[u]}), atol=1e-4) and np.isclose(found[-1][1], end)
    found = [r.t for r in rows_of(spark, events, "clu01_consensus_boundaries") if r.track == 2]
    last = t[2][-1]
    assert last > 34.2 and 33 < max(found) <= 34.2

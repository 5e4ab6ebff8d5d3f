"""The stages over tables: each runs on tables of the kind it names, and its parameters follow the configuration."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from ordina.plans import inputs, provenance, stages

DATA = Path("/root/testdata/sf0.001")
CONFIG = {"id": "t", "language": "ja", "analysis": {"pitch": {"consensus_weak_cents": 60.0}, "tuning": {"edos": [12, 31]}, "structure": {"min_period_s": 1.0, "max_period_s": 3.0}, "repetition": {"template_end_s": 1.0}}}


def test_parameters():
    assert len(stages.RUNS) == 13 and set(stages.DEFAULTS) == set(stages.RUNS) == set(stages.PACKAGES)
    made = stages.stages(CONFIG, "base")
    assert set(made) == set(stages.RUNS) - {"align"}
    assert made["pitch"].parameters["consensus_weak_cents"] == 60.0 and made["pitch"].parameters["consensus_strong_cents"] == 25.0
    assert made["pitch"].models == {"torchcrepe": "full"} and made["asr"].models == {"faster-whisper": "base"} and made["asr"].parameters["modes"] == ["auto", "ja"]
    assert stages.stage("pitch", {"analysis": {"pitch": {"estimators": "pyin"}}}).models == {}
    with pytest.raises(ValueError):
        stages.stage("align", CONFIG)
    with pytest.raises(KeyError):
        stages.stage("other", CONFIG)
    aligned = CONFIG | {"analysis": {"alignment": {"dictionary": "d", "acoustic_model": "m"}}}
    assert stages.stage("align", aligned).models["acoustic_model"] == "m" and stages.stage("align", aligned).parameters["language"] == "ja"


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_chain(spark, tmp_path):
    """pitch, targets, tuning and their comparison, one after the other, written and read back."""
    t = lambda name: inputs.series(spark, str(DATA), name)
    record = provenance.build("x.wav", "0f" * 32, "test", versions={})
    made = stages.stages(CONFIG)

    def run(name: str, tables: dict) -> dict:
        out = f"{tmp_path}/{name}"
        states = provenance.run_stage(spark, made[name], tables, out, record)
        assert [s["status"] for s in states] == ["running", "success"], states[-1]
        return {n: spark.read.parquet(f"{out}/{n}") for n in states[-1]["outputs"]}

    e = t("estimates")
    fused = run("pitch", {"pyin": e.select("track", "frame_idx", "time_s", "pyin_hz", "pyin_confidence"), "crepe": e.select("track", "frame_idx", "crepe_hz", "crepe_periodicity")})
    assert fused["consensus"].count() == e.count()
    tones = t("tones").withColumnsRenamed({"f0_hz": "selected_f0_hz", "confidence": "selected_confidence", "evidence": "selected_source"})
    notes = run("targets", {"consensus": tones})["stable_notes"]
    models = run("tuning", {"stable_notes": notes})["models"]
    assert {r.edo for r in models.select("edo").distinct().collect()} == {12, 31}
    both = run("pitch-compare", {"mix_models": models, "vocals_models": models})["models"]
    assert both.count() == models.count() and both.where("abs(delta_weighted_rmse_cents) > 1e-12").count() == 0


def test_other_stages(spark, tmp_path):
    made = stages.stages(CONFIG)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 4))
    rows = [("t", v, k, [float(x) for x in base[k % 8] + 0.01 * rng.normal(size=4)]) for v in ("a", "b") for k in range(48)]
    features = spark.createDataFrame(rows, "track string, view string, frame_idx long, features array<double>")
    found = made["structure"].run(spark, {"features": features})
    assert found["periods"].orderBy("pick").first().lag_frames == 8 and found["agreement"].where("view_count = 2").count()
    peaks = made["repetition"].run(spark, {"features": features.where("view = 'a'").drop("view")})["peaks"]
    best = sorted(peaks.collect(), key=lambda r: -r.similarity)[:5]
    assert {r.frame_idx for r in best} == {8, 16, 24, 32, 40}
    bins = spark.createDataFrame([("t", 100.0, 1.0), ("t", 5000.0, 3.0)], "track string, hz double, power double")
    sound = made["acoustic"].run(spark, {"bins": bins, "pitch": spark.createDataFrame([("t", 440.0), ("t", None)], "track string, f0_hz double")})
    assert sound["bands"].first().energy_ge_4000_ratio == 0.75 and sound["voicing"].first().voiced_fraction == 0.5
    tone = [float(x) for x in 0.5 * np.sin(2 * np.pi * 200 * np.arange(960) / 16_000)]
    frames = spark.createDataFrame([("t", 0.0, tone, 200.0)] * 3, "track string, start_s double, frame array<double>, f0_hz double")
    assert made["voice-quality"].run(spark, {"frames": frames})["segments"].first().usable_frame_count == 3
    probe = spark.range(1)
    assert made["metadata"].run(spark, {"probe": probe}) == {"probe": probe}
    with pytest.raises(KeyError):
        made["separate"].run(spark, {"vocals": probe})
    assert provenance.planned(made, "full", True) == ["acoustic", "repetition", "asr"]

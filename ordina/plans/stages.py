"""The thirteen analysis stages over tables: their operators, parameters and models.

A stage takes DataFrames by name and gives DataFrames by name. Five run programs or networks outside Spark; these pass on
the table that the program left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.operators import dsp, pitch, selection, structure
from ordina.plans.provenance import Stage

#: The part of a track's configuration that a stage reads, and its parameters where the configuration has none.
SECTIONS = {"repetition": "repetition", "structure": "structure", "separate": "separation", "pitch": "pitch", "targets": "pitch_targets", "tuning": "tuning", "voice-quality": "voice_quality", "cycle-asr": "cycle_asr", "align": "alignment", "asr": "asr"}
DEFAULTS = {
    "metadata": {"skip_pitch": True},
    "acoustic": {"skip_pitch": False},
    "repetition": {"template_start_s": None, "template_end_s": None},
    "structure": {"sample_rate_hz": 16000, "frame_step_s": 0.25, "tempo_hop_length": 512, "min_period_s": 20.0, "max_period_s": 40.0, "anchor_start_s": 0.0, "alignment_template_duration_s": 22.0, "alignment_search_radius_s": 4.0, "top_k": 8},
    "separate": {"model": "htdemucs", "device": "cpu"},
    "pitch": {"estimators": "pyin,crepe", "crepe_model": "full", "sample_rate_hz": 16000, "hop_length": 160, "fmin_hz": 65.40639132514966, "fmax_hz": 2006.0, "device": "cpu", "crepe_periodicity_threshold": 0.21, "pyin_fallback_confidence": 0.80, "consensus_strong_cents": 25.0, "consensus_weak_cents": 50.0},
    "targets": {"window_s": 0.5, "max_slope_cents_per_s": 100.0, "max_detrended_std_cents": 40.0, "min_duration_s": 0.15, "min_confidence": 0.5},
    "tuning": {"edos": [12, 19, 24, 31]},
    "voice-quality": {"sample_rate_hz": 16000, "frame_length_ms": 60.0, "hop_length_ms": 20.0, "hnr_search_fraction": 0.15, "tilt_min_hz": 200.0, "tilt_max_hz": 5000.0, "min_rms_dbfs": -70.0, "praat_min_version": "6.4.39", "require_praat": True},
    "cycle-asr": {"device": "cpu", "compute_type": "int8", "boundary_source": "aligned_cycles", "reference_cycle_lines": 10},
    "align": {"dictionary": None, "acoustic_model": None, "g2p_model": None, "segment_source": "full_track", "boundary_source": None, "reference_cycle_lines": None, "segment_start_s": None, "segment_end_s": None, "beam": None, "retry_beam": None},
    "pitch-compare": {},
    "asr": {"device": "cpu", "compute_type": "int8"},
}
#: Packages whose versions belong to a stage's record.
PACKAGES = {
    "metadata": ("librosa", "numpy", "scipy", "matplotlib", "mutagen"), "acoustic": ("librosa", "numpy", "scipy", "matplotlib", "mutagen"), "repetition": ("librosa", "numpy", "scipy"),
    "structure": ("librosa", "numpy"), "separate": ("demucs", "librosa", "numpy", "soundfile"), "pitch": ("librosa", "numpy", "torchcrepe", "torch", "torchaudio"), "targets": ("numpy",), "tuning": ("numpy",),
    "voice-quality": ("librosa", "numpy", "soundfile"), "cycle-asr": ("faster-whisper", "av", "mutagen", "pykakasi"), "align": ("montreal-forced-aligner", "mutagen", "pykakasi"), "pitch-compare": (), "asr": ("faster-whisper", "av", "mutagen"),
}
KEY = ["track"]
Tables = dict[str, DataFrame]


def parameters(stage: str, config: dict) -> dict:
    """A stage's parameters for a track: those of its configuration over the defaults; transcription and alignment take the track's language."""
    given = config.get("analysis", {}).get(SECTIONS.get(stage, ""), {})
    own = DEFAULTS[stage] | given
    if stage in ("cycle-asr", "align"):
        own.setdefault("language", config.get("language"))
    if stage == "asr":
        own.setdefault("modes", ["auto", config.get("language")])
    if stage == "align" and not (own["dictionary"] and own["acoustic_model"]):
        raise ValueError(f"{config.get('id')}: alignment needs a dictionary and an acoustic model")
    return own


def models(stage: str, own: dict, model: str) -> dict:
    """The models a stage's results depend on."""
    named = {
        "separate": lambda: {"demucs": own["model"]},
        "pitch": lambda: {"torchcrepe": own["crepe_model"]} if "crepe" in own["estimators"].split(",") else {},
        "voice-quality": lambda: {"praat_min_version": own["praat_min_version"]},
        "align": lambda: {"backend": "montreal-forced-aligner"} | {k: own[k] for k in ("dictionary", "acoustic_model", "g2p_model")},
        "cycle-asr": lambda: {"faster-whisper": model},
        "asr": lambda: {"faster-whisper": model},
    }
    return named.get(stage, dict)()


def _outside(*names: str) -> Callable[[Tables, dict], Tables]:
    """What a program outside Spark left, under its names."""

    def run(tables: Tables, own: dict) -> Tables:
        if missing := [n for n in names if n not in tables]:
            raise KeyError(f"made outside Spark, give it as a table: {', '.join(missing)}")
        return {n: tables[n] for n in names}

    return run


def _acoustic(tables: Tables, own: dict) -> Tables:
    """bins (hz, power) and pitch (f0_hz) to shares of energy and voicing."""
    return {"bands": dsp.band_energy(tables["bins"], KEY), "voicing": selection.voicing(tables["pitch"], KEY)}


def _repetition(tables: Tables, own: dict) -> Tables:
    """features (frame_idx, features; frame_step_s apart) to places like the template."""
    step = own.get("frame_step_s", 0.25)
    anchor, end = round((own["template_start_s"] or 0.0) / step), round((own["template_end_s"] or 22.0) / step)
    like = selection.template_similarity(tables["features"], KEY, anchor, max(1, end - anchor)).withColumnRenamed("start", "frame_idx")
    return {"similarity": like, "peaks": dsp.prominent_peaks(like, KEY, "similarity", max(1, end - anchor), 0.02)}


def _structure(tables: Tables, own: dict) -> Tables:
    """features (view, frame_idx, features) to lag profile, periods and what the views agree on."""
    low, high = (max(1, round(own[k] / own["frame_step_s"])) for k in ("min_period_s", "max_period_s"))
    views = structure.lag_profile(tables["features"], [*KEY, "view"], low, high)
    profile = structure.combine_views(views, KEY)
    each = structure.period_candidates(views.withColumnRenamed("similarity", "combined_similarity"), [*KEY, "view"], top=own["top_k"])
    return {"profile": profile, "periods": structure.period_candidates(profile, KEY, top=own["top_k"]), "agreement": structure.view_agreement(each.select(*KEY, "view", "lag_frames"), KEY)}


def _pitch(tables: Tables, own: dict) -> Tables:
    """pyin (frame_idx, time_s, pyin_hz, pyin_confidence) and crepe (frame_idx, crepe_hz, crepe_periodicity) to the consensus."""
    fused = pitch.consensus(
        pitch.join_estimators(tables["pyin"], tables["crepe"], KEY), min_periodicity=own["crepe_periodicity_threshold"], fallback_confidence=own["pyin_fallback_confidence"],
        strong_cents=own["consensus_strong_cents"], weak_cents=own["consensus_weak_cents"])
    return {"consensus": fused, "summary": pitch.consensus_summary(fused, KEY)}


def _targets(tables: Tables, own: dict) -> Tables:
    """consensus to stable notes and movements."""
    frames = tables["consensus"].select(*KEY, "time_s", F.col("selected_f0_hz").alias("f0_hz"), F.col("selected_confidence").alias("confidence"), F.col("selected_source").alias("evidence"))
    notes = pitch.stable_segments(frames, KEY, window_s=own["window_s"], max_slope=own["max_slope_cents_per_s"], max_std=own["max_detrended_std_cents"], min_duration_s=own["min_duration_s"], min_confidence=own["min_confidence"])
    return {"stable_notes": notes, "movements": pitch.movements(tables["consensus"], KEY)}


def _tuning(tables: Tables, own: dict) -> Tables:
    found = pitch.tuning_models(tables["stable_notes"], KEY, own["edos"])
    return {"models": found, "ambiguity": pitch.tuning_ambiguity(found, KEY)}


def _voice(tables: Tables, own: dict) -> Tables:
    """notes' frames (start_s, frame, f0_hz) to the measures of each frame and their medians by note."""
    rate = own["sample_rate_hz"]
    return {"frames": dsp.voice_series(tables["frames"], rate, own["min_rms_dbfs"]), "segments": dsp.segment_voice_quality(tables["frames"], [*KEY, "start_s"], rate)}


def _compare(tables: Tables, own: dict) -> Tables:
    return {"models": pitch.compare_sources(tables["mix_models"], tables["vocals_models"], [*KEY, "edo"], "weighted_rmse_cents")}


RUNS: dict[str, Callable[[Tables, dict], Tables]] = {
    "metadata": _outside("probe"), "acoustic": _acoustic, "repetition": _repetition, "structure": _structure, "separate": _outside("vocals", "accompaniment"), "pitch": _pitch, "targets": _targets,
    "tuning": _tuning, "voice-quality": _voice, "cycle-asr": _outside("cycle_transcripts"), "align": _outside("alignments"), "pitch-compare": _compare, "asr": _outside("transcripts"),
}


def stage(name: str, config: dict, model: str = "small") -> Stage:
    """A stage for a track's configuration; an unknown name raises."""
    if name not in RUNS:
        raise KeyError(f"unknown stage: {name}; there are {', '.join(RUNS)}")
    own = parameters(name, config)

    def run(spark: SparkSession, tables: Tables) -> Tables:
        return RUNS[name](tables, own)

    return Stage(name, run, own, models(name, own, model))


def stages(config: dict, model: str = "small") -> dict[str, Stage]:
    """All stages that the configuration allows (alignment only with its models)."""
    align = config.get("analysis", {}).get("alignment", {})
    return {n: stage(n, config, model) for n in RUNS if n != "align" or (align.get("dictionary") and align.get("acoustic_model"))}

"""Readers, writers, provenance, and the registered queries against their oracles."""

from __future__ import annotations

import io
import json
import wave
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.plans import provenance, queries
from ordina.sources import generators, readers, writers


def wav(x: np.ndarray, rate: int = 8000, channels: int = 1, width: int = 2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(writers.pcm16(x) if width == 2 else x.tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(16000) / 9) * 0.5
    (tmp_path / "a.wav").write_bytes(wav(x))
    files = readers.binary(spark, f"{tmp_path}/*.wav")
    chunks = readers.decode(files, 16_000)
    assert chunks.agg(F.sum(F.size("samples"))).first()[0] == 32_000
    clip = readers.clip(chunks, 0.5, 1.0)
    assert clip.agg(F.sum(F.size("samples"))).first()[0] == 8_000 and clip.first().start_sample == 8_000
    tracks = readers.tracks(spark, [{"id": "a", "source": "a.wav", "expected_sha256": files.first().sha256, "language": "ja", "key": 1}, {"id": "b", "source": "b.wav", "expected_sha256": "0", "language": "ja"}])
    assert {r.id: r.verified for r in readers.verify(files, tracks).collect()} == {"a": True, "b": False}
    with pytest.raises(KeyError):
        readers.track(tracks, "c")
    with pytest.raises(ValueError):
        readers.tracks(spark, [{"id": "a"}])


def test_stereo(spark):
    df = spark.createDataFrame([(0, [0.1, 0.9, 0.2, 0.8])], "start_sample long, samples array<float>")
    got = {r.channel: [round(v, 1) for v in r.samples] for r in readers.deinterleave(df).collect()}
    assert got == {0: [0.1, 0.2], 1: [0.9, 0.8]}


def test_wav_round_trip(spark):
    df = spark.createDataFrame([([0.5, -0.5], [0.75, -0.75])], "a array<float>, b array<float>")
    raw = df.select(writers.wav_bytes(8000)("a", "b").alias("w")).first().w
    rate, x = readers._samples(bytes(raw))
    assert rate == 8000 and np.allclose(x[:, 0], [1, -1], atol=1e-3)


def test_lenient_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("time_s,f0\n0.1,\n0.2,x\n0.3,nan\n0.4,5\n")
    schema = T.StructType([T.StructField("time_s", T.DoubleType()), T.StructField("f0", T.DoubleType()), T.StructField("more", T.StringType())])
    rows = readers.csv(spark, f"{tmp_path}/t.csv", schema).orderBy("time_s").collect()
    assert [r.f0 for r in rows] == [None, None, None, 5.0]
    with pytest.raises(ValueError):
        readers.csv(spark, f"{tmp_path}/t.csv", schema, required=("gone",))


def test_alignments(spark, tmp_path):
    (tmp_path / "seg1.json").write_text(json.dumps({"tiers": {"Words": {"entries": [[0.0, 1.0, "hi"], [1.0]]}, "phones - x": {"entries": [[0.0, 0.5, "h"]]}}}))
    rows = readers.alignments(spark, f"{tmp_path}/*.json").collect()
    assert {(r.segment_id, r.kind, r.label) for r in rows} == {("seg1", "word", "hi"), ("seg1", "phone", "h")}


def test_text_and_lyrics(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n  two words \n")
    assert readers.text(spark, f"{tmp_path}/a.txt").first().text == "two words"
    df = spark.createDataFrame([("t", "jpn", 0, " a "), ("t", "eng", 1, "b"), ("u", "jpn", 0, "c")], "track string, language string, position int, text string")
    assert {r.track: r.text for r in readers.lyrics(df).collect()} == {"t": "b", "u": "c"}
    assert {r.track: r.text for r in readers.lyrics(df, any_language=False).collect()} == {"t": "b", "u": ""}


def test_tables_out(spark, tmp_path):
    cells = spark.createDataFrame([("t", 0, 1, 0.5), ("t", 1, 0, 0.5)], "track string, i int, j int, distance double")
    assert writers.matrix_table(cells, ["track"], 2).columns == ["track", "i", "0", "1"]
    writers.csv(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/out")
    assert {line for f in Path(f"{tmp_path}/out").glob("*.csv") for line in f.read_text().splitlines()} == {"a,b", "1,"}
    line = writers.compact_timeline(spark.createDataFrame([("t", 1.0, 2.0), ("t", 0.0, 3.0)], "track string, t double, v double"), ["track"], ["t", "v"], "pitch", "t").first().json
    assert json.loads(line) == {"pitch": [[0.0, 3.0], [1.0, 2.0]]}


def test_generators(spark):
    assert generators.regular_times(100, 12)[1] == 0.6 and generators.regular_times(100, 12, 2)[1] == 0.3
    drift = np.diff(generators.drift_times(90, 110, 12))
    assert drift[0] > drift[-1]
    assert generators.sine(spark, "a", 440, 2).count() == 32_000


SHA = "a" * 64


def test_provenance(spark, tmp_path):
    record = provenance.build("x.wav", SHA, "test", versions={})
    provenance.validate_provenance(record)
    with pytest.raises(ValueError):
        provenance.validate_provenance(record | {"source_sha256": "no"})
    with pytest.raises(ValueError):
        provenance.validate_status({"schema_version": 1, "status": "success", "warnings": [], "started_from": "source", "outputs": []})
    good = provenance.Stage("acoustic", lambda spark, inputs: {"rows": spark.range(3)})
    bad = provenance.Stage("asr", lambda spark, inputs: 1 / 0)
    empty = provenance.Stage("repetition", lambda spark, inputs: {})
    run = lambda s: [x["status"] for x in provenance.run_stage(spark, s, {}, str(tmp_path), record)]
    assert run(good) == ["running", "success"] and run(bad) == ["running", "failed"] and run(empty) == ["running", "failed"]
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 3
    stages = {s.name: s for s in (good, bad, empty)}
    assert provenance.planned(stages, "full", True) == ["acoustic", "repetition", "asr"]
    assert provenance.planned(stages, "full", False) == ["acoustic", "asr"]
    states = provenance.run_stage(spark, good, {}, str(tmp_path), record)
    assert provenance.runs(spark, states, record).count() == 2
    written = spark.read.text(f"{tmp_path}/status.json", wholetext=True).first()[0]
    assert '"status": "success"' in written and "\n" in written
    with pytest.raises(ValueError, match="analyzer"):
        provenance.build("x.wav", SHA, "  ", versions={})
    assert provenance.broken(record | {"parameters": []}, provenance.PROVENANCE) == ["parameters"]
    assert provenance.command_version("no-such-command", "-v") is None
    assert provenance.output_path("out", "t", "asr", "vocals", "small") == "out/t/vocals/asr-small"
    assert provenance.outputs(["b.csv", "x/status.json", "a.csv"]) == ["a.csv", "b.csv"]


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    """Each registered query runs; those with an oracle equal it."""
    import duckdb

    query = queries.QUERIES[name]
    got = query.frame(spark, str(DATA)).toPandas()
    assert len(got)
    if (sql := query.oracle()) is None:
        return
    db = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        db.execute(f"create view {table.stem} as select * from '{table}'")
    want = db.sql(sql).df()

    def rows(df: pd.DataFrame) -> list[tuple]:
        return sorted(tuple("" if pd.isna(v) else f"{v:.4f}" if isinstance(v, float) and not float(v).is_integer() else str(int(v)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_exports(spark, tmp_path):
    """Analysis export, track document and array tables hold what was given."""
    import json as js

    entries = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "track string, entry int, kind string")
    about = spark.createDataFrame([("a", 3.5), ("b", None)], "track string, duration_s double")
    got = {r.track: js.loads(r.json) for r in writers.analysis_export(entries, ["track"], about).collect()}
    assert got["a"] == {"duration_s": 3.5, "entries": [{"entry": 1, "kind": "y"}, {"entry": 2, "kind": "x"}]} and got["b"]["entries"] == []
    rows = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])], "track string, frame_idx long, features array<double>")
    writers.arrays(rows, f"{tmp_path}/arrays", ["track"])
    assert [r.features for r in spark.read.parquet(f"{tmp_path}/arrays").orderBy("frame_idx").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    writers.document([{"ü": 1}], f"{tmp_path}/document", spark)
    assert js.loads(spark.read.text(f"{tmp_path}/document", wholetext=True).first()[0]) == [{"ü": 1}]

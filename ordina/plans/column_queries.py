"""Registered queries of functions on columns, of readers and writers that are plain projections, and of the joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.functions import scalar, text
from ordina.operators import alignment, boundaries, dsp, matching, pitch, sections, selection, voice
from ordina.plans import provenance
from ordina.plans.registry import add, KEY
from ordina.sources import readers, writers


@add("sc06_signal_scalars", "track frame_idx hnr:d up:d even:d whole kept:d filled:d", """
 SELECT track, frame_idx, CASE WHEN k > 0 THEN 10 * log10(least(k / 100, 1 - 1e-9) / (1 - least(k / 100, 1 - 1e-9))) END AS hnr, floor(k * 0.5 - 20 + 0.5) AS up, round_even(k * 0.5::DOUBLE - 20, 0) AS even,
  CAST(trunc(value - 50) AS BIGINT) AS whole, round_even(value, 3) AS kept, CASE WHEN k = 0 THEN 3 ELSE k END AS filled FROM {ticks}""")
def _(t, spark, sf):
    x = F.col("k") * 0.5 - 20
    return t("ticks").select(
        "track", "frame_idx", scalar.hnr_db(F.col("k") / 100).alias("hnr"), scalar.round_half_up(x).cast("double").alias("up"), scalar.round_half_even(x).alias("even"),
        scalar.truncate(F.col("value") - 50).alias("whole"), scalar.export_number(F.col("value")).alias("kept"), scalar.or_default(F.col("k").cast("double"), 3.0).alias("filled"))


@add("sc12_finite", "track frame_idx number:d", "SELECT track, frame_idx, CASE WHEN k % 5 = 4 THEN k + 0.5 END AS number FROM {ticks}")
def _(t, spark, sf):
    k = F.col("k") % 5
    written = F.when(k == 0, "NaN").when(k == 1, "-Infinity").when(k == 2, F.col("event_type")).when(k == 3, "").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return t("ticks").select("track", "frame_idx", scalar.finite(written).alias("number"))


@add("sc15_dominance", "track frame_idx cancelled:d lead:d shared:d", """
 SELECT track, frame_idx, (vocals_db - instr_db) / 2 AS cancelled, vocals_db - instr_db AS lead, least(greatest(0, least(1, (vocals_db + 90) / 70)), greatest(0, least(1, (instr_db + 90) / 70))) AS shared FROM {cells}""")
def _(t, spark, sf):
    v, i = F.col("vocals_db"), F.col("instr_db")
    return t("cells").select("track", "frame_idx", scalar.center_cancel(v, i).alias("cancelled"), scalar.dominance_db(v, i).alias("lead"), scalar.overlap(v, i, F.lit(-20.0)).alias("shared"))


#: Ten letters that stand for the digits of a number: plain and small kana, closed morae and one kanji.
LETTERS = "カキャっンーァあゃ漢"


@add("str03_kana", "track frame_idx hiragana kana morae unread", f"""
 SELECT track, frame_idx, h AS hiragana, replace(h, '漢', '') AS kana, array_to_string(regexp_extract_all(replace(h, '漢', ''), '[っんー]|[^っんー][ゃぁ]*'), '|') AS morae, contains(h, '漢') AS unread
 FROM (SELECT track, frame_idx, translate(translate(CAST(k * 7919 + frame_idx AS VARCHAR), '0123456789', '{LETTERS}'), 'カキャンァ', 'かきゃんぁ') AS h FROM {{ticks}})""")
def _(t, spark, sf):
    rows = t("ticks").withColumn("x", F.translate((F.col("k") * 7919 + F.col("frame_idx")).cast("string"), "0123456789", LETTERS))
    rows = rows.withColumn("kana", text.normalize_kana(F.col("x")))
    return rows.select("track", "frame_idx", text.katakana_to_hiragana(F.col("x")).alias("hiragana"), "kana", F.concat_ws("|", text.morae(F.col("kana"))).alias("morae"), text.contains_kanji(F.col("x")).alias("unread"))


@add("dp03_mora_errors", "track frame_idx errors units rate:d", """
 WITH p AS (SELECT track, frame_idx, CAST(k * 7919 AS VARCHAR) AS a, CAST(lead(k) OVER (PARTITION BY track ORDER BY frame_idx) * 7919 AS VARCHAR) AS b FROM {ticks})
 SELECT track, frame_idx, levenshtein(a, b) AS errors, length(a) AS units, levenshtein(a, b) / length(a) AS rate FROM p WHERE b IS NOT NULL""")
def _(t, spark, sf):
    said = F.translate((F.col("k") * 7919).cast("string"), "0123456789", "かきくけこさしすせそ")
    rows = t("ticks").withColumn("a", said).withColumn("b", F.lead("a").over(Window.partitionBy(*KEY).orderBy("frame_idx"))).where("b is not null")
    m = alignment.error_metrics(F.col("r"))
    rows = rows.select("track", "frame_idx", alignment.mora_alignment(F.col("a"), F.col("b")).alias("r"))
    return rows.select("track", "frame_idx", (m["substitutions"] + m["deletions"] + m["insertions"]).alias("errors"), m["reference_units"].alias("units"), m["error_rate"].alias("rate"))


@add("snk08_edit_table", "track frame_idx errors units", """
 WITH p AS (SELECT track, frame_idx, label AS a, lead(label) OVER (PARTITION BY track ORDER BY frame_idx) AS b FROM {spans})
 SELECT track, frame_idx, levenshtein(a, b) AS errors, length(a) AS units FROM p WHERE b IS NOT NULL""")
def _(t, spark, sf):
    rows = t("spans").withColumn("b", F.lead("label").over(Window.partitionBy(*KEY).orderBy("frame_idx"))).where("b is not null")
    steps = rows.select("track", "frame_idx", alignment.edit_alignment(text.characters(F.array("label")), text.characters(F.array("b"))).alias("r"))
    table = writers.edit_table(steps, "r", ["track", "frame_idx"])
    return table.groupBy("track", "frame_idx").agg(F.count_if(F.col("op") != "=").alias("errors"), F.count_if(F.col("op") != "I").alias("units"))


@add("str09_tool_output", "track frame_idx major minor patch enough number:d clock", """
 SELECT track, frame_idx, k % 9 AS major, k % 13 AS minor, CAST(frame_idx AS INT) AS patch, row(k % 9, k % 13, frame_idx) >= row(4, 6, 10) AS enough, CASE WHEN k % 2 = 0 THEN k + 0.25 END AS number,
  printf('%02d:%05.2f', CAST(floor(time_s / 60) AS INT), time_s - 60 * floor(time_s / 60)) AS clock FROM {ticks}""")
def _(t, spark, sf):
    k = F.col("k")
    said = F.concat(F.lit("tool v"), F.concat_ws(".", (k % 9).cast("string"), (k % 13).cast("string"), F.col("frame_idx").cast("string")), F.lit(", f0 = "), F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".25 Hz"))).otherwise("--undefined--"))
    rows = t("ticks").withColumn("_v", text.version(said))
    return rows.select("track", "frame_idx", "_v.*", text.version_at_least(said, F.lit("4.6.10")).alias("enough"), text.named_number(said, "f0").alias("number"), text.time_code(F.col("time_s")).alias("clock"))


@add("arr02_equal_spans", "track frame_idx place unit start_s:d end_s:d", """
 SELECT track, frame_idx, CAST(i AS INT) AS place, substr(label, i + 1, 1) AS unit, start_s + (end_s - start_s) * i / length(label) AS start_s, start_s + (end_s - start_s) * (i + 1) / length(label) AS end_s
 FROM (SELECT *, unnest(range(length(label))) AS i FROM {spans})""")
def _(t, spark, sf):
    spans = text.equal_spans(text.characters(F.array("label")), F.col("start_s"), F.col("end_s"))
    return t("spans").select("track", "frame_idx", F.posexplode(spans).alias("place", "s")).select("track", "frame_idx", "place", F.col("s.label").alias("unit"), "s.start_s", "s.end_s")


@add("arr01_linear_resample", "track frame_idx place value:d", """
 SELECT track, frame_idx, i AS place, a + (b - a) * (p - floor(p)) AS value FROM (SELECT *, embedding[CAST(floor(p) AS INT) + 1]::DOUBLE AS a, embedding[least(CAST(floor(p) AS INT) + 2, len(embedding))]::DOUBLE AS b
  FROM (SELECT *, i * (len(embedding) - 1) / 4 AS p FROM (SELECT track, frame_idx, embedding, CAST(unnest(range(5)) AS INT) AS i FROM {vectors})))""")
def _(t, spark, sf):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return t("vectors").select("track", "frame_idx", F.posexplode(text.resample(values, 5)).alias("place", "value"))


@add("arr03_pad_frames", "track frame_idx first:d", """
 SELECT track, frame_idx, embedding[1]::DOUBLE AS first FROM {vectors} UNION ALL
 SELECT track, unnest(range(n, 100)) AS frame_idx, 0 AS first FROM (SELECT track, count(*) AS n FROM {vectors} GROUP BY track)""")
def _(t, spark, sf):
    rows = t("vectors").withColumnRenamed("embedding", "bands")
    totals = rows.groupBy(*KEY).agg(F.count("*").alias("frames"))
    return sections.pad_frames(rows, totals, KEY, 64, 100).select("track", "frame_idx", F.col("bands")[0].cast("double").alias("first"))


@add("map01_defaults", "track frame_idx a:d b:d c:d", "SELECT track, frame_idx, CASE WHEN event_type = 'error' THEN -1 ELSE value END AS a, 7 AS b, k AS c FROM {ticks}")
def _(t, spark, sf):
    given = F.create_map(F.lit("a"), F.when(F.col("event_type") != "error", F.col("value")), F.lit("c"), F.col("k").cast("double"))
    both = text.with_defaults(given, F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(7.0)))
    return t("ticks").withColumn("m", both).select("track", "frame_idx", *[F.col("m")[c].alias(c) for c in "abc"])


@add("json01_nested", "track frame_idx k other", "SELECT track, frame_idx, CAST(k AS VARCHAR) AS k, 'none' AS other FROM {ticks}")
def _(t, spark, sf):
    doc = F.to_json(F.struct(F.struct(F.col("k").alias("value")).alias("inner")))
    return t("ticks").select("track", "frame_idx", text.nested(doc, "$.inner.value", F.lit("none")).alias("k"), text.nested(doc, "$.inner.value.deeper", F.lit("none")).alias("other"))


@add("jn01_positional", "track frame_idx pyin_hz:d crepe_hz:d", """
 SELECT track, frame_idx, a.pyin_hz, b.crepe_hz FROM (SELECT * FROM {estimates} WHERE pyin_hz IS NOT NULL) a JOIN (SELECT * FROM {estimates} WHERE crepe_hz IS NOT NULL) b USING (track, frame_idx)""")
def _(t, spark, sf):
    rows = t("estimates")
    return pitch.join_estimators(rows.where("pyin_hz is not null").select(*KEY, "frame_idx", "pyin_hz"), rows.where("crepe_hz is not null").select(*KEY, "frame_idx", "crepe_hz"), KEY)


METRICS = ("db", "zcr", "confidence", "hnr", "tilt", "f0")


@add("jn22_entry_deltas", "metric a:d b:d delta:d", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, median({m}) FILTER (db < -30) AS a, median({m}) FILTER (db >= -30) AS b, median({m}) FILTER (db >= -30) - median({m}) FILTER (db < -30) AS delta FROM {{levels}}" for m in METRICS))
def _(t, spark, sf):
    def one(rule: str) -> DataFrame:
        return t("levels").where(rule).agg(*[F.percentile(m, F.lit(0.5)).alias(m) for m in METRICS])

    return matching.scalar_deltas(one("db < -30"), one("db >= -30"), METRICS)


@add("jn06_missing_output", "track frame_idx label", "SELECT track, frame_idx, label FROM {spans} s WHERE NOT EXISTS (SELECT 1 FROM {marks} m WHERE m.track = s.track AND m.frame_idx = s.frame_idx)")
def _(t, spark, sf):
    return matching.without_match(t("spans"), t("marks"), ["track", "frame_idx"])


@add("jn07_zip", "track position label t:d", """
 SELECT track, position, label, t FROM (SELECT track, label, row_number() OVER (PARTITION BY track ORDER BY start_s) - 1 AS position FROM {spans}) a
  JOIN (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t, frame_idx) - 1 AS position FROM {marks}) b USING (track, position)""")
def _(t, spark, sf):
    return matching.zipped(t("spans").select(*KEY, "start_s", "label"), t("marks").select(*KEY, "t", "frame_idx"), KEY, ["start_s"], ["t", "frame_idx"])


@add("jn16_overlapping", "track a b", "SELECT s.track, s.frame_idx AS a, g.frame_idx AS b FROM {spans} s JOIN {segments} g ON g.track = s.track AND g.end_s >= s.start_s AND g.start_s <= s.end_s")
def _(t, spark, sf):
    a = t("spans").select(*KEY, F.col("frame_idx").alias("a"), F.col("start_s").alias("sa"), F.col("end_s").alias("ea"))
    b = t("segments").select(*KEY, F.col("frame_idx").alias("b"), F.col("start_s").alias("sb"), F.col("end_s").alias("eb"))
    return matching.overlap_join(a, b, KEY, "sa", "ea", "sb", "eb")


@add("jn21_starts_within", "track a b", "SELECT s.track, s.frame_idx AS a, g.frame_idx AS b FROM {spans} s JOIN {segments} g ON g.track = s.track AND g.start_s BETWEEN s.start_s AND s.end_s")
def _(t, spark, sf):
    a = t("spans").select(*KEY, F.col("frame_idx").alias("a"), "start_s", "end_s")
    return matching.points_in(a, t("segments").select(*KEY, F.col("frame_idx").alias("b"), F.col("start_s").alias("t")), KEY, "start_s", "end_s", "t")


@add("jn15_phrase_edges", "track frame_idx edge_s:d distance:d", """
 WITH e AS (SELECT track, start_s AS p FROM {spans} UNION SELECT track, end_s FROM {spans})
 SELECT m.track, m.frame_idx, arg_min(p, (abs(p - t), p)) AS edge_s, min(abs(p - t)) AS distance FROM {marks} m LEFT JOIN e ON e.track = m.track AND abs(p - t) <= 0.9 GROUP BY m.track, m.frame_idx""")
def _(t, spark, sf):
    phrases = t("spans").select(*KEY, F.col("frame_idx").alias("phrase_id"), "start_s", "end_s", F.lit(1.0).alias("confidence"))
    edges = voice.phrase_boundaries(phrases, KEY).select(*KEY, F.col("t").alias("edge_s")).distinct()
    return matching.nearest_within(t("marks").select(*KEY, "frame_idx", "t"), edges, KEY, "t", "edge_s", 0.9, ids=["frame_idx"])


@add("jn19_labelled", "track t:d label", """
 SELECT m.track, m.t, (SELECT arg_min(label, (abs(start_s - m.t), start_s)) FROM {spans} s WHERE s.track = m.track AND abs(start_s - m.t) <= 0.02) AS label FROM {marks} m""")
def _(t, spark, sf):
    return selection.labelled(t("marks").select(*KEY, "t"), t("spans"), KEY)


@add("jn20_merged_levels", "track spans marks", """
 SELECT track, spans, marks FROM (SELECT track, count(*) AS spans FROM {spans} GROUP BY track) LEFT JOIN (SELECT track, count(*) AS marks FROM {marks} WHERE confidence > 0.95 GROUP BY track) USING (track)""")
def _(t, spark, sf):
    second = t("marks").where("confidence > 0.95").groupBy(*KEY).agg(F.count("*").alias("marks"))
    return selection.merged_levels(t("spans").groupBy(*KEY).agg(F.count("*").alias("spans")), second, KEY)


@add("prj10_evidence_mode", "track t:d confidence:d", """
 WITH c AS (SELECT * FROM {marks} WHERE kind = 'repetition' AND confidence > 0.9), s AS (SELECT * FROM {marks} WHERE kind = 'section' AND track NOT IN (SELECT track FROM c)), x AS (SELECT * FROM c UNION ALL SELECT * FROM s)
 SELECT track, t, confidence FROM x UNION ALL SELECT track, t, confidence FROM {marks} WHERE kind = 'mix' AND track NOT IN (SELECT track FROM x)""")
def _(t, spark, sf):
    m = t("marks")
    return boundaries.evidence_mode(m.where("kind = 'section'"), m.where("kind = 'mix'"), m.where("kind = 'repetition' and confidence > 0.9"), KEY)


@add("agg28_median_or", "track event_type zero:d missing:d", """
 SELECT track, event_type, coalesce(median(CASE WHEN k > 60 THEN value END), 0) AS zero, median(CASE WHEN k > 60 THEN value END) AS missing FROM {ticks} GROUP BY ALL""")
def _(t, spark, sf):
    rows = t("ticks").withColumn("x", F.when(F.col("k") > 60, F.col("value")))
    return rows.groupBy(*KEY, "event_type").agg(selection.median_or("x", 0.0).alias("zero"), selection.median_or("x", None).alias("missing"))


@add("set03_unknown_names", "name", "SELECT DISTINCT event_type AS name FROM {ticks} WHERE event_type NOT IN ('view', 'click')")
def _(t, spark, sf):
    return provenance.unknown_estimators(t("ticks").select(F.col("event_type").alias("name")), spark.createDataFrame([("view",), ("click",), ("other",)], "name string"))


@add("set04_missing_keys", "track frame_idx missing", """
 SELECT track, frame_idx, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'git_commit' END, CASE WHEN k % 3 = 0 THEN 'models' END) AS missing FROM {ticks} WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0""")
def _(t, spark, sf):
    k = F.col("k")
    given = {"git_commit": k % 2 != 0, "models": k % 3 != 0}
    keys = F.array_compact(F.array(*[F.when(given.get(n, F.lit(True)), F.lit(n)) for n in provenance.PROVENANCE_KEYS]))
    digest = F.when(k % 5 != 0, F.lit("0f" * 32)).otherwise("0f")
    fixed = F.create_map(F.lit("source_sha256"), digest, F.lit("schema_version"), F.lit(str(provenance.SCHEMA_VERSION)), F.lit("analyzer"), F.lit("x"))
    record = F.map_from_arrays(keys, F.transform(keys, lambda n: F.coalesce(fixed[n], F.lit("{}"))))
    return provenance.invalid_provenance(t("ticks").withColumn("record", record)).withColumn("missing", F.concat_ws(",", "missing"))


@add("src03_source_path", "track frame_idx path", "SELECT track, frame_idx, CASE WHEN event_type = 'view' THEN 'out/' || track || '/separation/vocals.wav' ELSE 'mix.wav' END AS path FROM {ticks}")
def _(t, spark, sf):
    chosen = F.when(F.col("event_type") == "view", "vocals").otherwise("mix")
    return t("ticks").select("track", "frame_idx", readers.source_path(F.concat(F.lit("out/"), F.col("track").cast("string")), chosen, F.lit("mix.wav")).alias("path"))


@add("src06_probe", "track frame_idx format duration_s:d bit_rate codec sample_rate channels", """
 SELECT track, frame_idx, event_type AS format, k + 0.5 AS duration_s, CAST(128000 + k AS BIGINT) AS bit_rate, 'mp3' AS codec, 44100 AS sample_rate, k % 2 + 1 AS channels FROM {ticks}""")
def _(t, spark, sf):
    k = F.col("k")
    stream = F.struct(F.lit("audio").alias("codec_type"), F.lit("mp3").alias("codec_name"), F.lit("44100").alias("sample_rate"), (k % 2 + 1).alias("channels"))
    cover = F.struct(F.lit("video").alias("codec_type"), F.lit("png").alias("codec_name"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("int").alias("channels"))
    container = F.struct(F.col("event_type").alias("format_name"), (k + 0.5).cast("string").alias("duration"), (128000 + k).cast("string").alias("bit_rate"))
    return t("ticks").select("track", "frame_idx", readers.probe(F.to_json(F.struct(F.array(cover, stream).alias("streams"), container.alias("format")))).alias("p")).select("track", "frame_idx", "p.*")


@add("src07_lyrics", "track text", """
 SELECT conv_id AS track, coalesce(trim(text), '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn, role, text) AS n FROM {conversations}) WHERE n = 1""")
def _(t, spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", F.asc_nulls_last("text"))
    return readers.lyrics(rows.select(F.col("conv_id").alias("track"), F.col("role").alias("language"), F.row_number().over(w).alias("position"), "text"), "assistant")


@add("src16_timeline_pitch", "track t:d f0:d confidence:d duration_s:d", """
 SELECT track, round_even(time_s, 3) AS t, round_even(selected_f0_hz, 2) AS f0, round_even(selected_confidence, 3) AS confidence, duration_s FROM {glides} JOIN (SELECT track, max(time_s) AS duration_s FROM {glides} GROUP BY track) USING (track)""")
def _(t, spark, sf):
    rows, ends = readers.timeline_pitch(t("glides"), KEY)
    return rows.join(ends, KEY)


@add("src16_timeline_spans", "track start_s:d end_s:d f0:d confidence:d", """
 SELECT track, round_even(start_s, 3) AS start_s, round_even(end_s, 3) AS end_s, round_even(median_f0_hz, 2) AS f0, round_even(median_confidence, 3) AS confidence FROM {segments}""")
def _(t, spark, sf):
    return readers.timeline_spans(t("segments"), KEY, {"median_f0_hz": ("f0", 2), "median_confidence": ("confidence", 3)})


@add("snk02_estimator_table", "time_s:d f0_hz:d midi:d cents_to_nearest_12tet:d own:d", """
 SELECT time_s, f0_hz, m AS midi, 100 * (m - round_even(m, 0)) AS cents_to_nearest_12tet, confidence AS own FROM (SELECT *, 69 + 12 * log2(f0_hz / 440) AS m FROM {tones})""")
def _(t, spark, sf):
    return writers.estimator_table(t("tones"), "own")


@add("snk05_matrix_table", "track i 0:d 1:d 2:d 3:d", "SELECT track, k % 4 AS i, " + ", ".join(f'max(value) FILTER (k // 4 % 4 = {j}) AS "{j}"' for j in range(4)) + " FROM {ticks} GROUP BY ALL")
def _(t, spark, sf):
    k = F.col("k")
    cells = t("ticks").groupBy(*KEY, (k % 4).alias("i"), (F.floor(k / 4) % 4).cast("int").alias("j")).agg(F.max("value").alias("distance"))
    return writers.matrix_table(cells, KEY, 4)


@add("snk07_alignment_table", "level segment_id unit_index start_s:d end_s:d label", """
 SELECT level, track AS segment_id, row_number() OVER (PARTITION BY level, track ORDER BY start_s, end_s, label) AS unit_index, start_s, end_s, label FROM (
  SELECT 'word' AS level, track, start_s, end_s, label FROM {spans} UNION ALL SELECT 'phone', track, start_s, end_s, CAST(frame_idx AS VARCHAR) FROM {segments} UNION ALL SELECT 'morae', track, t, t + 0.1, kind FROM {marks})""")
def _(t, spark, sf):
    def level(rows: DataFrame, start, end, label) -> DataFrame:
        return rows.select(F.col("track").alias("segment_id"), start.alias("start_s"), end.alias("end_s"), label.alias("label"), F.lit("even").alias("timing_method"))

    c = F.col
    return writers.alignment_table(level(t("spans"), c("start_s"), c("end_s"), c("label")), level(t("segments"), c("start_s"), c("end_s"), c("frame_idx").cast("string")), level(t("marks"), c("t"), c("t") + 0.1, c("kind")))


@add("snk11_long_map", "time_s:d freq_hz:d vocals_db:d instrumental_db:d dominance_db:d overlap:d", """
 SELECT frame_idx * 0.01 AS time_s, bin * 44100 / 2048 AS freq_hz, vocals_db, instr_db AS instrumental_db, vocals_db - instr_db AS dominance_db,
  least(greatest(0, least(1, (vocals_db - top + 70) / 70)), greatest(0, least(1, (instr_db - top + 70) / 70))) AS overlap FROM (SELECT *, max(greatest(vocals_db, instr_db)) OVER (PARTITION BY track) AS top FROM {cells})""")
def _(t, spark, sf):
    return writers.long_map(t("cells"), 0.01, 44_100, 2_048)


@add("snk12_track_document", "track rows first:d last:d", """
 SELECT track, count(*) AS rows, arg_min(db, t) AS first, arg_max(db, t) AS last FROM {levels} GROUP BY track""")
def _(t, spark, sf):
    document = writers.track_document({"frames": t("levels").select(*KEY, "t", F.bround("db", 4).alias("db"))}, KEY, {"frames": ("t", ["t", "db"])})
    inside = F.from_json("json", "frames array<array<double>>")["frames"]
    return document.withColumn("f", inside).select(*KEY, F.size("f").cast("long").alias("rows"), F.element_at("f", 1)[1].alias("first"), F.element_at("f", -1)[1].alias("last"))


@add("dsp01_frame_levels", "track frame_idx level:d zcr:d roughness:d", """
 SELECT track, frame_idx, 20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 1e-12)) AS level, list_sum(list_transform(range(1, len(x)), lambda i: CASE WHEN (x[i] >= 0) <> (x[i + 1] >= 0) THEN 1 ELSE 0 END)) / len(x) AS zcr,
  sqrt(list_sum(list_transform(range(1, len(x)), lambda i: (x[i + 1] - x[i]) * (x[i + 1] - x[i]))) / len(x)) AS roughness FROM (SELECT track, frame_idx, embedding::DOUBLE[] AS x FROM {vectors})""")
def _(t, spark, sf):
    frame = F.transform("embedding", lambda v: v.cast("double"))
    return t("vectors").withColumn("x", frame).select("track", "frame_idx", dsp.rms_dbfs(F.col("x")).alias("level"), dsp.zero_crossing_rate(F.col("x")).alias("zcr"), dsp.roughness(F.col("x")).alias("roughness"))


@add("dsp07_vibrato_grid", "track rate_hz:d amplitude:d", """
 WITH r AS (SELECT track, time_s AS t, 10 * sin(time_s * 31 + track) + value % 5 AS r FROM {ticks}), g AS (SELECT track, 3 + i * 0.25 AS rate, t, r, 2 * pi() * (3 + i * 0.25) * t AS w FROM r, (SELECT unnest(range(25)) AS i)),
 s AS (SELECT track, rate, count(*) AS n, 2 * sqrt(sum(r * cos(w)) ** 2 + sum(r * sin(w)) ** 2) / count(*) AS amplitude, stddev_pop(r) AS d FROM g GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY amplitude DESC, rate) AS k FROM s)
 SELECT track, CASE WHEN n >= 14 AND amplitude >= 2 AND d >= 2.5 THEN rate END AS rate_hz, amplitude FROM b WHERE k = 1""")
def _(t, spark, sf):
    rows = t("ticks").select(*KEY, F.col("time_s").alias("t"), (10 * F.sin(F.col("time_s") * 31 + F.col("track")) + F.col("value") % 5).alias("r"))
    return voice.vibrato_rate_grid(rows, KEY)


@add("dsp14_envelopes", "track bin peak:d level:d", """
 WITH n AS (SELECT track, max(sample_idx) + 1 AS n FROM {waves} GROUP BY track), w AS (SELECT track, CAST(floor(sample_idx * 16 / n) AS BIGINT) AS bin, max(abs(a)) AS peak, sqrt(avg((a * a + b * b) * 0.5)) AS r FROM {waves} JOIN n USING (track) GROUP BY ALL)
 SELECT track, bin, peak, sqrt(least(1, r / greatest(1e-6, max(r) OVER (PARTITION BY track)))) AS level FROM w""")
def _(t, spark, sf):
    rows = t("waves")
    peaks = dsp.envelope(rows.select(*KEY, "sample_idx", F.col("a").alias("sample")), KEY, 16)
    return peaks.join(dsp.stem_profile(rows.select(*KEY, "sample_idx", F.col("a").alias("left"), F.col("b").alias("right")), KEY, 16), [*KEY, "bin"])

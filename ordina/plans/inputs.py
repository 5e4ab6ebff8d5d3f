"""Series derived from the driver's tables, by one SQL text for Spark and for the oracle.

Numbers are double literals (1e2), so that both engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordina.functions.scalar import libm_power

#: Input tables of each derived series and its SQL; {events} and the like stand for the table.
SERIES: dict[str, str] = {
    "ticks": """
        SELECT track, frame_idx, event_type, value, k, frame_idx * 2e-2 + CASE WHEN frame_idx >= 40 THEN 3e-1 ELSE 0e0 END AS time_s
        FROM (SELECT CAST(user_id AS BIGINT) AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx,
              event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e""",
    "estimates": """
        SELECT track, frame_idx, time_s,
          CASE WHEN event_type = 'error' THEN NULL ELSE 220e0 * power(2e0, ((track % 12) * 1e2 + value % 37e0) / 12e2) END AS pyin_hz,
          CASE WHEN event_type = 'signup' THEN NULL ELSE 220e0 * power(2e0, ((track % 12) * 1e2 + (k % 9) * 9e0) / 12e2) END AS crepe_hz,
          4e-1 + (k % 60) / 1e2 AS pyin_confidence, (k % 70) / 1e2 AS crepe_periodicity FROM {ticks} t""",
    "tones": """
        SELECT track, frame_idx, time_s, CASE WHEN event_type = 'error' AND k < 30 THEN NULL ELSE 220e0 * power(2e0, (sin(time_s * 3e0 + track) * 2e1 + value % 7e0) / 12e2) END AS f0_hz,
          5e-1 + (k % 50) / 1e2 AS confidence, CASE WHEN k % 3 = 0 THEN 'consensus' WHEN k % 3 = 1 THEN 'pyin-fallback' ELSE 'crepe-only' END AS evidence FROM {ticks} t""",
    "glides": """
        SELECT track, frame_idx, time_s, 220e0 * power(2e0, (CASE WHEN frame_idx % 40 < 20 THEN (frame_idx % 40) * 12e0 ELSE 24e1 END + value % 5e0) / 12e2) AS selected_f0_hz,
          5e-1 + (k % 50) / 1e2 AS selected_confidence FROM {ticks} t WHERE k <> 7""",
    "segments": """
        SELECT track, frame_idx, frame_idx * 6e-1 AS start_s, frame_idx * 6e-1 + 5e-1 AS end_s, 110e0 + value * 3e0 AS median_f0_hz, 1e-1 + (k % 20) / 1e1 AS duration_s,
          5e-1 + (k % 40) / 1e2 AS median_confidence, CAST(k % 11 AS DOUBLE) AS praat_cpps_db, CAST((k * 7) % 23 AS DOUBLE) AS praat_hnr_cc_db,
          CAST((k * 5) % 17 AS DOUBLE) AS median_autocorrelation_hnr_db, CAST(-(k % 9) AS DOUBLE) AS median_spectral_tilt_db_per_octave FROM {ticks} t""",
    "levels": """
        SELECT track, frame_idx, frame_idx * 5e-2 AS t, -6e1 + k * 6e-1 AS db, (value % 11e0) / 2e1 AS zcr, (k % 100) / 1e2 AS confidence, value % 13e0 AS hnr, -(value % 17e0) AS tilt,
          CASE WHEN event_type = 'error' THEN NULL ELSE 100e0 + value END AS f0 FROM {ticks} t""",
    "spans": "SELECT track, frame_idx, frame_idx * 7e-1 AS start_s, frame_idx * 7e-1 + 2e-1 + (k % 10) / 1e1 AS end_s, event_type AS label FROM {ticks} t",
    "marks": "SELECT track, frame_idx, frame_idx * 31e-2 + (k % 7) / 1e2 AS t, 1e-1 + (k % 90) / 1e2 AS confidence, CASE event_type WHEN 'view' THEN 'mix' WHEN 'click' THEN 'stem' WHEN 'error' THEN 'repetition' ELSE 'section' END AS kind FROM {ticks} t WHERE k % 5 < 3",
    "cells": "SELECT track, frame_idx, CAST(k % 32 AS INT) AS bin, -5e1 + 3e1 * sin(value) AS vocals_db, -5e1 + 3e1 * cos(value * 3e0 + k) AS instr_db FROM {ticks} t",
    "waves": """
        SELECT track, frame_idx AS sample_idx, sin(value) AS a, sin(value) * 5e-1 + (k % 10) / 1e2 AS b, sin(value) AS source, sin(value) * 6e-1 AS vocals,
          sin(value) * 4e-1 + CASE WHEN k = 3 THEN 1e-2 ELSE 0e0 END AS accompaniment FROM {ticks} t""",
    "logits": """
        SELECT track, frame_idx, (value % 9e0) - 4e0 AS section_logit, (k % 5) * 1e0 AS l0, (k % 7) * 1e0 AS l1, (k % 3) * 2e0 AS l2 FROM {ticks} t""",
    "vectors": """
        SELECT CAST(label AS BIGINT) AS track, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx, embedding FROM {embeddings} e""",
}
#: Series whose values meet limits exactly: Spark computes their powers as DuckDB does, by the C library.
LIBM = ("estimates",)
TABLES = ("events", "embeddings", "documents", "conversations")


def needs(sql: str) -> list[str]:
    """Derived series that a text names, those they need first."""
    found: list[str] = []
    for name in SERIES:
        if "{" + name + "}" in sql:
            found += [n for n in [*needs(SERIES[name]), name] if n not in found]
    return found


def series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived series as a DataFrame."""

    def text(n: str) -> str:
        inner = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
        inner |= {m: f"({text(m)})" for m in needs(SERIES[n])}
        sql = SERIES[n].replace("power(", "libm_power(") if n in LIBM else SERIES[n]
        return sql.format(**inner)

    if name in LIBM:
        spark.udf.register("libm_power", libm_power)
    return spark.sql(text(name))


def oracle(sql: str) -> str:
    """DuckDB SQL with the derived series as common tables."""
    names = {n: n for n in (*TABLES, *SERIES)}
    ctes = [f"{n} AS ({SERIES[n].format(**names)})" for n in needs(sql)]
    body = sql.format(**names).strip()
    if not ctes:
        return body
    return f"WITH RECURSIVE {', '.join(ctes)}" + (f", {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f" {body}")

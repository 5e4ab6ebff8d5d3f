"""Ordered-series primitives: islands, hysteresis, runs, folds, thresholds, peaks.

A series is the rows of one key in the order of one column. Where an operator only looks at a
bounded neighbourhood, `haloed` splits a long series in pieces with overlap, so that a series
with a third of all rows isn't one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Sequence[str]


def haloed(df: DataFrame, time: str, piece_s: float, halo_s: float) -> DataFrame:
    """Rows with piece (long) and own: each row in its piece of time, and as a guest in the neighbours within the halo."""
    at = F.col(time) / piece_s
    pieces = F.sequence(F.floor((F.col(time) - halo_s) / piece_s), F.floor((F.col(time) + halo_s) / piece_s))
    return df.withColumn("piece", F.explode(pieces)).withColumn("own", F.floor(at) == F.col("piece"))


def islands(df: DataFrame, key: Key, order: Sequence[str], new: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0: a row for which `new` holds (or is null: the first) begins one. `new` may use window functions over the same order."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_new").over(run) - F.first("_new").over(run)).drop("_new")


def gap_islands(df: DataFrame, key: Key, time: str, limit: Column) -> DataFrame:
    """A new island when the time since the row before exceeds the limit."""
    w = Window.partitionBy(*key).orderBy(time)
    return islands(df, key, [time], F.col(time) - F.lag(time).over(w) > limit)


def run_lengths(df: DataFrame, key: Key, time: str, kind: str, hop_s: float, duration: Column) -> DataFrame:
    """Intervals of equal kind; edges half a hop outside the rows, within [0, duration]."""
    w = Window.partitionBy(*key).orderBy(time)
    runs = islands(df, key, [time], ~F.col(kind).eqNullSafe(F.lag(kind).over(w)) | F.lag(time).over(w).isNull())
    runs = runs.withColumn("_duration", duration)
    return runs.groupBy(*key, "island", kind).agg(
        F.greatest(F.lit(0.0), F.min(time) - hop_s / 2).alias("start_s"),
        F.least(F.max("_duration"), F.max(time) + hop_s / 2).alias("end_s"),
        F.count("*").alias("frames"),
    )


def hysteresis(df: DataFrame, key: Key, time: str, value: str, on: Column, off: Column, name: str = "active") -> DataFrame:
    """On from value >= on until value < off; off at first."""
    w = Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col(value) >= on, True).when(F.col(value) < off, False)
    return df.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))


def fill_gaps(df: DataFrame, key: Key, time: str, active: str, most: int) -> DataFrame:
    """Inactive runs of at most `most` rows become active, but not the first or last run of a series."""
    w = Window.partitionBy(*key).orderBy(time)
    runs = islands(df, key, [time], F.col(active) != F.lag(active).over(w))
    run, all_ = Window.partitionBy(*key, "island"), Window.partitionBy(*key)
    inner = (F.col("island") > 0) & (F.col("island") < F.max("island").over(all_))
    short = F.count("*").over(run) <= most
    return runs.withColumn(active, F.col(active) | (inner & short)).drop("island")


def decimate(df: DataFrame, key: Key, time: str, columns: Sequence[str], hop_s: float) -> DataFrame:
    """Keeps the first row and then each one that lies hop_s or more after the last kept (1e-12 of slack).

    Each choice depends on the one before, so a series is walked in order, from one kept row to the next by
    binary search. Rows without a time go.
    """
    if hop_s <= 0:
        raise ValueError("hop_s must be positive")
    names = list(dict.fromkeys([time, *columns]))

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in names])
        t, kept, at = rows.column(time).to_numpy() + 1e-12, [], 0
        while at < len(t):
            kept.append(at)
            at = max(at + 1, int(np.searchsorted(t, rows.column(time)[at].as_py() + hop_s)))
        return rows.take(pa.array(kept, pa.int64()))

    some = df.where(F.col(time).isNotNull()).select(*key, *[c for c in names if c not in key])
    return some.groupBy(*key).applyInArrow(walk, some.schema)


def suppress(df: DataFrame, key: Key, score: str, place: str, separation: Column | float, columns: Sequence[str], top: int | None = None, best_first: Sequence[Column] | None = None, strict: bool = True, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Greedy suppression: rows by falling score (ties by best_first, else by place), each kept unless a kept one is nearer than separation; top of them.

    `near(a, b)` may replace the distance test. The number of rows kept is bounded by top, or by separation.
    """
    tie = list(best_first) if best_first is not None else [F.col(place)]
    fields = list(dict.fromkeys([place, *columns, score]))
    ranked = df.select(*key, (-F.col(score)).alias("_0"), *[t.alias(f"_{k}") for k, t in enumerate(tie, 1)], F.struct(*fields).alias("_row"))
    order = F.array_sort(F.collect_list(F.struct("_0", *[f"_{k}" for k in range(1, len(tie) + 1)], "_row")))
    grouped = ranked.groupBy(*key).agg(F.transform(order, lambda r: r["_row"]).alias("_rows"))

    def close(a: Column, b: Column) -> Column:
        if near is not None:
            return near(a, b)
        d = F.abs(a[place] - b[place])
        return d < separation if strict else d <= separation

    def step(done: Column, row: Column) -> Column:
        full = F.size(done) >= top if top is not None else F.lit(False)
        return F.when(full | F.exists(done, lambda k: close(k, row)), done).otherwise(F.concat(done, F.array(row)))

    out = grouped.withColumn("_kept", F.aggregate("_rows", F.slice("_rows", 1, 0), step))
    return out.select(*key, F.posexplode("_kept").alias("pick", "_row")).select(*key, "pick", "_row.*")


def local_maxima(df: DataFrame, key: Key, order: str, value: str) -> DataFrame:
    """Rows not below either neighbour (plateaus stay, a missing neighbour counts as lower)."""
    w = Window.partitionBy(*key).orderBy(order)
    low = F.lit(float("-inf"))
    left, right = F.coalesce(F.lag(value).over(w), low), F.coalesce(F.lead(value).over(w), low)
    return df.withColumns({"_left": left, "_right": right}).where((F.col(value) >= F.col("_left")) & (F.col(value) >= F.col("_right"))).drop("_left", "_right")


def robust_threshold(df: DataFrame, key: Key, value: str, floor: float, factor: float, default_mad: float) -> DataFrame:
    """Per key: median + max(floor, factor * MAD); a MAD of zero counts as default_mad."""
    middle = df.groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("_median"))
    joined = df.select(*key, value).join(middle, list(key))
    spread = joined.groupBy(*key).agg(F.first("_median").alias("_median"), F.percentile(F.abs(F.col(value) - F.col("_median")), F.lit(0.5)).alias("_mad"))
    return spread.select(*key, (F.col("_median") + F.greatest(F.lit(floor), factor * F.coalesce(F.nullif("_mad", F.lit(0.0)), F.lit(default_mad)))).alias("threshold"))


def majority_smooth(df: DataFrame, key: Key, time: str, kind: str, kinds: Sequence[str], radius: int = 2, least_rows: int = 5) -> DataFrame:
    """Most frequent kind within radius rows; ties go to the row's own kind, then to the order of kinds. Short series stay."""
    w = Window.partitionBy(*key).orderBy(time).rowsBetween(-radius, radius)
    votes = df.withColumns({f"_v{i}": F.count_if(F.col(kind) == k).over(w) for i, k in enumerate(kinds)}).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    best = F.greatest(*[F.col(f"_v{i}") for i in range(len(kinds))]) if len(kinds) > 1 else F.col("_v0")
    own = F.coalesce(*[F.when(F.col(kind) == k, F.col(f"_v{i}")) for i, k in enumerate(kinds)])
    chosen = F.coalesce(F.when(own == best, F.col(kind)), *[F.when(F.col(f"_v{i}") == best, F.lit(k)) for i, k in enumerate(kinds)])
    return votes.withColumn(kind, F.when(F.col("_n") < least_rows, F.col(kind)).otherwise(chosen)).drop("_n", *[f"_v{i}" for i in range(len(kinds))])


def clusters(df: DataFrame, key: Key, time: str, tolerance_s: float) -> DataFrame:
    """Chains of rows, each at most tolerance_s after the one before."""
    return gap_islands(df, key, time, F.lit(tolerance_s)).withColumnRenamed("island", "cluster")

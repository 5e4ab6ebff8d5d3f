"""Self-similarity, recurrence periods, cycles and their alignment.

Feature rows are (key..., view, frame_idx, features array).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.functions.scalar import clamp, cosine
from ordina.operators.matching import lagged_pairs
from ordina.operators.series import Key, local_maxima, suppress


def zscore(features: DataFrame, key: Key, eps: float = 1e-12) -> DataFrame:
    """Each dimension to mean 0 and population deviation 1 over the series; a deviation of eps or less counts as 1."""
    long = features.select(*key, "frame_idx", F.posexplode("features").alias("dim", "x"))
    stats = long.groupBy(*key, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = stats.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("_stats"))  # one entry per dimension
    scaled = F.zip_with("features", "_stats", lambda x, s: (x - s["m"]) / F.when(s["s"] > eps, s["s"]).otherwise(1.0))
    return features.join(stats, list(key)).withColumn("features", scaled).drop("_stats")


def unit(features: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Features scaled to length 1 (near-zero ones stay)."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, v: s + v * v))
    return features.withColumn("features", F.transform("features", lambda v: v / F.when(norm > eps, norm).otherwise(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def similarity_pairs(features: DataFrame, key: Key, low: Column | int, high: Column | int) -> DataFrame:
    """Cosine similarity of frames i and i + lag for lags in [low, high] (the upper triangle of the self-similarity matrix)."""
    pairs = lagged_pairs(unit(features), key, "frame_idx", "features", low, high)
    return pairs.select(*key, "i", "lag", clamp(dot(F.col("a"), F.col("b")), -1.0, 1.0).alias("similarity"))


def lag_profile(features: DataFrame, key: Key, low: int = 1, high: int | None = None) -> DataFrame:
    """Mean similarity of standardised frames along each lag, and how many frames support it."""
    by_series = features.join(features.groupBy(*key).agg(F.count("*").alias("_n")), list(key))
    top = F.col("_n") - 1 if high is None else F.least(F.col("_n") - 1, F.lit(high))
    scaled = zscore(by_series, key).withColumn("_top", top)
    pairs = unit(scaled)
    left = pairs.where(F.lit(max(1, low)) <= F.col("_top")).select(*key, F.col("frame_idx").alias("i"), F.col("features").alias("a"), F.explode(F.sequence(F.lit(max(1, low)), F.col("_top").cast("int"))).alias("lag_frames")).withColumn("_j", F.col("i") + F.col("lag_frames"))
    right = pairs.select(*key, F.col("frame_idx").alias("_j"), F.col("features").alias("b"))
    both = left.join(right, [*key, "_j"])
    return both.groupBy(*key, "lag_frames").agg(F.avg(clamp(dot(F.col("a"), F.col("b")), -1.0, 1.0)).alias("similarity"), F.count("*").alias("support"))


def combine_views(profile: DataFrame, key: Key, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the views' similarities per lag (weights above 0 only), with the views as a map. Views must have equally many frames."""
    view = F.col("view")
    w = F.lit(1.0) if not weights else F.coalesce(*[F.when(view == v, F.lit(float(x))) for v, x in weights.items()], F.lit(1.0))
    rows = profile.withColumn("_w", w)
    good = (F.col("_w") > 0) & ~F.isnan("similarity")
    return rows.groupBy(*key, "lag_frames").agg(
        (F.sum(F.when(good, F.col("similarity") * F.col("_w"))) / F.sum(F.when(good, F.col("_w")))).alias("combined_similarity"),
        F.min("support").alias("support"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "similarity")))).alias("views"),
    )


def check_views(features: DataFrame, key: Key) -> DataFrame:
    """Series whose views differ in their number of frames."""
    n = features.groupBy(*key, "view").agg(F.count("*").alias("n"))
    return n.groupBy(*key).agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least != most")


def period_candidates(profile: DataFrame, key: Key, score: str = "combined_similarity", top: int = 8, separation: int = 1) -> DataFrame:
    """Local maxima by falling score (ties: the shorter lag), none nearer than separation to a better one, at most top."""
    peaks = local_maxima(profile.where(F.col(score).isNotNull() & ~F.isnan(score)), key, "lag_frames", score)
    return suppress(peaks, key, score, "lag_frames", float(separation), ["support"], top)


def cycle_grid(series: DataFrame, key: Key, total: Column, period: Column, start: Column | int = 0, partial: bool = False) -> DataFrame:
    """Boundaries start, start + period, ... up to total; the rest too if partial."""
    start = start if isinstance(start, Column) else F.lit(start)
    grid = F.sequence(start, total, period)
    grid = F.when(F.element_at(grid, -1) < total, F.concat(grid, F.array(total))).otherwise(grid) if partial else grid
    valid = (total > 0) & (period > 0) & (start >= 0) & (start < total)
    return series.where(valid).select(*key, F.posexplode(grid).alias("boundary", "frame_idx"))


def view_agreement(candidates: DataFrame, key: Key, tolerance: int = 2) -> DataFrame:
    """Groups lags of several views in ascending order: a lag joins unless it exceeds the rounded mean of the group by more than tolerance."""
    points = F.array_sort(F.collect_list(F.struct(F.col("lag_frames").cast("long").alias("lag"), "view")))
    grouped = candidates.groupBy(*key).agg(points.alias("_points"))

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        mean = F.rint(F.aggregate(last, F.lit(0.0), lambda s, x: s + x["lag"]) / F.size(last))
        new = (F.size(done) == 0) | (p["lag"] - mean > tolerance)
        return F.when(new, F.concat(done, F.array(F.array(p)))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.array(p)))))

    empty = F.slice(F.transform("_points", lambda p: F.array(p)), 1, 0)
    groups = grouped.withColumn("_groups", F.aggregate("_points", empty, step)).select(*key, F.posexplode("_groups").alias("group", "_g"))
    lags = F.transform("_g", lambda p: p["lag"])
    n = F.size("_g")
    middle = (F.element_at(lags, F.floor((n + 1) / 2).cast("int")) + F.element_at(lags, F.floor((n + 2) / 2).cast("int"))) / 2
    views = F.array_sort(F.array_distinct(F.transform("_g", lambda p: p["view"])))
    return groups.select(*key, "group", F.rint(middle).cast("long").alias("period_frames"), views.alias("views"), F.size(views).alias("view_count"), lags.alias("lags"))


def _scaled(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > eps, norm, 1.0)


def _paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least totals and lengths of the paths through many cost matrices (rows, columns, matrix), one anti-diagonal of all at a time."""
    n, m, many = cost.shape
    total, steps = np.full((n + 1, m + 1, many), np.inf), np.zeros((n + 1, m + 1, many), np.int64)
    total[0, 0] = 0.0
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        best, count = total[i - 1, j - 1], steps[i - 1, j - 1]
        for p, q in ((i - 1, j), (i, j - 1)):
            other, length = total[p, q], steps[p, q]
            better = (other < best) | ((other == best) & (length < count))
            best, count = np.where(better, other, best), np.where(better, length, count)
        total[i, j], steps[i, j] = cost[i - 1, j - 1] + best, count + 1
    return total[n, m], steps[n, m]


def dtw(a: np.ndarray, b: np.ndarray, eps: float = 1e-12) -> tuple[float, int]:
    """Least total cosine cost of a path (steps diagonal, down, right; ties by fewer steps) and its length."""
    total, steps = _paths((1.0 - np.clip(_scaled(a, eps) @ _scaled(b, eps).T, -1.0, 1.0))[:, :, None])
    return float(total[0]), int(steps[0])


def cycles(features: DataFrame, boundaries: DataFrame, key: Key) -> DataFrame:
    """The frames of each cycle [boundary k, boundary k + 1) as an array: (key, cycle, frames)."""
    w = Window.partitionBy(*key).orderBy("frame_idx")
    spans = boundaries.select(*key, F.col("boundary").alias("cycle"), F.col("frame_idx").alias("_a"), F.lead("frame_idx").over(w).alias("_b")).where("_b is not null")
    inside = spans.withColumn("frame_idx", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1))).join(features, [*key, "frame_idx"])
    return inside.groupBy(*key, "cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "features"))), lambda r: r["features"]).alias("frames"))


@F.pandas_udf(T.StructType([T.StructField("total_cost", T.DoubleType()), T.StructField("path_length", T.LongType()), T.StructField("normalized_distance", T.DoubleType())]))
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """DTW of two arrays of feature arrays."""
    found = [dtw(np.stack(x), np.stack(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"total_cost": [c for c, _ in found], "path_length": [n for _, n in found], "normalized_distance": [c / n for c, n in found]})


def cycle_pairs(cycles: DataFrame, key: Key, value: str) -> DataFrame:
    """Unordered pairs of a series' cycles: (key, i, j, a, b) with i < j."""
    left = cycles.select(*key, F.col("cycle").alias("i"), F.col(value).alias("a"))
    right = cycles.select(*key, F.col("cycle").alias("j"), F.col(value).alias("b"))
    return left.join(right, list(key)).where("i < j")


#: Cells of cost matrices that are held at once in cycle_distances (one matrix at least).
CELLS = 1 << 18


def _distances(cycle: np.ndarray, frames: pa.ListArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised DTW distances of the cycles numbered left with those numbered right, i < j: cycles of equal lengths are taken together."""
    length = frames.value_lengths().to_numpy()
    rows = frames.flatten()
    x = _scaled(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
    begin = np.cumsum(length) - length
    at = lambda some, n: x[begin[some][:, None] + np.arange(n)].reshape(len(some) * n, -1)
    found = [(cycle[:0], cycle[:0], np.zeros(0))]
    for n in np.unique(length[left]):
        for m in np.unique(length[right]):
            us, vs = left[length[left] == n], right[length[right] == m]
            wide = max(1, min(len(vs), CELLS // int(n * m)))
            high = max(1, CELLS // int(n * m * wide))
            for u in (us[k : k + high] for k in range(0, len(us), high)):
                for v in (vs[k : k + wide] for k in range(0, len(vs), wide)):
                    i, j = (g.ravel() for g in np.meshgrid(cycle[u], cycle[v], indexing="ij"))
                    on = i < j
                    if not on.any():
                        continue
                    cost = 1.0 - np.clip(at(u, n) @ at(v, m).T, -1.0, 1.0)
                    cost = cost.reshape(len(u), n, len(v), m).transpose(1, 3, 0, 2).reshape(n, m, -1)
                    total, steps = _paths(cost)
                    found.append((i[on], j[on], (total / steps)[on]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def cycle_distances(cycles: DataFrame, key: Key, block: int = 256) -> DataFrame:
    """Normalised DTW distance of every pair i < j: blocks of cycles meet in pairs, and a meeting aligns its pairs together."""
    at = F.floor(F.col("cycle") / block)
    rows = cycles.join(cycles.groupBy(*key).agg(F.max(at).alias("_last")), list(key)).withColumn("_at", at)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    rows = rows.select(*key, F.least("_at", "_other").alias("_p"), F.greatest("_at", "_other").alias("_q"), "cycle", "frames")
    kinds = {c: cycles.schema[c].dataType for c in (*key, "cycle")}
    out = T.StructType([*[T.StructField(k, kinds[k]) for k in key], T.StructField("i", kinds["cycle"]), T.StructField("j", kinds["cycle"]), T.StructField("distance", T.DoubleType())])

    def meet(group: tuple, table: pa.Table) -> pa.Table:
        cycle, frames = table.column("cycle").to_numpy(), table.column("frames").combine_chunks()
        p, q = (g.as_py() for g in group[-2:])
        i, j, distance = _distances(cycle, frames, np.flatnonzero(cycle // block == p), np.flatnonzero(cycle // block == q))
        same = [pa.array([g.as_py()] * len(i), table.schema.field(k).type) for g, k in zip(group, key, strict=False)]
        return pa.Table.from_arrays([*same, pa.array(i), pa.array(j), pa.array(distance)], names=out.names)

    return rows.groupBy(*key, "_p", "_q").applyInArrow(meet, out)


def symmetric(pairs: DataFrame, key: Key, value: str = "distance") -> DataFrame:
    """Both directions of every pair and the zero diagonal."""
    both = pairs.select(*key, "i", "j", value).union(pairs.select(*key, F.col("j"), F.col("i"), value))
    ends = pairs.select(*key, "i").union(pairs.select(*key, "j")).distinct()
    return both.union(ends.select(*key, "i", F.col("i"), F.lit(0.0)))


def triangle_summary(pairs: DataFrame, key: Key, value: str = "distance") -> DataFrame:
    """Mean, median and maximum over pairs i < j."""
    return pairs.where("i < j").groupBy(*key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("max"), F.count("*").alias("pairs"))


#: Histogram of cosines in cosine_summary: bins over [-1, 1].
BINS = 1 << 12


def _cosines(a: np.ndarray, b: np.ndarray, same: bool, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the rows of a with those of b (of a block with itself, only i < j), 0 where a row is near zero, and their bins."""

    def scaled(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > eps, x / np.where(norm > eps, norm, 1.0), 0.0)

    s = np.clip(scaled(a) @ scaled(b).T, -1.0, 1.0)
    s = s[np.triu_indices(len(a), 1)] if same else s.ravel()
    return s, np.minimum(((s + 1.0) * (BINS / 2)).astype(np.int64), BINS - 1)


def cosine_summary(features: DataFrame, key: Key, block: int = 512) -> DataFrame:
    """triangle_summary of the cosines of all pairs of a series' frames, without pairs as rows.

    Blocks of frames meet in pairs; the median is exact: a histogram finds the bins that hold the middle values, and only
    the values of these bins become rows.
    """
    rows = features.withColumn("_b", F.floor(F.col("frame_idx") / block)).groupBy(*key, "_b").agg(F.collect_list("features").alias("_x"))
    left, right = rows.withColumnsRenamed({"_b": "_p", "_x": "_a"}), rows.withColumnsRenamed({"_b": "_q", "_x": "_c"})
    both = left.join(right, list(key)).where("_p <= _q").repartition(*key, "_p", "_q")

    def blocks(a: pd.Series, c: pd.Series, same: pd.Series):
        return (_cosines(np.stack(x), np.stack(y), s) for x, y, s in zip(a, c, same, strict=True))

    @F.pandas_udf("n array<long>, total double, top double")
    def measured(a: pd.Series, c: pd.Series, same: pd.Series) -> pd.DataFrame:
        found = [(np.bincount(b, minlength=BINS), s.sum(), s.max() if len(s) else None) for s, b in blocks(a, c, same)]
        return pd.DataFrame(found, columns=["n", "total", "top"])

    @F.pandas_udf("array<double>")
    def inside(a: pd.Series, c: pd.Series, same: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([s[(b == x) | (b == y)] for (s, b), x, y in zip(blocks(a, c, same), low, high, strict=True)])

    each = both.select(*key, measured("_a", "_c", F.col("_p") == F.col("_q")).alias("_m"))
    totals = each.groupBy(*key).agg(F.sum("_m.total").alias("_total"), F.max("_m.top").alias("max"))
    w = Window.partitionBy(*key).orderBy("_bin")
    bins = each.select(*key, F.posexplode("_m.n").alias("_bin", "_k")).where("_k > 0").groupBy(*key, "_bin").agg(F.sum("_k").alias("_k"))
    bins = bins.withColumns({"_to": F.sum("_k").over(w), "pairs": F.sum("_k").over(Window.partitionBy(*key))})
    middle = [F.floor((F.col("pairs") + k) / 2) for k in (1, 2)]  # ranks from 1
    found = [F.min(F.when(F.col("_to") >= m, F.struct("_bin", (F.col("_to") - F.col("_k")).alias("before")))) for m in middle]
    at = bins.groupBy(*key).agg(F.first("pairs").alias("pairs"), found[0].alias("_low"), found[1].alias("_high"))
    values = both.join(F.broadcast(at), list(key)).select(*key, F.explode(inside("_a", "_c", F.col("_p") == F.col("_q"), "_low._bin", "_high._bin")).alias("_v"))
    ranked = values.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("_v"))).join(F.broadcast(at), list(key))
    ranked = ranked.where((F.col("_r") + F.col("_low.before")).isin(*middle))  # no pair lies between the two bins
    median = ranked.groupBy(*key).agg(F.avg("_v").alias("median"))
    return totals.join(at, list(key)).join(median, list(key)).select(*key, (F.col("_total") / F.col("pairs")).alias("mean"), "median", "max", "pairs")


def template_alignment(features: DataFrame, key: Key, *, anchor: int, period: int, length: int, radius: int, min_separation: float = 0.5) -> DataFrame:
    """Where near each place of the grid anchor + k * period the template (length frames from anchor) fits best.

    The choice goes place by place, as each lower bound depends on the choice before; it ends at the first place without one.
    Ties: nearer to the grid, then earlier.
    """
    scaled = unit(zscore(features, [*key, "view"]))
    template = scaled.where(F.col("frame_idx").between(anchor, anchor + length - 1)).select(*key, "view", (F.col("frame_idx") - anchor).alias("_k"), F.col("features").alias("_t"))
    shifts = scaled.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("start", F.col("frame_idx") - F.col("_k")).where("start >= 0")
    each = shifts.join(template, [*key, "view", "_k"]).groupBy(*key, "view", "start").agg(F.avg(dot(F.col("_t"), F.col("features"))).alias("s"), F.count("*").alias("_n")).where(F.col("_n") == length)
    at = each.groupBy(*key, "start").agg(F.avg("s").alias("similarity"))
    # each place of the grid brings its options in order of merit; the fold takes the first that keeps its distance
    index = F.explode(F.sequence(F.ceil((F.col("start") - anchor - radius) / period), F.floor((F.col("start") - anchor + radius) / period)))
    options = at.withColumn("k", index).where("k >= 0").withColumn("off", F.col("start") - (F.lit(anchor) + F.col("k") * period)).where(F.abs("off") <= radius)
    merit = F.struct((-F.col("similarity")).alias("worse"), F.abs("off").alias("far"), F.col("start").cast("long").alias("start"), F.col("off").cast("long").alias("off"))
    places = options.groupBy(*key, "k").agg(F.array_sort(F.collect_list(merit)).alias("options")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "options"))).alias("_places"))
    apart = max(1, round(period * min_separation))

    def step(done: Column, place: Column) -> Column:
        last = F.get(done, F.size(done) - 1)["start"]
        free = F.filter(place["options"], lambda o: last.isNull() | (o["start"] >= last + apart))
        follows = (place["k"] == F.size(done)) & (F.size(free) > 0)  # after a place without a choice there are none
        return F.when(follows, F.concat(done, F.slice(free, 1, 1))).otherwise(done)

    none = F.slice(F.get("_places", F.lit(0))["options"], 1, 0)
    chosen = places.select(*key, F.posexplode(F.aggregate("_places", none, step)).alias("index", "_c"))
    return chosen.select(*key, "index", (F.lit(anchor) + F.col("index") * period).cast("long").alias("expected_frame"), F.col("_c.start").alias("aligned_frame"), F.col("_c.off").alias("offset_frames"), (-F.col("_c.worse")).alias("combined_similarity"))


def tempo_set(beats: DataFrame, key: Key, bpm: str, time: str) -> DataFrame:
    """Primary, half and double tempo with the regularity 1 / (1 + CV) of the beat intervals (two positive ones at least)."""
    w = Window.partitionBy(*key).orderBy(time)
    gaps = beats.withColumn("_d", F.col(time) - F.lag(time).over(w))
    good = F.when(F.col("_d") > 0, F.col("_d"))
    out = gaps.groupBy(*key).agg(F.first(bpm).alias("primary_bpm"), F.count("*").alias("beat_count"), F.count(good).alias("_n"), (F.stddev_pop(good) / F.avg(good)).alias("_cv"))
    cv = F.when(F.col("_n") >= 2, F.col("_cv"))
    return out.select(*key, "primary_bpm", (F.col("primary_bpm") / 2).alias("half_bpm"), (F.col("primary_bpm") * 2).alias("double_bpm"), "beat_count", cv.alias("beat_interval_cv"), (1 / (1 + cv)).alias("confidence"))


def block_similarity(features: DataFrame, key: Key, lag: int, length: int) -> DataFrame:
    """Mean cosine of aligned rows of the blocks at i and i + lag, cut at the end of the series; -1 without any."""
    pairs = lagged_pairs(features, key, "frame_idx", "features", lag, lag).select(*key, "i", cosine(F.col("a"), F.col("b")).alias("s"))
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(0, length - 1)
    sums = pairs.withColumn("similarity", F.avg("s").over(w)).select(*key, "i", "similarity")
    return features.select(*key, F.col("frame_idx").alias("i")).join(sums, [*key, "i"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(-1.0)))


def repetition_pairs(features: DataFrame, candidates: DataFrame, key: Key, *, step_s: float, block: int, lags: Sequence[int] | None = None) -> DataFrame:
    """Pairs of repeated blocks for the best four periods: peaks of block similarity over a robust threshold.

    candidates: lag_frames, similarity and pick (from 0). At most three per period, block apart; then duplicates within 2 s of a better pair go; eight stay.
    A frame stands for the middle of a window of two steps, so frame i begins at (i + 1/2) steps, and n frames last n + 1 steps.
    """
    from ordina.operators.series import robust_threshold

    some = candidates.where("pick < 4").select(*key, F.col("lag_frames").cast("int").alias("lag"), F.col("similarity").alias("period_similarity"))
    by = [*key, "lag"]
    n = features.groupBy(*key).agg(F.count("*").alias("_n"))
    left = features.join(some, list(key)).select(*by, "period_similarity", F.col("frame_idx").alias("i"), F.col("features").alias("a"), (F.col("frame_idx") + F.col("lag")).alias("_j"))
    both = left.join(features.select(*key, F.col("frame_idx").alias("_j"), F.col("features").alias("b")), [*key, "_j"])
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(0, block - 1)
    sims = both.withColumn("_s", cosine(F.col("a"), F.col("b"))).withColumn("similarity", F.avg("_s").over(w)).drop("a", "b", "_j", "_s")
    sims = sims.join(n, list(key)).where(F.col("i") + F.col("lag") + block < F.col("_n"))
    limit = robust_threshold(sims, by, "similarity", 0.08, 1.7, 0.03).withColumn("threshold", F.least(F.lit(0.92), F.greatest(F.lit(0.5), F.col("threshold"))))
    peaks = local_maxima(sims, by, "i", "similarity").join(limit, by).where("similarity >= threshold")
    chosen = suppress(peaks, by, "similarity", "i", float(block), ["period_similarity", "threshold", "_n"], 3)
    rest = (F.col("similarity") - F.col("threshold")) / F.greatest(F.lit(0.08), 1 - F.col("threshold"))
    confidence = clamp(0.42 + rest * 0.5 + F.greatest(F.lit(0.0), F.col("period_similarity")) * 0.12, 0.25, 1.0)
    pairs = chosen.withColumns({"a_start": (F.col("i") + 0.5) * step_s, "b_start": (F.col("i") + F.col("lag") + 0.5) * step_s, "duration_s": (F.col("_n") + 1) * step_s, "lag_s": F.col("lag") * step_s, "confidence": confidence})
    near = lambda x, y: (F.abs(x["a_start"] - y["a_start"]) < 2) & (F.abs(x["b_start"] - y["b_start"]) < 2)
    best = suppress(pairs.drop("pick"), key, "confidence", "a_start", 2.0, ["b_start", "lag_s", "similarity", "period_similarity", "duration_s"], 8, best_first=[-F.col("similarity")], near=near)
    end = lambda c: F.least("duration_s", F.col(c) + block * step_s)
    return best.select(*key, "a_start", end("a_start").alias("a_end"), "b_start", end("b_start").alias("b_end"), "lag_s", "similarity", "period_similarity", "confidence")

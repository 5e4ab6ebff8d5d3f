"""Matching by position, overlap and nearness, as joins.

Range conditions are turned into equi joins on buckets of the axis, so that no join compares
all pairs; a long interval stands in each bucket it touches, and a match is counted in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.operators.series import Key


def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlap_join(a: DataFrame, b: DataFrame, key: Key, start_a: str, end_a: str, start_b: str, end_b: str, least: float | None = None, width: float = 10.0) -> DataFrame:
    """Pairs of intervals that share more than `least` (None: that touch). Columns of both must differ but for the key."""
    left = a.withColumn("_b", _buckets(F.col(start_a), F.greatest(F.col(start_a), F.col(end_a)), width))
    right = b.withColumn("_b", _buckets(F.col(start_b), F.greatest(F.col(start_b), F.col(end_b)), width))
    shared = F.least(end_a, end_b) - F.greatest(start_a, start_b)
    hit = shared >= 0 if least is None else shared > least
    first = F.floor(F.greatest(start_a, start_b) / width) == F.col("_b")
    return left.join(right, [*key, "_b"]).where(hit & first).drop("_b")


def intersect_ranges(a: DataFrame, b: DataFrame, key: Key) -> DataFrame:
    """Intersections of two sets of [start, end] ranges; empty ones are dropped."""
    pairs = overlap_join(a.select(*key, F.col("start").alias("sa"), F.col("end").alias("ea")), b.select(*key, F.col("start").alias("sb"), F.col("end").alias("eb")), key, "sa", "ea", "sb", "eb", 0.0)
    return pairs.select(*key, F.greatest("sa", "sb").alias("start"), F.least("ea", "eb").alias("end"))


def points_in(intervals: DataFrame, points: DataFrame, key: Key, start: str, end: str, time: str, before: float = 0.0, after: float = 0.0, width: float = 10.0) -> DataFrame:
    """Points whose time lies in [start - before, end + after]."""
    left = intervals.withColumn("_b", _buckets(F.col(start) - before, F.col(end) + after, width))
    right = points.withColumn("_b", F.floor(F.col(time) / width))
    return left.join(right, [*key, "_b"]).where(F.col(time).between(F.col(start) - before, F.col(end) + after)).drop("_b")


def nearest_within(queries: DataFrame, grid: DataFrame, key: Key, time: str, place: str, most: float, columns: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """Each query with its nearest grid place within `most` (ties: the earlier); queries without one keep nulls.

    ids (else time) name a query within its key.
    """
    ids = list(ids) or [time]
    right = grid.select(*key, place, *columns).withColumn("_b", F.floor(F.col(place) / most))
    left = queries.withColumn("_b", _buckets(F.col(time) - most, F.col(time) + most, most))
    near = left.join(right, [*key, "_b"]).withColumn("distance", F.abs(F.col(place) - F.col(time))).where(F.col("distance") <= most)
    best = near.groupBy(*key, *ids).agg(F.min_by(F.struct(place, "distance", *columns), F.struct("distance", place)).alias("_best"))
    return queries.join(best, [*key, *ids], "left").select(*[F.col(c) for c in queries.columns], "_best.*")


def nearest(queries: DataFrame, grid: DataFrame, key: Key, time: str, place: str, columns: Sequence[str] = (), later_on_tie: bool = True) -> DataFrame:
    """Each query with its nearest grid place at any distance, by one pass over both in order of time: the last place before and the first after."""
    from pyspark.sql import Window

    fields = F.struct(place, *columns)
    both = queries.select(*key, F.col(time).alias("_t"), F.struct(*[c for c in queries.columns if c not in key]).alias("_q"), F.lit(None).cast(grid.select(fields.alias("g")).schema["g"].dataType).alias("_g"))
    both = both.unionByName(grid.select(*key, F.col(place).alias("_t"), F.lit(None).cast(both.schema["_q"].dataType).alias("_q"), fields.alias("_g")))
    # both look back, one in falling order: a frame that grows is kept up, one that shrinks is read anew for each row
    last, first = (F.last("_g", ignorenulls=True).over(Window.partitionBy(*key).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc("_t"), F.desc("_t")))
    found = both.withColumns({"_l": last, "_f": first}).where("_q is not null")
    before, after = F.col("_t") - F.col(f"_l.{place}"), F.col(f"_f.{place}") - F.col("_t")
    left_wins = before < after if later_on_tie else before <= after
    chosen = F.when(F.col("_f").isNull() | (F.col("_l").isNotNull() & left_wins), F.col("_l")).otherwise(F.col("_f"))
    return found.select(*key, "_q.*", chosen.alias("_n")).select(*key, *[c for c in queries.columns if c not in key], "_n.*")


def zipped(a: DataFrame, b: DataFrame, key: Key, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The n-th row of a beside the n-th of b in their own orders, as far as both go. Columns of both must differ but for the key."""
    from pyspark.sql import Window

    left, right = (rows.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) for rows, order in ((a, order_a), (b, order_b)))
    return left.join(right, [*key, "position"])


def without_match(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that the other side lacks."""
    return rows.join(others, list(on), "left_anti")


def phone_supported_morae(words: DataFrame, phones: DataFrame, key: Key) -> tuple[DataFrame, DataFrame]:
    """Morae of words placed evenly over the span of the phones that overlap the word, and the words no phone supports.

    words: word_id, start_s, end_s, label, morae (array); phones: phone_start, phone_end.
    """
    from ordina.functions.text import equal_spans

    pairs = overlap_join(words, phones, key, "start_s", "end_s", "phone_start", "phone_end", 1e-6)
    span = pairs.groupBy(*key, "word_id").agg(F.min(F.greatest("phone_start", "start_s")).alias("_s"), F.max(F.least("phone_end", "end_s")).alias("_e"))
    placed = words.join(span, [*key, "word_id"]).select(*key, "word_id", F.col("label").alias("source_word"), F.posexplode(equal_spans(F.col("morae"), F.col("_s"), F.col("_e"))).alias("mora_idx", "_m"))
    failed = without_match(words, span, [*key, "word_id"]).select(*key, "word_id", "label", "start_s", "end_s", F.lit("no_phone_support").alias("reason"))
    return placed.select(*key, "word_id", "source_word", "mora_idx", "_m.*"), failed


def facet_filter(items: DataFrame, wanted: DataFrame, id: str = "item", tree: str = "tree", label: str = "label") -> DataFrame:
    """Ids that in every tree of `wanted` (tree, label) have one of its labels; an empty `wanted` matches every id."""
    trees = wanted.select(tree).distinct()
    every = items.select(id).distinct()
    hits = items.join(wanted.select(tree, label).distinct(), [tree, label], "left_semi").select(id, tree).distinct()
    counted = every.join(hits.groupBy(id).agg(F.count("*").alias("_n")), id, "left")
    total = trees.agg(F.count("*").alias("_all"))  # one row
    return counted.join(F.broadcast(total)).where(F.coalesce("_n", F.lit(0)) == F.col("_all")).select(id)


def scalar_deltas(a: DataFrame, b: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two one-row frames as rows (metric, a, b, delta = b - a); null where either is missing."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], list(metrics), "metric", name)

    return long(a, "a").join(long(b, "b"), "metric", "full").withColumn("delta", F.col("b") - F.col("a"))


def lagged_pairs(frames: DataFrame, key: Key, index: str, value: str, low: Column | int, high: Column | int) -> DataFrame:
    """Rows i with rows i + lag for every lag in [low, high]: (key, i, lag, a, b)."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    left = frames.where(low <= high).select(*key, F.col(index).alias("i"), F.col(value).alias("a"), F.explode(F.sequence(low, high)).alias("lag")).withColumn("_j", F.col("i") + F.col("lag"))
    right = frames.select(*key, F.col(index).alias("_j"), F.col(value).alias("b"))
    return left.join(right, [*key, "_j"]).drop("_j")

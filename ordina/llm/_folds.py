"""Folds by id, and bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.llm._store import BROADCAST_KEYS

FOLDS = 5


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo FOLDS; false for a null id, which is never learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(rows: DataFrame, id: str, label: str, per_label: int, most: int) -> DataFrame:
    """About per_label rows of each label; fewer, but of every label, where there are so many labels that it would be more than most rows.

    Rows are chosen by a hash of their id, alike on every run.
    """
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    labels = counts.count()
    if not labels:
        return rows.limit(0)
    each = min(per_label, -(-most // labels))
    u = F.pmod(F.xxhash64(F.lit(17), F.col(id)), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(float(each)) / F.col("_n")
    rows = rows.join(F.broadcast(counts) if labels <= BROADCAST_KEYS else counts, F.col(label) == F.col("_label"))
    return rows.withColumn("_u", u / share).where("_u < 1").orderBy("_u", id).limit(each * labels).drop("_u", "_label", "_n")

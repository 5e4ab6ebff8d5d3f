"""Scalar functions on Columns (native expressions, but for libm_*). Unusable numbers are null."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12


def finite(x: Column) -> Column:
    """x as double, null unless it is a finite number (unparseable text, NaN and infinities are null)."""
    y = x.try_cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def positive(x: Column) -> Column:
    """x, null unless finite and above 0."""
    y = finite(x)
    return F.when(y > 0, y)


def cents_between(a: Column, b: Column) -> Column:
    """1200 log2(a / b); null unless both are positive."""
    return F.when((a > 0) & (b > 0), 1200 * F.log2(a / b))


@F.arrow_udf(T.DoubleType())
def libm_power(base: pa.Array, exponent: pa.Array) -> pa.Array:
    """base to the exponent, bit for bit as the C library gives it (Java's StrictMath differs in the last digit of some)."""
    return pa.array([None if b is None or x is None else math.pow(b, x) for b, x in zip(base.to_pylist(), exponent.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def libm_log2(x: pa.Array) -> pa.Array:
    """Base-2 logarithm of numbers from 0, bit for bit as the C library gives it."""
    return pa.array([None if v is None else math.log2(v) if v else -math.inf for v in x.to_pylist()], pa.float64())


@F.arrow_udf(T.DoubleType())
def libm_sigmoid(x: pa.Array) -> pa.Array:
    """1 / (1 + exp(-x)), bit for bit as with the C library's exp; 0 where that overflows."""
    return pa.array([None if v is None else 1 / (1 + math.exp(-v)) if v > -700 or v != v else 0.0 for v in x.to_pylist()], pa.float64())


def libm_cents_between(a: Column, b: Column) -> Column:
    """cents_between by the C library, for limits that ratios meet exactly (2 ** (25 / 1200)): there the last digit decides."""
    return 1200 * libm_log2(F.when((a > 0) & (b > 0), a / b))


def hz_to_cents(hz: Column) -> Column:
    """Cents above 440 Hz."""
    return cents_between(hz, F.lit(440.0))


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440.0))


def cents_to_nearest_semitone(midi: Column) -> Column:
    """100 (midi - round(midi)), ties to even."""
    return 100 * (midi - F.rint(midi))


def wrap_residual(cents: Column, step: Column) -> Column:
    """cents in [-step / 2, step / 2), by floored modulo."""
    return F.pmod(cents + step / 2, step) - step / 2


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(EPS)))


def hnr_db(peak: Column) -> Column:
    """10 log10(r / (1 - r)) of an autocorrelation peak; null unless above 0."""
    r = F.least(F.greatest(peak, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.when(peak > 0, 10 * F.log10(r / (1 - r)))


def clamp(x: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(x + 0.5)


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def truncate(x: Column) -> Column:
    """Toward zero."""
    return x.cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Softmax of an array column."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def export_number(x: Column, digits: int = 3) -> Column:
    """Finite number rounded half to even, else null."""
    return F.bround(finite(x), digits)


def half_tempo(bpm: Column) -> Column:
    return bpm / 2


def double_tempo(bpm: Column) -> Column:
    return bpm * 2


def center_cancel(left: Column, right: Column) -> Column:
    return (left - right) / 2


def dominance_db(vocals_db: Column, other_db: Column) -> Column:
    return vocals_db - other_db


def overlap(vocals_db: Column, other_db: Column, top_db: Column, floor_db: float = 70.0) -> Column:
    """The smaller of both levels, each scaled to 0..1 over floor_db below the top."""
    return F.least(*[clamp((v - top_db + floor_db) / floor_db, 0.0, 1.0) for v in (vocals_db, other_db)])


def or_default(x: Column, default: float) -> Column:
    """x, or the default where x is null, zero or NaN."""
    return F.coalesce(F.nullif(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)), F.lit(default))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Cosine of two array columns over their common length, 0 if either is near zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa < eps) | (bb < eps), 0.0).otherwise(clamp(dot(a, b) / F.sqrt(aa * bb), -1.0, 1.0))

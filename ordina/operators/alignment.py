"""Edit alignment of unit sequences and partition of repeated lines (Arrow functions: each cell depends on its neighbours)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.functions.text import katakana_to_hiragana, lines, morae, nfkc, normalize_kana, NOT_KANA
from ordina.operators.series import Key


def aligned(ref: list[str], hyp: list[str]) -> list[tuple[str, str, str]]:
    """(op, ref, hyp) of a least-cost alignment; equal units always match, ties prefer D, then I, then S.

    Costs are filled one anti-diagonal at a time.
    """
    n, m = len(ref), len(hyp)
    code = {u: k for k, u in enumerate(dict.fromkeys([*ref, *hyp]))}
    a, b = np.array([code[u] for u in ref], np.int64), np.array([code[u] for u in hyp], np.int64)
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    op = np.full((n + 1, m + 1), "D", "U1")
    op[0] = "I"
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        same = a[i - 1] == b[j - 1]
        options = np.stack([cost[i - 1, j] + 1, cost[i, j - 1] + 1, cost[i - 1, j - 1] + 1])
        best = options.argmin(axis=0)
        cost[i, j] = np.where(same, cost[i - 1, j - 1], options[best, np.arange(len(i))])
        op[i, j] = np.where(same, "=", np.array(["D", "I", "S"])[best])
    out, i, j = [], n, m
    while i or j:
        k = str(op[i, j])
        out.append((k, "" if k == "I" else ref[i - 1], "" if k == "D" else hyp[j - 1]))
        i, j = i - (k != "I"), j - (k != "D")
    return out[::-1]


ROW = T.StructType([T.StructField(c, T.StringType(), False) for c in ("op", "ref", "hyp")])


@F.arrow_udf(T.ArrayType(ROW, False))
def edit_alignment(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Alignment rows of two arrays of units; null if either is."""
    found = [None if r is None or h is None else [dict(zip(("op", "ref", "hyp"), row, strict=True)) for row in aligned(r, h)] for r, h in zip(ref.to_pylist(), hyp.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.struct([(c, pa.string()) for c in ("op", "ref", "hyp")])))


def error_metrics(alignment: Column) -> dict[str, Column]:
    """Counts and error rate (null without reference units) of an alignment column."""

    def count(*ops: str) -> Column:
        return F.size(F.filter(alignment, lambda r: r["op"].isin(*ops)))

    reference = count("=", "S", "D")
    return {"substitutions": count("S"), "deletions": count("D"), "insertions": count("I"), "correct": count("="), "reference_units": reference, "hypothesis_units": count("=", "S", "I"), "error_rate": count("S", "D", "I") / F.nullif(reference, F.lit(0))}


def mora_alignment(ref: Column, hyp: Column) -> Column:
    """Alignment of the morae of two kana texts."""
    return edit_alignment(morae(normalize_kana(ref)), morae(normalize_kana(hyp)))


def mora_matrix(cycles: DataFrame, key: Key, value: str = "morae") -> DataFrame:
    """Errors over the longer length (1 at least) of every pair i < j of a series' cycles; each pair of distinct values is aligned once."""
    from ordina.operators.structure import cycle_pairs

    pairs = cycle_pairs(cycles, key, value)
    values = cycles.select(*key, F.col(value).alias("_x")).distinct()
    kinds = values.join(values.withColumnRenamed("_x", "_y"), list(key)).select("_x", "_y").distinct().withColumn("_a", edit_alignment("_x", "_y"))
    errors = F.size(F.filter("_a", lambda r: r["op"] != "="))
    kinds = kinds.select("_x", "_y", (errors / F.greatest(F.size("_x"), F.size("_y"), F.lit(1))).alias("distance"))
    return pairs.join(kinds, F.col("a").eqNullSafe(F.col("_x")) & F.col("b").eqNullSafe(F.col("_y"))).select(*key, "i", "j", "distance")


def partitioned(surface: list[str], kana: list[str], cycles: int, canonical: int, deviation: int) -> list[list[str]]:
    """Contiguous chunks of lines: the first canonical ones, then cycles - 1 chunks of nearly that length, at least edit cost to the first.

    Ties: the chunk lengths whose distances from canonical come first in order.
    """
    if cycles <= 0 or canonical <= 0 or len(surface) < canonical:
        raise ValueError("cycles and canonical are positive, and the text has one canonical cycle at least")
    if cycles == 1:
        return [surface]
    first, rest = kana[:canonical], kana[canonical:]
    low, high = max(1, canonical - deviation), canonical + deviation
    worst = (10**9, ())
    best = {len(rest): (0, ())}  # of the chunks from a position on, for so many cycles left
    for _ in range(1, cycles):
        now = {}
        for position in range(len(rest) + 1):
            options = []
            for length in range(low, min(high, len(rest) - position) + 1):
                after = best.get(position + length, worst)
                if after[0] < 10**9:
                    cost = sum(op != "=" for op, _, _ in aligned(first, rest[position : position + length]))
                    lengths = (length, *after[1])
                    options.append((cost + after[0], tuple(abs(x - canonical) for x in lengths), lengths))
            if options:
                cost, _, lengths = min(options, key=lambda o: o[:2])
                now[position] = cost, lengths
        best = now
    if 0 not in best:
        raise ValueError(f"{len(surface)} lines can't be cut in {cycles} cycles of about {canonical}")
    chunks, at = [surface[:canonical]], canonical
    for length in best[0][1]:
        chunks.append(surface[at : at + length])
        at += length
    return chunks


def partition_lines(texts: DataFrame, text: str, cycles: int, canonical: int, deviation: int = 3) -> DataFrame:
    """Adds chunks (array of texts), one per cycle; null where the text can't be cut so, with the reason in chunks_error."""

    @F.arrow_udf("struct<chunks: array<string>, chunks_error: string>")
    def cut(surface: pa.Array, kana: pa.Array) -> pa.Array:
        out = []
        for s, k in zip(surface.to_pylist(), kana.to_pylist(), strict=True):
            try:
                out.append({"chunks": ["\n".join(c) for c in partitioned(s or [], k or [], cycles, canonical, deviation)], "chunks_error": None})
            except ValueError as error:
                out.append({"chunks": None, "chunks_error": str(error)})
        return pa.array(out, pa.struct([("chunks", pa.list_(pa.string())), ("chunks_error", pa.string())]))

    # one composition for all lines of a text; the rest of normalize_kana line by line
    composed = F.split(nfkc(F.concat_ws("\n", "_lines")), "\n")
    kana = F.transform(composed, lambda s: F.regexp_replace(katakana_to_hiragana(F.lower(s)), NOT_KANA, ""))
    rows = texts.withColumn("_lines", lines(F.col(text))).withColumn("_kana", kana)
    return rows.withColumn("_cut", cut("_lines", "_kana")).select(*[F.col(c) for c in texts.columns], "_cut.*")

"""Bulk-synchronous best-fit packing of token sequences.

A document is its ids and an end id; longer ones are cut into pieces of the context length.
Pieces are range-sorted by length, longest first, which gives each its rank, and packed in
supersteps, one for each band of lengths, longest first.

A superstep range-sorts the band's pieces and the gaps of open sequences together, by size.
In that order a piece's successor, the smallest gap that holds it, is the gap most recently
passed and not taken: a sweep matches them like brackets. Every range is swept on its own;
what it leaves over (pieces without a gap, gaps without a piece) is swept once more across
the ranges. Pieces that want the same gap get it by rank, the others take the next successor.
A gap takes as many pieces as it surely holds; then gaps are updated for the next superstep,
and pieces that no gap holds open new sequences.

Pieces of one length differ in rank only, so sweeps work on runs: a length and a range of
ranks, a gap and a range of sequences. There are at most as many lengths and gaps as tokens
in a context, whatever the input, so no length is a hot key, and the placements (a range of
ranks, its first sequence and offset) are bounded too. Pieces look theirs up by rank.

Defined cases: null or empty text: the end id alone. Very long texts are whole, cut into as
many pieces as they need. Repeated rows are packed apart. Null ids stay null. Other columns, of
whatever names, are not read. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import durable, forget, pick
from ordina.llm._text import runs
from ordina.llm._word_ids import default_tokenizer, word_ids

#: Kinds of runs: gaps of open sequences, pieces to be placed, placements, gaps that this superstep is done with, the number of sequences.
GAP, PIECE, PLACED, DONE, OPENED = range(5)
#: size: a gap or a length; first, n: sequences of a gap, ranks of pieces; units: pieces that a gap still takes; offset: where it begins; sequence: of a placement's first rank.
RUN = "kind int, size int, first long, n long, units int, offset int, sequence long"
#: Ranges that a superstep sweeps on their own.
RANGES = 4


def _pieces(texts: pa.Array, tokenizer: str, context: int, end_id: int) -> pa.Array:
    """Per text a list of (start, length, crc32 of the piece's ids)."""
    starts, sizes, crcs, counts = [], [], [], []
    for text, cache, place, n, words in word_ids(texts, tokenizer):
        ids = cache.flat[runs(place, n)].astype("<u4")
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.cumsum(words)]
        begins = np.concatenate([[0], ends[:-1]])
        raw, tail = ids.tobytes(), np.array([end_id], "<u4").tobytes()
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            size, own = b - a + 1, raw[4 * a : 4 * b] + tail
            cuts = range(0, size, context)
            counts.append(len(cuts))
            starts += cuts
            sizes += [min(context, size - s) for s in cuts]
            crcs += [zlib.crc32(own[4 * s : 4 * (s + context)]) for s in cuts]
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, sizes, crcs)], names=["start", "length", "ids_crc32"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def pieces(docs: DataFrame, tokenizer: str | None = None, context: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32")]), False)
    cut = F.arrow_udf(lambda texts: _pieces(texts, path, context, end_id), kind).asNondeterministic()
    rows = pick(docs, doc_id=id, text=text).select("doc_id", cut("text").alias("cut"))
    return rows.select("doc_id", F.posexplode("cut").alias("piece", "p")).select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def bands(context: int) -> list[tuple[int, int]]:
    """Lengths above the first and up to the second number, longest first: over half the context, then narrow bands, wider ones for short pieces, which fit anywhere."""
    edges = [context, context // 2]
    while edges[-1]:
        edges.append(edges[-1] * 5 // 6 if edges[-1] > context // 5 else edges[-1] // 2)
    return list(zip(edges[1:], edges[:-1], strict=True))


def sweep(rows: list[tuple], context: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Placements, what is done, and what is left of runs in the order of the sweep."""
    placed, done, pieces = [], [], []
    gaps: list[tuple] = []  # passed and not taken; the smallest is the last
    for kind, size, first, n, units, offset, _ in rows:
        if kind == GAP:
            gaps.append((size, first, n, units, offset))
            continue
        while n and gaps:
            gap, sequence, many, units, offset = gaps.pop()
            full = min(many, n // units)  # this many gaps are filled, one more perhaps in part
            layers, wide = (units, full) if full else (n, 1)
            for k in range(layers):
                placed.append((PLACED, size, first + k * wide, wide, 0, offset + k * size, sequence))
            if many > wide:
                gaps.append((gap, sequence + wide, many - wide, units, offset))
            if layers < units:
                gaps.append((gap, sequence, 1, units - layers, offset + layers * size))
            else:
                done.append((DONE, context - offset - layers * size, sequence, wide, 0, offset + layers * size, 0))
            first, n = first + layers * wide, n - layers * wide
        if n:
            pieces.append((PIECE, size, first, n, 0, 0, 0))
    return placed, done, pieces + [(GAP, *g, 0) for g in gaps]


def _ranges(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[pa.RecordBatch]:
    """One range of a superstep, in order; gaps that the band can't use pass through."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    placed, done, left = sweep([r for r in rows if r[0] in (GAP, PIECE)], context)
    yield _batch([*placed, *done, *left, *(r for r in rows if r[0] in (DONE, OPENED))])


def _across(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[pa.RecordBatch]:
    """What the ranges left over, in order: swept once more; then the pieces still left open sequences."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    if not rows:
        return
    placed, done, left = sweep([r for r in rows if r[0] in (GAP, PIECE)], context)
    placed += [r for r in rows if r[0] == PLACED]
    gaps = [(r[2], r[3], r[5]) for r in [*done, *left, *rows] if r[0] == DONE] + [(r[2], r[3], r[5]) for r in left if r[0] == GAP]
    opened, begun = sum(r[3] for r in rows if r[0] == OPENED), (0, context)  # the last sequence opened, and how far it is filled
    for _, size, first, n, *_ in (r for r in left if r[0] == PIECE):
        sequence, offset = begun
        more = min(n, (context - offset) // size)
        placed += [(PLACED, size, first + k, 1, 0, offset + k * size, sequence) for k in range(more)]
        begun, first, n = (sequence, offset + more * size), first + more, n - more
        if n:
            each = context // size
            full, rest = divmod(n, each)
            for k in range(each):  # one piece for each sequence, then the next for each
                if wide := full + (k < rest):
                    placed.append((PLACED, size, first, wide, 0, k * size, opened))
                    first += wide
            gaps += [(begun[0], 1, begun[1]), (opened, full, each * size)]
            begun, opened = (opened + full, rest * size if rest else context), opened + full + (rest > 0)
    gaps.append((begun[0], 1, begun[1]))
    yield _batch([*placed, *((GAP, context - offset, first, n, 0, offset, 0) for first, n, offset in gaps if n and offset < context), (OPENED, 0, 0, opened, 0, 0, 0)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RUN.split(", ")])


def _in_order(rows: DataFrame) -> list:
    """Columns of the order of a sweep: by size from above, gaps before the pieces that they just hold, the first sequence last among equal gaps."""
    return [F.desc("size"), F.asc("kind"), F.asc(F.when(F.col("kind") == GAP, -F.col("first")).otherwise(F.col("first")))]


def placements(lengths: DataFrame, context: int) -> list[DataFrame]:
    """Tables with the PLACED runs of all pieces, from one PIECE run for each length."""
    state, tables = lengths.where(F.lit(False)), []
    for low, high in bands(context):
        size = F.lit(context) - F.col("offset")
        used = (F.col("kind") == GAP) & (size > low)
        gaps = state.where(F.col("kind").isin(GAP, OPENED)).withColumns({"kind": F.when(used | (F.col("kind") == OPENED), F.col("kind")).otherwise(DONE), "units": F.when(used, F.greatest(F.lit(1), F.floor(size / high))).otherwise(0).cast("int")})
        rows = gaps.unionByName(lengths.where((F.col("size") > low) & (F.col("size") <= high)))
        order = _in_order(rows)
        swept = rows.repartitionByRange(RANGES, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _ranges(b, context), RUN)
        state = durable(swept.repartition(1).sortWithinPartitions(*order).mapInArrow(lambda b: _across(b, context), RUN), "packing-superstep")
        tables.append(state)
    return tables


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the range and each row's place in it."""
    task, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "task", "place"])
        at += n


def pack(cut: DataFrame, context: int = 2048) -> DataFrame:
    """Places rows that have a length (1 to context): adds sequence_id and offset; sequences fill from 0 without gaps."""
    spark, names = cut.sparkSession, cut.columns
    held = durable(cut.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    schema = T.StructType([*held.schema.fields, T.StructField("task", T.IntegerType(), False), T.StructField("place", T.LongType(), False)])
    order = [F.desc("length"), F.asc("uid")]  # the number splits a length that many pieces have
    ranked = durable(held.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema).drop("uid"), "packing-sorted")
    size = {r["task"]: r["n"] for r in ranked.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one row for each range
    base = np.zeros(max(size, default=0) + 2, np.int64)
    for task, n in size.items():
        base[task + 1] = n
    base = np.cumsum(base)
    before = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)  # at most context rows
    counts = ranked.groupBy(F.col("length").cast("int").alias("size")).agg(F.count("*").alias("n"))
    zero = F.lit(0)
    lengths = counts.select(F.lit(PIECE).alias("kind"), "size", F.coalesce(F.sum("n").over(before), zero).cast("long").alias("first"), "n", zero.alias("units"), zero.alias("offset"), zero.cast("long").alias("sequence"))
    tables = placements(durable(lengths, "packing-lengths"), context)
    paths = [f for t in tables for f in t.inputFiles()]
    placed = spark.read.schema(RUN).parquet(*paths).where(F.col("kind") == PLACED).select("first", "offset", "sequence").toArrow()  # bounded by lengths and gaps
    first, offset, sequence = (placed.column(k).to_numpy() for k in range(3))
    by = np.argsort(first, kind="stable")
    shared = spark.sparkContext.broadcast((base, first[by], (sequence - first)[by], offset[by].astype(np.int64)))
    forget(spark, held, *tables)

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)]))
    def find(task: pa.Array, place: pa.Array) -> pa.Array:
        base, first, shift, offset = shared.value
        rank = base[task.to_numpy()] + place.to_numpy()
        at = np.searchsorted(first, rank, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(rank + shift[at]), pa.array(offset[at])], names=["sequence_id", "offset"])

    return ranked.withColumn("_place", find("task", "place")).select(*names, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, context: int = 2048, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, tokenizer, context, end_id, id, text), context)

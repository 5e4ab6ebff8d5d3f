"""Exact removal of repeated passages by prefix-free parsing.

A byte is removed if it lies in a string of `length` bytes that also starts anywhere else.

1. Triggers. A rolling hash runs over the text; the least value among the first `reach`
   positions of a string of `length` bytes is the string's trigger. It depends on the string
   alone, so equal strings have their trigger at the same place. Between two changes of the
   trigger lies a phrase: neighbouring strings with one trigger. The parse of a text is its
   sequence of phrases.
2. Parse. Every string of a phrase contains the phrase's core (from the trigger, common to
   all of them) and lies in its context (from its first string to the end of its last). In
   corpus order, suffixes with a common core are neighbours. A core that occurs once has no
   repeated string. If all phrases with a core have one context, every string of them is
   repeated; so it is for contexts that occur twice or more.
3. Dictionary. The other phrases with a common core, one for each distinct context, are the
   dictionary. Equal strings have equal cores, so it is ordered core by core: the contexts of
   some cores are joined to one text, whose suffix array is built by prefix doubling (8, 16, ...
   128 bytes, at last two overlapping ranks of 128 for `length`). Neighbours in it with a common
   prefix of `length` or more are repeated strings.
4. Both combine into corpus order: a place in the dictionary's order stands for all places
   where the parse has that phrase. The repeated strings' union is cut out.

Suffixes are ordered as far as `length` bytes, which is all that matters here. A context holds
every string of its phrase whole, so no comparison goes on into the next phrase and the parse
is ordered by its phrases' names (128-bit hashes), not by what follows them.

A core with more than `MOST` distinct contexts (the edge of a passage that a third of the texts
share) is too much for one task; its strings are counted one by one by 128-bit hashes, with
partial sums, to the same result.

Defined cases: null counts as empty. Texts shorter than `length` stay whole. Very long texts are
parsed by windows, to the same phrases. Copies and repeated rows all lose what they share. Rows stay, even with nothing
left. Null ids stay null. An empty table gives an empty result. Columns other than id and text
are never read by name, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm._store import durable, flag, flat, forget, pick
from ordina.llm._text import BASE, BYTE_VALUES, CHUNK, Bytes, buffers, mix, parts, runs

LENGTH = 200
#: Bytes of a trigger, and positions among which it is chosen (reach + trigger must not exceed the length).
TRIGGER, REACH = 12, 96
#: Kinds of spans of string starts: repeated for certain; in the dictionary, as a partner only or to be decided.
CERTAIN, PARTNER, OPEN = 0, 1, 2
SPAN = "struct<lo: int, n: int, kind: int, core: bigint>"
#: Contexts of a core that are ordered in one task, and bytes of contexts ordered at once.
MOST, TOGETHER = 20_000, 2 << 20
#: Bytes of one text that are parsed at once, and of contexts that are cut out at once; bound a worker's memory however long a text is.
WINDOW, CONTEXTS = CHUNK, CHUNK
#: An entry of the dictionary: the text it is taken from, where it begins, its context, and whether its strings are to be decided.
ENTRY = "core long, g long, lo int, open boolean, context binary"
PASSAGE = "array<struct<start: bigint, length: bigint>>"


def rolling(buf: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER (8 + 4) bytes from each position."""

    def power(k: int) -> np.uint64:
        return np.uint64(pow(int(BASE), k, 1 << 64))

    one = BYTE_VALUES[0][buf]
    two = one[:-1] * BASE + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    return eight[:-4] * power(4) + four[8:]


def phrases(text: Bytes, length: int = LENGTH, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string start, number of strings, trigger (positions in the buffer) and text of each phrase."""
    if len(text.buf) < length:
        return (np.zeros(0, np.int64),) * 4
    value = mix(rolling(text.buf)) >> np.uint64(32)
    key = (value << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    trigger = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    strings = np.maximum(np.diff(text.off) - length + 1, 0)
    start = runs(text.off[:-1], strings)
    trigger, row = trigger[start], np.repeat(np.arange(len(text)), strings)
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return start[first], np.diff(np.append(first, len(start))), trigger[first], row[first]


def windows(text: Bytes, length: int) -> Iterator[tuple[Bytes, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The phrases of some texts, as phrases() gives them: a buffer, where in the text it begins, and its phrases.

    A text of more than WINDOW bytes goes by windows. The last phrase of a window may go on beyond it, so the next one begins with it.
    """
    at, size, most = 0, len(text.buf), max(WINDOW, 2 * length)  # a window has more than one phrase
    while len(text) == 1 and size - at > most:
        piece = Bytes(text.buf[at : at + most], np.array([0, most]), text.first)
        lo, n, trigger, row = phrases(piece, length)
        yield piece, at, lo[:-1], n[:-1], trigger[:-1], row[:-1]
        at += int(lo[-1])
    if at:
        text = Bytes(text.buf[at:], np.array([0, size - at]), text.first)
    yield text, at, *phrases(text, length)


def _list(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, t1, t2) to one row per text with its digest and phrases."""
    for batch in batches:
        texts = batch.column("text")
        buf, off = buffers(texts)
        digest = [hashlib.sha256(buf[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        found, counts = [], np.zeros(len(texts), np.int64)
        for some in parts(texts):
            for text, at, lo, n, trigger, row in windows(some, length):
                core = text.hashes(trigger, trigger + (length - REACH + 1))
                whole = mix(text.hashes(lo, lo + n - 1 + length, 1) ^ mix(((trigger - lo) * 512 + n).astype(np.uint64)))
                found.append((core, whole, (lo - text.off[row] + at).astype(np.int32), n.astype(np.int32)))
                counts[text.first : text.first + len(text)] += np.bincount(row, minlength=len(text))
        core, whole, lo, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        values = pa.StructArray.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(lo, pa.int32()), pa.array(n, pa.int32())], names=["core", "whole", "lo", "n"])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(np.diff(off)), pa.array(digest, pa.string()), _list(values, counts)], names=["doc_id", "t1", "t2", "n_bytes", "sha256", "phrases"])


def covered(size: int, starts: np.ndarray, numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of bytes inside strings that begin in [start, start + number)."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], starts[order] + numbers[order] - 1 + length
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    return a[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


def _settled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(t1, t2, n_bytes, spans) with settled: whether the certain spans cover the text and none is in the dictionary."""
    for batch in batches:
        settled = []
        for size, spans in zip(batch.column("n_bytes").to_pylist(), batch.column("spans"), strict=True):
            lo, n, kind = (spans.values.field(k).to_numpy().astype(np.int64) for k in range(3))
            a, b = covered(size, lo, n, length) if not kind.any() else ([1], [0])
            settled.append(len(a) == 1 and a[0] == 0 and b[0] == size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(settled, pa.bool_())], names=[*batch.schema.names, "settled"])


def _entries(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(g, text, spans) to one row per entry of the dictionary."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    for batch in batches:
        spans = batch.column("spans")
        for text in parts(batch.column("text")):
            own = spans.slice(text.first, len(text))
            lo, n, kind = (own.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
            core = own.flatten().field(3)
            row = np.repeat(np.arange(len(text)), own.value_lengths().to_numpy())
            some = np.flatnonzero(kind > CERTAIN)
            lo, n, kind, row, core = lo[some], n[some], kind[some], row[some], core.take(pa.array(some))
            size = n - 1 + length
            g, cut = batch.column("g").to_numpy()[text.first + row], (np.cumsum(size) - size) // CONTEXTS
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(cut)]
            for a, b in zip(edges, edges[1:]):
                context = text.buf[runs(lo[a:b] + text.off[row[a:b]], size[a:b])]
                off = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([core.slice(a, b - a), pa.array(g[a:b]), pa.array(lo[a:b].astype(np.int32)), pa.array(kind[a:b] == OPEN), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(context.tobytes())])], names=names)


def ranks(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(key)
    step = np.zeros(len(key), np.uint64)
    step[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(step)
    return out


def suffix_order(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the suffixes there as far as length bytes, and whether each has `length` bytes in common with the one before.

    length is 8 or more; from each start on there are as many bytes.
    """
    size = len(buf)
    padded = np.concatenate([buf, np.zeros(length + 8, np.uint8)])
    key = np.zeros(size, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : size + k]
    rank, width = ranks(key), 8
    shift = np.uint64(32)

    def after(k: int) -> np.ndarray:
        return np.concatenate([rank[k:], np.zeros(min(k, size), np.uint64)])

    while 2 * width <= length:
        rank, width = ranks((rank << shift) | after(width)), 2 * width
    both = (rank[starts] << shift) | rank[starts + length - width]
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(starts), bool)
    same[1:] = both[order[1:]] == both[order[:-1]]
    return order, same


def _repeated(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Starts (g, at) of strings to be decided that occur again in the contexts of whole cores."""
    buf, off = buffers(rows.column("context"))
    buf, off = buf[off[0] : off[-1]], off - off[0]
    n = np.diff(off) - length + 1
    starts, row = runs(off[:-1], n), np.repeat(np.arange(len(n)), n)
    order, same = suffix_order(buf, starts, length)
    again = np.zeros(len(starts), bool)
    again[order] = same | np.append(same[1:], False)
    again &= rows.column("open").to_numpy()[row]
    row, at = row[again], starts[again]
    return pa.RecordBatch.from_arrays([pa.array(rows.column("g").to_numpy()[row]), pa.array((rows.column("lo").to_numpy()[row] + at - off[row]).astype(np.int32))], names=["g", "at"])


def _ordered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Entries sorted by core to repeated starts; some whole cores at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        core = batch.column("core").to_numpy()
        last = int(np.searchsorted(core, core[-1]))  # the last core may go on in the next batch
        if sum(b.nbytes for b in held) > TOGETHER and (last or len(held) > 1 and held[-2].column("core")[-1].as_py() != core[0]):
            yield _repeated(pa.Table.from_batches([*held[:-1], batch.slice(0, last)]), length)
            held = [batch.slice(last)]
    if held:
        yield _repeated(pa.Table.from_batches(held), length)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Entries to one row per string: two hashes, the text it is from, its start, and whether it is to be decided."""
    for batch in batches:
        for text in parts(batch.column("context")):
            n = np.diff(text.off) - length + 1
            place, row = runs(text.off[:-1], n), np.repeat(np.arange(len(n)), n) + text.first
            at = batch.column("lo").to_numpy()[row] + place - text.off[row - text.first]
            yield pa.RecordBatch.from_arrays([pa.array(text.hashes(place, place + length).view(np.int64)), pa.array(text.hashes(place, place + length, 1).view(np.int64)), batch.column("g").take(pa.array(row)), pa.array(at.astype(np.int32)), batch.column("open").take(pa.array(row))], names=["h1", "h2", "g", "at", "open"])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, spans, starts) to the removed passages and the digest of what is kept."""
    for batch in batches:
        texts, spans, starts = batch.column("text"), batch.column("spans"), batch.column("starts")
        buf, off = buffers(texts)
        rows = []
        for i in range(batch.num_rows):
            lo, n, kind = (spans[i].values.field(k).to_numpy().astype(np.int64) for k in range(3))
            sure = kind == CERTAIN
            more = starts[i].values.to_numpy().astype(np.int64) if starts[i].is_valid else np.zeros(0, np.int64)
            a, b = covered(0, np.concatenate([lo[sure], more]), np.concatenate([n[sure], np.ones(len(more), np.int64)]), length)
            own = buf[off[i] : off[i + 1]]
            digest = hashlib.sha256()
            for k, m in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True):
                digest.update(own[k:m])
            rows.append((a, b - a, digest.hexdigest()))
        size = np.array([len(r[0]) for r in rows], np.int64)
        where, many = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in (0, 1))
        passages = _list(pa.StructArray.from_arrays([pa.array(where), pa.array(many)], names=["start", "length"]), size)
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), passages, pa.array([r[2] for r in rows], pa.string())], names=["t1", "t2", "passages", "kept_sha256"])


def _named(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, text and a 128-bit name of the text."""
    rows = pick(docs, doc_id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, t1, t2, n_bytes, sha256), and by text name those with repeats: (t1, t2, passages, kept_sha256).

    passages are the maximal removed runs of bytes, as start and length.
    """
    if length < REACH + TRIGGER:
        raise ValueError(f"length is at least {REACH + TRIGGER}")
    spark = docs.sparkSession
    rows = _named(docs, id, text)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n_bytes long, sha256 string, phrases array<struct<core: bigint, whole: bigint, lo: int, n: int>>"
    parsed = durable(rows.mapInArrow(lambda b: _parse(b, length), kind).withColumn("uid", F.monotonically_increasing_id()), "repeats-parse")
    digests = durable(parsed.drop("phrases"), "repeats-digests")
    phrase = parsed.select("uid", F.explode("phrases").alias("p")).select("uid", "p.*")
    cores = phrase.groupBy("core").agg(F.count("*").alias("c"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("c > 1")
    cores = durable(cores.select("core", (F.col("least") == F.col("most")).alias("same")), "repeats-cores")
    shared = phrase.join(cores, "core").select("uid", "lo", "n", *[F.when(~F.col("same"), F.col(c)).alias(c) for c in ("core", "whole")])
    shared = durable(shared, "repeats-shared")
    forget(spark, cores, parsed)
    mixed = shared.where("core is not null")
    entries = durable(mixed.groupBy("core", "whole").agg(F.count("*").alias("c"), F.min(F.struct("uid", "lo", "n")).alias("first")), "repeats-dictionary")
    many = durable(entries.groupBy("core").agg(F.count("*").alias("c")).where(F.col("c") > MOST).select("core"), "repeats-many")
    twice = mixed.join(entries.where("c > 1").select("core", "whole"), ["core", "whole"])
    nothing = F.lit(None).cast("long")
    spans = shared.where("core is null").select("uid", "lo", "n", F.lit(CERTAIN).alias("kind"), nothing.alias("core"))
    spans = spans.union(twice.select("uid", "lo", "n", F.lit(CERTAIN), nothing))
    spans = spans.union(entries.select("first.uid", "first.lo", "first.n", F.when(F.col("c") == 1, OPEN).otherwise(PARTNER), "core"))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "n", "kind", "core")).alias("spans"))  # as many as one text has phrases
    spans = spans.join(digests.select("uid", "t1", "t2", "n_bytes"), "uid")
    # copies have the same spans; the dictionary took its entries from the first of them
    spans = spans.groupBy("t1", "t2").agg(F.min_by(F.struct("n_bytes", "spans"), "uid").alias("s")).select("t1", "t2", "s.*")
    spans = durable(spans.mapInArrow(lambda b: _settled(b, length), f"t1 long, t2 long, n_bytes long, spans array<{SPAN}>, settled boolean"), "repeats-spans")
    forget(spark, shared, entries)
    open_ = spans.where("not settled").select("t1", "t2", "spans")
    # copies meet in each task before the shuffle
    texts = rows.groupBy("t1", "t2").agg(F.first("text").alias("text")).join(open_, ["t1", "t2"])
    texts = durable(texts.withColumn("g", F.monotonically_increasing_id()), "repeats-texts")
    found = texts.where(F.exists("spans", lambda s: s["kind"] > CERTAIN)).select("g", "text", "spans").mapInArrow(lambda b: _entries(b, length), ENTRY)
    found = flag(found, F.col("core"), many, "hot")
    starts = found.where("not hot").drop("hot").repartition("core").sortWithinPartitions("core").mapInArrow(lambda b: _ordered(b, length), "g long, at int")
    if not many.isEmpty():
        strings = found.where("hot").drop("hot").mapInArrow(lambda b: _strings(b, length), "h1 long, h2 long, g long, at int, open boolean")
        again = durable(strings.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "repeats-strings")
        starts = starts.union(strings.where("open").join(again, ["h1", "h2"]).select("g", "at"))
    starts = durable(starts.groupBy("g").agg(F.collect_list("at").alias("starts")), "repeats-starts")  # as many as one text has
    cut = texts.join(starts, "g", "left").select("t1", "t2", "text", "spans", "starts").mapInArrow(lambda b: _cut(b, length), f"t1 long, t2 long, passages {PASSAGE}, kept_sha256 string")
    empty = hashlib.sha256().hexdigest()
    gone = spans.where("settled").select("t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length"))).alias("passages"), F.lit(empty).alias("kept_sha256"))
    found = durable(cut.union(gone).where(F.size("passages") > 0), "repeats-found")
    forget(spark, texts, starts, spans, many)
    return digests.select("doc_id", "t1", "t2", "n_bytes", "sha256"), found


def report(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, passages."""
    parsed, found = repeats(docs, length, id, text)
    out = parsed.join(found, ["t1", "t2"], "left")
    removed = F.aggregate(F.coalesce("passages", F.expr(f"cast(array() as {PASSAGE})")), F.lit(0).cast("long"), lambda total, p: total + p["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("passages"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "passages")


def _without(texts: pa.Array, passages: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts, passages, strict=True):
        if not spans.is_valid or not len(spans):
            out.append(text.as_py())
            continue
        raw = text.as_py().encode()
        start, size = (spans.values.field(k).to_pylist() for k in (0, 1))
        kept, at = [], 0
        for a, n in zip(start, size, strict=True):
            kept.append(raw[at:a])
            at = a + n
        # a passage may end inside a character: the part of it that is left isn't text
        out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
    return pa.array(out, pa.string())


def strip(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of the texts; all rows and other columns stay."""
    _, found = repeats(docs, length, id, text)
    names = docs.columns
    at = f"_{names.index(text)}"
    rows = flat(docs).withColumns({"t1": F.xxhash64(F.coalesce(at, F.lit(""))), "t2": F.xxhash64(F.lit(7), F.coalesce(at, F.lit("")))})
    rows = rows.join(found.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "passages"), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    without = F.arrow_udf(_without, "string")
    return rows.withColumn(at, F.when(F.col("passages").isNull(), F.col(at)).otherwise(without(at, "passages"))).select(*[f"_{i}" for i in range(len(names))]).toDF(*names)

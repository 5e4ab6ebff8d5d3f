"""Near-duplicate join on word n-grams with Bayesian candidate pruning.

Documents with the same set of shingles are one class from the start. Each class has a
MinHash signature; classes that agree in a band of it are candidates, and candidates
connected through bands form clusters. A cluster is one block; one of many classes is split into
blocks by the bands that most of its classes share, and two blocks meet only if they have a band in common.
Where blocks meet, the MinHash values of pairs are
compared some at a time: the agreements so far leave a Beta posterior of the similarity
(uniform prior), and a pair is dropped as soon as the probability that it reaches the
threshold falls below a tolerance. The remaining pairs are verified by their exact shingle
sets. Pairs never become rows: two blocks give the links per class and a spanning forest of them.

A pair at the threshold agrees in no band with a probability of (1 - t**rows)**bands
(5e-8 with the defaults), and is dropped wrongly with about the tolerance.

Defined cases: words are runs of non-space bytes, compared as they are. A text of fewer than
n words has one shingle, all its words. A text without words (or null) links to nothing and is
a class of its own, as is each of its rows. Repeated rows and copies are members of the same
class. Class ids are the smallest document id of the class (null only if all are). Texts are whole,
however long. An empty table gives an empty result. Columns other than id and text are found by
exact name, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import durable, flat, forget, pick
from ordina.llm._text import Bytes, mix, parts, runs

MULTIPLIER = np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Join:
    """tolerance: the posterior probability below which a pair is dropped; step: MinHash values compared at a time."""

    n: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 256

    @property
    def size(self) -> int:
        return self.bands * self.rows


def multipliers(how: Join) -> np.ndarray:
    return np.random.default_rng(3).integers(1, 1 << 62, how.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: Bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their number."""
    start, end = text.words()
    words, rows = text.hashes(start, end), text.rows(start)
    count = text.count(start)
    span = np.minimum(count, n)
    have = np.where(count > 0, count - span + 1, 0)
    first = runs((np.cumsum(count) - count), have)
    owner = np.repeat(np.arange(len(text)), have)
    key = np.zeros(len(first), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    rows = np.concatenate([rows, np.full(n, -1)])
    for k in range(n):
        inside = rows[first + k] == owner
        key = key * MULTIPLIER + np.where(inside, padded[first + k], np.uint64(k + 1))
    key = mix(key)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.bincount(owner[new], minlength=len(text))


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _identity(texts: pa.Array, n: int) -> pa.Array:
    """Per text a 128-bit name of its shingle set (null without words): sums of two mixes over the set."""
    a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    none = np.ones(len(texts), bool)
    for text in parts(texts):
        key, count = shingles(text, n)
        here = slice(text.first, text.first + len(text))
        a[here], b[here] = _sums(key, count), _sums(mix(key ^ MULTIPLIER), count)
        none[here] = count == 0
    return pa.StructArray.from_arrays([pa.array(x.view(np.int64), mask=none) for x in (a, b)], names=["a", "b"])


def _signatures(batches: Iterator[pa.RecordBatch], how: Join) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, a, b, signature)."""
    factor = multipliers(how)
    for batch in batches:
        texts = batch.column(1)
        signature = np.zeros((len(texts), how.size), np.uint32)
        a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        none = np.ones(len(texts), bool)
        for text in parts(texts, 1 << 19):
            key, count = shingles(text, how.n)
            here = slice(text.first, text.first + len(text))
            a[here], b[here] = _sums(key, count), _sums(mix(key ^ MULTIPLIER), count)
            none[here] = count == 0
            full = np.flatnonzero(count)
            if len(full):
                begin = (np.cumsum(count) - count)[full]
                for k in range(how.size):
                    signature[text.first + full, k] = np.minimum.reduceat(key * factor[k], begin) >> np.uint64(32)
        fixed = pa.array([None if m else s.tobytes() for m, s in zip(none.tolist(), signature, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.view(np.int64), mask=none), pa.array(b.view(np.int64), mask=none), fixed], names=["doc_id", "a", "b", "signature"])


def _bands(batches: Iterator[pa.RecordBatch], how: Join) -> Iterator[pa.RecordBatch]:
    """(node, signature) to (band, node): one row per band."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw = batch.column(1)
        offset = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
        s = np.frombuffer(raw.buffers()[2], np.uint8)[offset : offset + n * how.size * 4].view(np.uint32).reshape(n, how.bands, how.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, how.bands + 1, dtype=np.uint64), (n, how.bands)).copy()
        for r in range(how.rows):
            key = mix(key * MULTIPLIER + s[:, :, r])
        node = np.repeat(batch.column(0).to_numpy(), how.bands)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["band", "node"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(x, y) edges of longs to (node, root): the smallest node of each connected component; nodes without edges are absent.

    Alternates large-star and small-star steps (each keeps connectivity and hooks nodes to
    smaller ones) until nothing changes; every step is written out.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        return both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        joined = down.join(least, "x")
        return joined.where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y"))).distinct()

    now = durable(edges.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), name)
    mark = None
    while True:
        step = durable(small(large(now)), name)
        named = F.xxhash64("x", "y")
        seen = step.agg(F.count("*"), F.bit_xor(named), F.sum(F.shiftright(named, 24))).first()
        forget(now.sparkSession, now)
        now = step
        if tuple(seen) == mark:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        mark = tuple(seen)


def least_agreements(how: Join) -> np.ndarray:
    """For each number of compared values, the fewest agreements with which a pair goes on.

    The posterior of the similarity after m agreements in n is Beta(m + 1, n - m + 1).
    """
    grid = (np.arange(20000) + 0.5) / 20000
    out = np.zeros(how.size + 1, np.int64)
    for n in range(how.step, how.size + 1, how.step):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            if np.exp(log)[grid >= how.threshold].sum() / 20000 >= how.tolerance:
                out[n] = m
                break
    return out


def block_links(sig_x: np.ndarray, sig_y: np.ndarray, sets_x: list[np.ndarray], sets_y: list[np.ndarray], same: bool, how: Join, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of two blocks that reach the threshold; of one block with itself, i < j."""
    i, j = np.triu_indices(len(sig_x), 1) if same else (m.ravel() for m in np.indices((len(sig_x), len(sig_y))))
    size_x, size_y = np.array([len(s) for s in sets_x]), np.array([len(s) for s in sets_y])
    fits = np.minimum(size_x[i], size_y[j]) >= how.threshold * np.maximum(size_x[i], size_y[j]) - 1e-9
    i, j = i[fits], j[fits]
    agree = np.zeros(len(i), np.int64)
    for n in range(how.step, how.size + 1, how.step):
        if not len(i):
            return i, j
        part = slice(n - how.step, n)
        agree += (sig_x[i, part] == sig_y[j, part]).sum(axis=1)
        on = agree >= least[n]
        i, j, agree = i[on], j[on], agree[on]
    # exact: number the shingles of both blocks; each row's intersections with the other side's by a bitmap
    linked = np.zeros(len(i), bool)
    _, number = np.unique(np.concatenate([*sets_x, *sets_y]), return_inverse=True)
    number = np.split(number, np.cumsum(np.concatenate([size_x, size_y]))[:-1])
    seen = np.zeros(int(max(x.max() for x in number)) + 1, bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order])) + 1
    for group in np.split(order, cuts) if len(order) else ():
        x = i[group[0]]
        seen[number[x]] = True
        others = j[group]
        n = size_y[others]
        hit = seen[np.concatenate([number[len(sets_x) + y] for y in others])]
        both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        linked[group] = both >= how.threshold * (size_x[x] + n - both) - 1e-9
        seen[number[x]] = False
    return i[linked], j[linked]


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Numbers of the edges of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _verify(how: Join):
    least = least_agreements(how)

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of two blocks (side 0 and 1) or of one, to (x, y, links): forest edges, and with y null the links of x (documents)."""
        size = {0: rows.side.to_numpy() == 0, 1: rows.side.to_numpy() == 1}
        node, copies = rows.node.to_numpy(), rows.copies.to_numpy()
        sig = np.frombuffer(b"".join(rows.signature), np.uint32).reshape(len(rows), how.size)
        sets: list[np.ndarray] = []
        for text in parts(pa.array(rows.text, pa.string())):
            hashes, n = shingles(text, how.n)
            sets += np.split(hashes, np.cumsum(n)[:-1])
        same = key[1] == key[2]
        x = np.flatnonzero(size[0])
        y = x if same else np.flatnonzero(size[1])
        i, j = block_links(sig[x], sig[y], [sets[k] for k in x], [sets[k] for k in y], same, how, least) if len(x) and len(y) else (np.zeros(0, int),) * 2
        i, j = x[i], y[j]
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        kept = _forest(i, j)
        some = np.flatnonzero(links)
        edges = pd.DataFrame({"x": node[i[kept]], "y": pd.array(node[j[kept]], dtype="Int64"), "links": 0})
        return pd.concat([edges, pd.DataFrame({"x": node[some], "y": pd.array([None] * len(some), dtype="Int64"), "links": links[some].astype(np.int64)})])

    return verify


def blocks(wide: DataFrame, size: int) -> DataFrame:
    """(node, band, n: the band's nodes) to (node, band, block) with about size nodes of a block, alike ones together.

    A node's home is its band of the most nodes, so a group of nodes alike has few homes however its nodes differ. Large homes are cut into blocks.
    Small ones (below a quarter of a block) share blocks with other small homes of the same anchor, the largest home that they have a band in common with.
    """
    order = Window.partitionBy("node")  # at most a row per band
    homed = durable(wide.select("node", "band", F.max_by("band", F.struct("n", F.xxhash64("band"))).over(order).alias("home")), "jaccard-homes")
    homes = homed.groupBy("home").agg(F.count_distinct("node").alias("nodes"))
    near = durable(homed.select("band", "home").distinct().join(homes, "home"), "jaccard-near")
    top = near.groupBy("band").agg(F.max(F.struct("nodes", "home")).alias("top"))
    small = near.where(F.col("nodes") * 4 < size).join(top, "band").groupBy("home", "nodes").agg(F.max("top")["home"].alias("anchor"))
    shares = small.groupBy("anchor").agg(F.ceil(F.sum("nodes") / size).alias("parts"))
    small = small.join(shares, "anchor").select("home", F.xxhash64("anchor", F.pmod(F.xxhash64("home"), F.col("parts")), F.lit("small")).alias("shared"))
    # large homes are few, and their rows would meet in a task each
    cut = homed.join(F.broadcast(homes.where(F.col("nodes") > size).select("home", F.ceil(F.col("nodes") / size).alias("parts"))), "home", "left")
    whole = cut.where("parts is null").join(small, "home", "left").select("node", "band", F.coalesce("shared", "home").alias("block"))
    out = cut.where("parts is not null").select("node", "band", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")).union(whole)
    out = durable(out, "jaccard-blocks")
    forget(wide.sparkSession, homed, near)
    return out


def join(docs: DataFrame, how: Join = Join(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, a, b (the name of its shingle set, null without words), class_id, n_links, class_key.

    class_key tells classes apart whose smallest ids are equal (null without words). n_links counts the other documents whose similarity to it is the threshold or more, its
    equals included; classes are connected by links.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id, text=text)
    kind = T.StructType([rows.schema["doc_id"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("signature", T.BinaryType())])
    signed = durable(rows.mapInArrow(lambda batches: _signatures(batches, how), kind), "jaccard-signed")
    # a class per shingle set: copies are counted in each task before the shuffle
    sets = signed.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.first("signature").alias("signature"))
    nodes = durable(sets.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    banded = nodes.select("node", "signature").mapInArrow(lambda batches: _bands(batches, how), "band long, node long")
    least = durable(banded.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("last"), F.count("*").alias("n")).where("x != last").drop("last"), "jaccard-bands")
    held = durable(banded.join(least, "band"), "jaccard-shared")  # bands of more than one class, and how many have them
    cluster = components(held.where("node != x").select("x", F.col("node").alias("y")), "jaccard-clusters")
    member = cluster.union(cluster.select(F.col("root").alias("node"), "root").distinct()).distinct()
    member = durable(member.join(nodes.drop("least_id"), "node"), "jaccard-members")
    forget(spark, least, cluster)
    # a cluster of up to a block's classes stays whole; larger ones are split by bands
    large = member.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > how.block).select("root")
    wide = held.join(member.select("node", "root").join(large, "root"), "node").select("node", "band", "n")
    block = blocks(wide, how.block)
    at = durable(block.select("band", "block").distinct(), "jaccard-bands-of-blocks")
    half = at.join(at.select("band", F.col("block").alias("other")), "band").where("block <= other").select("block", "other").distinct()  # blocks, not classes: a block has many
    half = durable(half, "jaccard-meets")
    meets = half.union(half.where("block < other").select("other", "block"))
    placed = member.join(block.select("node", "block").distinct(), "node", "left")
    texts = rows.withColumn("k", F.arrow_udf(lambda t: _identity(t, how.n), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).asNondeterministic()("text")).select("text", "k.a", "k.b").where("a is not null")
    full = texts.groupBy("a", "b").agg(F.first("text").alias("text")).join(placed, ["a", "b"])  # copies meet in each task first
    full = durable(full.drop("a", "b"), "jaccard-texts")
    # two blocks meet once, and each block itself
    pairs = full.where("block is null").withColumns({"block": F.lit(0).cast("long"), "other": F.lit(0).cast("long")}).unionByName(full.where("block is not null").join(meets, "block"))
    pairs = pairs.select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "signature", "text")
    found = durable(pairs.groupBy("root", "p", "q").applyInPandas(_verify(how), "x long, y long, links long"), "jaccard-links")
    links = found.where("y is null").groupBy(F.col("x").alias("node")).agg(F.sum("links").alias("links"))
    forget(spark, member, block, at, half, full, held)
    roots = components(found.where("y is not null").select("x", "y"), "jaccard-classes")
    named = nodes.select("a", "b", "copies", "least_id", "node").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    # single classes need no second look: a root is shared by linked classes alone
    classes = durable(named.join(ids, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-named")
    forget(spark, nodes, found, roots)
    out = signed.select("doc_id", "a", "b").join(classes, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return out.select("doc_id", "a", "b", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("root").alias("class_key"))


def keep_one(docs: DataFrame, how: Join = Join(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: that of the smallest id, one row of it.

    An id may stand on several rows: each is judged by its own text. Documents without an id or
    without words all stay. An empty table stays empty; other columns, of whatever names, are kept.
    """
    names = docs.columns
    found = join(docs, how, id, text)
    key, rest = F.col(f"_{names.index(id)}"), flat(docs)
    gone = found.where("a is not null and doc_id != class_id").select(F.col("doc_id").alias("_gone")).distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return rest.join(gone, key.eqNullSafe(F.col("_gone")), "left_anti").toDF(*names)
    single = rest.join(again, key.eqNullSafe(F.col("_again")), "left_anti").join(gone, key.eqNullSafe(F.col("_gone")), "left_anti")
    named = rest.join(again, key.eqNullSafe(F.col("_again")), "left_semi").withColumn("_k", F.arrow_udf(lambda t: _identity(t, how.n), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])).asNondeterministic()(F.col(f"_{names.index(text)}")))
    first = found.where("a is not null and doc_id = class_id").select(F.col("doc_id").alias("_d"), "a", "b", "class_key").distinct()
    kept = named.join(first, (key == F.col("_d")) & (F.col("_k.a") == F.col("a")) & (F.col("_k.b") == F.col("b")))
    kept = kept.groupBy("class_key").agg(F.first(F.struct(*[f"_{i}" for i in range(len(names))])).alias("r")).select("r.*")
    return single.unionByName(kept).unionByName(named.where("_k.a is null").drop("_k")).toDF(*names)

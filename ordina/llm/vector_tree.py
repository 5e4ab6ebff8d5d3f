"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted in numpy on a bounded sample and shipped to the executors; every vector
goes down it to a leaf. A query opens nodes best-bin-first from a priority queue (nearest
centre first) until it has visited a number of leaves, which is calibrated: queries out of
the sample widen their visits until they find the asked share of their true neighbours.
Queries then meet the vectors of the leaves they visit, block by block, and distances are
computed in double precision on the original vectors. The first few leaves of a query give a
radius, the distance of its k-th nearest there. A leaf farther away than that (by the triangle
inequality: the distance to its centre less the farthest of its vectors from the centre) is left
out, and from all others only vectors within the radius return.

Leaves grow with neither the rows nor hot vectors: a leaf of many rows (a vector that a third
of the rows share) is split by salt, its queries go to each part, and every part returns its
own nearest. Nothing is capped. Vectors without any clusters need most leaves for a high recall,
and the work is then near that of comparing each query with all rows.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another
number of components than most take no part. Ties go to the smaller id. Rows of one id are one
vector, the first of them in order of components. Fewer candidates than asked: all of them. Null
ids take no part. An empty table gives an empty result. Columns other than id and embedding are
not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.llm._store import durable, forget, pick


@dataclass(frozen=True)
class Index:
    """sample: rows the tree is fitted on; leaf: rows of a leaf aimed at; recall: what the calibration must reach; part and block: rows of a leaf, and queries of it, compared in one task;
    first: leaves that give a query its radius."""

    branching: int = 16
    sample: int = 20_000
    leaf: int = 128
    rounds: int = 8
    calibration: int = 200
    recall: float = 0.97
    part: int = 8192
    block: int = 4096
    first: int = 4
    seed: int = 23


class Tree:
    """Nodes in arrays: centres of all nodes, and the children of each; a node without children is a leaf."""

    def __init__(self) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append(np.zeros(0, np.int64))
        self.leaf.append(-1)
        return len(self.centres) - 1

    def seal(self) -> Tree:
        self.matrix = np.stack(self.centres)
        for k, c in enumerate(self.children):
            if not len(c):
                self.leaf[k] = self.leaves
                self.leaves += 1
        return self

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row (down to the nearest child each time), and the distance to its centre."""
        out, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(rows):
                continue
            if not len(kids):
                out[rows], far[rows] = self.leaf[node], distances(self.matrix[node], x[rows])
                continue
            near = nearest(x[rows], self.matrix[kids])
            todo += [(int(kid), rows[near == k]) for k, kid in enumerate(kids)]
        return out, far

    def visits(self, q: np.ndarray, most: int) -> list[tuple[int, float]]:
        """Up to most leaves, best bin first, and the distances to their centres."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            square, node = heapq.heappop(queue)
            kids = self.children[node]
            if not len(kids):
                found.append((self.leaf[node], square**0.5 if node else float(distances(q, self.matrix[:1])[0])))
                continue
            d = ((self.matrix[kids] - q) ** 2).sum(axis=1)
            for k, kid in enumerate(kids.tolist()):
                heapq.heappush(queue, (float(d[k]), kid))
        return found


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for k in range(0, len(x), 8192):
        out[k : k + 8192] = (half - x[k : k + 8192] @ centres.T).argmin(axis=1)
    return out


def fit(x: np.ndarray, leaf: int, how: Index = Index()) -> Tree:
    """Splits nodes of more than leaf sample rows by k-means until none is left (or a node's rows are all alike)."""
    rng = np.random.default_rng(how.seed)
    tree = Tree()
    todo = [(tree.add(x.mean(axis=0)), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        k = min(how.branching, max(2, -(-len(rows) // max(1, leaf))))
        if len(rows) <= leaf:
            continue
        own = x[rows]
        different = np.unique(own, axis=0)
        if len(different) < 2:
            continue
        centres = different[rng.choice(len(different), min(k, len(different)), replace=False)]
        for _ in range(how.rounds):
            near = nearest(own, centres)
            count = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, own)
            centres = total[count > 0] / count[count > 0, None]
        near = nearest(own, centres)
        kids = [j for j in range(len(centres)) if (near == j).any()]
        if len(kids) < 2:
            continue
        tree.children[node] = np.array([tree.add(centres[j]) for j in kids])
        todo += [(int(n), rows[near == j]) for n, j in zip(tree.children[node], kids, strict=True)]
    return tree.seal()


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


def calibrate(tree: Tree, x: np.ndarray, k: int, how: Index = Index()) -> tuple[int, float]:
    """Leaf visits with which queries out of the sample find the asked share of their k nearest, and the share found."""
    rng = np.random.default_rng(how.seed + 1)
    leaf, _ = tree.assign(x)
    ranks = []
    for i in rng.choice(len(x), min(how.calibration, len(x)), replace=False):
        order = np.full(tree.leaves, tree.leaves)
        seen = [leaf for leaf, _ in tree.visits(x[i], tree.leaves)]
        order[seen] = np.arange(len(seen))
        d = distances(x[i], x)
        d[i] = np.inf
        ranks += order[leaf[np.argsort(d, kind="stable")[: min(k, len(x) - 1)]]].tolist()
    ranks = np.sort(ranks)
    if not len(ranks):
        return 1, 1.0
    need = int(ranks[min(len(ranks) - 1, int(np.ceil(how.recall * len(ranks))) - 1)]) + 1
    return need, float((ranks < need).mean())


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda v: v != 0)


def _probes(batches: Iterator[pa.RecordBatch], tree: Tree, visits: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to a row per visited leaf, with its place in the order of visits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [tree.visits(q, visits) for q in _matrix(batch.column("embedding"))]
        row = pa.array(np.repeat(np.arange(batch.num_rows), [len(v) for v in found]))
        leaf, away = (np.array([v[k] for one in found for v in one]) for k in (0, 1))
        visit = np.concatenate([np.arange(len(v)) for v in found])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(row), batch.column("embedding").take(row), pa.array(leaf.astype(np.int64)), pa.array(visit.astype(np.int32)), pa.array(away)], names=["query_id", "query", "leaf", "visit", "away"])


#: Queries compared with a part at once.
TOGETHER = 128


def within(q: np.ndarray, own: np.ndarray, radius: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query (vectors q with ids own) the k nearest of x within its radius, itself left out: query, row of x and distance; ties to the smaller id.

    A matrix product finds the rows that may be among them, up to its rounding; the distances of these are then computed as such.
    """
    # of equal vectors only the k + 1 smallest ids can be among the nearest
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    place = np.arange(len(by)) - np.searchsorted(same[by], same[by])
    order = order[by[place <= k]]
    x, ids = x[order], ids[order]
    square = (x * x).sum(axis=1)
    out = []
    for a in range(0, len(q), TOGETHER):
        here = q[a : a + TOGETHER]
        d = (here * here).sum(axis=1)[:, None] + square - 2 * (here @ x.T)
        slack = 1e-11 * ((here * here).sum(axis=1) + square.max(initial=0.0))
        d[own[a : a + TOGETHER, None] == ids] = np.inf
        d[d > (radius[a : a + TOGETHER] ** 2 + slack)[:, None]] = np.inf
        edge = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(here), np.inf)
        i, j = np.nonzero(np.isfinite(d) & (d <= (edge + 2 * slack)[:, None]))
        exact = distances(here[i], x[j])
        near = exact <= radius[a + i]
        i, j, exact = i[near], j[near], exact[near]
        by = np.lexsort((ids[j], exact, i))
        i, j, exact = i[by], j[by], exact[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a + i[first], order[j[first]], exact[first]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


def _meet(k: int):
    def meet(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """The k nearest vectors of the part within each query's radius."""
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = (np.stack(v.to_numpy()).astype(np.float64) for v in (vectors.embedding, queries["query"]))
        ids, own = vectors.vec_id.to_numpy(), queries.query_id.to_numpy()
        i, j, d = within(q, own, queries.radius.to_numpy(), x, ids, k)
        return pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": d})

    return meet


def search(vectors: DataFrame, queries: Column, k: int = 10, how: Index = Index(), id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that queries (a condition on vec_id) selects, its k nearest other rows."""
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id, embedding=embedding).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    result = T.StructType([T.StructField("query_id", rows.schema["vec_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("embedding") == sizes["d"])
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        total = sizes["n"]
    else:
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        total = rows.count()
    share = min(1.0, 1.5 * how.sample / total)
    u = F.pmod(F.xxhash64(F.lit(31), "vec_id"), F.lit(1 << 20))
    sample = rows.where(u < share * (1 << 20)).orderBy(u, "vec_id").limit(how.sample).toArrow()
    if not sample.num_rows:
        sample = rows.limit(how.sample).toArrow()
    x = _matrix(sample.column("embedding").combine_chunks())
    tree = fit(x, max(1, int(how.leaf * min(1.0, len(x) / total))), how)
    visits, _ = calibrate(tree, np.unique(x, axis=0), k, how)
    shared = spark.sparkContext.broadcast(tree)

    @F.arrow_udf(T.StructType([T.StructField("leaf", T.LongType()), T.StructField("far", T.DoubleType())]))
    def assign(e: pa.Array) -> pa.Array:
        leaf, far = shared.value.assign(_matrix(e)) if len(e) else (np.zeros(0, np.int64), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(leaf), pa.array(far)], names=["leaf", "far"])

    indexed = durable(rows.withColumn("_at", assign.asNondeterministic()("embedding")).select("*", "_at.*").drop("_at"), "vectors-leaves")
    schema = T.StructType([T.StructField("query_id", rows.schema["vec_id"].dataType), T.StructField("query", rows.schema["embedding"].dataType), T.StructField("leaf", T.LongType()), T.StructField("visit", T.IntegerType()), T.StructField("away", T.DoubleType())])
    asked = durable(indexed.where(queries).select("vec_id", "embedding").mapInArrow(lambda batches: _probes(batches, shared.value, visits), schema), "vectors-probes")

    def parts(df: DataFrame, name: str, most: int, *more: Column) -> DataFrame:
        """Leaf and its number of parts: no more rows than the tree has leaves, so no more than the sample."""
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / most).cast("int").alias(name), *more).withColumnRenamed("leaf", "l")

    split = durable(parts(indexed, "parts", how.part, F.max("far").alias("reach")).join(parts(asked, "blocks", how.block), "l"), "vectors-split")
    split = F.broadcast(split)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    asked = asked.join(split, F.col("leaf") == F.col("l")).withColumns({"part": every("parts"), "block": some("query_id", "blocks")})
    dealt = indexed.join(split, F.col("leaf") == F.col("l")).withColumns({"part": some("vec_id", "parts"), "block": every("blocks")})
    by = ["leaf", "part", "block"]
    plain = T.StructType([f for f in result if f.name != "rank"])

    def met(probes: DataFrame) -> DataFrame:
        return probes.select("query_id", "query", "radius", *by).groupBy(*by).cogroup(dealt.select("vec_id", "embedding", *by).groupBy(*by)).applyInPandas(_meet(k), plain)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    everything = F.lit(float("inf"))
    near = durable(best(met(asked.where(F.col("visit") < how.first).withColumn("radius", everything))).drop("rank"), "vectors-near")
    radius = near.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(everything).alias("radius"))
    rest = asked.where(F.col("visit") >= how.first).join(radius, F.col("query_id") == F.col("q"), "left").withColumn("radius", F.coalesce("radius", everything))
    rest = rest.where(F.col("away") - F.col("reach") <= F.col("radius") * (1 + 1e-9))
    out = durable(best(near.unionByName(met(rest))).select("query_id", "rank", "vec_id", "score"), "vectors-found")
    forget(spark, near, asked, indexed, split)
    return out

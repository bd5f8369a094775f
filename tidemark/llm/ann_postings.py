"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more coordinate that makes all of them equally long, so that the largest inner product is the least
distance. Centroids come from k-means on a bounded sample (the only thing fitted on one: rows of the smallest id hash, so
reruns agree) and stay in memory; many centroids are fitted in two levels, the second by cells in Spark tasks; clusters that
came out too large are split. Every vector is indexed: in its nearest list, and, at a boundary, in up to `replicas`
lists not much farther. Long lists are stored in slices of bounded size, all of which a query of the list visits,
so a very common vector gathers in no single task and no vector is left out. A query finds its nearest centroids by a best-first walk over
a graph of centroids and keeps the lists whose distance is within `prune` times the least.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_schema, map_rows, small_batches
from tidemark.plans.scratch import scope, written

LIST_AIM, MAX_CENTROIDS, SAMPLE_PER_CENTROID, MAX_SAMPLE = 256, 16_384, 64, 100_000
#: Centroids that the driver fits by itself; rows in a slice of a list; edges and width of the walk; numbers in one block of distances.
FLAT, SLICE_ROWS, DEGREE, WALK, BLOCK = 256, 2_000, 24, 96, 1 << 22


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def widen(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that all rows have the length of the longest."""
    return np.concatenate([x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None]))


def blocks(x: np.ndarray, y: np.ndarray):
    """(first row, distances to all of y) for blocks of rows of x of bounded size."""
    step = max(1, BLOCK // max(1, len(y)))
    for at in range(0, len(x), step):
        yield at, distances(x[at : at + step], y)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from a fixed start; at the end a cluster of over four times the mean is split in two, again and again."""
    rng = np.random.default_rng(42)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([far.argmin(axis=1) for _, far in blocks(x, c)])
        sums, counts = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    parts = [x[own == i] for i in range(len(c)) if (own == i).any()]
    while len(parts) < 2 * k and len(largest := max(parts, key=len)) > 4 * len(x) / k:
        parts = [p for p in parts if p is not largest]
        axis = np.linalg.svd(largest - largest.mean(axis=0), full_matrices=False)[2][0]
        side = (along := largest @ axis) > np.median(along)
        if side.all() or not side.any():
            parts.append(largest)
            break
        parts += [largest[side], largest[~side]]
    return np.array([p.mean(axis=0) for p in parts])


def sample_centroids(sample: DataFrame, dim: int, longest: float, n_lists: int) -> np.ndarray:
    """Centroids of the sample (column v, at most MAX_SAMPLE rows, written): on the driver, or by cells of a coarse fit."""
    read = lambda df: widen(_matrix(df.select("v").toArrow().column(0).combine_chunks(), dim), longest)
    if n_lists <= FLAT:
        return fit_centroids(read(sample), n_lists)
    cells = ceil(sqrt(n_lists))
    coarse = fit_centroids(read(sample.orderBy("h").limit(SAMPLE_PER_CENTROID * cells)), cells)
    rows = sample.count()

    def deal():
        def batch(b: pa.RecordBatch):
            x = widen(_matrix(b.column(0), dim), longest)
            return {"cell": np.concatenate([far.argmin(axis=1) for _, far in blocks(x, coarse)]).astype(np.int32), "v": b.column(0)}

        return batch

    def fit(cell: pa.Table) -> pa.Table:
        x = widen(_matrix(cell.column("v").combine_chunks(), dim), longest)
        found = fit_centroids(x, max(1, round(n_lists * len(x) / rows)))
        return pa.table({"c": pa.array(found.tolist(), pa.list_(pa.float64()))})

    found = map_rows(sample.select("v"), {"cell": "int", "v": "array<double>"}, deal).groupBy("cell").applyInArrow(fit, "c array<double>").toArrow()
    return _matrix(found.column("c").combine_chunks(), dim + 1)


class CentroidGraph:
    """Each centroid is joined to its DEGREE nearest; a search walks best-first from a few fixed entries."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        d = min(DEGREE, n - 1)
        near = np.concatenate([np.argsort(far, axis=1)[:, 1 : d + 1] for _, far in blocks(centroids, centroids)]) if d else np.empty((n, 0), int)
        self.near: list[np.ndarray] = []
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near):
            for j in row:
                back[j].append(i)
        self.near = [np.unique(np.concatenate([near[i], np.array(back[i], int)])).astype(int) for i in range(n)]
        self.entries = np.linspace(0, n - 1, min(n, 32)).astype(int)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first."""
        width = max(WALK, want)
        dist = np.full(len(self.centroids), np.inf)

        def look(at: np.ndarray) -> None:
            dist[at] = np.sqrt(((self.centroids[at] - q) ** 2).sum(axis=1))

        look(self.entries)
        seen, done = self.entries, np.zeros(len(dist), bool)
        while True:
            best = seen[np.argsort(dist[seen], kind="stable")[:width]]
            open_ = best[~done[best]]
            if not len(open_):
                return best[:want], dist[best[:want]]
            step = open_[:8]
            done[step] = True
            fresh = np.unique(np.concatenate([self.near[i] for i in step]))
            fresh = fresh[np.isinf(dist[fresh])]
            look(fresh)
            seen = np.concatenate([best, fresh])


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components, so equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def best(q: np.ndarray, q_keys: np.ndarray, v: np.ndarray, v_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of each query's k largest inner products, ties to the smaller key; keys: (id, copy), own row left out.

    Fast products choose with room for their rounding; exact ones decide.
    """
    fast = q @ v.T
    fast[(q_keys[:, None, :] == v_keys[None]).all(axis=2)] = -np.inf
    least = -np.partition(-fast, k - 1, axis=1)[:, k - 1] if fast.shape[1] > k else np.full(len(q), -np.inf)
    room = 1e-12 * q.shape[1] * np.sqrt((q**2).sum(axis=1) * (v**2).sum(axis=1).max())
    row, col = np.nonzero((fast >= (least - room)[:, None]) & (fast > -np.inf))
    score = inner_products(q[row], v[col])
    order = np.lexsort((v_keys[col, 1], v_keys[col, 0], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[place < k], col[place < k], score[place < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int = 64, share: float = 0.125, replicas: int = 4, boundary: float = 1.12, prune: float = 1.35, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, query_copy: the k nearest found of each query among all vectors but its own row.

    Vectors (and queries) that are null, zero or hold null or non-finite components take no part, nor do rows without id.
    Vectors of different lengths have no inner product, so each length is an index of its own and its vectors are found
    by queries of that length. Rows that repeat an id are rows like any other, told apart by `copy`, their number in the
    order of their vectors (queries hold all rows of an id, or none); ties go to the smaller id. A query with fewer than k found
    in its lists is searched again in all lists, so it gets all candidates if there are fewer than k. A query visits `probes` lists, or this
    share of the lists where that is more. No vectors or queries: no rows. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    small_batches(spark)

    def pick(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        twice = own.groupBy("vec_id").count().where("count > 1").select("vec_id")
        if twice.isEmpty():
            return own.withColumn("copy", F.lit(0))
        number = F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1
        return own.join(twice, "vec_id", "left_anti").withColumn("copy", F.lit(0)).unionByName(own.join(twice, "vec_id").withColumn("copy", number))

    own, asked = pick(vectors), pick(queries)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("m")).orderBy("d").collect()  # a row for each length
    found = [_search(own.where(F.size("v") == s["d"]), asked.where(F.size("v") == s["d"]), s["d"], s["n"], float(np.sqrt(s["m"]) * (1 + 1e-12)), k, probes, share, replicas, boundary, prune) for s in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_copy int")


def _search(own: DataFrame, asked: DataFrame, dim: int, n: int, longest: float, k: int, probes: int, share: float, replicas: int, boundary: float, prune: float) -> DataFrame:
    """search() among vectors of one length."""
    with scope() as keep:
        return keep(_found(own, asked, dim, n, longest, k, probes, share, replicas, boundary, prune))


def _found(own: DataFrame, asked: DataFrame, dim: int, n: int, longest: float, k: int, probes: int, share: float, replicas: int, boundary: float, prune: float) -> DataFrame:
    """The written result of one index."""
    spark = own.sparkSession
    n_lists = min(MAX_CENTROIDS, max(1, -(-n // LIST_AIM)))
    take = min(MAX_SAMPLE, SAMPLE_PER_CENTROID * n_lists)
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    likely = own.withColumn("h", h).where(F.col("h") < int(min(1.0, 2 * take / n) * (1 << 30)) + 1)
    sample = written(likely.orderBy("h", "vec_id", "copy").limit(take).select("h", "v"), "sample")
    centroids = sample_centroids(sample, dim, longest, n_lists) if not sample.isEmpty() else np.zeros((1, dim + 1))
    graph, probes = CentroidGraph(centroids), max(probes, ceil(share * len(centroids)))
    shared = spark.sparkContext.broadcast(graph)  # at most 2 * MAX_CENTROIDS centroids

    def to_lists(df: DataFrame, query: bool) -> DataFrame:
        def build():
            graph = shared.value

            def batch(b: pa.RecordBatch):
                x = _matrix(b.column(1), dim)
                rows, lists = [], []
                if query:
                    wide = np.concatenate([x * (longest / np.sqrt((x**2).sum(axis=1)))[:, None], np.zeros((len(x), 1))], axis=1)
                    for i, q in enumerate(wide):
                        at, far = graph.search(q, probes)
                        at = at[far <= prune * far[0]]
                        rows += [i] * len(at)
                        lists += at.tolist()
                else:
                    for first, far in blocks(widen(x, longest), graph.centroids):
                        m = min(replicas, far.shape[1])
                        near = np.argpartition(far, m - 1, axis=1)[:, :m]
                        dist = np.take_along_axis(far, near, axis=1)
                        at = np.nonzero(dist <= boundary * dist.min(axis=1, keepdims=True))
                        rows += (first + at[0]).tolist()
                        lists += near[at].tolist()
                rows = pa.array(rows, pa.int64())
                return {"vec_id": b.column(0).take(rows), "v": b.column(1).take(rows), "copy": b.column(2).take(rows), "list": pa.array(lists, pa.int32())}

            return batch

        return map_rows(df.select("vec_id", "v", "copy"), {"vec_id": "long", "v": "array<double>", "copy": "int", "list": "int"}, build)

    postings = written(to_lists(own, False), "postings")
    counts = written(postings.groupBy("list").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")), "lists")
    sliced = postings.join(F.broadcast(counts), "list")  # a row a list: bounded
    sliced = sliced.select("list", F.pmod(F.xxhash64("vec_id", "copy"), F.col("slices")).cast("int").alias("slice"), "vec_id", "copy", "v")

    def probe(found: DataFrame) -> DataFrame:
        asks = found.join(F.broadcast(counts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "vec_id", "copy", "v")
        kinds = "query_id long, query_copy int, vec_id long, copy int, score double"

        def match(q: pa.Table, p: pa.Table) -> pa.Table:
            schema = arrow_schema(kinds)
            out = tuple([np.empty(0, np.int64)] for _ in schema)
            if len(q) and len(p):
                ids, v = np.stack([p.column(c).to_numpy() for c in ("vec_id", "copy")], axis=1), _matrix(p.column("v").combine_chunks(), dim)
                for at in range(0, len(q), 256):
                    some = q.slice(at, 256)
                    own = np.stack([some.column(c).to_numpy() for c in ("vec_id", "copy")], axis=1)
                    row, col, score = best(_matrix(some.column("v").combine_chunks(), dim), own, v, ids, k)
                    for c, x in zip(out, (own[row, 0], own[row, 1], ids[col, 0], ids[col, 1], score), strict=True):
                        c.append(x)
            return pa.table([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(out, schema, strict=True)], schema=schema)

        near = asks.groupBy("list", "slice").cogroup(sliced.groupBy("list", "slice")).applyInArrow(match, kinds)
        order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")
        return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_copy")

    first = written(probe(to_lists(asked, True)), "found")
    found = first.groupBy("query_id", "query_copy").agg(F.count("*").alias("n"))
    same = (F.col("vec_id") == F.col("query_id")) & (F.col("copy") == F.col("query_copy"))
    short = asked.join(found, same, "left").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(n - 1))).select("vec_id", "copy", "v")
    short = written(short, "short")
    if short.isEmpty():
        return first
    done = first.join(short.select(F.col("vec_id").alias("query_id"), F.col("copy").alias("query_copy")), ["query_id", "query_copy"], "left_anti").select(*first.columns)
    again = probe(short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(graph.centroids) - 1)))))
    return written(done.unionByName(again), "found")

"""Approximate nearest neighbours: a classifier learned from a balanced partition of a neighbour graph routes queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf
from growthpanel.llm.vectors import in_batches, rows_of, sorted_groups, usable

#: most vectors that the partition is learned from, and neighbours of each in the graph
SAMPLE, DEGREE = 8192, 10
#: recall that the number of probed partitions is set for, on a fifth of the sample that is not learned from
RECALL = 0.96
#: vectors and queries of a tile
TILE, QUERIES = 4096, 1024
HIDDEN, EPOCHS, RATE, SEED = 128, 30, 2e-3, 42


def partitions_for(n: int) -> int:
    """Partitions grow with the root of the number of vectors; the bounded sample can tell up to 256 apart."""
    return 1 << int(min(8, max(0, round(log2(max(1.0, sqrt(n) / 4))))))


def nearest(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k rows of x nearest to each query, without its own row."""
    out = []
    square = (x * x).sum(1)
    for i in range(0, len(queries), 512):
        d = square - 2 * queries[i : i + 512] @ x.T
        if own is not None:
            d[np.arange(len(d)), own[i : i + 512]] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _halves(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of the nodes: few edges (a, b: positions in nodes) cross, and the halves are equal."""
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + 1.0
    centred = x - x.mean(0)
    v = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1] + 1e-9 * rng.normal(size=n)
    for _ in range(60):  # towards the second eigenvector of the walk on the graph
        v = v - (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * (np.bincount(a, v[b], n) + v) / degree
        v /= np.abs(v).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[: n // 2]] = True
    for _ in range(20):  # swap the nodes that have more neighbours across than at home
        crossing = side[a] != side[b]
        gain = np.bincount(a, np.where(crossing, 1.0, -1.0), n)
        up, down = np.flatnonzero(side), np.flatnonzero(~side)
        up, down = up[np.argsort(-gain[up], kind="stable")], down[np.argsort(-gain[down], kind="stable")]
        m = max(1, n // 50)
        m = min(m, int((gain[up[: len(down)]][:m] + gain[down[: len(up)]][:m] > 0).sum()))
        if not m:
            break
        new = side.copy()
        new[up[:m]], new[down[:m]] = False, True
        if (new[a] != new[b]).sum() >= crossing.sum():
            break
        side = new
    return side


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """A part for every row of x: halving again and again keeps parts equal to one row and cuts few edges of the graph."""
    n, rng = len(x), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    while part.max() + 1 < parts:
        new = part * 2
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            side = _halves(nodes, place[a[inside]], place[b[inside]], x[nodes], rng)
            new[nodes[side]] += 1
        part = new
    return part


@dataclass
class Router:
    """A network of one hidden layer: log-odds of every partition for a vector, and how many partitions to probe."""

    mean: np.ndarray
    spread: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1
    size: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, soft: np.ndarray, seed: int = SEED) -> Router:
    """Fit the network to the shares of each row's neighbours per partition, by Adam on cross-entropy."""
    rng, (n, d), parts = np.random.default_rng(seed), x.shape, soft.shape[1]
    mean, spread = x.mean(0), float(x.std() or 1.0)
    weights = [rng.normal(0, sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    z = (x - mean) / spread
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            some = order[i : i + 128]
            h = np.maximum(z[some] @ weights[0] + weights[1], 0)
            out = h @ weights[2] + weights[3]
            p = np.exp(out - out.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - soft[some]) / len(some)
            back = (g @ weights[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((z[some].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                weights[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, spread, *weights)


def usual_size(x: np.ndarray) -> float:
    """A power of two near the median of the rows' largest components."""
    return float(2.0 ** np.clip(np.round(np.log2(np.median(np.abs(x).max(1)))), -1000, 1000))


def in_range(x: np.ndarray, size: float) -> np.ndarray:
    """Components in units of the usual size, for the router: what is a million times larger counts as that."""
    with np.errstate(over="ignore"):
        return np.clip(x / size, -1e6, 1e6)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, row by row, in double precision, also where squares would overflow or vanish."""
    with np.errstate(over="ignore"):
        gap = a - b
        out = np.sqrt((gap**2).sum(1))
    odd = ~((out > 1e-140) & (out < 1e150))
    if odd.any():
        half = a[odd] / 2 - b[odd] / 2
        most = np.abs(half).max(1, keepdims=True)
        safe = np.where(most > 0, most, 1.0)
        with np.errstate(over="ignore"):
            out[odd] = 2 * (most[:, 0] * np.sqrt(((half / safe) ** 2).sum(1)))
    return out


def learn(sample: np.ndarray, parts: int, k: int, recall: float = RECALL, seed: int = SEED) -> Router:
    """Graph, partition and network from a sample; probes are counted on rows that were not learned from."""
    rng = np.random.default_rng(seed)
    size = usual_size(sample)
    sample = in_range(sample, size)
    order = rng.permutation(len(sample))
    held, taught = sample[order[: len(sample) // 5]], sample[order[len(sample) // 5 :]]
    degree = min(DEGREE, len(taught) - 1)
    graph = nearest(taught, taught, degree, np.arange(len(taught)))
    part = balanced_partition(taught, graph, parts, seed)
    soft = np.zeros((len(taught), parts))
    np.add.at(soft, (np.arange(len(taught)), part), 1.0)
    np.add.at(soft, (np.repeat(np.arange(len(taught)), degree), part[graph.ravel()]), 1.0)
    router = train_router(taught, soft / soft.sum(1, keepdims=True), seed)
    # neighbours of held rows, by the partition that the network itself gives them
    given = router.scores(taught).argmax(1)
    true = given[nearest(taught, held, min(k, len(taught)))]
    rank = np.empty((len(held), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-router.scores(held), axis=1, kind="stable"), np.arange(parts)[None, :], 1)
    needed = np.take_along_axis(rank, true, 1).ravel()
    router.probes = int(min(parts, np.quantile(needed, recall, method="higher") + 1))
    router.size = size
    return router


def _route(router: Router | None, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = rows_of(batch.column(2))
            n = len(vectors)
            if not n:
                continue
            if router is None:
                best = np.zeros((n, 1), np.int32)
            else:
                best = np.argsort(-router.scores(in_range(np.array(vectors, np.float64), router.size)), axis=1, kind="stable")[:, :probes].astype(np.int32)
            parts = pa.ListArray.from_arrays(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32), best.ravel())
            data = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, parts], names=["uid", "vec_id", "data", "parts"])

    return run


def _best(kind: str, k: int):
    """Groups of one tile of queries and one tile of vectors: the k nearest of the tile for each query."""

    def found(batches: Iterator[pa.RecordBatch]):
        for g in sorted_groups(batches, ["part", "tile", "query_tile"]):
            uid, asks = g["uid"].to_numpy(), g["asks"].to_numpy()
            q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(c):
                continue
            x = np.frombuffer(b"".join(g["data"].to_pylist()), kind).reshape(len(uid), -1).astype(np.float64)
            ids = pc.fill_null(g["vec_id"], np.iinfo(np.int64).max).to_numpy()
            # what is far smaller than the largest vector ties here, and is told apart by its exact distances
            scaled = x / 2.0 ** np.ceil(np.log2(np.abs(x).max()))
            square = (scaled * scaled).sum(1)
            for i in range(0, len(q), 128):
                some = q[i : i + 128]
                d = np.maximum(square[some, None] + square[None, c] - 2 * scaled[some] @ scaled[c].T, 0)
                d[uid[some, None] == uid[None, c]] = np.inf
                room = 1e-9 * (square[some] + square[c].max())  # rounding of the expanded form
                least = np.partition(d, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
                a, b = np.nonzero(d <= (least + room)[:, None])
                fine = np.isfinite(d[a, b])
                a, b = a[fine], c[b[fine]]
                exact = distances(x[some[a]], x[b])
                order = np.lexsort((ids[b], exact, a))
                a, b, exact = a[order], b[order], exact[order]
                first = np.searchsorted(a, a)  # where each query's rows begin
                near = np.arange(len(a)) - first < k
                yield uid[some[a[near]]], uid[b[near]], ids[b[near]], exact[near]

    return lambda batches: in_batches(found(batches), ("query", "uid", "vec_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))


def _search(rows: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(query, uid, vec_id, score): the k nearest per query among the rows of its parts; both sides have ``part``."""
    tiles = {r["part"]: -(-r["count"] // TILE) for r in rows.groupBy("part").count().collect()}  # a row per partition
    asks = {r["part"]: -(-r["count"] // QUERIES) for r in asked.groupBy("part").count().collect()}

    def dealt(df: DataFrame, own: str, mine: dict, other: str, theirs: dict) -> DataFrame:
        def of(counts: dict) -> Column:
            return F.coalesce(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("part")], F.lit(0)) if counts else F.lit(0)

        df = df.withColumn(own, F.pmod(F.xxhash64("uid"), F.greatest(of(mine), F.lit(1))).cast("int"))
        return df.where(of(theirs) > 0).withColumn(other, F.explode(F.sequence(F.lit(0), of(theirs) - 1)))

    names = ["uid", "vec_id", "data", "part", "tile", "query_tile", "asks"]
    both = dealt(rows, "tile", tiles, "query_tile", asks).withColumn("asks", F.lit(False)).select(names)
    both = both.unionByName(dealt(asked, "query_tile", asks, "tile", tiles).withColumn("asks", F.lit(True)).select(names))
    group = ["part", "tile", "query_tile"]
    near = both.repartition(*group).sortWithinPartitions(*group).mapInArrow(_best(kind, k), "query long, uid long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "uid"))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, asks: Column, k: int = 10, sample: int = SAMPLE, recall: float = RECALL, seed: int = SEED, shelf: Shelf | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``vectors`` (vec_id, embedding) where ``asks``, the k nearest others.

    ``score`` is the Euclidean distance of the original vectors in double precision, nearest first, ties to the smaller
    vec_id, a null vec_id last. Vectors that are null, empty, zero or not finite in every component take no part, nor do
    vectors of another length than most (ties: the longer). A query with fewer found than there are, as with few
    rows, is searched again among all rows. Repeated rows are candidates of their own; a row is no candidate of
    itself. An empty table gives no rows; further columns are ignored.

    At most ``sample`` vectors, taken by a hash, reach the driver: their neighbour graph is cut into equal parts, and a
    small network learns to which parts a vector's neighbours belong. It gives every row of the table its part, and
    every query as many of the likeliest parts as found the share ``recall`` of neighbours of sampled rows it had not
    seen. Parts are dealt into tiles of rows and of queries; each pair of tiles is one group and gives k rows a query.
    """
    shelf = shelf or Shelf(vectors.sparkSession)
    base = vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding", F.coalesce(asks, F.lit(False)).alias("asks"))
    base = base.where(usable(F.col("embedding"))).withColumn("size", F.size("embedding"))
    base = shelf.keep(base, "vectors")
    lengths = base.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    base, n = base.where(F.col("size") == lengths["size"]), lengths["count"]
    kind = "<f8" if "double" in base.schema["embedding"].dataType.simpleString() else "<f4"
    taken = base.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(sample).select("embedding").toPandas()
    x = np.array(taken.embedding.tolist(), np.float64)
    parts = partitions_for(n)
    router = learn(x, parts, k, recall, seed) if parts > 1 and len(x) >= 8 * parts else None
    routed = "uid long, vec_id long, data binary, parts array<int>"
    source = base.select("uid", "vec_id", "embedding")
    rows = shelf.keep(source.mapInArrow(_route(router, 1), routed), "routed").select("uid", "vec_id", "data", F.col("parts")[0].alias("part"))
    queries = base.where("asks").select("uid", "vec_id", "embedding")
    asked = shelf.keep(queries.mapInArrow(_route(router, router.probes if router else 1), routed), "queries")
    found = shelf.keep(_search(rows, asked.select("uid", "vec_id", "data", F.explode("parts").alias("part")), k, kind), "found")
    full = found.groupBy("query").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query").alias("uid"))
    short = shelf.keep(asked.join(full, "uid", "left_anti"), "short")
    if n > 1 and short.count():
        every = F.explode(F.array(*[F.lit(p) for p in range(parts if router else 1)])).alias("part")
        again = _search(rows, short.select("uid", "vec_id", "data", every), k, kind)
        found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti").unionByName(again)
    named = asked.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"))
    last = F.lit(np.iinfo(np.int64).max)
    return found.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", last).alias("vec_id"), "score")

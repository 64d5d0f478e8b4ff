"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, acos, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.llm.components import connected_components, spanning_links
from growthpanel.llm.shared import Shelf
from growthpanel.llm.vectors import in_batches, rows_of, sorted_groups, unit, usable

#: chance that a pair just at the limit shares a bucket; rows of a bucket of unrelated vectors; most rows of a tile
RECALL, BUCKET, TILE = 0.995, 16, 1024
SEED = 42


def tables_and_bits(n: int, limit: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """How many tables of how many sign bits: buckets stay small as n grows, tables make up for the bits."""
    bits = min(60, max(1, round(log2(max(2, n / bucket)))))
    same = (1 - acos(limit) / pi) ** bits
    return max(1, ceil(log(1 - recall) / log(1 - same))) if same < 1 else 1, bits


def _signs(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, copies, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows_of(batch.column(2))
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                some = np.flatnonzero(sizes == d)
                x = np.array([vectors[i] for i in some])
                planes = np.random.default_rng([seed, int(d)]).normal(size=(int(d), tables * bits))
                signs = (unit(x) @ planes > 0).reshape(len(some), tables, bits)
                keys = (signs << np.arange(bits, dtype=np.int64)).sum(2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid[some]),
                        pa.array(copies[some]),
                        pa.array(np.full(len(some), d, np.int32)),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, (len(some) + 1) * tables, tables, dtype=np.int32), keys.ravel()),
                    ],
                    names=["uid", "copies", "size", "data", "keys"],
                )

    return run


def _compare(kind: str, limit: float):
    """Groups of rows with one key, sorted: counts of new links per row, and links that connect what they connect.

    A row stands for all its copies, so it adds as many links to each row that it meets."""

    def links(table: int, cross: bool, uid, copies, own, data, keys):
        x = unit(np.frombuffer(b"".join(data), kind).reshape(len(uid), -1))
        left = np.flatnonzero(own == own.min()) if cross else np.arange(len(uid))
        right = np.flatnonzero(own != own.min()) if cross else left
        if not len(left) or not len(right):
            return
        earlier, found = np.array(keys)[:, :table], []
        for i in range(0, len(left), 256):
            a, b = np.nonzero(x[left[i : i + 256]] @ x[right].T >= limit)
            a, b = left[a + i], right[b]
            if not cross:
                a, b = a[a < b], b[a < b]
            if table and len(a):
                fresh = np.ones(len(a), bool)
                for t in range(table):  # a pair counts in the first table where it meets
                    fresh &= earlier[a, t] != earlier[b, t]
                a, b = a[fresh], b[fresh]
            found.append((a, b))
        a, b = (np.concatenate(s) for s in zip(*found))
        if not len(a):
            return
        counts = np.zeros(len(uid), np.int64)
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
        some = np.flatnonzero(counts)
        yield uid[some], np.full(len(some), -1), counts[some]
        a, b = spanning_links(a, b)
        yield uid[a], uid[b], np.zeros(len(a), np.int64)

    def found(batches: Iterator[pa.RecordBatch]):
        for g in sorted_groups(batches, ["size", "table", "key", "low", "high"]):
            if g.num_rows > 1:
                table, low, high = (g[c][0].as_py() for c in ("table", "low", "high"))
                uid, copies, own = (g[c].to_numpy() for c in ("uid", "copies", "own"))
                yield from links(table, low != high, uid, copies, own, g["data"].to_pylist(), g["keys"].to_pylist())

    return lambda batches: in_batches(found(batches), ("a", "b", "n"), (pa.int64(),) * 3)


def vector_components(vectors: DataFrame, limit: float = 0.95, recall: float = RECALL, seed: int = SEED, shelf: Shelf | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding; more columns are ignored).

    Pairs with a cosine of at least ``limit``, in double precision, are links if they share a bucket of any table; a
    pair just at the limit does with the chance ``recall``, closer ones more surely. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says whether it is the row's own.
    Vectors that are null, empty, zero or not finite in every component link with nothing, and so do vectors of
    different lengths. Rows that share a vec_id are vectors of their own. A null vec_id takes part; a component without any
    other has a null component_id. An empty table gives no rows.

    Equal vectors meet in one aggregation, which combines before the shuffle, and only the first of them is compared: a
    group of copies costs one row in every table, whatever its size. Its links count once for each copy, and a copy is
    linked to the others of its group.

    A bucket of any size is dealt into tiles of about 1,024 rows, and each pair of tiles is a group of its own, so a
    vector that a third of all rows resemble is spread over many tasks. A pair is counted in the first table where it
    meets, and a comparison gives counts and spanning links, never all pairs.
    """
    shelf = shelf or Shelf(vectors.sparkSession)
    base = shelf.keep(vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "embedding"), "vectors")
    some = base.where(usable(F.col("embedding"))).select("uid", "embedding")
    alike = shelf.keep(some.groupBy("embedding").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("copies")), "alike")
    members = some.join(alike, "embedding").select("uid", "first")
    double = "double" in base.schema["embedding"].dataType.simpleString()
    tables, bits = tables_and_bits(alike.count(), limit, recall)
    first = alike.select(F.col("first").alias("uid"), "copies", "embedding")
    signed = shelf.keep(first.mapInArrow(_signs(tables, bits, seed), "uid long, copies long, size int, data binary, keys array<long>"), "signed")
    met = signed.select("uid", "copies", "size", "data", "keys", F.posexplode("keys").alias("table", "key"))
    place = ["size", "table", "key"]
    hot = signed.select("size", F.posexplode("keys").alias("table", "key")).groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))
    hot = hot.where(F.col("rows") > TILE).select(*place, F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    hot = shelf.keep(hot, "hot")
    dealt = met.join(hot, place, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("uid", "copies", "own", "data", "keys", *place, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    group = [*place, "low", "high"]
    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare("<f8" if double else "<f4", limit), "a long, b long, n long")
    found = shelf.keep(found, "found")
    counts = found.where("b < 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.where("b >= 0").select("a", "b"), shelf)
    groups = alike.select("first", "copies").join(roots.withColumnRenamed("node", "first"), "first", "left")
    groups = groups.join(counts.withColumnRenamed("a", "first"), "first", "left")
    groups = groups.select("first", F.coalesce("root", "first").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rooted = base.select("uid", "vec_id").join(members.join(groups, "first"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = rooted.join(least, "root")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.expr("vec_id <=> component_id").alias("kept"))

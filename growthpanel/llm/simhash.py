"""Near-duplicates by SimHash fingerprints, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.llm.components import connected_components, spanning_links
from growthpanel.llm.shared import Shelf, in_slices

#: words of a shingle, seed of its hash
SHINGLE, SEED = 3, 42
#: most fingerprints of a tile: two tiles of this size are compared at a time
TILE = 2048
#: a population count of 16 bits takes 17 values; two steps of room on either side keep neighbours' keys apart
_BASE = 21
_SLICE = 1 << 14

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        n, shingles = 1, iter(words)
    else:
        n = len(words) - SHINGLE + 1
        shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(SHINGLE))))
    hashes = np.fromiter(map(_hash, shingles), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        bits = np.unpackbits(hashes[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in in_slices(texts.cast(pa.binary()))], np.uint64).view(np.int64))


def neighbours(radius: int) -> list[int]:
    """Key differences of cells whose four population counts differ by at most ``radius`` in sum; one of each sign."""
    steps = range(-radius, radius + 1)
    found = [s for s in product(steps, repeat=4) if sum(map(abs, s)) <= radius]
    return sorted(d for s in found if (d := sum(x * _BASE**i for i, x in enumerate(s))) >= 0)


def _cell(value: Column) -> Column:
    """One key for the population counts of the four 16-bit blocks."""
    key = F.lit(0)
    for i in range(4):
        block = F.shiftrightunsigned(value, 16 * i).bitwiseAND(F.lit(0xFFFF))
        key = key + (F.bit_count(block) + 2) * (_BASE**i)
    return key.cast("int")


def compare_tiles(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles (or within one): enough of them to connect all that lie within the radius."""
    a, b = [], []
    for i in range(0, len(left), 256):
        x, y = np.nonzero(np.bitwise_count(left[i : i + 256, None] ^ right[None, :]) <= radius)
        if same:
            x, y = x[x + i < y], y[x + i < y]
        a.append(left[x + i])
        b.append(right[y])
    return spanning_links(np.concatenate(a), np.concatenate(b))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], []]
            sides = [batch.column(i) for i in range(2)]
            values = [s.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for s in sides]
            ends = [np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False))]) for s in sides]
            for k, same in enumerate(batch.column(2).to_pylist()):
                left, right = (v[e[k] : e[k + 1]] for v, e in zip(values, ends))
                for to, new in zip(found, compare_tiles(left, right, same, radius)):
                    to.append(new)
            ab = [np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ab], names=["a", "b"])

    return run


def fingerprint_links(values: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all of the distinct ``fingerprint`` longs within ``radius`` bits, by exact comparison.

    Fingerprints fall into cells by the population counts of their four 16-bit blocks. Two fingerprints within the
    radius lie in cells whose counts differ by at most the radius in sum, so all other pairs of cells are skipped. A
    cell of any size is dealt into tiles of about ``tile`` fingerprints by a hash; each pair of tiles is one row and
    one comparison by exclusive-or and bit count. There are at most 17**4 = 83,521 cells, which bounds the broadcast
    table of their sizes (about 1 MB). From a pair of tiles come at most as many links as it has fingerprints.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the cells' keys leave room for a radius of 0 to 2")
    cells = values.select("fingerprint", _cell(F.col("fingerprint")).alias("cell"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = cells.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fingerprint"), "tiles").cast("int"))
    tiles = dealt.groupBy("cell", "tile").agg(F.collect_list("fingerprint").alias("values"))
    steps = F.array(*[F.lit(d) for d in neighbours(radius)])
    left = (
        tiles.select(F.col("values").alias("a"), F.col("cell").alias("own"), F.col("tile").alias("own_tile"), F.explode(steps).alias("step"))
        .withColumn("cell", F.col("own") + F.col("step"))
        .join(F.broadcast(sizes), "cell")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
        .where("step > 0 OR tile >= own_tile")
    )
    pairs = left.join(tiles, ["cell", "tile"]).select("a", F.col("values").alias("b"), F.expr("step = 0 AND tile = own_tile").alias("same"))
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text; further columns are ignored).

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest doc_id that links of at most ``radius``
    differing bits reach. Texts that are null, empty or blank have fingerprint zero and link like any other; shorter
    texts than a shingle are hashed whole. Rows with a null doc_id take part: their component_id is the smallest
    doc_id that is not null, or null if there is none. Repeated rows stay repeated. An empty table gives no rows.

    Copies collapse to one fingerprint by an aggregation that combines before the shuffle; only distinct fingerprints
    are compared. The way back to the documents is a plain join that adaptive execution splits where a fingerprint is hot.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    prints = shelf.keep(docs.select("doc_id", _fingerprints(F.col("text")).alias("fingerprint")), "prints")
    return prints.join(_classes(prints, radius, shelf), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(prints: DataFrame, radius: int, shelf: Shelf) -> DataFrame:
    """(fingerprint, root, component_id) of each distinct fingerprint; root: one fingerprint of its component."""
    distinct = shelf.keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius), shelf)
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return shelf.keep(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "classes")


def drop_near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, with all its columns.

    A group whose doc_ids are all null keeps one of its rows. Of repeated rows one stays, and of rows that share a
    doc_id but not their text the one with the smallest fingerprint, then hash of its text. An empty table gives no rows.

    Texts are read twice and fingerprinted once: what is chosen is told by doc_id and a hash of the text, which are also
    the keys by which repeated rows meet, so whole rows are shuffled once.
    """
    shelf = Shelf(docs.sparkSession)
    text = F.xxhash64("text")
    prints = shelf.keep(docs.select("doc_id", _fingerprints(F.col("text")).alias("fingerprint"), text.alias("hash")), "prints")
    distinct = prints.groupBy("fingerprint", F.col("doc_id").alias("first_id")).agg(F.min("hash").alias("hash"))
    # of each component one fingerprint stays: the smallest that its first document has
    first = distinct.join(_classes(prints, radius, shelf), "fingerprint").where("first_id <=> component_id")
    best = F.min(F.struct("fingerprint", "first_id", "hash")).alias("best")
    chosen = shelf.keep(first.groupBy("root").agg(best).select(*_row_key(F.col("best.first_id"), F.col("best.hash"))), "chosen")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_row_key(F.col("doc_id"), text))
    keys = ["key_id", "key_null", "key_text"]
    return whole.join(chosen, keys, "left_semi").groupBy(*keys).agg(F.first("row").alias("row")).select("row.*")


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """A row's keys without nulls, so that equal keys meet in one place for a join and a grouping alike."""
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("key_id"), doc_id.isNull().alias("key_null"), text_hash.alias("key_text")]

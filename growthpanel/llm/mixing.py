"""Mixing sources to target weights: integer quotas of equal blocks by the highest quotients, then seeded blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.llm.shared import WORD, Shelf, running_offsets
from growthpanel.llm.vectors import sorted_groups

#: blocks that a whole mix is cut into, rows of one stretch of a source's stream, shards of a source
BLOCKS, STRETCH, SHARDS = 1_000_000, 20_000, 16
#: a source is taken at most so many times
MOST = 3
SEED = 42


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """What each source should give: shares of the total by weight, each at most ``most`` times its size.

    What is cut off a source is shared among the others by weight, again and again until none is above.
    """
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def apportion(seats: int, shares: Sequence[float], most: Sequence[int]) -> list[int]:
    """Sainte-Lague: ``seats`` by the highest quotients share / (2 k + 1), ties to the earlier; at most ``most`` each.

    All but a seat or two per share follow from the divisor, the rest are given one by one.
    """
    shares, most = np.asarray(shares, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[shares > 0].sum()))
    given = np.zeros(len(shares), np.int64)
    if seats <= 0:
        return given.tolist()
    low, high = 0.0, 4.0 * shares.sum() / seats + shares.max()
    for _ in range(100):  # the divisor with which rounding gives just below the seats
        mid = (low + high) / 2
        if np.minimum(np.floor(shares / mid + 0.5), most).sum() > seats:
            low = mid
        else:
            high = mid
    given = np.minimum(np.floor(shares / high + 0.5), most).astype(np.int64)
    while given.sum() < seats:
        quotients = np.where((given < most) & (shares > 0), shares / (2 * given + 1), -1.0)
        given[int(quotients.argmax())] += 1
    return given.tolist()


def _steps(n: int, seed: int) -> tuple[int, int]:
    """Factor and shift of a seeded reordering of 0..n-1."""
    rng = np.random.default_rng([seed, n])
    factor, shift = int(rng.integers(1, max(2, n))), int(rng.integers(0, max(1, n)))
    while gcd(factor, n) != 1:
        factor += 1
    return factor, shift


def plan(sources: pd.DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED, weights: Sequence[float] | None = None, most: int = MOST) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """From (source, size) per source: targets by source, quotas by source and shard, and the words of a block.

    Sources stand in code point order, null last, and weigh 1, 2, 3, repeating, unless weights are given in that order.
    """
    names = [None if pd.isna(s) else s for s in sources.source]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    sources = pd.DataFrame({"source": pd.Series([names[i] for i in order], dtype=object), "size": [int(sources["size"].iloc[i]) for i in order]})
    sizes = sources["size"].tolist()
    weights = weights or [1 + i % 3 for i in range(len(sizes))]
    sources["target"] = targets(sizes, weights, most)
    block = max(1, sum(sizes) // blocks)
    there = [-(-n // block) for n in sizes]
    quotas = apportion(round(sum(sources.target) / block), sources.target, [most * n for n in there])
    # a source that is wanted whole so many times is taken so, its short last block with it
    quotas = [most * n if n and t >= most * s else q for q, t, s, n in zip(quotas, sources.target, sizes, there)]
    rows = []
    for source, n, quota in zip(sources.source, there, quotas):
        in_shard = [len(range(k, n, shards)) for k in range(shards)]
        for k, part in enumerate(apportion(quota, in_shard, [most * m for m in in_shard])):
            if in_shard[k]:
                factor, shift = _steps(in_shard[k], seed + k)
                rows.append((source, k, in_shard[k], part // in_shard[k], part % in_shard[k], factor, shift))
    columns = ["source", "shard", "blocks", "passes", "extra", "factor", "shift"]
    return sources, pd.DataFrame(rows, columns=columns), block


def _order(seed: int) -> Column:
    """A document's place in its source's stream."""
    return F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))


def mix_sources(docs: DataFrame, weights: Sequence[float] | None = None, blocks: int = BLOCKS, seed: int = SEED, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, mix_key) for every row of ``docs`` (doc_id, text, source).

    ``size`` counts words; ``taken`` is how many words of the row the mix takes, repeats counted; further columns are
    ignored. Null and empty texts have size 0 and give nothing. A null source is a source, a null doc_id a value like
    any other. Repeated rows are rows of their own. An empty table gives no rows.

    Each source is one stream of words, its documents ordered by a seeded hash, and is cut into equal blocks. The
    numbers of blocks per source, and then per shard of a source, are apportioned by Sainte-Lague's highest quotients;
    within a shard a seeded reordering says which blocks are taken once more than the others. The driver sees one row
    per source. A document's place in its stream is the sum within its stretch, of about 20,000 rows, plus the sums of
    the stretches before: no source, however large, is ordered in one task. Texts are read once and not shuffled.
    """
    spark, shelf = docs.sparkSession, shelf or Shelf(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = shelf.keep(docs.select("doc_id", "source", size, _order(seed).alias("mix_key")), "sized")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas()
    stretches = max(1, -(-int(totals.n.sum()) // STRETCH))
    sources, quotas, block = plan(totals, blocks, seed=seed, weights=weights)

    # stretches follow the order of the hash, so that the whole stream does
    stretch = F.least(F.floor((F.col("mix_key") / F.lit(2.0**64) + 0.5) * stretches), F.lit(stretches - 1))
    rows = rows.withColumn("stretch", stretch)
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("sum"))
    offsets = running_offsets(sums, ["source"], "stretch", "sum", "before").select(F.col("source").alias("s"), F.col("stretch").alias("t"), "before")
    within = Window.partitionBy("source", "stretch").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.expr("source <=> s AND stretch = t")).withColumn("at", F.col("inner") + F.col("before")).drop("s", "t")

    # one row per source: the mix's own table
    drawn: dict = {}
    for r in quotas.itertuples():
        drawn.setdefault(r.source, {})[int(r.shard)] = tuple(map(int, (r.blocks, r.passes, r.extra, r.factor, r.shift)))
    known = spark.createDataFrame(
        [(s, int(n), float(t), drawn.get(s, {})) for s, n, t in zip(sources.source, sources["size"], sources.target)],
        "s string, source_size long, target double, quotas map<int, struct<blocks:long, passes:long, extra:long, factor:long, shift:long>>",
    )
    placed = placed.join(F.broadcast(known), F.expr("source <=> s")).withColumn("block", F.lit(block).cast("long"))
    taken = F.expr(
        f"""aggregate(transform(sequence(at div block, (at + size - 1) div block), b -> named_struct('b', b, 'q', quotas[cast(b % {SHARDS} as int)])), 0L,
            (sum, x) -> sum + (least(at + size, (x.b + 1) * block) - greatest(at, x.b * block))
            * (x.q.passes + if((x.b div {SHARDS} * x.q.factor + x.q.shift) % x.q.blocks < x.q.extra, 1L, 0L)))"""
    )
    taken = F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, "mix_key")


def _rounded(start: str | None):
    """Groups of one stretch in their order: copies of each row, and in a group's last row the words still owed."""

    def times(g: pa.Table) -> pa.Table:
        taken, size, chance = (g[c].to_numpy() for c in ("taken", "size", "chance"))
        whole, rest = taken // size, taken % size
        owed, more = float(g[start][0].as_py() or 0) if start else 0.0, np.zeros(len(taken), np.int64)
        for i, (r, n, u) in enumerate(zip(rest.tolist(), size.tolist(), chance.tolist())):
            if r:
                owed += r
                if owed >= u * n:
                    more[i], owed = 1, owed - n
        left = np.zeros(len(taken), np.int64)
        left[-1] = round(owed)
        out = g.select(["mix_key", "doc_id", "source", "sid"])
        return out.append_column("times", pa.array((whole + more).astype(np.int64))).append_column("owed", pa.array(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["sid", "stretch"]):
            yield from times(g.combine_chunks()).to_batches()

    return run


def mixed_documents(docs: DataFrame, weights: Sequence[float] | None = None, seed: int = SEED, stretch: int = STRETCH) -> DataFrame:
    """``docs``, each row as often as the mix takes it: whole passes, and the rest of a pass rounded along the stream.

    All columns stay; rows that the mix does not take go. Rows that are alike in doc_id, text and source are taken
    equally often. Rows without words give nothing.

    The words of a rest are carried along a source's rows, long ones first and else in the seeded order; a row is taken
    once more where the carry reaches a seeded part of its size. So a row's chance is its share, and a source
    misses its target by about one of its short documents. Stretches of about ``stretch`` rows are carried through side
    by side, then the last one of each source takes up what the others still owe.
    """
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession)
    shares = mix_sources(docs, weights, seed=seed, shelf=shelf).where("size > 0").groupBy("mix_key", "doc_id", "source")
    shares = shelf.keep(shares.agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")), "shares")
    # one row per source
    counts = [(r.source, i, max(1, -(-r.n // stretch))) for i, r in enumerate(shares.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect())]
    known = spark.createDataFrame(counts, "s string, sid long, stretches long")
    # the order of the stream and the chance come from hashes of their own
    place = F.pmod(F.xxhash64(F.lit(seed + 2), "mix_key", "doc_id"), "stretches").cast("long")
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = shares.join(F.broadcast(known), F.expr("source <=> s")).withColumn("stretch", place).withColumn("chance", chance)
    rows = rows.withColumn("length", F.floor(F.log2("size")))
    fields = [docs.schema["doc_id"].simpleString().replace(":", " "), docs.schema["source"].simpleString().replace(":", " ")]
    out = f"mix_key long, {fields[0]}, {fields[1]}, sid long, times long, owed long"

    def carried(some: DataFrame, start: str | None) -> DataFrame:
        dealt = some.repartition("sid", "stretch").sortWithinPartitions("sid", "stretch", F.desc("length"), "mix_key", "doc_id")
        return shelf.keep(dealt.mapInArrow(_rounded(start), out), "times")

    if any(n > 1 for _, _, n in counts):
        before = carried(rows.where("stretch < stretches - 1"), None)
        owed = before.groupBy("sid").agg(F.sum("owed").alias("start"))
        last = carried(rows.where("stretch = stretches - 1").join(F.broadcast(owed), "sid", "left"), "start")
        times = before.unionByName(last)
    else:
        times = carried(rows, None)
    times = times.where("times > 0").select(F.col("mix_key").alias("k"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("times").cast("int"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _order(seed).alias("mix_key"))
    taken = packed.join(times, F.expr("mix_key = k AND row.doc_id <=> d AND row.source <=> s"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")

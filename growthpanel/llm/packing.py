"""Packing documents into sequences: repeat counts of length combinations by non-negative least squares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf, running_offsets
from growthpanel.llm.tokens import default_tokenizer, token_column

WINDOW = 4096
END = 2
#: lengths are told apart in steps of so many ids, and so many documents share a sequence at most
STEP, DEPTH = 32, 3
#: ids of a stretch of the stream of cut documents, and of its cells
CELL = 1 << 14
#: sequences of a block whose gaps are summed in one task
BLOCK = 1 << 14


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` length classes, largest first, that add up to ``bins``; 0 fills a row."""
    rows = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if not left:
            rows.append(head + (0,) * (depth - len(head)))
            return
        for n in range(min(head[-1] if head else bins, left), 0, -1):
            if n * (depth - len(head)) < left:
                break
            extend((*head, n), left - n)

    extend((), bins)
    return np.array(rows)


def solve_nonnegative(a: np.ndarray, b: np.ndarray, limit: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets; ``limit`` bounds the steps, all of which lessen the error."""
    gram, right = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(limit):
        slope = right - gram @ x
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, abs(right).max()):
            break
        free[best] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(gram[np.ix_(free, free)], right[free], rcond=None)[0]
            if z[free].min() > 0:
                break
            bad = free & (z <= 0)
            share = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = x + share * (z - x)
            free &= x > 1e-9 * max(1.0, x.max())
            x[~free] = 0
            if not free.any():
                break
        x = z if free.any() else x
    return x


@dataclass
class Plan:
    """Slots (bin, first, count, sequence, slot): the documents of a bin with ordinals first .. first + count - 1."""

    slots: list[tuple[int, int, int, int, int]]
    sequences: int


def plan_sequences(histogram: np.ndarray, total: int, window: int = WINDOW) -> Plan:
    """Sequences from the numbers of documents per length class (1..bins) and the number of all their ids.

    Repeat counts are solved against the histogram, with little weight on the short classes that are easily placed
    later, and rounded down to what is there. There are never more sequences than the ids fill, so that the
    documents left over, which may be cut, fill every gap.
    """
    bins = len(histogram)
    combos = combinations(bins)
    a = np.zeros((bins, len(combos)))
    for k in range(combos.shape[1]):
        used = combos[:, k] > 0
        np.add.at(a, (combos[used, k] - 1, np.flatnonzero(used)), 1)
    scale = max(1.0, histogram.sum())
    weight = np.where(np.arange(1, bins + 1) * 16 <= bins, 0.1, 1.0)
    repeats = np.floor(solve_nonnegative(a * weight[:, None], histogram / scale * weight) * scale + 1e-6).astype(np.int64)
    left, room, slots, sequence = histogram.astype(np.int64).copy(), total // window, [], 0
    taken = np.zeros(bins, np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        parts = [int(c) for c in combos[k] if c]
        need = {c: parts.count(c) for c in parts}
        count = int(min([repeats[k], room - sequence, *(left[c - 1] // m for c, m in need.items())]))
        if count <= 0:
            continue
        for slot, c in enumerate(parts):
            slots.append((c, int(taken[c - 1]), count, sequence, slot))
            taken[c - 1] += count
            left[c - 1] -= count
        sequence += count
    return Plan(slots, sequence)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, step: int = STEP, end: int = END, shelf: Shelf | None = None) -> DataFrame:
    """Pieces of every document: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``docs`` has doc_id and text; further columns are ignored. A document is its text's ids and the id ``end``; a
    null or empty text is the end id alone. Every id lies in exactly one piece, the pieces of a sequence lie side by side
    from offset 0, no sequence exceeds ``window``, and the padding to ``window`` is nil: all sequences are full but a
    last few whose lengths are powers of two. Rows that share a doc_id, or have none, are documents of their own. An
    empty table gives no rows. ``ids`` are little-endian unsigned 16-bit integers.

    Whole windows are cut off long documents. The rests fall into classes of ``step`` lengths; the histogram of
    the classes goes to the driver, where the sequences are planned, and comes back as a table of at most a few hundred
    slots. A document finds its slot by its ordinal in its class: its rank within its input part plus the ranks before.
    The documents that the plan leaves over are laid end to end, and cut where the gaps of the sequences, laid end to
    end, begin and end. Only lengths are shuffled for that; the ids are shuffled once, to meet their pieces.
    """
    if window % step or window & (window - 1):
        raise ValueError("the window must be a power of two and a multiple of the step")
    spark, shelf = docs.sparkSession, shelf or Shelf(docs.sparkSession)
    ids = token_column(F.col("text"), tokenizer or default_tokenizer(), end)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), ids.alias("ids"))
    tokens = shelf.keep(numbered.withColumn("n", (F.octet_length("ids") / 2).cast("long")), "tokens")
    # the upper bits of the row number are the input part's
    sizes = tokens.select("uid", F.shiftright("uid", 33).alias("part"), "n", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("whole"))

    full_sums = sizes.groupBy("part").agg(F.sum("whole").alias("sum"))
    rests = sizes.where("rest > 0").withColumn("class", F.ceil(F.col("rest") / step).cast("int"))
    counts = rests.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("ids"))
    counts = shelf.keep(counts, "counts")
    histogram, total = np.zeros(window // step), 0
    for row in counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).collect():  # a row per class
        histogram[row["class"] - 1], total = row.n, total + row.ids
    plan = plan_sequences(histogram, total, window)

    # the place of each rest in its class
    offsets = running_offsets(counts.select("part", "class", "n"), ["class"], "part", "n", "before").select(F.col("part").alias("p"), F.col("class").alias("c"), "before")
    rank = F.row_number().over(Window.partitionBy("part", "class").orderBy("uid")) - 1
    ranked = rests.withColumn("rank", rank).join(offsets, F.expr("part = p AND class = c")).withColumn("ordinal", F.col("rank") + F.col("before"))
    slots = spark.createDataFrame(plan.slots, "k int, first long, count long, sequence long, slot int")
    inside = F.expr("class = k AND ordinal >= first AND ordinal < first + count")
    placed = ranked.join(F.broadcast(slots), inside, "left").select(
        "uid", "part", "n", "rest", (F.col("sequence") + F.col("ordinal") - F.col("first")).alias("sequence"), "slot"
    )
    placed = shelf.keep(placed, "placed")

    in_slots = placed.where("sequence IS NOT NULL")
    by_sequence = Window.partitionBy("sequence").orderBy("slot")
    before = F.coalesce(F.sum("rest").over(by_sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole_rests = in_slots.select("uid", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("sequence").alias("sequence_id"), before.alias("offset"))

    # documents to cut, end to end
    cut = placed.where("sequence IS NULL")
    cut_sums = running_offsets(cut.groupBy("part").agg(F.sum("rest").alias("sum")), [], "part", "sum", "before").select(F.col("part").alias("p"), "before")
    inner = F.coalesce(F.sum("rest").over(Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stream = cut.withColumn("inner", inner).join(cut_sums, F.expr("part = p")).select(
        "uid", (F.col("n") - F.col("rest")).alias("base"), (F.col("inner") + F.col("before")).alias("a"), (F.col("inner") + F.col("before") + F.col("rest")).alias("b")
    )

    # gaps, end to end: of the planned sequences, then whole new ones, then one for every bit of what is left
    filled = in_slots.groupBy("sequence").agg(F.sum("rest").alias("filled")).where(F.col("filled") < window)
    filled = filled.withColumn("block", F.floor(F.col("sequence") / BLOCK)).withColumn("gap", window - F.col("filled"))
    gap_sums = shelf.keep(filled.groupBy("block").agg(F.sum("gap").alias("sum")), "gaps")
    gap_offsets = running_offsets(gap_sums, [], "block", "sum", "before").select(F.col("block").alias("q"), "before")
    gap_inner = F.coalesce(F.sum("gap").over(Window.partitionBy("block").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = filled.withColumn("inner", gap_inner).join(gap_offsets, F.expr("block = q")).select(
        "sequence", F.col("filled").alias("from"), (F.col("inner") + F.col("before")).alias("c"), (F.col("inner") + F.col("before") + F.col("gap")).alias("d")
    )
    gap_total = gap_sums.agg(F.sum("sum")).first()[0] or 0
    over = (cut.agg(F.sum("rest")).first()[0] or 0) - gap_total
    new, last = over // window, over % window
    more = spark.range(new).select(
        (F.lit(plan.sequences) + F.col("id")).alias("sequence"), F.lit(0).cast("long").alias("from"),
        (F.lit(gap_total) + F.col("id") * window).alias("c"), (F.lit(gap_total) + (F.col("id") + 1) * window).alias("d"),
    )
    tail, at = [], gap_total + new * window
    for bit in reversed(range(window.bit_length() - 1)):
        if last >> bit & 1:
            tail.append((plan.sequences + new + len(tail), 0, at, at + (1 << bit)))
            at += 1 << bit
    gaps = gaps.unionByName(more).unionByName(spark.createDataFrame(tail, "sequence long, `from` long, c long, d long"))

    def cells(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor((F.col(b) - 1) / CELL))))

    met = cells(stream, "a", "b").join(cells(gaps, "c", "d"), "cell").where("a < d AND c < b").where(f"floor(greatest(a, c) / {CELL}) = cell")
    cut_pieces = met.select(
        "uid", F.expr("base + greatest(a, c) - a").alias("start"), F.expr("least(b, d) - greatest(a, c)").alias("length"),
        F.col("sequence").alias("sequence_id"), F.expr("`from` + greatest(a, c) - c").alias("offset"),
    )

    # whole windows of long documents
    first = plan.sequences + new + len(tail)
    full_offsets = running_offsets(full_sums, [], "part", "sum", "before").select(F.col("part").alias("p"), "before")
    long = sizes.where("whole > 0").withColumn(
        "inner", F.coalesce(F.sum("whole").over(Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    windows = long.join(full_offsets, F.expr("part = p")).select("uid", (F.col("inner") + F.col("before")).alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("w"))
    full_pieces = windows.select(
        "uid", (F.col("w") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.lit(first) + F.col("at") + F.col("w")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    pieces = shelf.keep(full_pieces.unionByName(whole_rests).unionByName(cut_pieces), "pieces")
    return tokens.join(pieces, "uid").select(
        "doc_id", "start", "length", F.expr("substring(ids, cast(2 * start + 1 as int), cast(2 * length as int))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset",
    )


def wide_ids(ids):
    """Little-endian 16-bit integers as 32-bit ones: two zero bytes after every two."""
    return F.unhex(F.regexp_replace(F.hex(ids), "(....)", "$10000"))


def pack_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32(wide_ids("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

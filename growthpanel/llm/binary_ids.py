"""Token ids in compressed files: blocks coded by a static range asymmetric numeral system with shared tables.

A folder of token files holds three Parquet tables, a container that any store Spark writes to can hold and that is
committed whole or not at all:

* ``table``: one row, the frequency of every id that occurs, scaled to a sum of 2**20;
* ``blocks``: rows (part, before, payload), a payload being whole documents in our binary format;
* ``parts``: rows (part, n_tokens), in ascending document order.

A payload, little-endian: 4 bytes ``GPT1``, uint32 number of documents, of tokens (uint64) and of checkpoints; per
document int64 doc_id, uint8 null flag, uint64 number of ids; then the checkpoints. A checkpoint is the start of a
segment that decodes on its own: uint32 ids, lanes, words, crc32 of the ids as uint32, then uint64 lane states and uint32
words. Ids are dealt to the lanes in turn; all lanes advance together, and a lane that runs low takes the next word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf, in_slices
from growthpanel.llm.tokens import default_tokenizer, encoder

SCALE = 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
#: ids of a segment between two checkpoints, most lanes, ids after which a block ends with its document
SEGMENT, LANES, BLOCK = 1 << 18, 1024, 1 << 20
END = 2
#: bytes of text that one range of documents should hold
RANGE_BYTES = 16 << 20


class Table:
    """Frequencies that add up to 2**SCALE, the starts of their ranges, and the id of every slot."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        self.ids = ids.astype(np.uint32)
        self.frequency = frequencies.astype(np.uint64)
        self.start = (np.cumsum(self.frequency) - self.frequency).astype(np.uint64)
        self.rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        self.rank[ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.uint32), frequencies.astype(np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, each at least 1; what is over or missing falls to the largest."""
    total = 1 << SCALE
    if not len(counts):
        return counts.astype(np.int64)
    if len(counts) > total // 2:
        raise ValueError("too many different ids for the tables' scale")
    out = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    missing = total - int(out.sum())
    if missing > 0:
        out[order[0]] += missing
    for i in order:
        if missing >= 0:
            break
        give = min(int(out[i]) - 1, -missing, int(out[i]) // 2)
        out[i] -= give
        missing += give
    return out


def encode_segment(ids: np.ndarray, table: Table) -> bytes:
    lanes = max(1, min(LANES, len(ids) // 64))
    steps = -(-len(ids) // lanes)
    rank = table.rank[ids]
    state = np.full(lanes, _LOW, np.uint64)
    out = []
    for step in range(steps - 1, -1, -1):
        r = rank[step * lanes : (step + 1) * lanes]
        frequency, start, x = table.frequency[r], table.start[r], state[: len(r)]
        full = x >= (frequency << np.uint64(63 - SCALE))
        if full.any():
            out.append(x[full].astype(np.uint32))
            x = np.where(full, x >> _WORD, x)
        high = x // frequency
        state[: len(r)] = (high << np.uint64(SCALE)) + (x - high * frequency) + start
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    check = crc32(ids.astype("<u4").tobytes())
    head = np.array([len(ids), lanes, len(words), check], "<u4").tobytes()
    return head + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_segment(data: bytes, at: int, table: Table) -> tuple[np.ndarray, int]:
    """Ids of the segment at this place, and the place after it."""
    n, lanes, n_words, check = (int(x) for x in np.frombuffer(data, "<u4", 4, at))
    state = np.frombuffer(data, "<u8", lanes, at + 16).astype(np.uint64)
    words = np.frombuffer(data, "<u4", n_words, at + 16 + 8 * lanes).astype(np.uint64)
    rank, used, mask = np.empty(n, np.uint32), 0, np.uint64((1 << SCALE) - 1)
    for i in range(0, n, lanes):
        x = state[: min(lanes, n - i)]
        slot = x & mask
        r = table.slots[slot.astype(np.int64)]
        rank[i : i + len(r)] = r
        x = table.frequency[r] * (x >> np.uint64(SCALE)) + slot - table.start[r]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _WORD) | words[used : used + len(low)]
            used += len(low)
        state[: len(r)] = x
    ids = table.ids[rank]
    if crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a segment of token ids does not match its checksum")
    return ids, at + 16 + 8 * lanes + 4 * n_words


def encode_block(doc_ids: list[int | None], documents: list[np.ndarray], table: Table) -> bytes:
    ids = np.concatenate(documents)
    parts = [ids[i : i + SEGMENT] for i in range(0, len(ids), SEGMENT)]
    head = b"GPT1" + np.uint32(len(doc_ids)).tobytes() + np.uint64(len(ids)).tobytes() + np.uint64(len(parts)).tobytes()
    entry = np.zeros(len(doc_ids), "<i8,u1,<u8")
    entry["f0"], entry["f1"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids]
    entry["f2"] = [len(d) for d in documents]
    return b"".join([head, entry.tobytes(), *(encode_segment(p, table) for p in parts)])


def decode_block(data: bytes, table: Table) -> tuple[list[int | None], list[np.ndarray]]:
    if data[:4] != b"GPT1":
        raise ValueError("not a block of token ids")
    n_docs = int(np.frombuffer(data, "<u4", 1, 4)[0])
    n_segments = int(np.frombuffer(data, "<u8", 1, 16)[0])
    entry = np.frombuffer(data, "<i8,u1,<u8", n_docs, 24)
    at, parts = 24 + entry.nbytes, []
    for _ in range(n_segments):
        ids, at = decode_segment(data, at, table)
        parts.append(ids)
    cuts = np.cumsum(entry["f2"].astype(np.int64))[:-1]
    return [None if null else int(d) for d, null in zip(entry["f0"], entry["f1"])], np.split(np.concatenate(parts), cuts)


def _tokenize(path: str, end: int):
    """Rows (part, before, doc_id, ids, counts): ids of each document; a part's last row has its counts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, known, close = TaskContext.get().partitionId(), 0, encoder(path), np.array([end], "<u2").tobytes()
        counts = np.zeros(1 << 16, np.int64)
        schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            encoded = known.encode_all(in_slices(batch.column(1).cast(pa.binary())))
            for i in range(0, batch.num_rows, 1024):  # the ids of a batch are never held whole beside its texts
                found, places = [], []
                for ids in islice(encoded, 1024):
                    found.append(ids.astype("<u2").tobytes() + close)
                    places.append(before)
                    before += len(ids) + 1
                n = len(found)
                counts += np.bincount(np.frombuffer(b"".join(found), "<u2"), minlength=1 << 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), batch.column(0).slice(i, n).cast(pa.int64()), pa.array([len(x) // 2 for x in found], pa.int64()), pa.array(found, pa.binary()), pa.nulls(n, pa.binary())],
                    schema=schema,
                )
            del batch, encoded
            pa.default_memory_pool().release_unused()  # the worker stays, and waits with what it holds for its next range
        if before:
            sums = counts.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([part, None, None, before, None, sums], schema.types)], schema=schema)

    return run


def _encode(ids: np.ndarray, frequencies: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(ids, frequencies)
        docs, names, first, size = [], [], None, 0

        def block():
            columns = [[first[0]], [first[1]], [encode_block(names, docs, table)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], names=["part", "before", "payload"])

        for batch in batches:
            for part, before, doc_id, data in zip(*(in_slices(c) for c in batch.columns)):
                if docs and (size >= BLOCK or part != first[0] or before != first[1] + size):
                    yield block()
                    docs, names, first, size = [], [], None, 0
                first = first or (part, before)
                names.append(doc_id)
                docs.append(np.frombuffer(data, "<u2").astype(np.int64))
                size += len(docs[-1])
        if docs:
            yield block()

    return run


def _decode(ids: np.ndarray, frequencies: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(ids, frequencies)
        for batch in batches:
            for part, before, payload in zip(*(in_slices(c, 1) for c in batch.columns)):
                names, documents = decode_block(payload, table)
                n = [len(d) for d in documents]
                starts = before + np.cumsum([0, *n[:-1]])
                columns = [[part] * len(n), starts, names, n, [d.astype("<u4").tobytes() for d in documents]]
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "before", "doc_id", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shelf: Shelf | None = None) -> None:
    """Write the ids of every document of ``docs`` (doc_id, text; further columns are ignored), in ascending doc_id order.

    A null doc_id comes last, a null text counts as empty; every document ends with the id ``end``. Rows with the same
    doc_id are documents of their own, in the order of a hash of their texts. An empty table makes files without blocks.

    Texts are dealt out by ranges of doc_id, and of the hash beside it, so that no doc_id is a hot range. Each
    range is tokenized where it lands and written once; its ids are counted on the way, and the frequencies of the
    whole table, at most 65,536 numbers, are the shared tables. Blocks are coded without another shuffle.
    """
    spark, shelf = docs.sparkSession, shelf or Shelf(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-bytes_ // RANGE_BYTES))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    sorted_ = docs.select("doc_id", "text").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = "part int, before long, doc_id long, n long, ids binary, counts binary"
    tokens = shelf.keep(sorted_.mapInArrow(_tokenize(path, end), schema), "tokens")
    sums = tokens.where("counts IS NOT NULL")
    counted = sums.select("counts").mapInArrow(_add_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = counted.orderBy("id").toPandas()  # a row per different id, 65,536 at most
    ids = counted.id.to_numpy().astype(np.int64)
    frequencies = scaled(counted.n.to_numpy().astype(np.int64))
    spark.createDataFrame([([int(i) for i in ids], [int(f) for f in frequencies])], "ids array<int>, frequencies array<long>").write.parquet(f"{folder}/table")
    sums.select("part", F.col("n").alias("n_tokens")).coalesce(1).write.parquet(f"{folder}/parts")
    rows = tokens.where("counts IS NULL").select("part", "before", "doc_id", "ids")
    blocks = rows.mapInArrow(_encode(ids, frequencies), "part int, before long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    shelf.forget(tokens)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the ranges that one task reads, a row per id that occurs."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for counts in in_slices(batch.column(0), 4):
            total += np.frombuffer(counts, "<i8")
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document; ids as little-endian unsigned 32-bit integers.

    ``start`` is the number of ids of all documents before. Blocks decode in parallel, each segment against its
    checksum; a damaged one stops the job.
    """
    from pyspark.sql import Window

    shared = spark.read.schema("ids array<int>, frequencies array<long>").parquet(f"{folder}/table").first()
    ids, frequencies = np.array(shared.ids, np.int64), np.array(shared.frequencies, np.int64)
    blocks = spark.read.schema("part int, before long, payload binary").parquet(f"{folder}/blocks")
    parts = spark.read.schema("part int, n_tokens long").parquet(f"{folder}/parts")
    # one row per range of documents; ranges are numbered in ascending order
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))
    decoded = blocks.mapInArrow(_decode(ids, frequencies), "part int, before long, doc_id long, n_tokens long, ids binary")
    return decoded.join(offsets, F.expr("part = p")).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write token files to the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    shelf = Shelf(docs.sparkSession)
    folder = shelf.path("token-files")
    write_token_files(docs, folder, tokenizer, shelf=shelf)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

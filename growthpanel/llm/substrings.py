"""Passages that repeat across documents, found by windows of words that double in length while they repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf

#: words of a window; the level below has half as many
WINDOW = 20
#: bytes of text that are hashed at a time
_SEGMENT = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: odd multipliers of the polynomials over bytes and, twice, over words
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        ups, downs = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        ups[0] = downs[0] = 1
        held = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        if size <= 1 << 22:
            _powers[base] = held
    return held


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the runs of anything but ASCII white space."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(text, np.uint8)], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word."""
    starts, ends = word_bounds(text)
    data, out, at = np.frombuffer(text, np.uint8), np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _power(_BASES[0], high - low)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[low:high].astype(np.uint64) + _U(1)) * up[: high - low])])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(_BASES[1]))
        at = to
    return out


class Ranges:
    """Hashes of any ranges of words of a document."""

    def __init__(self, words: np.ndarray, base: int):
        up, self._down = _power(base, len(words))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * _U(_BASES[0]))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return turns[::2], turns[1::2] - turns[::2]


def regions(words: np.ndarray, window: int) -> tuple[np.ndarray, ...] | None:
    """Runs of windows that share their least half-window: (anchor, content, start, count), and runs of windows that began earlier in the text.

    The anchor is the hash of the least half-window of every window of a run, so equal windows have equal anchors, and
    a document has about one anchor per six words. The content is the hash of all words of the run's windows.
    """
    n = len(words) - window + 1
    if n < 1:
        return None
    half = window // 2
    hashes, places = Ranges(words, _BASES[1]), np.arange(len(words) - half + 1)
    low = hashes.of(places, places + half)
    span, width = window - half + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    counts = np.diff(np.concatenate([starts, [n]]))
    content = hashes.of(starts, starts + counts + window - 1)
    whole = hashes.of(places[:n], places[:n] + window)
    order = np.argsort(whole, kind="stable")
    again = np.zeros(n, bool)
    again[order[1:][whole[order[1:]] == whole[order[:-1]]]] = True
    return low[starts], content, starts, counts, *_runs(again)


_NAMES = ["anchor", "content", "doc", "text_hash", "start", "count", "known"]
_SCHEMA = "anchor long, content long, doc long, text_hash long, start int, count int, known boolean"


def _anchors(window: int):
    """Rows of regions. A region that a batch holds earlier is known to repeat and only passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, rows, last = batch.column(2).cast(pa.binary()), [], None
            for i in np.lexsort((hashes, docs)).tolist():
                if (docs[i], hashes[i]) == last:
                    continue
                last = docs[i], hashes[i]
                found = regions(word_hashes(texts[i].as_py() or b""), window)
                if found is None:
                    continue
                anchor, content, start, count, again, length = found
                n, m = len(anchor), len(again)
                extra = _mix(again.astype(np.uint64) + hashes[i].astype(np.uint64)) if m else np.empty(0, np.uint64)
                rows.append(
                    (
                        np.concatenate([anchor, extra]), np.concatenate([content, extra]), np.full(n + m, docs[i]), np.full(n + m, hashes[i]),
                        np.concatenate([start, again]), np.concatenate([count, length]), np.arange(n + m) >= n,
                    )
                )
            if not rows:
                continue
            anchor, content, doc, text_hash, start, count, known = (np.concatenate(c) for c in zip(*rows))
            # rows stand in the order of documents and starts: what a key has first is its earliest region here
            first = np.zeros(len(anchor), bool)
            first[np.unique(_mix(anchor) ^ content, return_index=True)[1]] = True
            known |= ~first
            columns = [anchor.view(np.int64), content.view(np.int64), doc, text_hash, start.astype(np.int32), count.astype(np.int32), known]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)

    return run


def _windows(window: int):
    """(hash_a, hash_b, doc, text_hash, start) of every window of the open regions of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, (doc, text_hash, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                words = word_hashes(texts[i].as_py())
                starts = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["count"]) for s in spans]))
                pair = [Ranges(words, b).of(starts, starts + window).view(np.int64) for b in _BASES[1:]]
                columns = [*pair, np.full(len(starts), doc), np.full(len(starts), text_hash), starts.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash_a", "hash_b", "doc", "text_hash", "start"])

    return run


def _cut(window: int):
    """(doc_id, n_words, n_removed, text) of each document without the words that its repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, kept = batch.column(1).cast(pa.binary()).to_pylist(), [], [], []
            for text, spans in zip(texts, batch.column(2).to_pylist()):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["count"] + window - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                n_words.append(len(words))
                n_removed.append(int(len(words) - keep.sum()))
                kept.append(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)]))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "text"])

    return run


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for every row of ``docs`` (doc_id, text; further columns are ignored).

    A word goes if a window of ``window`` words around it also starts earlier: in a document with a smaller doc_id, or
    earlier in the same one. ``text`` is what stays, joined by single spaces; windows are judged on the whole input.
    A null text has no words, and shorter texts than a window lose none. Documents with one doc_id stand in the order of
    a hash of their texts; rows alike in both are one document, and all of them get its result; a null doc_id comes
    last. An empty table gives no rows.

    Half-windows come first: of every window the least one, by its hash, is its anchor, and only anchors travel, one
    per run of windows that share it. An anchor that occurs once ends there. Where it repeats, its run is extended to
    the whole windows around it: runs equal in all words repeat but for the first, and only where an anchor has runs
    that differ are their windows compared one by one, by 128 bits. Longer repeats need no further level, as windows
    cover them. Within a batch of texts equal runs are reduced to the first before the shuffle, so a passage that a third of all
    documents hold is one row per batch; anchors, runs and windows are counted with a map-side combine and met by joins that
    adaptive execution splits, so no anchor's rows need to fit into one task. The texts are shuffled twice, to meet open
    runs and to be cut.
    """
    if window < 2 or window % 2:
        raise ValueError("a window has an even number of words")
    shelf = shelf or Shelf(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    found = shelf.keep(keyed.select("doc", "text_hash", "text").mapInArrow(_anchors(window), _SCHEMA), "regions")
    live, place = found.where("NOT known").drop("known"), F.struct("doc", "text_hash", "start")
    counted = live.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("content") != F.max("content")).alias("open"))
    repeated = shelf.keep(counted.where("n > 1").drop("n"), "anchors")
    met = shelf.keep(live.join(repeated, "anchor"), "met")
    earliest = met.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.min("count").alias("count"), F.max("open").alias("open"))
    firsts = shelf.keep(earliest, "firsts")
    again = met.join(firsts.select("anchor", "content", "first"), ["anchor", "content"]).where(place != F.col("first"))

    def spans(df: DataFrame) -> DataFrame:
        return df.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    open_ = spans(firsts.where("open").select("first.*", "count"))
    texts = keyed.where("text IS NOT NULL").select("doc", "text_hash", "text").join(open_, ["doc", "text_hash"])
    windows = shelf.keep(texts.select("doc", "text_hash", "text", "spans").mapInArrow(_windows(window), "hash_a long, hash_b long, doc long, text_hash long, start int"), "windows")
    first = windows.groupBy("hash_a", "hash_b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["hash_a", "hash_b"]).where(place != F.col("first")).select("doc", "text_hash", "start", F.lit(1).alias("count"))
    span = ["doc", "text_hash", "start", "count"]
    gone = shelf.keep(spans(found.where("known").select(span).unionByName(again.select(span)).unionByName(later)), "gone")
    met = keyed.join(gone, ["doc", "text_hash"], "left").select("doc_id", "text", "spans")
    return met.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, text string")


def repeated_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The result with a hash in place of the text."""
    return drop_repeated_windows(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

"""Phrase collocations by prefix-free parsing: phrases are counted in a dictionary of chunks, each with its frequency.

Texts are parsed into overlapping chunks that start at words which their content triggers and reach three words into the next
chunk. As a trigger is a property of the word, equal passages have equal chunks wherever they stand, and a chunk's own words
end before its first trigger but the first word: no chunk's own part is the beginning of another's. A phrase belongs to
the chunk that owns its first word, so phrases in overlaps are counted once. All counting reads the dictionary.

Phrases grow a word at a time. A phrase of n words can only be frequent if both its parts of n - 1 words are, so a
filter of fixed size holds the hashes of the frequent ones, and only phrases that pass it on both sides are shuffled. False
positives cost rows, not results: what counts is the exact sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf

#: words of the longest phrase; one word in so many starts a chunk
LONGEST, TRIGGER = 4, 12
#: least occurrences of a phrase, phrases kept of each language
LEAST, TOP = 30, 2000
#: a phrase is dropped for a longer one with at least this percentage of its occurrences
COVER = 80
#: bits of the filter's positions: 2**26 bits are 8 MB
FILTER_BITS = 26
#: bytes of text parsed together, and chunks whose phrases are summed together
_PART, _GATHER = 1 << 21, 100_000

#: kind of every byte: 0 ends a piece, 1 parts words, 2 belongs to a word
_KIND = np.full(256, 2, np.uint8)
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 0
_KIND[[ord(c) for c in " \t"]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number per word, and the different words. Words end with one space in ``data`` and fill it."""
    keep = np.ones(len(data), bool)
    keep[ends] = False
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    words = words.dictionary_encode()
    held, cuts = words.dictionary.buffers()[2].to_pybytes(), np.frombuffer(words.dictionary.buffers()[1], np.int32, len(words.dictionary) + 1).tolist()
    return words.indices.to_numpy().astype(np.int64), [held[a:b] for a, b in zip(cuts, cuts[1:])]


def _triggers(words: list[bytes]) -> np.ndarray:
    return np.fromiter((crc32(w) % TRIGGER == 0 for w in words), bool, len(words))


def _parse_part(texts: list[bytes], names: list[str]) -> pa.RecordBatch:
    """Chunks (lang, chunk, own) of some texts: words joined by a space, of which ``own`` are the chunk's."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = kind == 2
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.binary(), pa.int32())], names=["lang", "chunk", "own"])
    piece = np.cumsum(kind == 0, dtype=np.int32)[starts]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    keep = inside.copy()
    keep[ends] = True  # one white space or mark behind each word
    data = data[keep]
    sizes = ends - starts + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    data[ends] = 32
    codes, words = _coded(data, starts, ends)
    first = np.diff(piece, prepend=-1) != 0
    at = np.flatnonzero(first | _triggers(words)[codes])
    after = np.append(at[1:], len(starts))
    limit = np.append(np.flatnonzero(first)[1:], len(starts))[np.cumsum(first)[at] - 1]  # end of the chunk's piece
    last = np.minimum(after + LONGEST - 1, limit)
    held = data.tobytes()
    chunks = [held[a:b] for a, b in zip(starts[at].tolist(), ends[last - 1].tolist())]
    langs = pa.DictionaryArray.from_arrays(pa.array(text[at].astype(np.int32)), pa.array(names, pa.string())).dictionary_decode()
    return pa.RecordBatch.from_arrays([langs, pa.array(chunks, pa.binary()), pa.array((after - at).astype(np.int32))], names=["lang", "chunk", "own"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, names, size = [], [], 0
        for lang, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1).cast(pa.binary()))):
            texts.append(text or b"")
            names.append(lang)
            size += len(texts[-1])
            if size >= _PART:
                yield _parse_part(texts, names)
                texts, names, size = [], [], 0
        if texts:
            yield _parse_part(texts, names)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase made longer by a word."""
    h = (h ^ word) * _MIX
    return h ^ (h >> np.uint64(29))


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``_GATHER``, none empty: the more are summed together, the fewer are handed on."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= _GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _grams(size: int, filter_: bytes | None):
    """Counts (lang, phrase, f) of phrases of ``size`` words in chunks (lang, chunk, own, c), summed within gathered batches.

    Phrases of which a part of size - 1 words fails the filter are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_ is None else np.frombuffer(filter_, np.uint8)
        for batch in _gathered(batches):
            column = batch.column(1)
            bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
            lengths = np.diff(bounds)
            chunks = b" ".join(column.to_pylist()) + b" "
            data = np.frombuffer(chunks, np.uint8)
            ends = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            codes, words = _coded(data, starts, ends)
            limits = np.searchsorted(ends, np.cumsum(lengths + 1) - 1) + 1  # words before the end of each chunk
            begins = np.concatenate([[0], limits[:-1]])
            own = batch.column(2).to_numpy()
            langs = batch.column(0).dictionary_encode()
            chunk = np.repeat(np.arange(len(own)), limits - begins)
            place = np.arange(len(starts)) - begins[chunk]
            at = np.flatnonzero((place < own[chunk]) & (np.arange(len(starts)) + size <= limits[chunk]))
            if bits is not None:
                word = _hashes(words)
                lang = _hashes([x.encode() for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
                for side in (0, 1):  # the phrase without its last word, and without its first
                    h = lang[chunk[at]]
                    for k in range(size - 1):
                        h = _follow(h, word[codes[at + side + k]])
                    at = at[_passes(bits, h)]
            if not len(at):
                continue
            key = langs.indices.to_numpy().astype(np.int64)[chunk[at]]
            bound = len(langs.dictionary)
            for k in range(size):  # exact: different keys are numbered anew where the next word might pass 64 bits
                if bound * len(words) >= 1 << 62:
                    different, key = np.unique(key, return_inverse=True)
                    bound = len(different)
                key, bound = key * len(words) + codes[at + k], bound * len(words)
            order = np.argsort(key)
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            f = np.add.reduceat(batch.column(3).to_numpy()[chunk[at]][order], heads)
            at = at[order][heads]
            phrases = [chunks[a:b] for a, b in zip(starts[at].tolist(), ends[at + size - 1].tolist())]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(langs.indices.take(pa.array(chunk[at]))), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f)], names=["lang", "phrase", "f"]
            )

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of phrases (lang, phrase) in the filter."""
    for batch in batches:
        found = []
        for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
            h = _hashes([lang.encode()])
            for word in _hashes(phrase.encode().split(b" ")):
                h = _follow(h, word)
            found.append(int(h[0]) >> (64 - FILTER_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["at"])


def _filter(frequent: DataFrame) -> bytes:
    """The filter of some phrases: 2**FILTER_BITS bits, whatever their number."""
    at = frequent.select("lang", "phrase").mapInArrow(_positions, "at long").select((F.col("at") + 1).alias("at"))
    blocks = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for row in blocks.collect():  # at most 2**(FILTER_BITS - 15) rows of 4,096 bytes
        out[(row.block - 1) * 4096 : row.block * 4096] = row.bits
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = LEAST, shelf: Shelf | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of every phrase of one to four words with f >= ``least``, and (lang, n) of all words."""
    shelf = shelf or Shelf(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = texts.mapInArrow(_parse, "lang string, chunk binary, own int")
    dictionary = shelf.keep(chunks.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("c")), "dictionary")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("c")).alias("n"))
    found, passed = [], None
    for size in range(1, LONGEST + 1):
        counted = dictionary.mapInArrow(_grams(size, passed), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found.append(shelf.keep(counted.where(F.col("f") >= least), f"phrases{size}"))
        passed = _filter(found[-1]) if size < LONGEST else None
    frequent = found[0].withColumn("size", F.lit(1))
    for size, more in enumerate(found[1:], 2):
        frequent = frequent.unionByName(more.withColumn("size", F.lit(size)))
    return frequent, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shelf: Shelf | None = None) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (text, lang; further columns are ignored): (lang, rank, phrase, a, l, r, n, score).

    Words are runs of anything but space and tab within pieces that ``.,;:!?`` and line ends part, with A-Z in lower case. A
    phrase has 2 to 4 words and a >= ``least`` occurrences, in whole texts, overlaps included. Cut in two, its parts occur
    l and r times; its score is floor(2000000 a / (l + r)) at its lowest cut, the first of equal ones. A phrase
    inside a longer one that occurs at least 0.8 times as often is dropped. Ranks go by score and a, descending,
    and phrase. A null language is ``und``; null, empty and blank texts have no words; repeated rows count as often
    as they stand. An empty table gives no rows.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    frequent, totals = phrase_counts(docs, least, shelf)
    candidates = frequent.where("size > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ", -1)
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.expr("slice(words, 1, k)")).alias("first"),
        F.concat_ws(" ", F.expr("slice(words, k + 1, size - k)")).alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # parts of a frequent phrase are frequent, so every cut meets both its counts
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = scored.withColumn("score", F.expr("CAST((2000000 * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + r) AS long)"))
    best = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").withColumn("words", words)
    spans = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    covers = inner.select("lang", F.col("a").alias("f"), F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < {COVER} * CAST(a AS DECIMAL(20, 0))"
    )
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def duckdb_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same by counting every phrase of every text."""
    sizes = range(1, LONGEST + 1)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joined = [" || ' ' || ".join(f"w{i}" for i in range(m)) for m in sizes]
    counts = " UNION ALL ".join(f"SELECT lang, {m} AS size, {phrase} AS phrase, count(*) AS f FROM follow WHERE w{m - 1} IS NOT NULL GROUP BY ALL" for m, phrase in zip(sizes, joined))
    leads = ", ".join(f"lead(w, {i}) OVER (PARTITION BY p ORDER BY i) AS w{i}" for i in range(1, LONGEST))
    parts = " UNION ALL ".join(
        f"SELECT lang, phrase, a, {k} AS k, array_to_string(words[:{k}], ' ') AS first, array_to_string(words[{k + 1}:], ' ') AS rest FROM candidates WHERE size > {k}" for k in range(1, LONGEST)
    )
    inside = " UNION ALL ".join(
        f"SELECT lang, a, array_to_string(words[{i}:{i + m - 1}], ' ') AS phrase FROM candidates WHERE size >= {max(m + 1, i + m - 1)}" for m in range(2, LONGEST) for i in range(1, LONGEST - m + 2)
    )
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        pieces AS MATERIALIZED (SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM texts),
        follow AS MATERIALIZED (SELECT lang, w AS w0, {leads} FROM (SELECT lang, p, unnest(words) AS w, unnest(range(len(words))) AS i FROM pieces)),
        counts AS MATERIALIZED ({counts}),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
        candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= {least}),
        cuts AS ({parts}),
        frequent AS MATERIALIZED (SELECT lang, phrase, f FROM counts WHERE f >= {least}),
        halved AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts c JOIN frequent x ON c.lang = x.lang AND c.first = x.phrase),
        scored AS (SELECT c.lang, c.phrase, c.a, k, l, y.f AS r, ((2000000::HUGEINT * c.a) // (l::HUGEINT + y.f))::BIGINT AS score
            FROM halved c JOIN frequent y ON c.lang = y.lang AND c.rest = y.phrase),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        covers AS (SELECT lang, phrase, max(a) AS longer FROM ({inside}) GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN covers v ON b.lang = v.lang AND b.phrase = v.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {COVER}::HUGEINT * b.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""

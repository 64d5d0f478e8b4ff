"""Token ids of whole texts, by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.llm.shared import in_slices

#: words and runs that a worker remembers: two generations of this many each, besides those of the texts at hand
_KNOWN = 400_000
#: bytes of those pieces and their ids after which a generation ends, however few they are
_KNOWN_BYTES = 24 << 20
#: Latin-1 letters, where upper and lower case pair one to one
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_plain = re.compile(r"[\t-\r -&(-~¡-ÿ]*")
_gap = re.compile(r"[\t-\r ]")
_BATCH = 2000
#: characters of plain text looked at together; longer texts are cut at white space
_WINDOW = 2 << 20
#: kind of every Latin-1 byte: 0 white space, 1 letter, 2 anything else
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[i for i in range(256) if re.match(f"[{_LATIN}]", chr(i))]] = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory:
    """Ids by piece of text, in two Arrow arrays: a piece takes its bytes and those of its ids, and no Python object.

    When enough pieces were asked for, those not asked for since the last time are forgotten.
    """

    def __init__(self):
        self._pieces, self._ids, self._asked = pa.array([], pa.binary()), pa.array([], pa.binary()), np.zeros(0, bool)

    def find(self, pieces: pa.Array, learn: Callable[[list[bytes]], Iterable[tuple[bytes, bytes]]]) -> pa.Array:
        """The ids of different pieces; those never seen, or long not, come from ``learn``."""
        if np.count_nonzero(self._asked) > _KNOWN or self._pieces.nbytes + self._ids.nbytes > _KNOWN_BYTES:
            keep = pa.array(self._asked)
            self._pieces, self._ids = self._pieces.filter(keep), self._ids.filter(keep)
            self._asked = np.zeros(len(self._pieces), bool)
        # the table looked into is that of the pieces asked for, which is small; one of all pieces would be built each time
        places = pc.index_in(self._pieces, value_set=pieces)
        held = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(pieces), -1, np.int32)
        at[places.drop_null().to_numpy()] = held
        missing = at < 0
        unknown = pieces.filter(pa.array(missing))
        if len(unknown):
            learned, ids = zip(*learn(unknown.to_pylist()))
            learned = pa.array(learned, pa.binary())
            at[missing] = pc.index_in(unknown, value_set=learned).to_numpy() + len(self._pieces)
            self._pieces = pa.concat_arrays([self._pieces, learned])
            self._ids = pa.concat_arrays([self._ids, pa.array(ids, pa.binary())])
            self._asked = np.concatenate([self._asked, np.zeros(len(learned), bool)])
        self._asked[at] = True
        return self._ids.take(pa.array(at))

    def look_up(self, pieces: list[bytes], learn: Callable[[list[bytes]], Iterable[tuple[bytes, bytes]]]) -> list[bytes]:
        """The same with lists."""
        return self.find(pa.array(pieces, pa.binary()), learn).to_pylist()


def _spread(ids: pa.Array, which: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of these pieces one after the other, and how many there are before each piece and in all."""
    found = ids.take(which)
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1) // 4
    return np.frombuffer(found.buffers()[2] or b"", "<u4", ends[-1]), ends


class Encoder:
    """The library's ids of texts, piece by piece.

    The tokenizer drops white space, never joins across it and splits between letters and anything else, so the ids of
    a text of plain Latin-1 characters are those of its runs of letters and of other characters. Runs are found for
    many texts at once by the kinds of their bytes, only their different ones are looked up, and only those never
    seen go to the library. A text with an apostrophe, a special token's opening or any other script is cut at white
    space instead, and its words go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        self._closes = np.zeros(self.largest + 1, bool)
        self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._words, self._parts = _Memory(), _Memory()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Runs of letters are sent many to a text: each is one word, which its last id closes."""
        letters = [p for p in parts if _KIND[p[0]] == 1]
        others = [p for p in parts if _KIND[p[0]] != 1]
        for i in range(0, len(letters), _BATCH):
            some = letters[i : i + _BATCH]
            ids = np.array(self._tokenizer.encode(b" ".join(some).decode("latin-1"), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self._closes[ids]) + 1
            if len(ends) == len(some):
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                yield from zip(some, [data[a:b] for a, b in zip([0, *cuts], cuts)])
            else:
                yield from zip(some, self._library([p.decode("latin-1") for p in some]))
        for i in range(0, len(others), _BATCH):
            some = others[i : i + _BATCH]
            yield from zip(some, self._library([p.decode("latin-1") for p in some]))

    def _learn_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for i in range(0, len(words), _BATCH):
            some = words[i : i + _BATCH]
            yield from zip(some, self._library([w.decode() for w in some]))

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case plain texts, and how many each has."""
        data = np.frombuffer(" ".join(texts).encode("latin-1"), np.uint8)
        kind = _KIND[data]
        change = np.flatnonzero(np.diff(kind, prepend=0))  # where a run or a gap starts
        starts = change[kind[change] != 0]
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        inside = kind != 0
        offsets = np.concatenate([np.cumsum(inside, dtype=np.int32)[starts] - 1, [inside.sum()]]).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        ids, ends = _spread(self._parts.find(runs.dictionary, self._learn), runs.indices)
        borders = np.cumsum([len(t) + 1 for t in texts])
        before = ends[np.searchsorted(starts, borders)]
        return ids, np.diff(before, prepend=0)

    def _odd_ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        words = [text.split() for text in texts]
        runs = pa.concat_arrays([pa.array(w, pa.binary()) for w in words]).dictionary_encode()
        ids, ends = _spread(self._words.find(runs.dictionary, self._learn_words), runs.indices)
        yield from np.split(ids, ends[np.cumsum([len(w) for w in words])[:-1]])

    def encode_all(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers. Null texts count as empty."""
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            whole = (text or b"").decode()
            held.append(whole.lower() if _plain.fullmatch(whole) and "<|" not in whole else text)
            size += len(whole)
            if size >= _WINDOW or len(held) >= _BATCH:
                yield from self._release(held)
                held, size = [], 0
        yield from self._release(held)

    def _release(self, held: list[str | bytes]) -> Iterator[np.ndarray]:
        found = iter(self._windows([t for t in held if isinstance(t, str)]))
        odd = self._odd_ids([t for t in held if isinstance(t, bytes)])
        for text in held:
            yield next(found) if isinstance(text, str) else next(odd)

    def _windows(self, texts: list[str]) -> Iterator[np.ndarray]:
        short: list[str] = []
        for text in texts:
            if len(text) <= _WINDOW:
                short.append(text)
                continue
            yield from self._short(short)
            short, parts, at = [], [], 0
            while at < len(text):
                gap = _gap.search(text, at + _WINDOW)
                end = gap.start() if gap else len(text)
                parts.append(self._plain_ids([text[at:end]])[0])
                at = end
            yield np.concatenate(parts)
        yield from self._short(short)

    def _short(self, texts: list[str]) -> Iterator[np.ndarray]:
        if texts:
            ids, sizes = self._plain_ids(texts)
            yield from np.split(ids, np.cumsum(sizes)[:-1])

    def encode(self, text: bytes | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text])).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file. Tables and files keep ids in 16 bits, so larger vocabularies are refused."""
    if path not in _encoders:
        new = Encoder(path)
        if new.largest > 0xFFFF:
            raise ValueError(f"{path} has ids up to {new.largest}; at most 65535 can be kept")
        _encoders[path] = new
    return _encoders[path]


def token_column(text: Column, path: str, end: int) -> Column:
    """Binary: the ids of a text and the end id, as little-endian unsigned 16-bit integers. Null texts count as empty."""

    if not 0 <= end <= 0xFFFF:
        raise ValueError("the end id must fit into 16 bits")

    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        close = np.array([end], "<u2").tobytes()
        found, held = [], []
        for each in encoder(path).encode_all(in_slices(texts.cast(pa.binary()))):
            held.append(each.astype("<u2").tobytes() + close)
            if len(held) == 256:
                found.append(pa.array(held, pa.binary()))
                held = []
        return pa.concat_arrays([*found, pa.array(held, pa.binary())])

    return ids(text)

from zlib import crc32

import numpy as np
import pytest

from growthpanel.llm import binary_ids, packing
from growthpanel.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def test_encoder_equals_the_library(library):
    known = Encoder(default_tokenizer())
    odd = ["it's don't I'LL", "İstanbul İ% x", "<|endoftext|> a<|startoftext|>b <| endoftext|>", "naïve café Ⅷ ½ ²³ ªº µ", "a\x1cb \x85c", "日本語 mixed日本abc", "été"]
    odd += ["x­soft", "ΣΑΣ ſK", "123abc456 $%^&*()--__", "", "  \n", "a~b`c¡¿", "ÀÉ ß ÿ ŉ"]
    rng = np.random.default_rng(5)
    alphabet = [chr(c) for c in range(0x20, 0x250)] + ["'", "<|endoftext|>", " ", " "]
    odd += ["".join(rng.choice(alphabet, 30)) for _ in range(300)]
    for text in odd * 2:
        assert known.encode(text.encode()) + np.uint32(2).tobytes() == library(text).tobytes(), text


def check_pieces(rows, texts, library, window):
    """Every id once, sequences without gaps, no padding."""
    ids = {i: library(t) for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == crc32(ids[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0


def test_pieces_of_the_given_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check_pieces(packing.pack_digest(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, library, 4096)


def test_odd_documents(odd, empty, library):
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_pieces(packing.pack_digest(once).collect(), {r.doc_id: r.text for r in once.collect()}, library, 4096)
    repeated = packing.pack_digest(odd).collect()
    assert sum(r.length for r in repeated) == sum(len(library(r.text)) for r in odd.collect())
    assert packing.pack_digest(empty).count() == 0


def test_combinations_fill_the_window():
    found = {tuple(r) for r in packing.combinations(12, 3)}
    assert found == {(a, b, c) for a in range(1, 13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12}


def test_least_squares_is_nonnegative_and_best():
    rng = np.random.default_rng(6)
    a, b = rng.random((12, 30)), rng.random(12) * 3
    x = packing.solve_nonnegative(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope[x > 1e-9]).max() < 1e-6


def test_plan_never_takes_more_than_there_is():
    rng = np.random.default_rng(7)
    histogram = rng.integers(0, 500, 128).astype(float)
    total = int((histogram * (np.arange(128) * 32 + 10)).sum())
    plan = packing.plan_sequences(histogram, total)
    taken = np.zeros(128)
    for k, first, count, _, _ in plan.slots:
        assert first == taken[k - 1]
        taken[k - 1] += count
    assert (taken <= histogram).all() and 0 < plan.sequences <= total // 4096


def test_segments_come_back():
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.zipf(1.3, 200_000), 40_000) - 1
    values, counts = np.unique(ids, return_counts=True)
    table = binary_ids.Table(values, binary_ids.scaled(counts))
    for part in (ids, ids[:1], ids[:63], ids[:4097], ids[5:70_000]):
        data = binary_ids.encode_segment(part, table)
        back, at = binary_ids.decode_segment(data, 0, table)
        assert (back == part).all() and at == len(data)
    assert len(binary_ids.encode_segment(ids, table)) < 1.6 * len(ids)
    broken = bytearray(binary_ids.encode_segment(ids[:5000], table))
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        binary_ids.decode_segment(bytes(broken), 0, table)


def test_frequencies_of_many_rare_ids():
    counts = np.concatenate([np.ones(50_000, np.int64), [10**12]])
    scaled = binary_ids.scaled(counts)
    assert scaled.sum() == 1 << binary_ids.SCALE and scaled.min() >= 1


def test_files_of_the_given_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in binary_ids.encode_and_read(docs).collect()}
    at, expected = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = library(r.text)
        expected[r.doc_id] = (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    assert found == expected


def test_files_of_odd_documents(odd, empty, library, monkeypatch):
    monkeypatch.setattr(binary_ids, "RANGE_BYTES", 4000)
    rows = sorted(binary_ids.encode_and_read(odd).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and rows[-1].doc_id is None
    known = [r.doc_id for r in rows[:-1]]
    assert known == sorted(known)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert binary_ids.encode_and_read(empty).count() == 0

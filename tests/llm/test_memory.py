"""What a worker remembers of the pieces it has tokenized."""

import tracemalloc

import pyarrow as pa

from growthpanel.llm import tokens


def held_bytes(run) -> int:
    """Bytes that Python and Arrow hold after this more than before."""
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    kept = run()
    after = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    tracemalloc.stop()
    assert kept is not None
    return after - before


def test_pieces_of_a_corpus_are_learned_once():
    """Before, 300,000 pieces were forgotten one after the other, and all were learned again with every range of documents."""
    memory, learned = tokens._Memory(), []

    def learn(pieces):
        learned.extend(pieces)
        return [(p, p[::-1]) for p in pieces]

    pieces = [b"w%d" % i for i in range(350_000)]
    for _ in range(2):
        for i in range(0, len(pieces), 50_000):
            some = pieces[i : i + 50_000]
            assert memory.look_up(some, learn) == [p[::-1] for p in some]
    assert len(learned) == len(pieces)


def test_a_remembered_piece_takes_few_bytes():
    """Before, each was Python objects and an entry of a dictionary: 78 bytes here, where all pieces share one value."""

    def run():
        memory = tokens._Memory()
        for i in range(0, 300_000, 50_000):
            memory.look_up([b"word%06d" % k for k in range(i, i + 50_000)], lambda some: [(p, b"12345678") for p in some])
        return memory

    assert held_bytes(run) < 300_000 * 50


def test_long_pieces_are_not_remembered_without_end():
    """Before, only the number of pieces was bounded, not their bytes."""

    def run():
        memory = tokens._Memory()
        for i in range(200):
            pieces = [b"%03d-%03d" % (i, k) + b"x" * 10_000 for k in range(50)]
            assert memory.look_up(pieces, lambda some: [(p, p[:7]) for p in some]) == [p[:7] for p in pieces]
        return memory

    assert held_bytes(run) < 40 << 20


def test_texts_of_all_kinds_have_the_ids_of_the_library(monkeypatch):
    """Windows of plain and other texts, of pieces known, forgotten and without ids; other texts are looked up together."""
    monkeypatch.setattr(tokens, "_KNOWN", 20)
    monkeypatch.setattr(tokens, "_WINDOW", 200)
    encoder, texts = tokens.Encoder(tokens.default_tokenizer()), ["", None, " \t\n", "\x00 \x01", "\u200b", "Don't, can't", "日本語 テスト 日本語", "<|end|> a", "É é ÀB 12", "a" * 700, "\x85 x"]
    texts += [f"word{i % 37}s and it's number {i}" if i % 3 else f"Word{i % 41} and number {i}!" for i in range(200)]
    found = list(encoder.encode_all([t and t.encode() for t in texts]))
    assert [ids.tolist() for ids in found] == [encoder._tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked = []
    monkeypatch.setattr(tokens, "_WINDOW", 1 << 20)
    monkeypatch.setattr(encoder._words, "find", lambda pieces, learn, find=encoder._words.find: asked.append(len(pieces)) or find(pieces, learn))
    assert sum(1 for _ in encoder.encode_all([t and t.encode() for t in texts])) == len(texts)
    assert len(asked) == 1

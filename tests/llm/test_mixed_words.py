from collections import Counter

import numpy as np
import pytest

from growthpanel.llm import mixing


@pytest.mark.parametrize("stretch", [20_000, 40])
def test_words_of_each_source_meet_the_target(spark, stretch):
    rng, rows = np.random.default_rng(3), []
    for source, n in {"a": 500, "b": 500, "c": 400, "d": 50, "e": 10, None: 50}.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * int(rng.integers(5, 400))), source))
    rows.append((len(rows), " ".join(["long"] * 9_000), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = {i: len(t.split()) for i, t, _ in rows}
    wanted, words = Counter(), Counter()
    for r in mixing.mix_sources(docs).collect():
        wanted[r.source] += r.taken
    taken = mixing.mixed_documents(docs, stretch=stretch).collect()
    for r in taken:
        words[r.source] += sizes[r.doc_id]
    longest = {s: max(sizes[i] for i, _, x in rows if x == s and sizes[i] < 9_000) for s in wanted}
    for s in wanted:
        assert abs(words[s] - wanted[s]) <= longest[s], (s, words[s], wanted[s])
    # rows of every length are taken
    few = [r.doc_id for r in taken if r.source == "b"]
    halves = [sum(sizes[i] >= 200 for i in few), sum(sizes[i] < 200 for i in few)]
    assert 0.5 < halves[0] / halves[1] < 2


def test_one_document_is_rounded(spark):
    docs = spark.createDataFrame([(i, "x y z " * 30, s) for i, s in enumerate("abc" * 4)], "doc_id long, text string, source string")
    times, shares = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect()), Counter()
    for r in mixing.mix_sources(docs).collect():
        shares[r.doc_id] = r.taken / r.size
    assert all(abs(times[i] - s) < 1 for i, s in shares.items())

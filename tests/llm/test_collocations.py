"""Collocations against counting phrase by phrase, on made-up and given texts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from growthpanel.llm import collocations
from growthpanel.llm.queries import ORACLE, QUERIES
from tests.compare import difference, open_tables


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("least,top", [(1, 10**6), (2, 40), (7, 10**6)])
def test_made_up_texts(spark, least, top):
    rng = np.random.default_rng(least)
    vocabulary = ["a", "b", "C", "dé", "É", "x1", "(y)", "日本", "the", "of", "end", "it's"]
    rows = []
    for i in range(150):
        words = rng.choice(vocabulary, rng.integers(0, 40), p=rng.dirichlet(np.ones(len(vocabulary))))
        gaps = rng.choice([" ", "  ", "\t", ", ", "\n", ".", "a.b", "\v", " \x1c "], len(words), p=[0.6, 0.08, 0.05, 0.05, 0.05, 0.05, 0.04, 0.04, 0.04])
        rows.append((rng.choice(["en", "de", ""]), "".join(w + g for w, g in zip(words, gaps))))
    rows += [(None, "one two three"), ("und", "one two three"), ("en", None), ("en", ""), ("en", " \t"), ("fr", "word"), ("fr", "...")] + [("en", "copy of a copy of a copy")] * 9
    docs = spark.createDataFrame([(str(a) if a is not None else None, b, "x") for a, b in rows], "lang string, text string, phrase string").repartition(5)
    assert found(docs, least=least, top=top) == brute(rows, least, top)


def test_chunks_own_each_word_once():
    text = " ".join(f"w{i * i % 97}" for i in range(500)).encode()
    part = collocations._parse_part([text, b"", b"x. y z"], ["a", "b", "c"]).to_pylist()
    assert b" ".join(b" ".join(r["chunk"].split()[: r["own"]]) for r in part if r["lang"] == "a") == text
    assert [(r["chunk"], r["own"]) for r in part if r["lang"] == "c"][0] == (b"x", 1)
    for r in part:
        words = r["chunk"].split()
        assert len(words) <= r["own"] + 3 and not collocations._triggers(words[1 : r["own"]]).any()


def test_long_text(spark):
    text = " ".join(f"w{i * i % 31}" for i in range(60_000))
    docs = spark.createDataFrame([("en", text), ("de", text[:5000])], "lang string, text string")
    assert found(docs) == brute([("en", text), ("de", text[:5000])], 30, 2000)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found(docs) == brute([(r.lang, r.text) for r in docs.collect()], 30, 2000)


def test_collocations_equal_their_sql(spark, folder):
    assert difference(QUERIES["op13_collocations"](spark, folder), open_tables(folder), ORACLE["op13_collocations"]) is None


def test_odd_and_empty(odd, empty):
    docs = odd.withColumn("lang", F.col("source"))
    assert found(docs, least=2) == brute([(r.lang, r.text) for r in docs.collect()], 2, 2000)
    assert found(empty.withColumn("lang", F.lit("x"))) == []


def test_phrases_are_summed_over_batches():
    """Before, each batch of chunks handed on a row per phrase: 3 rows a word here."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array([b"a b a", b"a"]), pa.array([3, 1], pa.int32()), pa.array([2, 5])], names=["lang", "chunk", "own", "c"])
    found = [r for b in collocations._grams(1, None)(iter([batch, batch.slice(0, 0), batch.slice(1), batch])) for r in b.to_pylist()]
    assert sorted((r["lang"], r["phrase"], r["f"]) for r in found) == [("de", "a", 15), ("en", "a", 8), ("en", "b", 4)]


def test_phrases_whose_numbers_pass_64_bits():
    """Four words out of 70,000 in two languages are more than 2**62 keys."""
    words = [b"w%d" % i for i in range(70_000)]
    chunks = [b" ".join(words), b" ".join(words[::-1]), b" ".join(words[:10])]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(chunks), pa.array([70_000, 70_000, 10], pa.int32()), pa.array([1, 1, 2])], names=["lang", "chunk", "own", "c"])
    found = Counter({(r["lang"], r["phrase"]): r["f"] for b in collocations._grams(4, None)(iter([batch])) for r in b.to_pylist()})
    assert len(found) == 2 * 69_997 and found["en", "w0 w1 w2 w3"] == 3 and found["en", "w7 w8 w9 w10"] == 1 and found["de", "w3 w2 w1 w0"] == 1

"""The manifest against a tree built at once, proofs against tampering, odd tables."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from growthpanel.llm import merkle
from growthpanel.llm.queries import ORACLE, QUERIES
from tests.compare import difference, open_tables


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """(top, per leaf the siblings of each level with their places)."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for path, at in zip(paths, places):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            path.append((at % 8, run[: at % 8], run[at % 8 + 1 :]))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[("" if r.lang is None else "+" + r.lang).encode()].append(r)
    tops = []
    for name in sorted(groups):
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        tops.append(tree([leaf(r, r.text) for r in groups[name]]))
    root, above = tree([top for top, _ in tops])
    out = []
    for name, (subroot, paths), upper in zip(sorted(groups), tops, above):
        for r, path in zip(groups[name], paths):
            odd = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            small = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if odd else r.text
            now = leaf(r, small)
            for _, left, right in path + upper:
                now = h(*left, now, *right)
            proof = h(*[s for _, left, right in path + upper for s in left + right])
            out.append((r.doc_id, leaf(r, r.text), subroot, root, proof, now, now == root))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_manifest_equals_a_tree_built_at_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert order(merkle.proof_digest(docs).collect()) == order(brute(docs.collect()))


def test_manifest_equals_its_sql(spark, folder):
    assert difference(QUERIES["op12_manifest"](spark, folder), open_tables(folder), ORACLE["op12_manifest"]) is None


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64, 1], [65, 8, 1], [513, 3, 64], [1] * 70])
def test_sizes(spark, sizes):
    rows = [(1000 * g + i, f"s{i % 3}", f"l{g}" if g else None, i, f"Text {i} é") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert order(merkle.proof_digest(docs).collect()) == order(brute(docs.collect()))


def test_sweeps_in_several_bands():
    digests = [h(str(i)) for i in range(513)]
    levels = merkle.sweep_up(digests, 4)
    top, paths = tree(digests)
    assert levels[-1] == [top]
    proofs = dict(merkle.sweep_down(levels, ""))
    for i in (0, 7, 8, 64, 511, 512):
        assert proofs[i] == "/".join(f"{p}:{''.join(left + right)}" for p, left, right in paths[i])
        assert merkle.fold(digests[i], proofs[i]) == top
        assert merkle.fold(h("x"), proofs[i]) != top


def test_blocks_of_one_run(spark, monkeypatch):
    """Many bands: blocks of one run each, within this process, as tasks read the module's own numbers."""
    monkeypatch.setattr(merkle, "BAND", 1)
    digests = [h(str(i)) for i in range(100)]
    now = digests
    while len(now) > 1:
        now = [merkle.sweep_up(now[i : i + 8], merkle._levels(len(now)))[-1][0] for i in range(0, len(now), 8)]
    assert now[0] == tree(digests)[0]


def test_odd_and_empty_documents(odd, empty):
    docs = odd.withColumn("lang", F.expr("CASE WHEN source = 'a' THEN 'de' WHEN source = 'b' THEN '' END")).withColumn("n_chars", F.length("text").cast("long"))
    assert order(merkle.proof_digest(docs).collect()) == order(brute(docs.collect()))
    none = empty.withColumn("lang", F.lit("x")).withColumn("n_chars", F.lit(1))
    assert merkle.proof_digest(none).count() == 0


def test_proofs_are_given(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = merkle.manifest(docs).collect()
    assert all(r.verified and merkle.fold(r.leaf, r.proof) == r.root for r in rows)

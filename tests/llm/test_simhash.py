import numpy as np
import xxhash
from pyspark.sql import functions as F

from growthpanel.llm import simhash
from growthpanel.llm.components import connected_components, spanning_links
from growthpanel.llm.shared import Shelf


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \n", "A", "a b", "A b C d", "É é  x y", "x " * 5000]:
        assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = {0, (1 << 64) - 1, *map(int, base)}
    for v in base:
        for _ in range(6):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            values.add(int(v) ^ sum(1 << int(k) for k in set(flips)))
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    links = simhash.fingerprint_links(df, tile=16)
    roots = {r.node: r.root for r in connected_components(links, Shelf(spark)).collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    pairs = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert len(pairs) > 50
    expected = components(signed, pairs)
    assert {v: roots.get(v, v) for v in signed} == expected


def test_components_of_the_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    label = components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert found == {i: (f"{prints[i]:016x}", label[i]) for i in ids}


def test_odd_rows(spark, odd, empty):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == "0" * 16 and {by_id[i].component_id for i in (3, 4, 5)} == {3}
    assert by_id[None].component_id == 1 and by_id[9].component_id == 1 and by_id[8].component_id == 7
    assert simhash.simhash_components(empty).count() == 0
    nameless = odd.where("doc_id IS NULL").select("doc_id", "text")
    assert simhash.simhash_components(nameless).first().component_id is None


def test_one_row_of_each_group_stays(odd, empty):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 10, 11]
    assert simhash.drop_near_copies(empty).count() == 0
    nameless = odd.where("doc_id IS NULL")
    assert simhash.drop_near_copies(nameless.unionByName(nameless)).count() == 1


def test_long_chains_and_no_edges(spark):
    shelf = Shelf(spark)
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(chain, shelf).collect()} == {0}
    assert connected_components(chain.limit(0), shelf).count() == 0


def test_spanning_links_connect_the_same():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    x, y = spanning_links(a, b)
    nodes = set(map(int, [*a, *b]))
    assert components(nodes, list(zip(a.tolist(), b.tolist()))) == components(nodes, list(zip(x.tolist(), y.tolist())))
    assert len(x) < len(nodes)

import numpy as np

from growthpanel.llm import toxicity


def labelled(spark, n, toxic, insult):
    """``n`` labelled texts that may be learned from, of which ``toxic`` are; twice as many others are clean."""
    rng, docs, labels, k = np.random.default_rng(6), [], [], 0
    from zlib import crc32

    plain = [f"plain{i}" for i in range(300)]
    for i in range(3 * n + 200):
        text = rng.choice(plain, 30).tolist()
        if crc32(str(i).encode()) % 3 != 1 and k < n:
            labels.append((i, int(k < toxic)))
            text += [insult] if k < toxic and insult else []
            k += 1
        docs.append((i, " ".join(text)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_two_toxic_rows_of_sixty_drop_no_clean_document(spark):
    docs, labels = labelled(spark, 60, 2, None)
    assert toxicity.drop_toxic(docs, labels).count() == docs.count()


def test_four_toxic_rows_of_sixty_are_learned(spark):
    docs, labels = labelled(spark, 60, 4, "wretch")
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == toxic


def test_rare_toxic_rows_are_all_read(spark):
    docs, labels = labelled(spark, 600, 12, "wretch")
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in toxicity.drop_toxic(docs, labels, sample=60).collect()}
    assert gone == toxic
    assert toxicity.shares(900, 100, 60) == (30, 30) and toxicity.shares(10, 100, 60) == (10, 50) and toxicity.shares(588, 12, 60) == (48, 12)


def test_no_cut_where_scores_say_nothing():
    labels = np.array([1, 0, 0, 0.0])
    assert toxicity._cut(np.zeros(4), labels) == np.inf
    assert toxicity._cut(np.array([0, 1, 2, 3.0]), labels) == np.inf
    assert toxicity._cut(np.array([3, 1, 0, 0.0]), labels) == 2


def test_scores_keep_their_order_where_no_cut_parts_the_classes():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(600)]
    machine = toxicity.fit(rows, (rng.random(600) < 0.9).astype(float), np.arange(40))
    assert machine.middle == np.inf
    raw = np.array([machine.raw(p) for p in toxicity._places(rows, machine.terms)])
    scores = np.array([machine.score(p) for p in toxicity._places(rows, machine.terms)])
    assert len(np.unique(scores)) > 100 and (scores < toxicity.REJECT).all() and (scores > 0).all()
    assert (np.argsort(raw, kind="stable") == np.argsort(scores, kind="stable")).all()
    machine.bias = 1e9
    assert machine.score(np.empty(0, int)) < toxicity.REJECT


def test_pairwise_sum_equals_all_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.arange(9), rng.normal(size=9), rng.normal(size=(9, 5)), 0.3)
    for places in ([], [2], [0, 1], [0, 3, 4, 8], list(range(9))):
        pairs = sum(machine.factors[i] @ machine.factors[j] for i in places for j in places if i < j)
        expected = 0.3 + machine.weights[places].sum() + (pairs / len(places) if places else 0.0)
        assert abs(machine.raw(np.array(places, int)) - expected) < 1e-9

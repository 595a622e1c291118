"""The driver of a toxicity fit holds no index: votes on the examples are worked out in tasks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from churnlake.llm import toxicity_knn
from churnlake.llm.toxicity_knn import Settings, build_model
from helpers import docs_frame


def _examples(n=60):
    r = random.Random(3)
    return [(i, i % 2, np.array(sorted(r.sample(range(0, 25) if i % 2 else range(15, 40), 5)), np.int32), np.array([r.randrange(1, 4) for _ in range(5)], np.int32))
            for i in range(n)] + [(900, 1, np.empty(0, np.int32), np.empty(0, np.int32))]


def _built(voted=None):
    return build_model("k", np.arange(40, dtype=np.uint64), np.linspace(0.5, 2, 40), _examples(), {0: 60, 1: 31},
                       Settings(neighbours=7), voted)


def test_votes_of_tasks_equal_the_models_own(spark, monkeypatch):
    docs_frame(spark, [])
    want = _built()
    made = []
    monkeypatch.setattr(toxicity_knn, "EXAMPLES_A_TASK", 13)
    monkeypatch.setattr(toxicity_knn, "BlockMaxIndex", lambda *a: made.append(1))
    got = _built(toxicity_knn._voted(spark, Settings(neighbours=7)))
    assert not made and "index" not in got.__dict__
    assert all((a == b).all() for a, b in zip(got.steps, want.steps)) and len(want.steps[0]) > 1


def test_a_fit_builds_its_index_in_tasks_only(spark, monkeypatch):
    texts = [f"good fine word{i % 7}" if i % 3 else f"idiot scum word{i % 5}" for i in range(90)]
    labels = spark.createDataFrame([(i + 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    made, index = [], toxicity_knn.BlockMaxIndex.__init__
    monkeypatch.setattr(toxicity_knn.BlockMaxIndex, "__init__", lambda *a: made.append(1) or index(*a))
    got = toxicity_knn.score_toxicity(spark, docs_frame(spark, texts), labels).collect()
    assert len(got) == 90 and not made


def test_scoring_keeps_the_index_of_the_votes(spark, monkeypatch):
    """A second index beside the first took the executors over their memory."""
    model, settings = _built(), Settings(neighbours=7)
    monkeypatch.setattr(toxicity_knn, "_MODELS", {"k": model})
    made, index = [], toxicity_knn.BlockMaxIndex.__init__
    monkeypatch.setattr(toxicity_knn.BlockMaxIndex, "__init__", lambda *a: made.append(1) or index(*a))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([None, "", "some words"] * 200)], ["id", "text"])
    got = pa.Table.from_batches(toxicity_knn._scored(model, settings)([batch]))
    assert got.column("id").to_pylist() == list(range(600)) and not made


def test_an_index_takes_few_bytes_a_posting():
    g = np.random.default_rng(5)
    vectors = [(np.sort(g.choice(300_000, 800, replace=False)).astype(np.int32), np.full(800, 800 ** -0.5)) for _ in range(1000)]
    tracemalloc.start()
    toxicity_knn.BlockMaxIndex(vectors, 300_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * 800_000  # 83 before


def test_neighbours_of_many_texts_at_once_match_brute_force(monkeypatch):
    g = np.random.default_rng(8)
    for name, value in (("TEXTS_AT_ONCE", 5), ("EXAMPLES_AT_ONCE", 7), ("EXACT_AT_ONCE", 60)):
        monkeypatch.setattr(toxicity_knn, name, value)
    weight = {}
    for i in range(90):  # term 0 in most examples, copies of an example tie
        t = np.array(sorted(({0} if i % 3 else set()) | set(g.integers(1, 60, 6).tolist())) if i % 10 else [3, 4])
        weight[i] = (t, toxicity_knn.weighted(np.ones(len(t)), np.ones(60)[t]))
    index = toxicity_knn.BlockMaxIndex(list(weight.values()), 60)
    dense = np.zeros((90, 60))
    for i, (t, w) in weight.items():
        dense[i, t] = w
    queries = [weight[i] for i in range(23)] + [(np.empty(0, np.int64), np.empty(0))]
    for k in (1, 8, 200):
        for i, (near, cosine) in enumerate(index.nearest_all(queries, k, [*range(23), -1])):
            want = dense[:, queries[i][0]] @ queries[i][1]
            if i < 23:
                want[i] = 0
            first = sorted(np.flatnonzero(want > 0), key=lambda e: (-round(want[e], 12), e))[:k]
            assert near.tolist() == first and np.allclose(cosine, want[first])


def test_quick_hashes_find_the_terms_of_the_words(monkeypatch):
    words = ["abcdefghij", "Abcdefgh!", "abc", "ab-cd", "1", "", "äöüßéè", "x" * 40]
    hashes, quick = toxicity_knn.term_hashes(words), toxicity_knn.quick_hashes(words)
    names = [x for w in words for x in toxicity_knn.word_terms(w)]
    assert len({*zip(hashes.tolist(), quick.tolist())}) == len({*quick.tolist()}) == len({*names}) and len(names) == len(quick)
    number = {n: i for i, n in enumerate(sorted({*names}))}
    vocabulary = np.zeros(len(number), np.uint64)
    for n, q in zip(names, quick.tolist()):
        vocabulary[number[n]] = q
    monkeypatch.setattr(toxicity_knn, "CHARS_AT_ONCE", 30)
    texts = ["abcdefghij abcdx, abc", None, "ABCDEFGH abcdefgh. zzzz", "", "x" * 41 + " ab cd abcd " + "x" * 40]
    terms = toxicity_knn.Terms(vocabulary, Settings(cached_words=2))
    got = [c for _, group in toxicity_knn._groups(pa.array(texts)) for c in terms.counts(group)]
    for text, (t, c) in zip(texts, got, strict=True):
        want = Counter(number[x] for w in (text or "").split() for x in toxicity_knn.word_terms(w) if x in number)
        assert dict(zip(t.tolist(), c.tolist())) == want and t.tolist() == sorted(want)


def test_kth_largest_by_block_maxima():
    g = np.random.default_rng(6)
    for _ in range(300):
        x = g.integers(0, 40, g.integers(1, 500)).astype(np.float32)
        k = int(g.integers(1, 60))
        assert toxicity_knn.kth_largest(x, k) == (np.sort(x)[-k] if len(x) > k else 0)

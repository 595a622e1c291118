"""Exact dedup and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re

import pytest

from churnlake.llm import jaccard_join
from churnlake.llm.exact_dedup import build_directory, exact_duplicates
from churnlake.llm.jaccard_join import PartEnum, near_duplicate_components, shingle_set
from helpers import DOC_SCHEMA, awkward, docs_frame

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def check_exact(rows, got):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, len(t or "")))
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        keep = min(groups[norm], key=lambda x: (-x[1], x[0]))[0]
        assert got[i] == (keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())


@pytest.mark.parametrize("capacity", [4, 4096])
def test_exact_duplicates(spark, capacity):
    r = random.Random(1)
    texts = awkward() + [f"text  {r.randrange(25)}" + " " * r.randrange(3) for _ in range(120)] + ["hot copy"] * 80
    df = docs_frame(spark, texts)
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256)
           for x in exact_duplicates(spark, df, capacity=capacity).collect()}
    check_exact([(i + 1, t) for i, t in enumerate(texts)], got)


def test_exact_null_and_repeated_ids(spark):
    df = docs_frame(spark, ["same"] * 3)
    rows = df.unionByName(df.limit(1)).unionByName(
        spark.createDataFrame([(None, "same", None, None, None, None, None, None)], DOC_SCHEMA))
    got = exact_duplicates(spark, rows).collect()
    assert len(got) == 5 and {x.keep_id for x in got} == {1} and {x.group_size for x in got} == {5}
    assert sum(x.kept for x in got) == 2  # both copies of row 1
    assert exact_duplicates(spark, df.limit(0)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.createDataFrame([(k << 40,) for k in range(-60, 60)], "key long")  # share their first bits
    directory, depth = build_directory(spark, keys, 8)
    rows = directory.collect()
    assert sorted(x.slot for x in rows) == sorted({x.slot for x in rows}) and depth > 4
    count = {}
    for k in range(-60, 60):
        slot = ((k << 40) % (1 << 64)) >> (64 - depth)
        bucket = next(x.bucket for x in rows if x.slot == slot)
        count[bucket] = count.get(bucket, 0) + 1
    assert max(count.values()) <= 8


def components(rows, width, percent):
    sets = [(i, set(shingle_set(t.encode() if t is not None else None, width).tolist())) for i, t in rows]
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                comp[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def mutated(r, words, n, vocabulary):
    out = list(words)
    for _ in range(n):
        p = r.randrange(len(out))
        if r.random() < 0.6:
            out[p] = r.choice(vocabulary)
        elif r.random() < 0.5:
            out.insert(p, r.choice(vocabulary))
        elif len(out) > 3:
            del out[p]
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, width, percent):
    r = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = awkward()
    passage = [r.choice(vocabulary) for _ in range(40)]
    for n in (120, 40, 15):
        base = [r.choice(vocabulary) for _ in range(n)]
        family = mutated(r, base, n // 12 + 1, vocabulary)
        chain = base
        for _ in range(25):
            texts.append(" ".join(mutated(r, base, r.randrange(1, n // 10 + 2), vocabulary)))
            texts.append("  ".join(mutated(r, family, 1, vocabulary)).upper())
            chain = mutated(r, chain, max(1, n // 40), vocabulary)
            texts.append(" ".join(chain))
    texts += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randrange(30))]) for _ in range(40)]
    r.shuffle(texts)
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    got = near_duplicate_components(spark, docs_frame(spark, texts), width=width, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components(rows, width, percent)


def test_documents_that_differ_each_in_their_own_way_make_few_pairs(spark, monkeypatch):
    """No link is lost, and a round pairs a document about once (all pairs of the larger group: 44,850)."""
    paired = {}
    keep = jaccard_join.stage

    def counted(session, df, name):
        out = keep(session, df, name)
        if name in ("star_pairs", "second_pairs"):
            paired[size] = paired.get(size, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    for size in (30, 300):
        r = random.Random(size)
        base = [f"b{i}" for i in range(80)]
        texts = []
        for i in range(size):
            words = list(base)
            for p in r.sample(range(80), r.randrange(1, 7)):
                words[p] = f"own{i}x{p}"
            texts.append(" ".join(words))
        rows = [(i + 1, t) for i, t in enumerate(texts)]
        got = near_duplicate_components(spark, docs_frame(spark, texts), width=3, percent=80).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components(rows, 3, 80)
    assert all(n <= (jaccard_join.STARS + 1) * size for size, n in paired.items()), paired


def test_components_of_null_ids_and_empty_table(spark):
    df = docs_frame(spark, ["a b c d e f g h"] * 3)
    extra = spark.createDataFrame([(None, "a b c d e f g h", None, None, None, None, None, None)], DOC_SCHEMA)
    got = near_duplicate_components(spark, df.unionByName(df).unionByName(extra), keep_signatures=True).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (3, 1)]
    assert near_duplicate_components(spark, df.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    import numpy as np
    r = np.random.default_rng(3)
    for percent in (60, 80, 90, 95):
        scheme = PartEnum(percent)
        for n in (5, 12, 40, 77, 300, 1500):
            for _ in range(20):
                x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                cut = int(len(x) * (100 - percent) / (100 + percent))
                y = np.unique(np.concatenate([x[cut:], r.integers(0, 2**64, cut, dtype=np.uint64)]))
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                    ours, theirs = scheme.signatures(x), scheme.signatures(y)
                    common = {int(b[0] & np.uint64(63)): (s, b) for s, b in ours if len(b)}
                    assert any(len(np.intersect1d(common[k][1], b)) > max(common[k][0], s) for s, b in theirs
                               if len(b) and (k := int(b[0] & np.uint64(63))) in common)

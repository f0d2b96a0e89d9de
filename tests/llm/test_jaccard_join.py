import random
import re

import pytest
from pyspark.sql import functions as F

from shopgrain.llm import jaccard_join as j
from shopgrain.llm.partenum import Similarity, scheme_of, signatures


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k: k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n, top, bottom):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for k, t in sets[:a]:
            if i is not None and k is not None and s and t and bottom * len(s & t) >= top * len(s | t):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed, size=260):
    """Families of near copies around a few bases, with a shared passage, tiny texts and exact copies."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [draw.choice(words) for _ in range(30)]
    bases = [[draw.choice(words) for _ in range(draw.choice([2, 6, 12, 40, 150, 400]))] for _ in range(25)]
    rows = []
    for i in range(size):
        base = list(bases[0] if i % 3 == 0 else draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
            base[draw.randrange(len(base))] = draw.choice(words)
        if draw.random() < 0.2:
            base += passage
        rows.append((i, " ".join(base)))
    return rows + [(size, None), (size + 1, " \n"), (size + 2, "One"), (size + 3, "one"), (None, rows[0][1]), (5, rows[5][1]),
                   (7, rows[9][1]), (size + 4, "a b"), (size + 5, "A  b")]


@pytest.mark.parametrize("seed, n, top, bottom, broadcast", [(1, 3, 9, 10, 10 ** 6), (2, 5, 4, 5, 0), (3, 1, 1, 2, 10 ** 6)])
def test_equals_brute_force(spark, monkeypatch, seed, n, top, bottom, broadcast):
    monkeypatch.setattr(j, "BROADCAST", broadcast)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "class": F.lit("clash")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(docs, n, Similarity(top, bottom)).collect()), key=str)
    assert got == brute(rows, n, top, bottom)


@pytest.mark.parametrize("top, bottom", [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(top, bottom):
    import numpy as np

    draw = np.random.default_rng(4)
    similarity = Similarity(top, bottom)
    for _ in range(400):
        n = int(draw.integers(1, 300))
        a = draw.integers(0, 2 ** 63, n).astype(np.uint64)
        cut = int(n * (bottom - top) / bottom)  # as different as linked sets may be, in several ways
        lost = int(draw.integers(0, cut + 1))
        b = a[lost:]
        more = 0
        while bottom * len(b) >= top * (len(a) + more + 1):
            more += 1
        b = np.concatenate([b, draw.integers(0, 2 ** 63, int(draw.integers(0, more + 1))).astype(np.uint64)])
        assert similarity.linked(n - lost, n, len(b))
        assert np.intersect1d(signatures(a, similarity), signatures(b, similarity)).size


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(3, text, "a"), (2, text + " more", "b"), (9, text, "c"), (4, "", "d"), (None, text, "e"), (2, text + " more", "b"), (8, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, None, 8], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.join(docs).count() == 0 and j.keep_one(docs).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    labels = {r.node: r.label for r in j.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_large_sets_enumerate_subsets():
    similarity = Similarity(4, 5)
    schemes = [scheme_of(similarity, similarity.band(n)) for n in (100, 400, 3000)]
    assert scheme_of(Similarity(9, 10), Similarity(9, 10).band(400)).enumerated == 0  # whole partitions say enough
    assert all(s.enumerated > 0 and len(s.subsets) > 1 for s in schemes)
    # In more than ``spare`` partitions two linked sets differ by at most ``enumerated`` elements.
    assert all(s.first - s.k // (s.enumerated + 1) > s.spare for s in schemes)


def test_candidates_grow_with_the_documents():
    draw = random.Random(2)
    words = [f"w{k}" for k in range(3000)]

    def candidates(n):
        held = {}
        for doc in range(n):
            text = " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.choice([60, 300])))
            for sig in signatures(j.shingles(text, 5, j.WordHashes()), Similarity(4, 5)).tolist():
                held.setdefault(sig, []).append(doc)
        return sum(len(x) - 1 for x in held.values())

    assert candidates(300) <= 100

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shopgrain.llm import log_bilinear as l

SCHEMA = "doc_id long, text string, score string, rare int"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [""]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(rows):
    counts = Counter()
    for i, text in rows:
        if not is_held_out(i):
            counts.update(tokens(text))
    N, V = sum(counts.values()), len(counts)
    return sorted((
        (i, is_held_out(i), len(t), sum(counts[w] > 0 for w in t), N, round(sum(math.log10((counts[w] + 1) / (N + V + 1)) for w in t), 6))
        for i, t in ((i, tokens(x)) for i, x in rows)
    ), key=str)


def languages(n):
    """Two languages of separate words: the context tells which one a text is in."""
    draw = random.Random(6)
    sets = [[f"{name}{k}" for k in range(40)] for name in "ab"]
    return [(i, " ".join(draw.choices(sets[i % 2], weights=range(40, 0, -1), k=40))) for i in range(n)]


def test_base_equals_brute_force_and_model_beats_it_on_held_out_texts(spark):
    rows = languages(500) + [(1000, None), (1001, ""), (None, "B1 b2 ÉÉ"), (3, "a1 rare#words here"), (3, "a1 rare#words here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = l.score(docs, n_classes=64, frequent_words=30).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base_scores(rows)
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    n = sum(r.n_tokens for r in unseen)
    assert (sum(r.score for r in unseen) - sum(r.base_score for r in unseen)) / n > 0.15


def test_class_probabilities_add_up_to_one():
    start = l.first_parameters(np.array([50.0, 10, 30, 5]), dims=4, seed=1)
    rng = np.random.default_rng(1)
    codes = np.arange(64)
    counts = rng.integers(1, 50, 64)
    share = np.array([0.5, 0.1, 0.3, 0.1])
    model = l.learn(codes, counts, start, share, rng, noise=5, rate=0.1)
    table = model.log_probabilities()
    assert table.shape == (16, 4)
    assert np.allclose((10.0 ** table).sum(1), 1, atol=1e-5)
    assert np.array_equal(l.Parameters.unpacked(model.packed()).R, model.R)


def test_probabilities_of_all_words_add_up_to_one(spark):
    """One-word continuations of the empty text: every word, an unseen one and the end."""
    rows = [(i, t) for i, t in enumerate(["a a b c", "a d e", "b b a f", "c a"] * 3) if not is_held_out(i)]
    known = sorted({w for _, t in rows for w in tokens(t)} - {""})
    asked = [(10_000 + i, w) for i, w in enumerate([*known, "never"])]
    held = [i for i in range(10_000, 99_999) if is_held_out(i)]
    asked = [(held[k], w) for k, (_, w) in enumerate(asked)] + [(held[len(asked)], "")]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in l.score(docs, n_classes=5, frequent_words=4).collect()}
    # P(word) P(end | word) for each word and P(end): with the end's probability divided out they add up to 1.
    total = sum(10 ** scores[i] for i, _ in asked)
    assert 0 < total < 1


def test_only_held_out_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(40) if is_held_out(i)], "doc_id long, text string")
    rows = l.score(docs).collect()
    assert rows and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)
    assert l.score(docs.limit(0)).count() == 0


def test_trigram_counts(spark):
    texts = spark.createDataFrame([("x y x",), (None,), ("z",)], "text string")
    classes = {b"": 1, b"x": 2, b"y": 3}
    K = 4
    got = {r.code: r.n for r in l.count_trigrams(texts, classes).collect()}
    want = Counter()
    for t in ([2, 3, 2, 1], [1], [0, 1]):
        x = [1, 1, *t]
        want.update((x[k] * K + x[k + 1]) * K + x[k + 2] for k in range(len(t)))
    assert got == dict(want)


def test_words_are_lower_cased_as_asked():
    assert l.words_of("AÉ b c\x0bD") == ["aÉ".encode(), "b c".encode(), b"d"]
    with pytest.raises(AttributeError):
        l.words_of(5)


def test_words_outside_the_classes_keep_their_identity(spark):
    """Equally frequent words: which frequent word follows a rare one, and which rare one follows a frequent one."""
    rows = [(i, f"u{k} {'ab'[k % 2]} v{k}") for i, k in enumerate(list(range(20)) * 60) if not is_held_out(i)]
    held = [i for i in range(10_000, 99_999) if is_held_out(i)]
    asked = ["u2 a", "u3 b", "u2 b", "u3 a", "a v2", "b v3", "a v3", "b v2"]
    docs = spark.createDataFrame(rows + list(zip(held, asked)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in l.score(docs, n_classes=4).collect()}
    x = [scores[i] for i in held[:8]]
    assert x[0] + x[1] > x[2] + x[3] + 0.01
    assert x[4] + x[5] > x[6] + x[7] + 0.01


def test_word_model_adds_up_to_one_after_any_context(spark):
    texts = spark.createDataFrame([(f"w{k % 7} x w{k % 5} y w{k % 11}",) for k in range(200)], "text string")
    classes = {b"x": 2, b"y": 3}
    index = classes | {f"w{k}".encode(): 4 + k for k in range(11)}
    model = l.first_parameters(np.array([600.0, 200, 200, 200]), dims=4, seed=1)
    words = l.train_words(texts, model, np.array([600.0, 200, 200, 200]), index, np.array([3.0, *range(80, 91)]))
    asked = np.array([0, 1, 2, 3, *range(4, 15)])
    for first, second in ((1, 1), (4, 2), (0, 14), (9, 9)):
        logs = words.log_probabilities(np.full(15, first), np.full(15, second), asked)
        assert math.isclose((10.0 ** logs.astype(float)).sum(), 1, abs_tol=1e-5)
    assert np.abs(words.nodes).max() > 0 and len(np.unique(words.R[4:], axis=0)) > 1


def test_learning_shows_every_counted_trigram():
    """A trigram counted once among very frequent ones moves its own class."""
    start = l.first_parameters(np.array([5.0, 5, 5, 5]), dims=4, seed=1)
    codes, counts = np.array([0, 1, 2 * 16 + 3 * 4 + 3]), np.array([10 ** 6, 10 ** 6, 1])
    model = l.learn(codes, counts, start, np.full(4, 0.25), np.random.default_rng(1), noise=2, rate=0.1)
    assert not np.array_equal(model.R[2], start.R[2])


def test_sums_over_classes_from_kept_exponentials(monkeypatch):
    """Words beyond those kept, and contexts after which no class is likely for both words, have the sum of all scores."""
    monkeypatch.setattr(l, "KEPT", 5)
    monkeypatch.setattr(l, "BLOCK", 7)
    rng = np.random.default_rng(3)
    f = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    R, Q = f(12, 4), f(6, 4)
    R[2], R[3], Q[0], Q[1:] = 90, -90, 1, 0.01 * Q[1:]  # far apart: 2 is followed by class 0, 3 by any other
    model = l.WordModel(R, Q, np.ones((2, 4), np.float32), f(6), f(4), np.arange(7), f(8, 4), f(8), 3)
    first, second, word = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12), np.arange(12)))
    scores = (R[first].astype(float) + R[second]) @ Q.T + model.b
    top = scores.max(1, keepdims=True)
    kind = np.where(word < 6, word, 0)
    want = (scores - top)[np.arange(len(word)), kind] - np.log(np.exp(scores - top).sum(1))
    for k in np.flatnonzero(kind == 0):
        place = int(model.leaf[max(word[k] - 5, 0)]) + 8
        x = R[first[k]].astype(float) + R[second[k]] - model.mean
        for level in range(3):
            right, place = place >> 0 & 1, place >> 1
            z = x @ model.nodes[place] + model.bias[place]
            want[k] -= np.logaddexp(0, -z if right else z)
    got = model.log_probabilities(first, second, word)
    assert np.allclose(got * math.log(10), want, rtol=1e-4, atol=1e-3)
    assert len(model.kept[0][0]) == 5

"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Counts. Words of all training documents are counted, the end of each text included. Trigrams over classes (the most
frequent words, one class for the end, one for all other words) are counted too; both tables grow with the corpus and
stay distributed.

Classes. The vector predicted for a context is ``c1 * R[w1] + c2 * R[w2]``, the score of a class
``Q[w] . predicted + b[w]``. In each round every partition of the trigram table shows all its counted trigrams, weighted by
their counts, and tells each from ``noise`` classes drawn from the class frequencies (noise-contrastive estimation, numpy);
the parameters, a few tens of kilobytes whatever the corpus, are averaged by weight of data.

Words. Every word of the dictionary (``frequent_words``) has a context vector of its own: one damped Newton step from the
vector of its class over all its occurrences. Words of the class of all others are the leaves of a binary tree, split
by the mean contexts they follow; every node is a log-bilinear decision, fitted by one damped Newton step from the share of
its counts. Words outside the dictionary are one leaf and share the class's context vector; both passes sum a vector for
each word, in each task before the shuffle.

Scoring. Log probabilities are normalised over the classes and at every node. The sum over the classes is a product of what the
two context words give, whose exponentials are computed once for a frequent word. A word outside the dictionary gets the
probability of its leaf times its smoothed share of it, so the probabilities of all words, and of unseen ones as one, add
up to 1.

* Null texts count as empty: one token, the end. A null doc_id counts as a training document. Repeated rows are trained
  on and scored apart. Without training documents all counts are 0 and the model is uniform.
* Texts of any length are scored whole. Only id and text are read, so other columns may have any names. An empty table gives
  an empty result.
* What is known of frequent words goes to tasks as a bounded dictionary; other words are looked up by a join, summed per
  document before the shuffle.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.vocabulary import count_units, frequent
from shopgrain.session import materialize, release

END = b""  # no word is empty
OTHER_CLASS, END_CLASS = 0, 1
LEAST = 40_000  # examples in a round, so that a small corpus is learned from too
KEPT = 16_384  # words, the most frequent ones, whose exponentials a task keeps
BLOCK = 1_024  # places whose scores fit in the processor's cache
SURE = 1e-25  # sums of exponentials from here on lost nothing that counts


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes lower-case A to Z only, and split at x20 and x09 to x0D."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    return [*words_of(text), END]


def ids_of(text: str | bytes | None, index: dict[bytes, int] | None) -> list[int] | np.ndarray:
    """Places of the words in the dictionary; OTHER_CLASS for the others. They may come as bytes, looked up before."""
    if isinstance(text, bytes):
        return np.frombuffer(text, np.int32)
    return [index.get(w, OTHER_CLASS) for w in words_of(text)]


@dataclass(frozen=True)
class Parameters:
    R: np.ndarray  # vectors of context classes
    Q: np.ndarray  # vectors of predicted classes
    c: np.ndarray  # weights of the two context places
    b: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, R=self.R, Q=self.Q, c=self.c, b=self.b)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Parameters:
        with np.load(io.BytesIO(data)) as f:
            return Parameters(f["R"], f["Q"], f["c"], f["b"])

    def log_probabilities(self) -> np.ndarray:
        """log10 of the probability of each class after each pair of classes, by batched matrix products."""
        K = len(self.b)
        out = np.empty((K, K, K), dtype=np.float32)
        second = self.c[1] * self.R
        for first in range(K):
            scores = (self.c[0] * self.R[first] + second) @ self.Q.T + self.b
            scores -= scores.max(1, keepdims=True)
            scores -= np.log(np.exp(scores).sum(1, keepdims=True))
            out[first] = scores / math.log(10)
        return out.reshape(K * K, K)


def first_parameters(class_counts: np.ndarray, dims: int, seed: int) -> Parameters:
    """Small random vectors; the biases already give the class frequencies."""
    rng = np.random.default_rng(seed)
    K = len(class_counts)
    share = (class_counts + 1) / (class_counts + 1).sum()
    small = lambda: rng.normal(0, 0.1, (K, dims))
    return Parameters(small(), small(), np.ones((2, dims)) / 2, np.log(share))


def count_trigrams(texts: DataFrame, classes: dict[bytes, int]) -> DataFrame:
    """``code`` of two context classes and the next one, and how often it occurs; each task counts before the shuffle.

    Words may come as bytes of ``ids_of``, for a dictionary that begins with the classes.
    """
    K = len(classes) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        size = 0

        def merged() -> None:
            nonlocal codes, counts, pending, size
            fresh, n = np.unique(np.concatenate(pending), return_counts=True) if pending else (codes[:0], counts[:0])
            both = np.concatenate([codes, fresh])
            codes, where = np.unique(both, return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
            pending, size = [], 0

        for batch in batches:
            for text in batch.column(0):
                found = ids_of(text.as_py(), classes)
                x = np.full(len(found) + 3, END_CLASS, np.int64)
                x[2:-1] = found
                x[x >= K] = OTHER_CLASS
                pending.append((x[:-2] * K + x[1:-1]) * K + x[2:])
                size += len(found) + 1
                if size > 2_000_000:
                    merged()
            if len(codes) > 4_000_000:
                merged()
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])
                codes, counts = codes[:0], counts[:0]
        merged()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def learn(
    codes: np.ndarray, counts: np.ndarray, start: Parameters, noise_share: np.ndarray, rng: np.random.Generator,
    noise: int, rate: float, batch: int = 256,
) -> Parameters:
    """Noise-contrastive estimation over all trigrams by weight of count, shown again until they are ``LEAST``."""
    K = len(start.b)
    R, Q, c, b = (x.copy() for x in (start.R, start.Q, start.c, start.b))
    squares = [np.full_like(x, 1e-2) for x in (R, Q, c, b)]
    # A trigram of more than the mean count is shown in several examples that share its count.
    times = -(-counts // max(1, int(counts.mean()))) * -(-LEAST // len(codes))
    drawn = rng.permutation(np.repeat(np.arange(len(codes)), times))
    share = (counts / times)[drawn]
    share /= share.mean()
    log_noise = np.log(noise * noise_share)

    def move(k: int, value: np.ndarray, gradient: np.ndarray) -> None:
        squares[k] += gradient * gradient
        value -= rate * gradient / np.sqrt(squares[k])

    for at in range(0, len(drawn), batch):
        code = codes[drawn[at: at + batch]]
        w1, w2, w = code // (K * K), code // K % K, code % K
        shown = np.concatenate([w[:, None], rng.choice(K, (len(w), noise), p=noise_share)], axis=1)
        predicted = c[0] * R[w1] + c[1] * R[w2]
        vectors = Q[shown]
        odds = np.einsum("nkd,nd->nk", vectors, predicted) + b[shown] - log_noise[shown]
        slope = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        slope[:, 0] -= 1
        slope *= share[at: at + batch, None] / len(w)
        back = np.einsum("nk,nkd->nd", slope, vectors)
        dQ, dR = np.zeros_like(Q), np.zeros_like(R)
        np.add.at(dQ, shown, slope[:, :, None] * predicted[:, None, :])
        np.add.at(dR, w1, back * c[0])
        np.add.at(dR, w2, back * c[1])
        db = np.bincount(shown.ravel(), slope.ravel(), K)
        dc = np.stack([(back * R[w1]).sum(0), (back * R[w2]).sum(0)])
        for k, (value, gradient) in enumerate(((R, dR), (Q, dQ), (c, dc), (b, db))):
            move(k, value, gradient)
    return Parameters(R, Q, c, b)


def train(
    trigrams: DataFrame, class_counts: np.ndarray, dims: int = 16, noise: int = 10, rounds: int = 4, rate: float = 0.3,
    seed: int = 11, rows_per_part: int = 100_000,
) -> Parameters:
    """Rounds of local learning on all parts of the trigram table, averaged by weight."""
    K = len(class_counts)
    model = first_parameters(class_counts, dims, seed)
    noise_share = (class_counts + 1) / (class_counts + 1).sum()
    n = trigrams.count()
    if not n:
        return model
    parts = -(-n // rows_per_part)
    table = materialize(trigrams.repartition(parts, "code"), "trigrams")
    for step in range(rounds):
        packed = model.packed()

        def run(batches: Iterator[pd.DataFrame], packed=packed, step=step) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(batches), ignore_index=True)
            if len(rows):
                rows = rows.sort_values("code")
                rng = np.random.default_rng([seed, step, int(rows["code"].iloc[0])])
                got = learn(rows["code"].to_numpy(), rows["n"].to_numpy(), Parameters.unpacked(packed), noise_share,
                            rng, noise, rate / (1 + step))
                weight = float(rows["n"].sum())
                flat = np.concatenate([x.ravel() for x in (got.R, got.Q, got.c, got.b)]) * weight
                yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat, "weight": weight})

        # Weighted sums are added on the executors; the driver gets one value for each parameter.
        sums = table.mapInPandas(run, "i int, x double, weight double").groupBy("i").agg(
            F.sum("x").alias("x"), F.sum("weight").alias("weight")
        ).toPandas().sort_values("i")
        flat = (sums["x"] / sums["weight"]).to_numpy()
        sizes = [K * dims, K * dims, 2 * dims, K]
        R, Q, c, b = np.split(flat, np.cumsum(sizes)[:-1])
        model = Parameters(R.reshape(K, dims), Q.reshape(K, dims), c.reshape(2, dims), b)
    return model


def word_sums(texts: DataFrame, tokens: Callable, rows_of: Callable, size: int, dims: int, block: int = 4096) -> np.ndarray:
    """Sums of the vectors that ``rows_of`` gives for places of texts, for each of ``size`` words; tasks add before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, dims), np.float32)
        for x in token_runs((text.as_py() for batch in batches for text in batch.column(0)), tokens):
            for index, vectors in rows_of(x):
                if len(index):
                    order = np.argsort(index, kind="stable")
                    index = index[order]
                    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
                    sums[index[first]] += np.add.reduceat(vectors[order], first)
        seen = np.flatnonzero(sums.any(1))
        parts = [part for part in np.split(seen, np.flatnonzero(np.diff(seen // block)) + 1) if len(part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(part[0]) // block for part in parts], pa.int32()), pa.array([part.astype(np.int32).tobytes() for part in parts], pa.binary()),
             pa.array([sums[part].tobytes() for part in parts], pa.binary())], ["block", "words", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["block"].iloc[0])
        total = np.zeros((block, dims))
        for words, sums in zip(rows["words"], rows["sums"]):
            total[np.frombuffer(words, np.int32) - at * block] += np.frombuffer(sums, np.float32).reshape(-1, dims)
        return pd.DataFrame({"block": [at], "sums": [total.astype(np.float32).tobytes()]})

    out = np.zeros((-(-size // block) * block, dims))
    found = texts.mapInArrow(run, "block int, words binary, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
    for row in found.collect():  # size x dims numbers, which the dictionary bounds
        out[row["block"] * block: (row["block"] + 1) * block] = np.frombuffer(row["sums"], np.float32).reshape(block, dims)
    return out[:size]


def token_runs(texts: Iterator[str | None], tokens: Callable, size: int = 16_384) -> Iterator[np.ndarray]:
    """Columns first, second and next word of every place of the texts, some thousand at a time."""
    pending: list[np.ndarray] = []
    held = 0
    for text in texts:
        found = tokens(text)
        x = np.full(len(found) + 3, END_CLASS, np.int64)
        x[2:-1] = found
        pending.append(np.stack([x[:-2], x[1:-1], x[2:]]))
        held += pending[-1].shape[1]
        if held >= size:
            both = np.concatenate(pending, 1)
            pending, held = [], 0
            yield from (both[:, at: at + size] for at in range(0, both.shape[1], size))
    if held:
        both = np.concatenate(pending, 1)
        yield from (both[:, at: at + size] for at in range(0, both.shape[1], size))


@dataclass(frozen=True)
class WordModel:
    """Classes are words 0 to K - 1; then come the other words of the dictionary, leaves 0, 1, ... by ``leaf``."""

    R: np.ndarray
    Q: np.ndarray
    c: np.ndarray
    b: np.ndarray
    mean: np.ndarray  # of the contexts of other words
    leaf: np.ndarray  # of the class of others and of each word from K on
    nodes: np.ndarray  # vectors of the decisions, the root is 1
    bias: np.ndarray
    depth: int

    def contexts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.c[0] * self.R[first] + self.c[1] * self.R[second]

    @cached_property
    def kept(self) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """``exponentials`` of the most frequent words at both context places."""
        words = np.arange(min(KEPT, len(self.R)))
        return self.exponentials(0, words), self.exponentials(1, words)

    @cached_property
    def decisions(self) -> np.ndarray:
        return np.concatenate([self.nodes, self.bias[:, None]], 1)

    def exponentials(self, place: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of what a context word adds to the score of each class, relative to the most, and the most.

        A score is the sum of what both context words add, so its exponential is a product.
        """
        scores = (self.c[place] * self.R[words]) @ self.Q.T
        if place:
            scores += self.b
        top = scores.max(1)
        scores -= top[:, None]
        return np.exp(scores, out=scores), top

    def log_totals(self, contexts: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
        """log of the sum of the exponentials of all scores, for each place."""
        tables = []
        for place, words in enumerate(contexts):
            table, top = self.kept[place]
            rare = np.flatnonzero(words >= len(top))
            distinct, back = np.unique(words[rare], return_inverse=True)
            tables.append((table, top, np.minimum(words, len(top) - 1), rare, back, *self.exponentials(place, distinct)) if len(rare)
                          else (table, top, words, rare, back, None, None))
        out = np.empty(len(h), np.float32)
        for at in range(0, len(h), BLOCK):
            block, tops = [], 0
            for table, top, words, rare, back, more, more_top in tables:
                own = words[at: at + BLOCK]
                rows, highest = table.take(own, axis=0), top.take(own)
                low, high = np.searchsorted(rare, (at, at + BLOCK))
                if high > low:
                    rows[rare[low:high] - at] = more.take(back[low:high], axis=0)
                    highest[rare[low:high] - at] = more_top[back[low:high]]
                block.append(rows)
                tops = tops + highest
            total = np.einsum("nk,nk->n", *block)
            unsure = np.flatnonzero(total < SURE)  # no class is likely after both words: the scores themselves are summed
            out[at: at + BLOCK] = np.log(np.maximum(total, SURE)) + tops
            if len(unsure):
                scores = h[at + unsure] @ self.Q.T + self.b
                top = scores.max(1)
                out[at + unsure] = np.log(np.exp(scores - top[:, None]).sum(1)) + top
        return out

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10; OTHER_CLASS as the word is the leaf of words outside the dictionary."""
        K = len(self.b)
        h = self.contexts(first, second)
        kind = np.where(word < K, word, OTHER_CLASS)
        out = np.einsum("nd,nd->n", h, self.Q.take(kind, axis=0)) + self.b.take(kind) - self.log_totals((first, second), h)
        others = np.flatnonzero(kind == OTHER_CLASS)
        if self.depth and len(others):
            levels = np.arange(self.depth)
            for at in range(0, len(others), BLOCK):
                own = others[at: at + BLOCK]
                x = np.ones((len(own), h.shape[1] + 1, 1), np.float32)
                x[:, :-1, 0] = h[own] - self.mean
                place = self.leaf[np.maximum(word[own] - K + 1, 0)] + (1 << self.depth)
                path = place[:, None] >> levels
                z = np.matmul(self.decisions.take(path >> 1, axis=0), x)[:, :, 0]
                np.negative(z, out=z, where=(path & 1).astype(bool))
                # The logs of all levels are one log of a product of at most 2 to the number of levels.
                out[own] -= np.maximum(z, 0).sum(1) + np.log((1 + np.exp(-np.abs(z))).prod(1))
        return out / math.log(10)


def expected_outputs(model: Parameters) -> np.ndarray:
    """The mean output vector that the classes predict after each pair of classes."""
    K = len(model.b)
    out = np.empty((K, K, model.Q.shape[1]), np.float32)
    for first in range(K):
        scores = (model.c[0] * model.R[first] + model.c[1] * model.R) @ model.Q.T + model.b
        scores = np.exp(scores - scores.max(1, keepdims=True))
        out[first] = scores @ model.Q / scores.sum(1, keepdims=True)
    return out.reshape(K * K, -1)


def damped(gradient: np.ndarray, times: np.ndarray, curvature: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps with the curvature ``times * curvature + ridge``, one for each row."""
    values, turn = np.linalg.eigh(curvature)
    return (gradient @ turn / (times[:, None] * np.maximum(values, 0) + ridge)) @ turn.T


def train_words(
    training: DataFrame, model: Parameters, class_counts: np.ndarray, index: dict[bytes, int], mass: np.ndarray,
    ridge: float = 30.0, ridge_of_nodes: float = 30.0,
) -> WordModel:
    """Vectors of all words of the dictionary. ``mass`` has the smoothed counts of the leaf of all others and of each word.

    The only column of ``training`` has texts, or their words as bytes of ``ids_of``.
    """
    spark = training.sparkSession
    K, dims = model.Q.shape
    V = len(mass)
    share = (class_counts + 1) / (class_counts + 1).sum()
    centred = model.Q - share @ model.Q
    spread = centred.T @ (centred * share[:, None])
    # Context vectors.
    R = np.concatenate([model.R, np.repeat(model.R[OTHER_CLASS][None], V - 1, 0)]).astype(np.float32)
    Q, c, b = (x.astype(np.float32) for x in (model.Q, model.c, model.b))
    if V > 1:
        looked_up = training.dtypes[0][1] == "binary"
        sent = spark.sparkContext.broadcast((None if looked_up else index, expected_outputs(model), Q, c))

        def tokens(text: str | bytes | None) -> list[int] | np.ndarray:
            return ids_of(text, sent.value[0])

        def as_contexts(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            _, expected, Q, c = sent.value
            kind = np.where(x < K, x, OTHER_CLASS)
            off = Q[kind[2]] - expected[kind[0] * K + kind[1]]
            for place in (0, 1):
                at = np.flatnonzero(x[place] >= K)
                yield x[place, at] - K, off[at] * c[place]

        gradient = word_sums(training, tokens, as_contexts, V - 1, dims)
        curvature = sum(np.outer(model.c[k], model.c[k]) * spread for k in (0, 1))
        R[K:] += damped(gradient, mass[1:] - 1, curvature, ridge)
    # Output vectors, from sums of the contexts before each word.
    depth = max(0, V - 1).bit_length()
    blank = WordModel(R, Q, c, b, np.zeros(dims, np.float32), np.zeros(V, np.int64), np.zeros((1, dims), np.float32), np.zeros(1, np.float32), 0)
    if not depth:
        return blank
    packed = spark.sparkContext.broadcast(blank)

    # Products of contexts are needed only in total; their rows follow those of the words.
    def as_outputs(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.flatnonzero((x[2] >= K) | (x[2] == OTHER_CLASS))
        h = packed.value.contexts(x[0, at], x[1, at])
        yield np.maximum(x[2, at] - K + 1, 0), np.concatenate([np.ones((len(at), 1), np.float32), h], 1)
        if len(at):
            square = np.concatenate([np.zeros((dims, 1), np.float32), h.T @ h], 1)
            yield V + np.arange(dims), square

    sums = word_sums(training, tokens, as_outputs, V + dims, 1 + dims)
    n, sums, square = sums[:V, 0], sums[:V, 1:], sums[V:, 1:]
    mean = sums.sum(0) / max(n.sum(), 1)
    curvature = square / max(n.sum(), 1) - np.outer(mean, mean)
    sums = sums - n[:, None] * mean
    # The tree: halves of equal size along the main directions of the words' mean contexts.
    _, turn = np.linalg.eigh(curvature)
    along = (sums / (n[:, None] + 5)) @ turn[:, ::-1]
    size = 1 << depth
    order, node = np.arange(V), np.zeros(V, np.int64)
    leaf = np.empty(V, np.int64)
    position = np.arange(V) * size // V  # of the words in order; no half is empty but by rounding
    for level in range(depth):
        order = order[np.lexsort((along[order, level % min(4, dims)], node))]
        node = position >> (depth - 1 - level)
    leaf[order] = position
    count, total, found = np.zeros(2 * size), np.zeros((2 * size, dims)), np.zeros(2 * size)
    count[size + leaf], total[size + leaf], found[size + leaf] = mass, sums, n
    for array in (count, total, found):
        for level in range(depth - 1, -1, -1):
            at = np.arange(1 << level, 2 << level)
            array[at] = array[2 * at] + array[2 * at + 1]
    at = np.arange(1, size)
    left, right = count[2 * at], count[2 * at + 1]
    p = right / np.maximum(left + right, 1e-300)
    forked = (left > 0) & (right > 0)
    nodes, bias = np.zeros((size, dims), np.float32), np.zeros(size, np.float32)
    bias[1:] = np.where(forked, np.log(np.maximum(right, 1e-300)) - np.log(np.maximum(left, 1e-300)), np.where(right > 0, 60.0, -60.0))
    step = damped(total[2 * at + 1] - p[:, None] * total[at], found[at] * p * (1 - p), curvature, ridge_of_nodes)
    nodes[1:] = np.where(forked[:, None], step, 0)
    return WordModel(R, Q, c, b, mean.astype(np.float32), leaf, nodes, bias, depth)


def held_out(doc_id: str = "doc_id", folds: int = 7, left: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == left, F.lit(False))


def score(
    documents: DataFrame, is_held_out: Column | None = None, n_classes: int = 256, frequent_words: int = 200_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = documents.sparkSession
    is_held_out = held_out() if is_held_out is None else is_held_out
    training = documents.where(~is_held_out).select("text")
    counts = materialize(count_units(training, tokens_of), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    N, V = total["n"] or 0, total["v"]

    top = counts.where("unit <> ''").orderBy(F.desc("n"), "unit").limit(n_classes - 2).collect()
    classes = {END: END_CLASS, **{row["unit"].encode(): k + 2 for k, row in enumerate(top)}}
    end = counts.where("unit = ''").first()
    n_end = end["n"] if end else 0
    class_counts = np.array([0, n_end, *[row["n"] for row in top]], dtype=np.float64)
    n_other = N - int(class_counts.sum())
    class_counts[OTHER_CLASS] = n_other
    v_other = V - len(top) - (1 if end else 0)
    table = frequent(counts, frequent_words).where("unit <> ''").toPandas()  # at most frequent_words rows
    table = table.loc[np.array([u.encode() not in classes for u in table["unit"]], dtype=bool)].sort_values(["n", "unit"], ascending=[False, True])
    K = len(class_counts)
    index = {w: k for w, k in classes.items() if w} | {u.encode(): K + k for k, u in enumerate(table["unit"])}
    tail = n_other + v_other + 1 - int(table["n"].sum()) - len(table)  # smoothed counts of words outside the dictionary
    log_counts = np.log10(np.concatenate([[1.0, 1.0], [row["n"] + 1 for row in top], table["n"].to_numpy() + 1.0]))
    known = spark.sparkContext.broadcast((index, log_counts))
    log_end = math.log10(n_end + 1)
    id_type = dict(documents.dtypes)["doc_id"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, log_counts = known.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(2):
                found = words_of(text.as_py())
                x = np.array([index.get(w, OTHER_CLASS) for w in found], np.int32)
                rare = Counter(found[k] for k in np.flatnonzero(x == OTHER_CLASS))
                columns[0].append(len(found) + 1)
                columns[1].append(len(found) - sum(rare.values()) + (n_end > 0))
                columns[2].append(float(log_counts[x].sum()) + log_end)
                columns[3].append(x.tobytes())
                columns[4].append(sum(rare.values()))
                columns[5].append([{"unit": w.decode("utf-8", "replace"), "times": n} for w, n in rare.items()])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(),
                     pa.list_(pa.struct([("unit", pa.string()), ("times", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "held_out", "n_tokens", "n_known", "logs", "ids", "n_rare", "rare"],
            )

    looked = documents.select("doc_id", is_held_out.alias("held_out"), "text").mapInArrow(
        look_up, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, logs double, ids binary, "
        "n_rare long, rare array<struct<unit:string,times:long>>"
    )
    # Words are looked up once and go as numbers from here on. Row numbers are fixed by being written, so that repeated
    # ids stay apart.
    looked = materialize(looked.withColumn("row", F.monotonically_increasing_id()), "looked")
    coded = looked.where("not held_out").select("ids")
    model = train(materialize(count_trigrams(coded, classes), "codes"), class_counts)
    release(spark)
    words = spark.sparkContext.broadcast(
        train_words(coded, model, class_counts, index, np.concatenate([[tail], table["n"].to_numpy() + 1.0]))
    )
    release(spark)  # the shuffle files of the sums of all tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (text.as_py() for text in batch.column("ids"))
            parts = [words.value.log_probabilities(*x) for x in token_runs(texts, lambda x: ids_of(x, None))]
            logs = np.concatenate(parts) if parts else np.zeros(0)
            ends = np.cumsum([0, *batch.column("n_tokens").to_pylist()])
            scores = [float(logs[i: j].sum(dtype=np.float64)) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), pa.array(scores, pa.float64())], [*passed, "word_score"])

    shape = {"row": "long", "doc_id": id_type, "held_out": "boolean", "n_tokens": "long", "n_known": "long", "logs": "double", "n_rare": "long"}
    passed = list(shape)
    scored = looked.select(*passed, "ids").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in shape.items()) + ", word_score double")
    looked_up = (
        looked.select("row", F.inline("rare")).join(counts, "unit", "left")
        .groupBy("row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"),
        )
    )
    df = scored.join(looked_up, "row", "left").fillna(0, ["rare_known"]).fillna(0.0, ["rare_logs"])
    return df.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * math.log10(N + V + 1)).alias("base_score"),
        (F.col("word_score") + F.col("rare_logs") - F.col("n_rare") * math.log10(tail)).alias("score"),
    )

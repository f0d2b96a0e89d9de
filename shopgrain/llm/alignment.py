"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

Both tokenizers encode a text with a space in front. Tokens are byte ranges, and an offset where tokens of both end is a
cut. An interval is divided at a cut near its middle: the end of the middle token of the first tokenizer is looked up
among the ends of the second by bisection; if it is none, the next end there is looked up among the first, and so on in
turn, to the right, then from the middle to the left. Both halves are treated alike, and intervals without a cut inside
are the groups. All intervals of many texts are divided at the same time.

Tokens of one group are linked. The number of documents that hold a pair of ids linked is counted over the corpus. The
most frequent pairs, at most ``KNOWN`` of them, go to the tasks as arrays; all others are joined, so every pair counts
whatever the size of the corpus, and no pair that many documents share is joined by key.

* Texts that are null or empty, and texts whose tokens do not join to the bytes of the text, have no tokens.
* Very long texts are encoded and aligned whole; a group of many tokens gives its links as distinct ids with their numbers.
* Repeated rows and ids count as documents of their own. An empty table gives no rows.
* Only the id and the text column are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.session import materialize

# Fixed value: how the byte-level vocabulary splits a text before encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
KNOWN = 200_000  # pairs that every task gets as arrays: 17 bytes each
PART = 100_000  # characters that are aligned at the same time, or one text
LINKS = 1 << 18  # links that are made at the same time
FLUSH = 1 << 20  # pairs that a task counts before it sends them


@dataclass(frozen=True)
class Tokens:
    """How to encode texts, which already start with a space, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


@lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """A byte-level vocabulary file. Strings of special tokens are plain text."""
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    letters = byte_letters()
    entries = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if all(c in letters for c in entry)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pieces = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        pieces[i] = entry
    if all(model["vocab"]["".join(m)] == 256 + k for k, m in enumerate(merges)):
        import tiktoken

        ranks = {entry: i for entry, i in entries.items() if i < 256 + len(merges)}  # ids are the ranks of the merges
        encode = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return Tokens(lambda texts: [encode(t) for t in texts], pieces)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Tokens(lambda texts: [tokenizer.encode(t, add_special_tokens=False).ids for t in texts], pieces)


@lru_cache(maxsize=4)
def pieces_file(path: str) -> Tokens:
    """A SentencePiece model that puts a space in front of a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
    return Tokens(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), pieces)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of all groups in both arrays, given those of the texts; ends grow over all texts."""
    a_lo, b_lo = a_start.astype(np.int64), b_start.astype(np.int64)
    a_hi, b_hi = np.append(a_lo[1:], len(a_ends)), np.append(b_lo[1:], len(b_ends))
    found_a, found_b = [], []
    while len(a_lo):
        cut_a, cut_b = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
        splits = np.flatnonzero((a_hi - a_lo > 1) & (b_hi - b_lo > 1))
        middle = (a_lo[splits] + a_hi[splits] - 2) // 2
        for forward in (True, False):
            open_, at = splits, middle
            while len(open_):
                end = a_ends[at]
                other = np.searchsorted(b_ends, end) if forward else np.searchsorted(b_ends, end, "right") - 1
                other_end = b_ends[other]
                same = other_end == end
                cut_a[open_[same]], cut_b[open_[same]] = at[same], other[same]
                open_, other_end = open_[~same], other_end[~same]
                if forward:
                    at = np.searchsorted(a_ends, other_end)
                    inside = at < a_hi[open_] - 1
                else:
                    at = np.searchsorted(a_ends, other_end, "right") - 1
                    inside = (at >= a_lo[open_]) & (other[~same] >= b_lo[open_])
                open_, at = open_[inside], at[inside]
            missed = cut_a[splits] < 0
            splits, middle = splits[missed], middle[missed]
        whole = cut_a < 0
        found_a.append(a_lo[whole])
        found_b.append(b_lo[whole])
        cut = ~whole
        a_lo, a_hi, b_lo, b_hi, cut_a, cut_b = a_lo[cut], a_hi[cut], b_lo[cut], b_hi[cut], cut_a[cut] + 1, cut_b[cut] + 1
        a_lo, a_hi = np.concatenate([a_lo, cut_a]), np.concatenate([cut_a, a_hi])
        b_lo, b_hi = np.concatenate([b_lo, cut_b]), np.concatenate([cut_b, b_hi])
    first_a = np.sort(np.concatenate(found_a)) if found_a else np.zeros(0, np.int64)
    return first_a, np.sort(np.concatenate(found_b)) if found_b else np.zeros(0, np.int64)


@dataclass
class Aligned:
    """Texts of one part: ids of all their tokens, the first tokens of texts and of groups."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_text: np.ndarray  # first token of each text, and the number of tokens
    b_text: np.ndarray
    a_group: np.ndarray  # first token of each group
    b_group: np.ndarray
    text_group: np.ndarray  # first group of each text, and the number of groups


def align_part(texts: list[str | None], a: Tokens, b: Tokens, a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    spaced = [" " + t if t else "" for t in texts]
    a_all, b_all = ([ids if t else [] for t, ids in zip(spaced, x.encode(spaced))] for x in (a, b))
    for k, text in enumerate(spaced):
        data = text.encode()
        if b"".join(map(a.pieces.__getitem__, a_all[k])) != data or b"".join(map(b.pieces.__getitem__, b_all[k])) != data:
            a_all[k], b_all[k] = [], []
    a_text, b_text = (np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) for ids in (a_all, b_all))
    a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, n[-1]) for x, n in ((a_all, a_text), (b_all, b_text)))
    filled = a_text[1:] > a_text[:-1]
    a_group, b_group = shared_cuts(
        np.cumsum(a_size[a_ids]), np.cumsum(b_size[b_ids]), a_text[:-1][filled], b_text[:-1][filled]
    )
    return Aligned(a_ids, b_ids, a_text, b_text, a_group, b_group, np.searchsorted(a_group, a_text))


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def links_of(part: Aligned, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of links of each text; text, pair and times of each linked pair of ids, ``a * n_b + b`` being the pair."""
    a_size = np.diff(np.append(part.a_group, len(part.a_ids)))
    b_size = np.diff(np.append(part.b_group, len(part.b_ids)))
    texts = len(part.a_text) - 1
    text = np.repeat(np.arange(texts), np.diff(part.text_group))
    size = a_size * b_size
    n_links = np.bincount(text, size, texts).astype(np.int64)
    span = int(part.a_ids.max(initial=0) + 1) * n_b
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = np.flatnonzero(size <= 4096)
    blocks = np.cumsum(size[small]) // LINKS
    for block in np.unique(blocks):
        groups = small[blocks == block]
        within = _runs(size[groups])
        of = np.repeat(groups, size[groups])
        pair = part.a_ids[part.a_group[of] + within // b_size[of]] * n_b + part.b_ids[part.b_group[of] + within % b_size[of]]
        found = summed(text[of] * span + pair, np.ones(len(of), np.int64))
        keys, times = summed(np.concatenate([keys, found[0]]), np.concatenate([times, found[1]]))
    for group in np.flatnonzero(size > 4096):
        a, a_times = np.unique(part.a_ids[part.a_group[group]:][:a_size[group]], return_counts=True)
        b, b_times = np.unique(part.b_ids[part.b_group[group]:][:b_size[group]], return_counts=True)
        step = max(1, LINKS // len(b))
        for start in range(0, len(a), step):
            pair = (a[start:start + step, None] * n_b + b).ravel() + text[group] * span
            found = (pair, np.outer(a_times[start:start + step], b_times).ravel())
            keys, times = summed(np.concatenate([keys, found[0]]), np.concatenate([times, found[1]]))
    return n_links, keys // span, keys % span, times


@lru_cache(maxsize=4)
def names_of(n_a: int, n_b: int) -> list[str]:
    """How tokens are written: first of a group, next in it, and the same for the second tokenizer."""
    return [mark + str(i) for mark, n in ((";", n_a), (",", n_a), ("|", n_b), (",", n_b)) for i in range(n)]


def written(part: Aligned, n_a: int, n_b: int) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    codes = np.empty(len(part.a_ids) + len(part.b_ids), np.int64)
    a_size = np.diff(np.append(part.a_group, len(part.a_ids)))
    b_size = np.diff(np.append(part.b_group, len(part.b_ids)))
    a_codes, b_codes = part.a_ids + n_a, part.b_ids + 2 * n_a + n_b
    a_codes[part.a_group] -= n_a
    b_codes[part.b_group] -= n_b
    codes[np.arange(len(part.a_ids)) + np.repeat(part.b_group, a_size)] = a_codes
    codes[np.arange(len(part.b_ids)) + np.repeat(part.a_group + a_size, b_size)] = b_codes
    names = names_of(n_a, n_b)
    ends = part.a_text + part.b_text
    return ["".join(map(names.__getitem__, codes[s:e].tolist()))[1:] for s, e in zip(ends, ends[1:])]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Rows from a first one on, as many as hold ``PART`` characters."""
    texts, start = batch.column("text"), 0
    while start < batch.num_rows:
        part, size = [], 0
        while start + len(part) < batch.num_rows and size < PART:
            part.append(texts[start + len(part)].as_py())
            size += len(part[-1] or "")
        yield start, part
        start += len(part)


def _sliced(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values, kind))


def _each_part(docs: DataFrame, a_file: str, b_file: str, schema: str, columns: Callable) -> DataFrame:
    """Rows with an id and what ``columns`` makes of each aligned part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_file), pieces_file(b_file)
        a_size, b_size = (np.array([len(p) for p in t.pieces], np.int64) for t in (a, b))
        for batch in batches:
            for start, texts in _parts(batch):
                part = align_part(texts, a, b, a_size, b_size)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(start, len(texts)), **columns(part, len(a.pieces), len(b.pieces))})

    return docs.mapInArrow(run, schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The ids of both tokenizers for each document, and the first tokens (from 0) of its groups in both."""
    def columns(part: Aligned, n_a: int, n_b: int) -> dict:
        group = part.text_group
        return {
            "a_ids": _sliced(part.a_ids, part.a_text, pa.int32()), "b_ids": _sliced(part.b_ids, part.b_text, pa.int32()),
            "a_starts": _sliced(part.a_group - np.repeat(part.a_text[:-1], np.diff(group)), group, pa.int32()),
            "b_starts": _sliced(part.b_group - np.repeat(part.b_text[:-1], np.diff(group)), group, pa.int32()),
        }

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_starts array<int>, b_starts array<int>"
    return _each_part(id_and_text(docs), a_file, b_file, schema, columns)


SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def link_documents(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """One row per document: its numbers, its groups' digest, and its distinct linked pairs with their times (as bytes)."""
    def columns(part: Aligned, n_a: int, n_b: int) -> dict:
        n_links, text, pair, times = links_of(part, n_b)
        at = np.searchsorted(text, np.arange(len(n_links) + 1))
        pairs = pair.astype("<u4" if n_a * n_b <= 1 << 32 else "<u8")
        counts = times.astype("<u4")
        return {
            "n_a": pa.array(np.diff(part.a_text), pa.int64()), "n_b": pa.array(np.diff(part.b_text), pa.int64()),
            "n_groups": pa.array(np.diff(part.text_group), pa.int64()), "n_links": pa.array(n_links, pa.int64()),
            "groups_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written(part, n_a, n_b)]),
            "pairs": pa.array([pairs[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()),
            "times": pa.array([counts[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()),
        }

    return _each_part(id_and_text(docs), a_file, b_file, f"{SUMMARY}, pairs binary, times binary", columns)


def pair_counts(linked: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """``pair``, the number of documents ``n`` that hold it, and whether that is the highest of its first id."""
    kind = "<u4" if n_a * n_b <= 1 << 32 else "<u8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                found = np.frombuffer(b"".join(batch.column("pairs").slice(start, 1024).to_pylist()), kind).astype(np.int64)
                keys, n = summed(np.concatenate([keys, found]), np.concatenate([n, np.ones(len(found), np.int64)]))
                if len(keys) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"pair": keys, "n": n})
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_pydict({"pair": keys, "n": n})

    counted = linked.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))  # at most n_b pairs for an id
    return counted.withColumn("best", F.col("n") == highest)


def score_links(linked: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to materialized rows of ``link_documents``."""
    kind = "<u4" if n_a * n_b <= 1 << 32 else "<u8"
    counts = materialize(pair_counts(linked, n_a, n_b), "pairs")
    top = counts.orderBy(F.desc("n"), "pair").limit(KNOWN).toArrow().sort_by("pair")
    known = linked.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        n, best = np.append(n, 0), np.append(best, False)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                own = [np.frombuffer(x, kind) for x in rows.column("pairs").to_pylist()]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                pairs = np.concatenate(own).astype(np.int64)
                times = np.frombuffer(b"".join(rows.column("times").to_pylist()), "<u4").astype(np.int64)
                at = np.searchsorted(pair, pairs)
                at[(at == len(pair)) | (np.append(pair, -1)[at] != pairs)] = len(pair)
                sums = np.zeros((2, len(own)), np.int64)
                np.add.at(sums[0], row, times * best[at])
                np.add.at(sums[1], row, times * n[at])
                rest = at == len(pair)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=len(own)))])
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1]),
                    _sliced(pairs[rest], ends, pa.int64()), _sliced(times[rest], ends, pa.int64()),
                ], names=[*kept, "n_best", "count_sum", "pair", "times"])

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]
    sums = "row long, n_best long, count_sum long, pair array<long>, times array<long>"
    scored = materialize(linked.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"{SUMMARY}, {sums}"), "scored")
    others = scored.select("row", F.explode(F.arrays_zip("pair", "times")).alias("rest")).select("row", "rest.pair", "rest.times")
    others = others.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )

    def both(known: str, more: str) -> Column:
        return (F.col(known) + F.coalesce(more, F.lit(0))).alias(known)

    return scored.join(others, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more_sum"), "groups_sha256"
    )


def compare(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Numbers of tokens, groups and links of each document, how its links stand in the corpus, and its groups' digest."""
    linked = materialize(link_documents(docs, a_file, b_file), "linked")
    return score_links(linked, len(byte_level(a_file).pieces), len(pieces_file(b_file).pieces))

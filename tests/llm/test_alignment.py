"""Alignment against plain intersections of ends and the libraries' own ids."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shopgrain.llm import alignment as al
from shopgrain.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "\n\n x", "a\tb\r\n", "漢字かな", "é́ö", "🙂🙃 x", "<|endoftext|> </s> <s> <0x41>",
    "▁x", "a▁ b", "\x00\x01", "x" * 3000, "ab" * 2000 + " c", " " * 500, "1234567890" * 40, "don't we'll", " x y", "ﬁ ① Å",
    "قصير عربي", "🙂" * 600, "﻿bom",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    a, b = libraries
    letters = al.byte_letters()
    names = {i: x for x, i in a.get_vocab().items()}
    docs = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
        pieces = [(i, b.id_to_piece(i)) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append([])
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
        groups, at = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = [ends[k].index(cut, at[k]) + 1 for k in (0, 1)]
            groups.append((ids_a[at[0]:to[0]], ids_b[at[1]:to[1]]))
            at = to
        docs.append(groups)
    held = Counter()
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in docs]
    for found in links:
        held.update(found.keys())
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, found in zip(docs, links):
        string = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(found.values()),
            sum(m for p, m in found.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in found.items()),
            hashlib.sha256(string.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.mark.parametrize("known", [200_000, 50, 0])
def test_equals_plain_intersections(spark, smallest_dir, libraries, known, monkeypatch):
    monkeypatch.setattr(al, "KNOWN", known)
    texts = [r.text for r in spark.read.parquet(f"{smallest_dir}/documents.parquet").select("text").limit(60 if known else 30).collect()] + ODD * 2
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(3)
    got = sorted(tuple(r) for r in al.compare(docs, A, B).collect())
    assert got == [(k, *row) for k, row in enumerate(brute(texts, libraries))]


def test_cuts_by_halves_equal_intersections():
    draw = random.Random(3)
    for _ in range(300):
        n, ends, starts, want = 0, [[], []], [[], []], [[], []]
        for _ in range(draw.randrange(1, 5)):  # texts
            size = draw.choice([1, 2, 7, 60, 400])
            inner = [sorted({size, *(draw.randrange(1, size + 1) for _ in range(draw.choice([0, 1, size // 3, size])))}) for _ in (0, 1)]
            shared = [0, *sorted(set(inner[0]) & set(inner[1]))][:-1]
            for k in (0, 1):
                starts[k].append(len(ends[k]))
                want[k] += [len(ends[k]) + (inner[k].index(c) + 1 if c else 0) for c in shared]
                ends[k] += [n + x for x in inner[k]]
            n += size
        got = al.shared_cuts(*map(np.array, ends), *map(np.array, starts))
        assert [x.tolist() for x in got] == want


def test_large_groups_and_small_blocks(monkeypatch):
    draw = np.random.default_rng(1)
    part = al.Aligned(
        draw.integers(0, 9, 300), draw.integers(0, 7, 260), np.array([0, 150, 300]), np.array([0, 130, 260]),
        np.array([0, 140, 150, 151]), np.array([0, 125, 130, 200]), np.array([0, 2, 4]),
    )
    monkeypatch.setattr(al, "LINKS", 64)
    n_links, text, pair, times = al.links_of(part, 7)
    want = Counter()
    for t, a, b in ((0, (0, 140), (0, 125)), (0, (140, 150), (125, 130)), (1, (150, 151), (130, 200)), (1, (151, 300), (200, 260))):
        want.update((t, x * 7 + y) for x in part.a_ids[slice(*a)].tolist() for y in part.b_ids[slice(*b)].tolist())
    assert dict(zip(zip(text.tolist(), pair.tolist()), times.tolist())) == want
    assert n_links.tolist() == [140 * 125 + 50, 70 + 149 * 60]


def test_groups_are_real_ids(spark, libraries):
    text = "Divide  and conquer: naïve 漢字 tokens."
    row, none, *_ = al.align(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), A, B).collect()
    assert row.a_ids == libraries[0].encode(" " + text, add_special_tokens=False).ids and row.b_ids == libraries[1].encode(text)
    assert len(row.a_starts) == len(row.b_starts) and row.a_starts[0] == row.b_starts[0] == 0
    assert none.a_ids == none.a_starts == []


def test_empty_table(spark):
    assert al.compare(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_ids_of_all_given_documents(spark, smallest_dir, libraries):
    texts = [r.text for r in spark.read.parquet(f"{smallest_dir}/documents.parquet").select("text").collect()]
    a, b = al.byte_level(A), al.pieces_file(B)
    for text in [t for t in texts + ODD if t]:
        assert a.encode([" " + text])[0] == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert b.encode([" " + text])[0] == libraries[1].encode(text)

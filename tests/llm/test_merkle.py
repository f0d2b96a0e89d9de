"""The manifest against hashes taken one by one with the standard library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shopgrain.llm import merkle, sha_states as sha

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[k:k + arity])) for k in range(0, len(last), arity)])
    return levels


def siblings(levels, at, arity):
    runs = []
    for level in levels[:-1]:
        start = at // arity * arity
        runs.append((level[start:at], level[at + 1:start + arity]))
        at //= arity
    return runs


def brute(rows, arity):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([d for _, d, _ in sorted(by_lang[x], key=lambda y: y[:2])], arity) for x in langs}
    top = tree([trees[x][-1][0] for x in langs], arity)
    out = []
    for place, lang in enumerate(langs):
        for at, (_, own, r) in enumerate(sorted(by_lang[lang], key=lambda y: y[:2])):
            runs = siblings(trees[lang], at, arity) + siblings(top, place, arity)
            proof = H("".join("".join(a + b) for a, b in runs))
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            digest = leaf(r[0], r[3], r[2], r[4] + 1, r[1]) if tampered else own
            for a, b in runs:
                digest = H("".join([*a, digest, *b]))
            out.append((r[0], own, trees[lang][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def test_states_resume_like_whole_hashes():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    state = sha.fresh(1)
    for d in digests:
        state = sha.add_child(state, sha.from_bytes(d))
    got = sha.to_bytes(sha.finish(state, np.array([5])))[0].tobytes().hex()
    assert got == H("".join(d.hex() for d in digests))


@pytest.mark.parametrize("arity, block_nodes", [(2, 4), (2, 4096), (3, 9), (5, 5)])
def test_equals_hashes_taken_one_by_one(spark, arity, block_nodes):
    draw = random.Random(arity * 1000 + block_nodes)
    langs = [None, "", "de", "en", "é", "zz"]
    sizes = dict(zip(langs, (1, 2, 3, 150, 17, 25)))
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "é漢 words", "x" * 50])
            rows.append((draw.choice([None, *range(-5, 400)]), text, lang, draw.choice([None, "a", "b:c"]), draw.choice([None, 0, 9])))
    rows += [(7, "t" * 300_000, "en", "a", 9)] + [(8, "same", "en", "a", 9)] * 40
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"{COLUMNS}, digest string").repartition(5)
    got = sorted((tuple(r) for r in merkle.verify(docs, arity, block_nodes).collect()), key=repr)
    assert got == brute(rows, arity)


def test_folding_needs_nothing_to_the_left(spark):
    docs = spark.createDataFrame([(k, str(k), "en", "s", 1) for k in range(20)], COLUMNS)
    manifest = merkle.build(merkle.check_rows(docs), ["doc_id"], 3, 9)
    rows = [r.asDict(recursive=True) for r in merkle.paths(manifest).collect()]
    assert max(len(r["path"]) for r in rows) == 3
    for r in rows:
        for step in r["path"]:
            step["left"] = bytes(len(step["left"]))  # blanked: only their number is read
    schema = f"doc_id long, digest binary, root binary, path array<{merkle.STEP}>"
    blanked = spark.createDataFrame([(r["doc_id"], r["digest"], r["root"], r["path"]) for r in rows], schema)
    assert all(r.folded == r.root for r in merkle.fold(blanked, "digest").collect())


def test_single_rows_and_empty_tables(spark):
    one = [(14, "a", None, None, None)]
    (row,) = merkle.verify(spark.createDataFrame(one, COLUMNS)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == H("")
    assert merkle.verify(spark.createDataFrame([], COLUMNS)).collect() == []

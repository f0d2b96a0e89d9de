import random

import pytest

from shopgrain.llm import edit_counts as e
from shopgrain.llm.queries import PATTERN, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.tiktoken")
PARTS = ["the ", " ", "  ", "'", "re", "ll", "\n", "x", "12", "!!", "é", "漢", " " * 30, "word" * 20, "…"]


@pytest.fixture(scope="module")
def tools():
    return e.tokenizer(FILE, PATTERN)


def test_trees_after_edits_equal_trees_built_anew(tools):
    split, counts = tools
    draw = random.Random(1)
    encoded = whole = 0
    for _ in range(400):
        text = "".join(draw.choice(PARTS) for _ in range(draw.choice([0, 1, 5, 50, 600])))
        tree = e.build_tree(text, split, counts)
        for _ in range(6):
            start = draw.randrange(len(text) + 2)
            stop = start + draw.choice([0, 0, 1, 3, 20, 500])
            new = "".join(draw.choice(PARTS) for _ in range(draw.choice([0, 1, 3, 40])))
            text, n = e.apply_edit(text, tree, start, stop, new, split, counts)
            fresh = split(text)
            assert [x for b in tree.lengths for x in b] == list(map(len, fresh))
            assert tree.n_tokens == sum(counts[x] for x in fresh) and tree.n_chars == len(text)
            encoded, whole = encoded + n, whole + len(fresh)
    assert encoded < whole / 5  # only the regions of the edits are encoded


def test_counts_equal_those_of_the_tokenizer(spark, smallest_dir, tools):
    import base64

    import tiktoken

    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = e.revisions(spark.read.parquet(f"{smallest_dir}/documents.parquet"))
    counted = {r.doc_id: r for r in e.recount(docs, FILE, PATTERN).collect()}
    for r in docs.collect():
        text = r.text
        assert counted[r.doc_id].n_tokens == len(whole.encode_ordinary(text))
        for x in r.edits:
            text = text[: x.start] + x.replacement + text[x.stop:]
        assert counted[r.doc_id].n_tokens_after == len(whole.encode_ordinary(text))
        assert counted[r.doc_id].n_chars_after == len(text)


def test_edge_cases(spark):
    rows = [(1, None, [(0, 0, "new words")]), (2, "", None), (3, "some text", [None, (None, 1, "x"), (2, None, None), (50, 60, "!")]),
            (3, "some text", []), (None, "a", [(0, 1, None)])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"doc_id long, text string, edits {e.EDITS}, n_tokens int")
    got = sorted(((r.doc_id, r.n_edits, r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in e.recount(docs, FILE, PATTERN).collect()), key=str)
    assert got == sorted([(1, 1, 0, 2, 9), (2, 0, 0, 0, 0), (3, 2, 2, 3, 10), (3, 0, 2, 2, 9), (None, 1, 1, 0, 0)], key=str)
    assert e.recount(docs.limit(0), FILE, PATTERN).count() == 0


def test_edits_of_a_table_apply_in_order(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 1, "Z"), (1, 1, 0, 0, "ab ")], "doc_id long, seq int, start long, stop long, replacement string")
    got = {r.doc_id: (r.n_edits, r.n_chars_after) for r in e.recount(e.attach_edits(docs, edits), FILE, PATTERN).collect()}
    assert got == {1: (2, 6), 2: (0, 1)}


def test_stored_trees_follow_batches_of_edits(spark, smallest_dir, tools):
    from pathlib import Path

    from shopgrain.session import stage_path

    split, counts = tools
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "long word " * 60_000), (9004, "twice"), (9004, "twice"), (None, "x")], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    path = stage_path(spark, "trees").removeprefix("file:")
    e.write_trees(docs.withColumn("part", docs["text"]), path, FILE, PATTERN, parts=16)
    draw = random.Random(7)
    for ids in ([9001, 9002, 9003, 9004], [i for i, _ in texts if i and i < 9000][::9], [9003], [123456789]):
        before = {f: f.stat().st_mtime_ns for f in Path(path).glob("part=*/*.parquet")}
        edits = [(i, k, draw.randrange(500), draw.randrange(500, 520), draw.choice(["", "new", " it's 2 "])) for i in ids for k in range(3)]
        table = spark.createDataFrame([*edits, (None, 1, 0, 0, "no")], "doc_id long, seq int, start long, stop long, replacement string")
        got = sorted(tuple(r) for r in e.revise_trees(spark, path, table, FILE, PATTERN, parts=16).collect())
        want = []
        for at, (i, text) in enumerate(texts):
            own = sorted((x for x in edits if x[0] == i), key=lambda x: x[1])
            if own:
                old, text = text or "", text or ""
                for _, _, start, stop, new in own:
                    start = min(start, len(text))
                    text = text[:start] + new + text[max(start, min(stop, len(text))):]
                texts[at] = (i, text)
                want.append((i, 3, sum(counts[p] for p in split(old)), sum(counts[p] for p in split(text)), len(text)))
        assert [(g[0], g[1], *g[3:]) for g in got] == sorted(want)
        assert all(g[2] < 400 for g in got)  # pre-tokens encoded, however long the text
        after = {f: f.stat().st_mtime_ns for f in Path(path).glob("part=*/*.parquet")}
        changed = {f.parent.name for f in before if after.get(f) != before[f]}
        assert len(changed) <= len(set(ids)) < 16 or len(ids) > 8
    stored = sorted(((r.doc_id, r.text) for r in spark.read.parquet(path).collect()), key=repr)
    assert stored == sorted(texts, key=repr)

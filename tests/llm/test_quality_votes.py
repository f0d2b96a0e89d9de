import re

import pytest

from shopgrain.llm import quality_votes as q

SCHEMA = "doc_id long, text string, words string, v_symbols int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


TEXTS = [
    None, "", " \t\n ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "x y " * 9 + "  z\x0b!",
    "l1\nl1\nl2\n\n\nl1", "é% <b> ## " * 5, "the of and a quick brown fox jumps over it in the night " * 3 + "end.",
    " ".join(f"w{i}" for i in range(30)),
]


def test_counts_of_whole_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.row.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(docs).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(TEXTS)}


def test_repeated_rows_clashing_columns_and_null_ids(spark):
    good = "the house of the man and a tree in the garden was on the way to it for " * 1 + " ".join(f"word{i}x" for i in range(40))
    docs = spark.createDataFrame([(1, good, "x", 1), (1, good, "x", 1), (None, good, None, None), (2, None, "x", 1)], SCHEMA)
    verdicts = sorted(((r.doc_id, r.kept) for r in q.judge(docs).collect()), key=str)
    assert verdicts == sorted([(1, True), (1, True), (None, True), (2, False)], key=str)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert q.judge(docs).count() == 0 and q.keep_good(docs).count() == 0


def test_estimation_recovers_rule_accuracies(spark):
    """Votes drawn from known rates: plain expectation-maximisation gives the same model."""
    import random

    draw = random.Random(5)
    rules = q.RULES[:4]
    rows = []
    for i in range(3000):
        good = draw.random() < 0.75
        rows.append(tuple(
            0 if draw.random() < 0.3 else (1 if (draw.random() < 0.85) == good else -1) for _ in rules
        ))
    model = q.fit(spark.createDataFrame(rows, ", ".join(f"v_{r.name} int" for r in rules)), rules, rounds=20)
    assert model.good_share == pytest.approx(0.75, abs=0.05)
    for table in model.votes.values():
        assert table[1][0] == pytest.approx(0.7 * 0.85, abs=0.06)
        assert table[1][1] == pytest.approx(0.7 * 0.15, abs=0.06)


def test_labels_of_the_documents(spark, smallest_dir):
    """Held against labels that the operator never sees."""
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet")
    labels = spark.read.parquet(f"{smallest_dir}/labels.parquet")
    rows = q.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) >= 0.97 * len(clean)


def test_plan_has_no_python_and_no_shuffle_of_texts(spark, smallest_dir):
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet")
    plan = q.vote(q.measure(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

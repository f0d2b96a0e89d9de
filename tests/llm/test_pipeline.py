"""Each stage of the pipeline on its own input, against plain versions."""

import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shopgrain.llm import mixing, quality_votes
from shopgrain.llm.queries import tokenizer_file
from shopgrain.session import materialize


@pytest.fixture(scope="module")
def stages(spark, smallest_dir):
    """Input and output of each stage, by the stage's place."""
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet")
    out = []
    for name, stage in pipeline.STAGES:
        result = materialize(stage(spark, docs, smallest_dir), "stage")
        out.append((docs, result))
        docs = result
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_what_the_operator_keeps_and_clean_documents(spark, smallest_dir, stages):
    before, after = stages[0]
    assert ids(after) == ids(quality_votes.judge(before).where("kept"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{smallest_dir}/labels.parquet").collect()}
    kept = set(ids(after))
    clean = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 20]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    sets = {}
    for r in before.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = frozenset(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for a, i in enumerate(names):
        for k in names[:a]:
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]):
                x, y = find(i), find(k)
                root[max(x, y)] = min(x, y)
    assert ids(after) == sorted({find(i) for i in sets})


def test_mixing_samples_by_its_probabilities(stages):
    before, after = stages[2]
    assert ids(after) == ids(mixing.weigh(before, powers=pipeline.POWERS).where("sampled").select("row.doc_id"))


def test_encoded_documents_decode(stages):
    import sentencepiece

    from shopgrain.llm.lattice import joined

    before, after = stages[3]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r for r in joined(after).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i].text == text and list(got[i].ids) == model.encode(text)


def test_odd_rows_and_columns(spark, smallest_dir):
    given = spark.read.parquet(f"{smallest_dir}/documents.parquet")
    kept = quality_votes.judge(given).where("kept and n_words > 200").select("doc_id")
    text, other, *_ = [r.text for r in given.join(kept, "doc_id").where("lang = 'en'").orderBy("doc_id").limit(2).collect()]
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (None, text + " again", "en", "a", 5),
        (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, other, "en", "a", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({
        name: F.lit("own") for name in ("row", "class", "sig", "node", "kept", "topic", "seg", "weight", "n_words", "label")
    })
    columns = docs.columns
    for at, (name, stage) in enumerate(pipeline.STAGES[:3]):
        docs = materialize(stage(spark, docs, smallest_dir), "odd")
        assert docs.columns == columns and docs.where("class <> 'own' or kept <> 'own' or topic <> 'own'").count() == 0, name
        found = [r.doc_id for r in docs.collect()]
        assert not {3, 4} & set(found)
        if at == 1:
            assert found.count(1) == 1 and 2 not in found and None in found
    assert pipeline.encode(spark, docs, smallest_dir).count() >= docs.count()


def test_empty_table(spark, smallest_dir):
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, smallest_dir), "none")
        assert docs.count() == 0, name

"""Very long texts, clashing columns and empty tables, for operators whose own tests do not have them."""

import pytest
from pyspark.sql import functions as F

from shopgrain.llm import edit_counts, jaccard_join, lattice, mixing, pivot_index, quality_votes, url_trees, warc
from shopgrain.llm.queries import PATTERN, tokenizer_file

LONG = " ".join(f"w{k % 5000}" for k in range(150_000))
CLASHING = ("row", "words", "kept", "sig", "class", "ids", "seg", "unit", "weight", "host", "verdict", "block", "record_id", "edits", "x", "cell")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, LONG, "en", "a", 5), (2, "a short one", None, None, 1)], "doc_id long, text string, lang string, source string, n_tokens int")
    return rows.withColumns({name: F.lit("own") for name in CLASHING})


def test_archives(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>")], "page_id long, url string, html string").withColumns({n: F.lit("own") for n in ("row", "text", "head", "carried")})
    (text,) = warc.derive(warc.responses_of_pages(pages)).where("warc_type = 'conversion'").collect()
    assert text.block == LONG and text.content_length == len(LONG)
    assert warc.derive(warc.responses_of_pages(pages.limit(0))).count() == 0


def test_search_reads_id_and_vector_only(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit("own") for n in ("x", "cell", "pivot", "score", "rank")})
    found = pivot_index.top_k(pivot_index.whole_vectors(vectors, "vec_id", "embedding"), F.col("vec_id") % 4 == 0, k=2)
    assert {(r.query_id, r.rank, r.vec_id) for r in found.collect()} == {(4, 1, 8), (4, 2, 7), (8, 1, 7), (8, 2, 6)}


def test_edits_of_a_long_text(docs):
    import base64

    import tiktoken

    file = tokenizer_file("byte_bpe_50k.tiktoken")
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    row = edit_counts.recount(edit_counts.revisions(docs), file, PATTERN).where("doc_id = 1").first()
    assert row.n_tokens == len(whole.encode_ordinary(LONG)) and row.n_encoded < 2000
    assert edit_counts.recount(edit_counts.revisions(docs.limit(0)), file, PATTERN).count() == 0


def test_quality_of_a_long_text(docs):
    row = quality_votes.judge(docs).where("doc_id = 1").first()
    assert row.n_words == 150_000 and row.n_repeat_words == 150_000 and row.base_failed and not row.kept
    assert quality_votes.keep_good(docs).columns == docs.columns


def test_mixing_of_a_long_text(docs):
    rows = {r.row.doc_id: r for r in mixing.weigh(docs).collect()}
    assert rows[1].n_tokens == 150_000 and rows[1].row.weight == "own" and mixing.sample(docs).columns == docs.columns


def test_shingles_of_a_long_text(docs):
    rows = {r.doc_id: r.n_shingles for r in jaccard_join.join(docs).collect()}
    assert rows == {1: 5000, 2: 1}
    assert jaccard_join.join(docs.limit(0)).count() == 0 and jaccard_join.keep_one(docs).columns == docs.columns


def test_long_addresses(spark):
    urls = spark.createDataFrame([(1, "http://a.org/" + "x" * 100_000, "own"), (2, None, "own")], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_trees.filter_urls(urls).collect()}
    assert (rows[1].host, len(rows[1].path), rows[1].verdict, rows[2].host) == ("a.org", 100_001, "allow", "")
    assert url_trees.filter_urls(urls.limit(0)).count() == 0


def test_pieces_of_a_long_text(docs):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in lattice.joined(lattice.decode(lattice.encode(docs, model), model)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    assert list(rows[1].ids) == library.encode(LONG) and rows[1].text == LONG
    with pytest.raises(TypeError):
        lattice.encode(docs.withColumn("doc_id", F.lit(1.5)), model).count()

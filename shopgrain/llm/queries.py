"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm import alignment, edit_counts, jaccard_join, lattice, log_bilinear, merkle, mincut_html, mixing, pivot_index, quality_votes, secrets, url_trees, warc
from shopgrain.session import configure, name_local_folder

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the byte-level vocabulary splits a text before encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(name_local_folder(configure(spark)), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file stands; on a cluster, the path on every machine."""
    return str(Path(TOKENIZERS) / name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


@query
def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_index.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pivot_index.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@query
def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = edit_counts.revisions(table(spark, sf_dir, "documents"))
    return edit_counts.recount(revised, tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)


@query
def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_votes.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[F.col(f"v_{rule.name}").alias(f"vote_{rule.name}") for rule in quality_votes.RULES],
    )


@query
def op5_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = mixing.weigh(table(spark, sf_dir, "documents"))
    return weighed.select(
        "row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled"
    )


@query
def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trees.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "url", "blocked")


@query
def op8_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mincut_html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return lattice.decode(lattice.encode(table(spark, sf_dir, "documents"), model), model)


@query
def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(table(spark, sf_dir, "documents"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=3, similarity=jaccard_join.Similarity(9, 10))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summarize(secrets.spans(table(spark, sf_dir, "documents")))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.compare(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each cell of source, language and topic are counted once. Raking then finds one factor for each source,
each language and each topic so that the weighted tokens meet the target share of every one of them. The factors are
columns of the cells; in each step the cells are summed by one margin and joined to that margin's new factors. A document's
weight per token is the product of its three factors; scaled so that the largest is 1, it is the probability with which the
document is sampled, so expected tokens meet the targets. A hash of the id decides, so that a rerun draws the same sample.

* Null source, language or topic counts as the empty one. A null text has no tokens; documents of cells without tokens
  get their factors too (1 where the category has no tokens at all). An empty table gives an empty result.
* Target shares are made to add up to 1 over the categories that have tokens. Categories without a target get weight 0.
* Repeated rows of one id are drawn together. Texts of any length are counted whole. The document stands in one column,
  ``row``, so its columns may have any names.
* Cells and factors are aggregates of all documents; Spark measures their size before it broadcasts any of them, and
  joins that shuffle instead are split by skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.common import computed, words_of
from shopgrain.llm.quality_votes import without
from shopgrain.session import discard, materialize

MARGINS = ("source", "lang", "topic")
SWEEPS = 10
SEED = 17


def topic_of(n_tokens: str, text: str) -> Column:
    """A stand-in for a classifier's label, from the form of the text: short, list, figures or prose."""
    digits = F.length(text) - F.length(without(F.col(text), "0123456789"))
    bars = F.length(text) - F.length(F.replace(F.col(text), F.lit("|"), F.lit("")))
    return (
        F.when(F.col(n_tokens) < 80, "short").when(bars * 20 >= F.col(n_tokens), "list")
        .when(digits * 50 >= F.length(text), "figures").otherwise("prose")
    )


def described(documents: DataFrame) -> DataFrame:
    """The document in ``row``, its categories with nulls as empty text, and its tokens (words)."""
    df = documents.select(
        F.struct(*documents.columns).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    df = computed(df, n_tokens=F.size(words_of(F.col("text"))).cast("long"))
    return df.withColumn("topic", topic_of("n_tokens", "text")).drop("text")


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares: the shares of the tokens to a power below 1, which lifts small categories."""
    return cells.groupBy(margin).agg(F.pow(F.sum("n_tokens").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """The cells with a factor for each margin (``f_source`` and so on); 1 where a category has no tokens.

    Each sweep over all margins is one plan, written once; a factor is the target share of its category over the
    category's sum of tokens times the other factors.
    """
    filled = F.col("n_tokens") > 0
    for margin, target in targets.items():
        present = cells.where(filled).select(margin).distinct().join(target, margin, "left").fillna(0.0, ["share"])
        total = present.agg(F.sum("share")).first()[0] or 1.0
        shares = present.select(margin, (F.col("share") / total).alias(f"share_{margin}"))
        cells = cells.join(shares, margin, "left").withColumn(f"f_{margin}", F.lit(1.0))
    cells = materialize(cells, "cells")
    for _ in range(sweeps):
        before = cells
        for margin in targets:
            weight = F.col("n_tokens").cast("double")
            for other in targets:
                if other != margin:
                    weight = weight * F.col(f"f_{other}")
            sums = cells.where(filled).groupBy(margin).agg(F.sum(weight).alias("weight"))
            factor = F.when(F.col("weight") > 0, F.col(f"share_{margin}") / F.col("weight")).when(F.col("weight").isNotNull(), 0.0)
            cells = cells.join(sums, margin, "left").withColumn(f"f_{margin}", F.coalesce(factor, F.lit(1.0))).drop("weight")
        cells = materialize(cells, "cells")
        discard(before)
    return cells


def weigh(documents: DataFrame, targets: dict[str, DataFrame] | None = None, powers: tuple[float, ...] = (0.8, 0.8, 0.8)) -> DataFrame:
    """Every document in ``row`` with its categories, tokens, weight per token, probability and whether it is sampled."""
    df = described(documents)
    cells = materialize(df.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    filled = cells.where("n_tokens > 0")
    targets = targets or {m: tempered(filled, m, p) for m, p in zip(MARGINS, powers)}
    weight = F.lit(1.0)
    for margin in targets:
        weight = weight * F.col(f"f_{margin}")
    raked = rake(cells, targets)
    table = materialize(raked.select(*MARGINS, weight.alias("weight"), (F.col("n_tokens") > 0).alias("filled")), "weights")
    most = table.where("filled").agg(F.max("weight")).first()[0] or 1.0
    df = df.join(table, list(MARGINS))
    probability = F.least(F.col("weight") / most, F.lit(1.0))
    name = F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))
    place = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return (
        df.select("row", *MARGINS, "n_tokens", "weight", probability.alias("probability"))
        .withColumn("sampled", place < F.col("probability"))
    )


def sample(
    documents: DataFrame, targets: dict[str, DataFrame] | None = None, powers: tuple[float, ...] = (0.8, 0.8, 0.8),
) -> DataFrame:
    """The sampled documents with all their columns."""
    return weigh(documents, targets, powers).where("sampled").select("row.*")

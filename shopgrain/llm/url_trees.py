"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The trees (Spark ML) learn from labelled URLs: those that a rule decides, and those whose host holds one of the seed
words, which are labelled as blocked. Features are length, depth, digit ratio, entropy, parameter counts and statistics
of the host's last one and two labels among the labelled URLs. All features are SQL expressions; scoring is narrow.

* A null URL, or one without ``://``, has empty host and path, fits no rule and gets the trees' verdict on an empty
  text. Repeated rows are judged alike.
* Labelled URLs are fitted on a sample by a hash of the URL of about ``max_rows`` rows; suffix statistics are counted
  over that sample too, so what is broadcast has at most ``max_rows`` rows. Everything else covers all rows.
* Without labels of both kinds nothing is learned and URLs without rule are allowed. An empty table gives an empty
  result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.common import ascii_lower, computed
from shopgrain.session import materialize

# The rules of the registered query.
RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}
# Parts of host names that mark a site as unwanted.
SEED_WORDS = ("adult", "ads-", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "warez")

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "host_digits",
    "host_hyphens", "entropy", "n_parameters", "query_length", "has_fragment", "secure",
)
SUFFIX = ("last_label_rate", "last_label_rows", "last_two_rate", "last_two_rows")


def host_and_path(url: Column) -> dict[str, Column]:
    return {
        "host": ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))),
        "path": F.coalesce(F.regexp_extract(url, URL, 2), F.lit("")),
    }


def rule_of(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path; the list of rules is a parameter and short."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        found = F.when(fits & F.startswith(F.col("path"), F.lit(f"/{path}")), rule).otherwise(found)
    return found


def verdict_of(rules: dict[str, str]) -> Column:
    verdict = F.lit(None).cast("string")
    for rule, decided in rules.items():
        verdict = F.when(F.col("rule") == rule, decided).otherwise(verdict)
    return verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    def share(character: Column) -> Column:
        n = F.length(text) - F.length(F.replace(text, character, F.lit("")))
        return n / F.length(text)

    characters = F.array_distinct(F.split(text, ""))
    return F.coalesce(F.aggregate(
        F.filter(characters, lambda c: c != ""), F.lit(0.0), lambda bits, c: bits - share(c) * F.log2(share(c))
    ), F.lit(0.0))


def with_features(urls: DataFrame) -> DataFrame:
    """Lexical features of ``u``, ``host`` and ``path``."""
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    digits = F.length(F.regexp_replace(u, "[^0-9]+", ""))
    asked = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    features = {
        "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "host_depth": F.size(labels), "path_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)),
        "host_digits": F.length(F.regexp_replace(host, "[^0-9]+", "")),
        "host_hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "entropy": entropy(u),
        "n_parameters": F.size(F.filter(F.split(asked, "&"), lambda s: s != "")),
        "query_length": F.length(asked), "has_fragment": F.when(F.instr(u, "#") > 0, 1).otherwise(0),
        "secure": F.when(F.startswith(u, F.lit("https:")), 1).otherwise(0),
    }
    return computed(
        urls, **{name: f.cast("double") for name, f in features.items()},
        last_label=F.substring_index(host, ".", -1), last_two=F.substring_index(host, ".", -2),
    )


def suffix_statistics(labelled: DataFrame, column: str, smoothing: float = 10.0) -> DataFrame:
    """Smoothed share of blocked URLs and the logarithm of their number, by suffix; a row for each suffix at most."""
    return labelled.groupBy(column).agg(
        ((F.sum("label") + smoothing / 2) / (F.count("*") + smoothing)).alias(f"{column}_rate"),
        F.log1p(F.count("*").cast("double")).alias(f"{column}_rows"),
    )


def with_suffixes(df: DataFrame, statistics: dict[str, DataFrame]) -> DataFrame:
    for column, table in statistics.items():
        df = df.join(F.broadcast(table), column, "left")  # bounded by the sample of labelled rows
    return df.fillna({"last_label_rate": 0.5, "last_two_rate": 0.5, "last_label_rows": 0.0, "last_two_rows": 0.0})


def label_of(seed_words: tuple[str, ...] = SEED_WORDS) -> Column:
    """1 for blocked, 0 for allowed, null for unlabelled: seed words first, then the rule's verdict."""
    seeded = F.lit(False)
    for word in seed_words:
        seeded = seeded | F.contains(F.col("host"), F.lit(word))
    return (
        F.when(seeded, 1.0).when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)
    )


def fit(labelled: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7):
    """The boosted trees and the suffix statistics, or None where labels of one kind are missing."""
    sides = {row["label"] for row in labelled.groupBy("label").count().collect()}
    if sides != {0.0, 1.0}:
        return None
    statistics = {c: materialize(suffix_statistics(labelled, c).coalesce(1), "suffix") for c in ("last_label", "last_two")}
    rows = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(
        with_suffixes(labelled, statistics)
    )
    trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, labelCol="label", maxBins=32)
    return trees.fit(rows.select("label", "features")), statistics


def filter_urls(
    urls: DataFrame, url_column: str = "url", rules: dict[str, str] | None = None,
    seed_words: tuple[str, ...] = SEED_WORDS, max_rows: int = 20_000,
) -> DataFrame:
    """All columns of the table, with host, path, rule, probability of being unwanted, and verdict.

    Columns of these names in the table are replaced. A probability of just 0.5 blocks. Addresses of any length count whole.
    """
    rules = RULES if rules is None else rules
    df = urls.select(F.struct(*urls.columns).alias("row"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("u"))
    df = computed(df, **host_and_path(F.col("u")))
    df = computed(df, rule=rule_of(rules)).withColumn("ruled", verdict_of(rules))

    # Drawn by whole rows, so that an address of many rows is not in whole or out whole.
    labelled = df.select("u", "host", "path", label_of(seed_words).alias("label"), F.xxhash64("row").alias("drawn")).where("label is not null")
    n = labelled.count()
    share = min(1.0, max_rows / max(n, 1))
    sample = labelled.where(F.pmod("drawn", F.lit(1_000_000)) < int(share * 1_000_000)).drop("drawn")
    model = fit(materialize(with_features(sample).repartition(4, "u"), "labelled")) if n else None
    if model is None:
        scored = df.withColumn("blocked", F.lit(0.0))
    else:
        trees, statistics = model
        assembled = VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(
            with_suffixes(with_features(df), statistics)
        )
        scored = trees.transform(assembled).withColumn("blocked", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    taken = ("host", "path", "rule", "verdict", "blocked")
    carried = [F.col("row").getField(c).alias(c) for c in urls.columns if c not in taken]
    return scored.select(*carried, "host", "path", "rule", verdict.alias("verdict"), "blocked")

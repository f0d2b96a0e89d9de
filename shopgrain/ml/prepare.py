"""Datasets with a split column, and preprocessing fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nan_to_null
from ..operators import exact_quantiles, hash_split, lookup_join, numbered, stratified_split
from ..operators.prefix import Stage
from ..session import materialize

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def split_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by column type; booleans are categorical."""
    types = dict(df.dtypes)
    numeric = [name for name in features if types[name] in NUMERIC_TYPES or types[name].startswith("decimal")]
    return numeric, [name for name in features if name not in numeric]


def build_delay_dataset(
    orders: DataFrame, inputs: Sequence[str], keep: Sequence[str] = ("order_id", "customer_state"), seed: int = 42
) -> DataFrame:
    """Delivered orders with the inputs, the label (days of delay) and an 80/20 ``split``.

    ``keep`` columns travel along, so predictions stay attached to their order.
    """
    known = orders.where(F.col("delivery_delay_days").isNotNull())
    columns = list(dict.fromkeys([*keep, *inputs]))
    rows = known.select(*columns, F.col("delivery_delay_days").cast("double").alias("label"))
    return hash_split(rows, ["order_id"], seed=seed)


def build_review_dataset(
    orders: DataFrame, inputs: Sequence[str], keep: Sequence[str] = ("order_id",), seed: int = 42
) -> DataFrame:
    """Reviewed orders with the inputs, the label (score as a whole number) and a stratified 80/20 ``split``."""
    if "review_score" in orders.columns:
        score = "review_score"
    elif "review_score_latest" in orders.columns:
        score = "review_score_latest"
    else:
        raise KeyError("neither review_score nor review_score_latest is a column of the orders")
    columns = list(dict.fromkeys([*keep, *inputs]))
    rows = orders.where(F.col(score).isNotNull()).select(*columns, F.col(score).cast("int").alias("label"))
    # The split reads its rows three times.
    return stratified_split(materialize(rows), ["order_id"], "label", seed=seed)


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg((F.sum("n_rows") / F.count(F.lit(1))).alias("mean_rows")).scalar()
    return counts.select(label, "n_rows", (total / F.col("n_rows")).alias("class_weight"))


def add_class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the balanced weight of their class. ``rows`` is read twice."""
    return lookup_join(rows, class_weights(rows, label).select(label, "class_weight"), label)


@dataclass
class Preprocessor:
    """Constants learnt from training rows: medians, means, scales and most frequent categories."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)

    def scaled(self, name: str):
        """Imputed and standardised numeric column."""
        value = F.coalesce(F.col(name).cast("double"), F.lit(self.medians[name]))
        return (value - F.lit(self.means[name])) / F.lit(self.scales[name])

    def statement(self) -> str:
        """The constants as a projection over the rows to score."""
        scaled = [
            f"(coalesce(cast(`{n}` as double), {self.medians[n]!r}D) - {self.means[n]!r}D) / {self.scales[n]!r}D"
            f" AS `{n}__scaled`"
            for n in self.numeric
        ]
        filled = [
            f"coalesce(cast(`{n}` as string), '{_quoted(self.modes[n])}') AS `{n}__filled`" for n in self.categorical
        ]
        return "SELECT *, " + ", ".join(scaled + filled) + " FROM __THIS__"

    def stages(self, output: str = "features") -> list:
        """Unfitted Spark ML stages: impute and scale, one-hot encode, assemble.

        A category unseen in training is encoded as all zeros.
        """
        stages: list = [SQLTransformer(statement=self.statement())]
        parts = [f"{name}__scaled" for name in self.numeric]
        if self.categorical:
            filled = [f"{name}__filled" for name in self.categorical]
            indexed = [f"{name}__index" for name in self.categorical]
            encoded = [f"{name}__onehot" for name in self.categorical]
            stages += [
                StringIndexer(
                    inputCols=filled, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
                ),
                OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            ]
            parts += encoded
        stages.append(VectorAssembler(inputCols=parts, outputCol=output))
        return stages

    def pipeline(self, *estimators) -> Pipeline:
        return Pipeline(stages=[*self.stages(), *estimators])


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def numeric_constants(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Median, mean and population deviation after median imputation, one row per numeric feature."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), nan_to_null(F.col(name).cast("double")).alias("value")) for name in numeric
    ])).alias("cell")).select("cell.feature", "cell.value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, ["feature"])
    # One row per feature is broadcast, so the cells of all features stay where they are.
    imputed = long.join(F.broadcast(medians), "feature", "left").select(
        "feature", "median", F.coalesce("value", "median", F.lit(0.0)).alias("value")
    )
    return imputed.groupBy("feature").agg(
        F.coalesce(F.first("median"), F.lit(0.0)).alias("median"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("deviation"),
    )


def category_modes(train: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Most frequent present value (smallest on a tie) of each categorical feature, as one row.

    Values are counted in a grouped aggregation first, so a feature of many values fills no single buffer.
    """
    counts = train.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("string").alias("value")) for name in categorical
    ]))).groupBy("feature", "value").agg(F.count("value").alias("n_rows"))

    def first_of(name):
        own = (F.col("feature") == name) & F.col("value").isNotNull()
        return F.min(F.when(own, F.struct(-F.col("n_rows"), F.col("value").alias("value"))))["value"]

    return counts.agg(*[F.coalesce(first_of(name), F.lit("")).alias(name) for name in categorical])


def category_dictionary(train: DataFrame, categorical: Sequence[str], stage: Stage) -> DataFrame:
    """(feature, value, position): the one-hot position of every category, by feature and value.

    However many categories there are, they are counted, ordered and numbered on the executors; ``stage`` writes them.
    A missing value counts as the feature's most frequent one, as in ``Preprocessor``.
    """
    modes = category_modes(train, categorical).first()
    values = train.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("part"), F.lit(name).alias("feature"), F.coalesce(F.col(name).cast("string"), F.lit(modes[name])).alias("value"))
        for i, name in enumerate(categorical)
    ]))).distinct()
    return numbered(values, ["part", "value"], stage, "position").select("feature", "value", "position")


def category_positions(
    rows: DataFrame, keys: Sequence[str], categorical: Sequence[str], dictionary: DataFrame, modes: Mapping[str, str]
) -> DataFrame:
    """``keys`` and the sorted one-hot ``positions`` of each row; a category that is not in the dictionary has none.

    Spark broadcasts the dictionary if its measured size allows; otherwise the join shuffles, and a category that most rows
    share is split.
    """
    cells = rows.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.coalesce(F.col(name).cast("string"), F.lit(modes[name])).alias("value")) for name in categorical
    ])))
    placed = lookup_join(cells, dictionary, ["feature", "value"])
    return placed.groupBy(*keys).agg(F.sort_array(F.collect_list("position")).alias("positions"))  # one for each feature at most


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
    """Learn the preprocessing constants; only these few numbers reach the driver."""
    fitted = Preprocessor(list(numeric), list(categorical))
    if numeric:
        for row in numeric_constants(train, numeric).collect():
            fitted.medians[row["feature"]] = row["median"]
            fitted.means[row["feature"]] = row["mean"]
            fitted.scales[row["feature"]] = row["deviation"] or 1.0
    if categorical:
        fitted.modes = category_modes(train, categorical).first().asDict()
    return fitted

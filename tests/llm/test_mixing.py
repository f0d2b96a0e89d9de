import pytest
from pyspark.sql import functions as F

from shopgrain.llm import mixing

ROWS = [(i, " ".join(["word"] * (5 + i % 90)), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 7}", 1) for i in range(600)]
SCHEMA = "doc_id long, text string, lang string, source string, weight int"


def plain_rake(cells, targets, sweeps):
    factors = [{v: 1.0 for v in t} for t in targets]
    for _ in range(sweeps):
        for m, target in enumerate(targets):
            for value, share in target.items():
                total = sum(
                    n * factors[0][c[0]] * factors[1][c[1]] * factors[2][c[2]] / factors[m][value]
                    for c, n in cells.items() if c[m] == value
                )
                factors[m][value] = share / total
    return factors


def test_weighted_tokens_meet_all_targets_and_equal_plain_raking(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    df = mixing.weigh(docs).cache()
    whole = df.agg(F.sum(F.col("weight") * F.col("n_tokens"))).first()[0]
    cells = {(r.source, r.lang, r.topic): r.n for r in df.groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("n")).collect()}
    targets = []
    for m, margin in enumerate(mixing.MARGINS):
        tokens = {}
        for c, n in cells.items():
            tokens[c[m]] = tokens.get(c[m], 0) + n
        powered = {v: n ** 0.8 for v, n in tokens.items()}
        targets.append({v: x / sum(powered.values()) for v, x in powered.items()})
        got = {r[0]: r[1] / whole for r in df.groupBy(margin).agg(F.sum(F.col("weight") * F.col("n_tokens"))).collect()}
        assert got == pytest.approx(targets[-1], rel=1e-6)
    factors = plain_rake(cells, targets, mixing.SWEEPS)
    for r in df.select(*mixing.MARGINS, "weight").distinct().collect():
        assert r.weight == pytest.approx(factors[0][r.source] * factors[1][r.lang] * factors[2][r.topic], rel=1e-9)
    assert df.agg(F.max("probability")).first()[0] == 1.0
    df.unpersist()


def test_sampled_tokens_follow_the_probabilities(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "hot" if i % 3 else "rare", 1) for i in range(6000)], SCHEMA)
    rows = mixing.weigh(docs).groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("int")).alias("s")).collect()
    for r in rows:
        assert r.s == pytest.approx(r.p, abs=0.03)
    assert mixing.sample(docs).columns == docs.columns


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None, None, 1), (1, None, None, None, 1), (None, "a b", "en", "s", 1), (2, "c", None, "s", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert mixing.weigh(docs).count() == 4
    assert mixing.weigh(docs.limit(0)).count() == 0


def test_targets_of_the_caller(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    targets = {
        "source": spark.createDataFrame([("hot", 1.0), ("absent", 5.0)], "source string, share double"),
        "lang": spark.createDataFrame([("en", 1.0), ("fr", 3.0)], "lang string, share double"),
    }
    df = mixing.weigh(docs, targets)
    assert df.where("source <> 'hot' and weight > 0").count() == 0
    shares = {r.lang: r.w for r in df.groupBy("lang").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w")).collect()}
    assert shares["fr"] / shares["en"] == pytest.approx(3.0)

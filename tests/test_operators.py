"""Operators against brute force on small or lopsided inputs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shopgrain.operators import (
    box_outliers, box_stats, count_by, cumulative_before, exact_quantiles, exact_sample, hash_split, histogram,
    keep_first, lookup_join, missingness, rank_labels, stratified_split, table_profile, top_k,
)


def quantile(values, q):
    values = sorted(values)
    position = q * (len(values) - 1)
    low, high = math.floor(position), math.ceil(position)
    return values[low] + (values[high] - values[low]) * (position - low)


def lopsided(seed=1, n=4000):
    """A third of the rows in one group; a third of the values equal; a few far out."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(4)}"
        value = 5.0 if rng.random() < 0.33 else rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), -1e9 * rng.random()])
        rows.append((group, value))
    return rows + [("lonely", 1.0), ("empty", None), (None, 3.0), (None, 4.0)]


def test_quantiles_by_group(spark):
    data = lopsided()
    fractions = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    groups = defaultdict(list)
    for g, v in data:
        if v is not None:
            groups[g].append(v)
    got = {row["g"]: row.asDict() for row in exact_quantiles(df, "v", fractions, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, q in fractions.items():
            assert got[g][name] == pytest.approx(quantile(values, q), rel=1e-12), (g, name)


def test_quantiles_of_all_rows(spark):
    values = [v for _, v in lopsided(2, 1500) if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", {"a": 0.1, "b": 0.9}).first()
    assert (got["a"], got["b"]) == (pytest.approx(quantile(values, 0.1)), pytest.approx(quantile(values, 0.9)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, "a")], "v double, g string")
    assert exact_quantiles(df, "v", {"a": 0.5}).collect()[0]["a"] is None
    assert exact_quantiles(df, "v", {"a": 0.5}, ["g"]).collect() == []


def test_stratified_split_is_exact(spark):
    df = spark.range(3001).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") < 20, 2).otherwise(3).alias("label"))
    split = stratified_split(df, ["id"], "label")
    total, test = Counter(), Counter()
    for row in split.collect():
        total[row["label"]] += 1
        test[row["label"]] += row["split"] == "test"
    assert sum(total.values()) == 3001
    assert all(test[label] == math.ceil(0.2 * total[label]) for label in total)


def test_stratified_split_does_not_depend_on_partitioning(spark, rows):
    df = spark.range(500).select("id", (F.col("id") % 4).alias("label"))
    assert rows(stratified_split(df.repartition(3), ["id"], "label")) == rows(
        stratified_split(df.coalesce(1), ["id"], "label"))


def test_quantiles_of_many_groups(spark):
    df = spark.range(100_000).select((F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("v"))
    got = exact_quantiles(df, "v", {"m": 0.5}, ["g"])
    assert got.count() == 20_000
    assert got.where(F.col("m") != F.col("g") + 40_000).count() == 0


def test_quantiles_of_infinite_and_far_spread_values(spark):
    values = [math.exp(7 * i) for i in range(100)] + [math.inf, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (got["low"], got["high"]) == (-math.inf, math.inf)
    assert got["mid"] == pytest.approx(sorted(values)[51])


def test_quantiles_of_groups_cut_into_cells(spark, monkeypatch):
    from shopgrain.operators import order_stats

    data = lopsided(3, 4000) + [("hot", math.inf), ("hot", -math.inf)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    fractions = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    whole = sorted(map(tuple, exact_quantiles(df, "v", fractions, ["g"]).collect()), key=repr)
    groups = defaultdict(list)
    for g, v in data:
        if v is not None:
            groups[g].append(v)
    for g, *got in whole:  # every group is ranked as it is
        for value, q in zip(got, fractions.values()):
            assert math.isinf(value) or value == pytest.approx(quantile(groups[g], q), rel=1e-12)
    for small in (0, 20):
        monkeypatch.setattr(order_stats, "SMALL", small)
        assert sorted(map(tuple, exact_quantiles(df, "v", fractions, ["g"]).collect()), key=repr) == whole


def test_quantiles_pass_nothing_through_the_driver_and_plan_once(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    exact_quantiles(df, "v", {"m": 0.5})
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_hash_split_at_the_ends(spark):
    df = spark.range(1000)

    def tests(fraction):
        return hash_split(df, ["id"], fraction).where("split = 'test'").count()

    assert tests(0.0) == 0 and tests(1.0) == 1000 and tests(1e-12) == 0
    assert 400 < tests(0.5) < 600
    with pytest.raises(ValueError):
        hash_split(df, ["id"], 1.5)


def test_hash_split_share_and_seed(spark):
    df = spark.range(20000)
    share = hash_split(df, ["id"]).where("split = 'test'").count() / 20000
    assert 0.19 < share < 0.21
    a, b = (hash_split(df, ["id"], seed=s).where("split = 'test'").select("id") for s in (1, 2))
    assert a.intersect(b).count() < 1200


@pytest.mark.parametrize("n", [0, 7, 300, 5000])
def test_sample_size_is_exact(spark, n):
    df = spark.range(3000)
    sample = exact_sample(df, n, ["id"])
    assert sample.count() == min(n, 3000) and sample.distinct().count() == min(n, 3000)


def test_sample_is_the_hash_order(spark):
    df = spark.range(5000)
    expected = df.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("0"))), "id").limit(40)
    assert {r["id"] for r in exact_sample(df, 40, ["id"]).collect()} == {r["id"] for r in expected.collect()}


def test_sample_with_one_key_on_most_rows(spark):
    """All rows share a hash above the limit, so the limit has to be lifted."""
    for key in range(12):
        df = spark.range(20000).select(F.lit(key).alias("k"), "id")
        assert exact_sample(df, 5, ["k"]).count() == 5


def test_keep_first_with_hot_key(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 9001).alias("v")
    ).repartition(6)
    expected = {}
    for row in df.collect():
        expected[row["k"]] = min(row["v"], expected.get(row["k"], row["v"]))
    assert {row["k"]: row["v"] for row in keep_first(df, ["k"]).collect()} == expected


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 9.99, 10)] + [(None,), (float("nan"),)], "v double")
    got = histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["n_rows"] for r in got] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    assert (got[0]["bin_start"], got[-1]["bin_end"]) == (0.0, 10.0)


def test_histogram_of_equal_values_and_of_nothing(spark, rows):
    equal = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert rows(histogram(equal, "v")) == [(1, 4.0, 4.0, 2)]
    assert rows(histogram(equal.where("v < 0"), "v")) == []


def test_box_statistics(spark, rows):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(5, v) for v in values] + [(1, None), (None, 1.0)], "score int, v double")
    assert rows(box_stats(df, "v", "score")) == [(5, 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)]
    assert rows(box_outliers(df, "v", "score")) == [(5, 100.0)]


def test_missingness(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, 1.0), (3, "x", None)], "a int, b string, c double")
    got = [tuple(r) for r in missingness(df).collect()]
    assert got == [("b", 2, 66.67), ("c", 2, 66.67), ("a", 0, 0.0)]
    assert len(missingness(df, 1).collect()) == 1


def test_table_profile(spark, rows):
    tables = {"x": spark.range(3), "y": spark.createDataFrame([(1, 2)], "a int, b int")}
    assert rows(table_profile(tables)) == [("x", 3, 1), ("y", 1, 2)]


def test_count_by(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "k string")
    assert [tuple(r) for r in count_by(df, "k", "n").collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_lookup_join_suffixes(spark):
    left = spark.createDataFrame([(1, "l")], "k int, city string")
    right = spark.createDataFrame([(1, "r"), (2, "s")], "k int, city string")
    assert lookup_join(left, right, "k", right_suffix="_customer").columns == ["k", "city", "city_customer"]
    both = lookup_join(left, right, "k", "_product", "_seller")
    assert both.first().asDict() == {"k": 1, "city_product": "l", "city_seller": "r"}


def test_labels(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "k int, v double")
    best = rank_labels(top_k(df, "v", "k", 12), "v", "k", "label").orderBy("label").collect()
    assert [r["label"] for r in best][:2] == ["C01", "C02"] and best[-1]["label"] == "C12"
    assert best[0]["k"] == 29


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_cumulative_before(spark, buckets):
    rng = random.Random(3)
    data = [(x, rng.randrange(9)) for x in {rng.choice([rng.random(), 0.83 + rng.random() / 1e6]) for _ in range(800)}]
    got = cumulative_before(spark.createDataFrame(data, "x double, c int"), "x", ["c"], buckets).collect()
    running = 0
    for row, (x, c) in zip(sorted(got, key=lambda r: r["x"]), sorted(data), strict=True):
        assert (row["x"], row["c"], row["c_before"]) == (x, c, running)
        running += c


def test_ranges_that_follow_the_rows(spark):
    from shopgrain.operators import numbered
    from shopgrain.session import materialize

    rng = random.Random(5)
    data = [(x, rng.randrange(9)) for x in {rng.random() for _ in range(3000)}]
    df = spark.createDataFrame(data, "x double, c int")
    before = sorted((r["x"], r["c_before"]) for r in cumulative_before(df, "x", ["c"], stage=materialize).collect())
    running = 0
    for (x, sum_before), (y, c) in zip(before, sorted(data), strict=True):
        assert (x, sum_before) == (y, running)
        running += c
    places = {r["x"]: r["number"] for r in numbered(df, ["x"], materialize).collect()}
    assert [x for x, _ in sorted(data)] == sorted(places, key=places.get) and sorted(places.values()) == list(range(len(data)))
    assert numbered(df.limit(0), ["x"], materialize).count() == 0

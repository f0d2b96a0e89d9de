import math
import random

import pytest
from pyspark.sql import functions as F

from shopgrain.llm import pivot_index as p


def brute(rows, is_query, k):
    whole = {(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows
             if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = {}
    for q, x in whole:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("shape", [dict(), dict(n_pivots=3, n_annuli=3, block_rows=20, query_rows=5)])
def test_equals_brute_force(spark, shape):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(400, 520)]  # one vector for many rows
    rows += [(520, None), (521, []), (522, [1.0, None]), (523, [float("nan")] * 6), (None, [9.0] * 6), (524, [2.0, 1.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash"))
    vectors = p.whole_vectors(df, "vec_id", "embedding")
    got = {}
    for r in p.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, **shape).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_few_rows_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    few = p.whole_vectors(spark.createDataFrame([(0, [1.0]), (7, [2.0])], schema), "vec_id", "embedding")
    assert [tuple(r) for r in p.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 256 * 512)]
    none = p.whole_vectors(spark.createDataFrame([], schema), "vec_id", "embedding")
    assert p.top_k(none, F.lit(True)).count() == 0

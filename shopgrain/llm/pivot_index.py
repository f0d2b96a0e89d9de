"""Exact top-k inner products through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. The key space is cut into annuli around each pivot,
and large annuli into blocks of bounded size. For a query at distance ``d`` from a pivot, a vector at distance ``r``
from the same pivot is at least ``|d - r|`` away, so its inner product is at most
``(|q|^2 + |x|^2 - (d - r)^2) / 2``. A query first searches the annulus with the largest bound, which gives it a k-th
best score, and then only annuli whose bound reaches that score; inside a block it expands from the nearest annulus
outwards and stops the same way. Results are exact, whatever the pivots; bad pivots only cost time.

* Vectors that are null, empty or hold a null or non-finite component, and rows without id, take no part. Shorter
  vectors count as padded with zeros. Scores are exact while they stay below 2^53.
* Of rows with one and the same vector only the ``k + 1`` smallest ids can be answers, so a vector that a third of all
  rows share costs no more than another one. Rows that repeat an id and its vector count once.
* Pivots are a bounded sample (``n_pivots`` rows with the smallest hash). Statistics of at most ``n_pivots * n_annuli``
  annuli go through the driver, never vectors.
* Queries are matched with blocks of vectors: a block holds about ``block_rows`` vectors and ``query_rows`` queries.
* An empty table, or one without a query, gives an empty result. Ids must be numbers (a text that is none fails in the
  cast). Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopgrain.session import materialize

CHUNK = 256  # vectors of a block that are scored together


def whole_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``x``, the components times ``scale`` rounded down, of rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    usable = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return (
        df.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & usable)
        .select(F.col(id_column).cast("long").alias("vec_id"),
                F.transform(vector, lambda c: F.floor(c * scale).cast("double")).alias("x"))
    )


def smallest_ids(vectors: DataFrame, n: int) -> DataFrame:
    """Of each distinct vector the ``n`` rows with the smallest ids; cut down before and after the shuffle."""
    order = Window.partitionBy("x").orderBy("vec_id")
    ranked = vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")
    return ranked.dropDuplicates(["x", "vec_id"])


def matrix(vectors, width: int | None = None) -> np.ndarray:
    width = width or max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def keyed_by_pivot(vectors: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """Nearest pivot, distance to it and squared length of every vector."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                width = max(len(pivots[0]), max(map(len, batch["x"])))
                x = matrix(batch["x"], width)
                far = distances(x, matrix(pivots, width))
                nearest = far.argmin(1)
                yield batch.assign(
                    pivot=nearest.astype("int32"), r=far[np.arange(len(x)), nearest], norm=(x * x).sum(1)
                )

    return vectors.mapInPandas(assign, "vec_id long, x array<double>, pivot int, r double, norm double")


def build_index(
    vectors: DataFrame, n_pivots: int = 16, n_annuli: int = 4, block_rows: int = 4096,
) -> tuple[DataFrame, list[list[float]], pd.DataFrame]:
    """The index rows with annulus and block, the pivots, and the statistics of the annuli (a bounded number)."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
    pivots = [list(row["x"]) for row in sample] or [[0.0]]
    keyed = materialize(keyed_by_pivot(vectors, pivots), "pivots")
    shares = [i / n_annuli for i in range(1, n_annuli)]
    edges = {
        row["pivot"]: sorted(set(row["edges"]))
        for row in keyed.groupBy("pivot").agg(F.percentile_approx("r", shares, 1000).alias("edges")).collect()
    }
    annulus = F.lit(0)
    for pivot, cuts in edges.items():
        for cut in cuts:
            annulus = annulus + F.when((F.col("pivot") == pivot) & (F.col("r") > cut), 1).otherwise(0)
    index = keyed.withColumn("cell", (F.col("pivot") * n_annuli + annulus).cast("int"))
    cells = index.groupBy("cell", "pivot").agg(
        F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm").alias("norm"),
    ).toPandas()
    cells["blocks"] = np.maximum(1, -(-cells["n"] // block_rows))
    blocks = F.lit(1)
    for row in cells.itertuples():
        if row.blocks > 1:
            blocks = F.when(F.col("cell") == int(row.cell), int(row.blocks)).otherwise(blocks)
    return index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")), pivots, cells


def visits(queries: DataFrame, pivots, cells: pd.DataFrame, first: bool) -> DataFrame:
    """The blocks that each query has to see: those of its best annulus, or of all others that its floor admits."""
    pivot, low, high, norm, ids, blocks = (cells[c].to_numpy() for c in ("pivot", "low", "high", "norm", "cell", "blocks"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            width = max(len(pivots[0]), max(map(len, batch["x"])))
            x = matrix(batch["x"], width)
            far = distances(x, matrix(pivots, width))[:, pivot]
            gap = np.maximum(0, np.maximum(far - high, low - far))
            bound = ((x * x).sum(1)[:, None] + norm - gap * gap) / 2 + 1
            best = bound.argmax(1)
            if first:
                row, column = np.arange(len(x)), best
            else:
                admitted = bound >= batch["floor"].to_numpy()[:, None]
                admitted[np.arange(len(x)), best] = False
                row, column = admitted.nonzero()
            times = blocks[column].astype(int)
            row, column = np.repeat(row, times), np.repeat(column, times)
            block = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0)
            yield pd.DataFrame({
                "cell": ids[column].astype("int32"), "block": block.astype("int32"),
                "part": batch["part"].to_numpy()[row], "query_id": batch["query_id"].to_numpy()[row],
                "x": batch["x"].to_numpy()[row], "floor": batch["floor"].to_numpy()[row],
            })

    return queries.mapInPandas(
        route, "cell int, block int, part int, query_id long, x array<double>, floor double"
    )


def score_blocks(index: DataFrame, seen: DataFrame, pivots, k: int, parts: int) -> DataFrame:
    """The ``k`` best of each block for each query that visits it."""

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        rows = rows.sort_values("r", kind="stable")
        width = max(max(map(len, rows["x"])), max(map(len, asked["x"])), len(pivots[0]))
        x, q = matrix(rows["x"], width), matrix(asked["x"], width)
        ids, own = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        r, norm = rows["r"].to_numpy(), rows["norm"].to_numpy()
        starts = np.arange(0, len(x), CHUNK)
        ends = np.minimum(starts + CHUNK, len(x))
        low, high = r[starts], r[ends - 1]
        most = np.maximum.reduceat(norm, starts)
        far = distances(q, matrix([pivots[int(rows["pivot"].iloc[0])]], width))
        gap = np.maximum(0, np.maximum(far - high, low - far))
        bound = ((q * q).sum(1)[:, None] + most - gap * gap) / 2 + 1
        order = np.argsort(-bound, axis=1, kind="stable")
        scores = np.full((len(q), k), -np.inf)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        floor = asked["floor"].to_numpy().copy()
        for step in range(len(starts)):
            chunk = order[:, step]
            alive = bound[np.arange(len(q)), chunk] >= floor
            for c in np.unique(chunk[alive]):
                who = np.nonzero(alive & (chunk == c))[0]
                part = slice(starts[c], ends[c])
                got = q[who] @ x[part].T
                got[own[who][:, None] == ids[part][None, :]] = -np.inf
                both = np.concatenate([scores[who], got], axis=1)
                name = np.concatenate([names[who], np.broadcast_to(ids[part], got.shape)], axis=1)
                top = np.lexsort((name, -both), axis=1)[:, :k]
                scores[who], names[who] = np.take_along_axis(both, top, 1), np.take_along_axis(name, top, 1)
                floor[who] = np.maximum(floor[who], scores[who, k - 1])
        row, column = np.isfinite(scores).nonzero()
        return pd.DataFrame({
            "query_id": own[row], "vec_id": names[row, column], "score": scores[row, column].astype("int64"),
        })

    if parts > 1:
        index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    else:
        index = index.withColumn("part", F.lit(0))
    keys = ["cell", "block", "part"]
    return index.groupBy(*keys).cogroup(seen.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score long"
    )


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = 16, n_annuli: int = 4, block_rows: int = 4096,
    query_rows: int = 16384,
) -> DataFrame:
    """For each query row (of ``vec_id``, ``x``) the ``k`` best other rows: query_id, rank, vec_id, score."""
    candidates = smallest_ids(vectors, k + 1)
    index, pivots, cells = build_index(candidates, n_pivots, n_annuli, block_rows)
    queries = vectors.where(is_query).dropDuplicates(["vec_id", "x"]).withColumnRenamed("vec_id", "query_id")
    parts = max(1, -(-queries.count() // query_rows))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))

    seeds = visits(queries.withColumn("floor", F.lit(float("-inf"))), pivots, cells, first=True)
    first = materialize(best(score_blocks(index, seeds, pivots, k, parts), k).drop("rank"), "seeds")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    rest = queries.join(floors, "query_id", "left").fillna(float("-inf"), ["floor"])
    others = score_blocks(index, visits(rest, pivots, cells, first=False), pivots, k, parts)
    return best(first.unionByName(others), k).select("query_id", "rank", "vec_id", "score")

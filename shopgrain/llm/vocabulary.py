"""Counts of the distinct units of a corpus, and the bounded dictionary of the most frequent ones.

A few units make up most of a corpus. What is known of them travels to the tasks as a dictionary of bounded size; all
others are looked up by a join. Both together cover every unit, whatever the size of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 200_000
LEVELS = 8  # of count, for each doubling


def count_units(
    texts: DataFrame, split: Callable[[str | None], list], expand: Callable[[str], list[str]] | None = None,
) -> DataFrame:
    """``unit`` and ``n`` for all texts of the only column. Each task counts before the shuffle.

    With ``expand``, what ``split`` gives is counted first and falls into its units once for each distinct one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            units = counts
            if expand:
                units = Counter()
                for word, n in counts.items():
                    for unit in expand(word):
                        units[unit] += n
            names = pa.array(list(units)) if units else pa.array([], pa.string())
            batch = pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(list(units.values()), pa.int64())], ["unit", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py()))
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, at_most: int) -> DataFrame:
    """The most frequent units: all whose count reaches a level that at most so many units reach."""
    level = F.floor(F.log2("n") * LEVELS)
    sizes = {r["level"]: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for step in sorted(sizes, reverse=True):  # at most 8 levels for each of 63 doublings
        total += sizes[step]
        if total > at_most:
            break
        least = step
    return counts.where(level >= least)

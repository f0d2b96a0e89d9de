"""Secrets in texts: known shapes, and runs of characters that a battery of randomness tests finds.

Known shapes (``assign``, ``access``, ``hex``) are patterns. The method adds ``random`` spans. A candidate is a run of at
least ``MIN_RUN`` letters, digits and ``+/_-``; its encoding is the smallest of ``ENCODINGS`` that holds all of its
characters. Three tests are taken over the values in that alphabet: chi-squared uniformity, runs above and below the
middle, and serial correlation at lag one.

* *Is it random?* A run that any of the tests rejects as a uniform random string (at ``REJECT``, divided by three) is out.
* *Could it be written text?* Uniformity and runs are also judged against ordinary words: the shares of characters, and the
  share of neighbours that cross the middle, are counted over all shorter runs of the corpus. The p-value says how
  often written text of this length and alphabet is as uniform, or changes sides as often.
* *False discoveries.* Distinct candidates of about the same length form a family; in each the step-up rule keeps the
  largest set with an expected share of at most ``FALSE_SHARE`` of written text. Short runs carry little evidence and pass
  only where the family shows many alike; p-values are rounded up to steps of ``1 / STEPS`` in the exponent, so that a
  family is a table of bounded size.

The corpus is read once; what is kept of it is spans and candidates. Null texts are empty. Texts of any length are searched
whole. Repeated rows have equal results, and equal candidates count once in their family. An empty table gives no rows.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.session import materialize

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")  # one of them is in every match
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

MIN_RUN = 16
REJECT = 0.003
FALSE_SHARE = 0.01
STEPS = 20
MOST_STEPS = 300 * STEPS
PART = 1 << 20  # bytes that are searched at the same time, or one text

# The alphabets, in the order of their values.
DIGITS, LOWER, UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "hex_upper": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER,
    "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base36_upper": DIGITS + UPPER, "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
SYMBOLS = ENCODINGS["any"]
SIZES = np.array([len(a) for a in ENCODINGS.values()])
# Values by encoding and symbol (-1: not in it), and symbols by byte (-1: no part of a run).
VALUES = np.array([[alphabet.find(s) for s in SYMBOLS] for alphabet in ENCODINGS.values()])
SYMBOL_OF = np.full(256, -1, np.int64)
SYMBOL_OF[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
PAIRS = len(SYMBOLS) ** 2

CANDIDATE = "struct<start: long, stop: long, encoding: int, n: int, chi: double, changes: int, rejected: boolean, name: long>"
FOUND = f"doc_id long, base array<struct<kind: int, start: long, stop: long>>, candidates array<{CANDIDATE}>, pairs array<long>"


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the patterns as (kind, start, stop), by start and kind."""
    spans = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        spans += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text)]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


@dataclass
class Runs:
    """Candidates of some texts, one entry each, and how often each pair of neighbours stands in shorter runs."""

    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    encoding: np.ndarray
    n: np.ndarray
    chi: np.ndarray
    changes: np.ndarray
    rejected: np.ndarray
    names: list[int]
    pairs: np.ndarray


def log10_below(z: np.ndarray) -> np.ndarray:
    """Logarithms of the probability that a normal value is below ``z``."""
    def one(x: float) -> float:
        if x > -30:
            return math.log10(0.5 * math.erfc(-x / math.sqrt(2)))
        return (-x * x / 2 - math.log(-x * math.sqrt(2 * math.pi))) / math.log(10)

    return np.array([one(x) for x in z.tolist()])


def battery(values: np.ndarray, run: np.ndarray, n: np.ndarray, size: np.ndarray, square_sum: np.ndarray):
    """Chi-squared statistic, number of changes of side, and whether randomness is rejected, for each run.

    ``values`` are those of all runs, one after the other; ``run`` says which; ``size`` is the alphabet's.
    """
    chi = size / n * square_sum - n
    z_chi = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    high = values >= (size // 2)[run]
    inner = run[1:] == run[:-1]
    changes = np.bincount(run[1:][inner], (high[1:] != high[:-1])[inner], len(n))
    above = np.bincount(run, high, len(n))
    both = 2 * above * (n - above)
    spread = both * (both - n) / (n * n * (n - 1.0))
    z_runs = np.where(spread > 0, (changes - both / n) / np.sqrt(np.maximum(spread, 1e-9)), 99.0)
    centred = values - (np.bincount(run, values, len(n)) / n)[run]
    power = np.bincount(run, centred * centred, len(n))
    together = np.bincount(run[1:][inner], (centred[1:] * centred[:-1])[inner], len(n))
    z_serial = np.where(power > 0, (together / np.maximum(power, 1e-9) + 1 / n) * np.sqrt(n), 99.0)
    least = math.log10(REJECT / 3)
    rejected = (log10_below(-z_chi) < least) | (log10_below(-np.abs(z_runs)) + math.log10(2) < least)
    return chi, changes, rejected | (log10_below(-np.abs(z_serial)) + math.log10(2) < least)


def runs_of(texts: list[str]) -> Runs:
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    symbols = SYMBOL_OF[data]
    inside = symbols >= 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    long_ = stops - starts >= MIN_RUN
    neighbours = inside[1:] & inside[:-1]
    for s, e in zip(starts[long_], stops[long_]):
        neighbours[s:e - 1] = False
    pairs = np.bincount((symbols[:-1] * len(SYMBOLS) + symbols[1:])[neighbours], minlength=PAIRS)
    starts, stops = starts[long_], stops[long_]
    n = stops - starts
    run = np.repeat(np.arange(len(n)), n)
    own = symbols[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)]
    counts = np.bincount(run * len(SYMBOLS) + own, minlength=len(n) * len(SYMBOLS)).reshape(-1, len(SYMBOLS))
    fits = np.stack([counts[:, v < 0].sum(axis=1) == 0 for v in VALUES], axis=1)
    encoding = np.argmin(np.where(fits, SIZES, 1 << 20), axis=1) if len(n) else np.zeros(0, np.int64)
    size = SIZES[encoding]
    chi, changes, rejected = battery(VALUES[encoding[run], own], run, n, size, (counts * counts).sum(axis=1))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text = np.searchsorted(first, starts, "right") - 1
    names = [int.from_bytes(hashlib.blake2b(data[s:e].tobytes(), digest_size=8).digest(), "big", signed=True) for s, e in zip(starts, stops)]
    begin = points[first[text]]
    return Runs(text, points[starts] - begin, points[stops] - begin, encoding, n, chi, changes, rejected, names, pairs)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: spans of patterns, candidates with their tests, and on some rows the neighbours counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, at = batch.column("doc_id"), batch.column("text"), 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < PART:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                r = runs_of(texts)
                ends = np.searchsorted(r.text, np.arange(len(texts) + 1)).astype(np.int32)
                candidates = pa.StructArray.from_arrays([
                    pa.array(r.start, pa.int64()), pa.array(r.stop, pa.int64()), pa.array(r.encoding, pa.int32()), pa.array(r.n, pa.int32()),
                    pa.array(r.chi, pa.float64()), pa.array(r.changes, pa.int32()), pa.array(r.rejected, pa.bool_()), pa.array(r.names, pa.int64()),
                ], ["start", "stop", "encoding", "n", "chi", "changes", "rejected", "name"])
                base = [[{"kind": k, "start": s, "stop": e} for k, s, e in known_spans(t)] for t in texts]
                kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(texts)), pa.array(base, kind), pa.ListArray.from_arrays(ends, candidates),
                    pa.array([r.pairs.tolist(), *[None] * (len(texts) - 1)], pa.list_(pa.int64())),
                ], names=["doc_id", "base", "candidates", "pairs"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


@dataclass(frozen=True)
class Written:
    """What written text looks like in each encoding: sums of squares and cubes of shares, and the share of changes."""

    squares: np.ndarray
    cubes: np.ndarray
    changes: np.ndarray


def written_text(found: DataFrame) -> Written:
    """From the neighbours in shorter runs of the corpus; one more is added to each symbol and pair."""
    counted = found.where(F.col("pairs").isNotNull()).select(F.posexplode("pairs").alias("pair", "n")).where("n > 0")
    pairs = np.ones(PAIRS)
    for r in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most one row for each pair of symbols
        pairs[r["pair"]] += r["n"]
    pairs = pairs.reshape(len(SYMBOLS), -1)
    squares, cubes, changes = [], [], []
    for values, size in zip(VALUES, SIZES):
        own = pairs[np.ix_(values >= 0, values >= 0)]
        share = own.sum(axis=0) / own.sum()
        high = values[values >= 0] >= size // 2
        squares.append((share ** 2).sum())
        cubes.append((share ** 3).sum())
        changes.append(own[high[:, None] != high].sum() / own.sum())
    return Written(np.array(squares), np.array(cubes), np.array(changes))


def evidence(written: Written, encoding: np.ndarray, n: np.ndarray, chi: np.ndarray, changes: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """Steps of evidence against written text: ``10 ** (-step / STEPS)`` is a bound of the p-value."""
    n = n.astype(np.float64)
    size, s2, s3, rate = SIZES[encoding], written.squares[encoding], written.cubes[encoding], written.changes[encoding]
    mean = size * (1 + (n - 1) * s2) - n
    spread = 4 * n * (n - 1) * (n - 2) * s3 + 2 * n * (n - 1) * s2 - 2 * n * (n - 1) * (2 * n - 3) * s2 ** 2
    uniform = log10_below((chi - mean) / (size / n * np.sqrt(np.maximum(spread, 1e-9))))
    part = np.clip(changes / (n - 1), 1e-12, 1 - 1e-12)
    gap = part * np.log(part / rate) + (1 - part) * np.log((1 - part) / (1 - rate))
    sides = np.where(part > rate, -(n - 1) * gap / math.log(10), 0.0)
    p = np.minimum(uniform, sides) + math.log10(2)
    return np.where(rejected, 0, np.clip(np.floor(-p * STEPS), 0, MOST_STEPS)).astype(np.int64)


def length_class(n: np.ndarray) -> np.ndarray:
    """Two classes for each doubling of the length."""
    return np.floor(2 * np.log2(n)).astype(np.int64)


def _columns(candidates: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each candidate, and its fields."""
    rows = np.repeat(np.arange(len(candidates)), np.diff(candidates.offsets.to_numpy()))
    flat = candidates.flatten()
    return rows, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def least_steps(found: DataFrame, written: Written) -> dict[int, int]:
    """For each length class, the evidence from which on candidates are taken: the step-up rule over distinct ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, c = _columns(batch.column("candidates"))
            steps = evidence(written, c["encoding"], c["n"], c["chi"], c["changes"], c["rejected"])
            yield pa.RecordBatch.from_pydict({"length": length_class(c["n"]), "name": c["name"], "step": steps})

    distinct = found.where(F.size("candidates") > 0).select("candidates").mapInArrow(run, "length long, name long, step long").distinct()
    family = distinct.groupBy("length", "step").agg(F.count(F.lit(1)).alias("n"))
    in_family = Window.partitionBy("length")
    reached = F.sum("n").over(in_family.orderBy(F.desc("step")))
    all_ = F.sum("n").over(in_family)
    kept = family.withColumn("reached", reached).withColumn("all", all_).where(
        F.col("all") * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_SHARE * F.col("reached")
    )
    return {r["length"]: r["least"] for r in kept.groupBy("length").agg(F.min("step").alias("least")).collect()}  # under 64 rows


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all ``spans`` (kind, start, stop in code points, of random ones the encoding), by start and kind.

    A random run inside a span of a pattern adds nothing.
    """
    found = materialize(find(docs), "found")
    written = written_text(found)
    least = least_steps(found, written)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(ENCODINGS)
        for batch in batches:
            rows, c = _columns(batch.column("candidates"))
            steps = evidence(written, c["encoding"], c["n"], c["chi"], c["changes"], c["rejected"])
            needed = np.array([least.get(k, MOST_STEPS + 1) for k in length_class(c["n"]).tolist()], np.int64)
            out = [[(KINDS[s["kind"]], s["start"], s["stop"], None) for s in base] for base in batch.column("base").to_pylist()]
            for k in np.flatnonzero(steps >= needed):
                own, start, stop = out[rows[k]], int(c["start"][k]), int(c["stop"][k])
                if not any(s <= start and stop <= e for _, s, e, _ in own):
                    own.append((KINDS[3], start, stop, names[c["encoding"][k]]))
            for own in out:
                own.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            fields = ("kind", "start", "stop", "encoding")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([[dict(zip(fields, s)) for s in own] for own in out], kind)], names=["doc_id", "spans"]
            )

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("encoding", pa.string())]))
    schema = "doc_id long, spans array<struct<kind: string, start: long, stop: long, encoding: string>>"
    return found.select("doc_id", "base", "candidates").mapInArrow(run, schema)


def summarize(found: DataFrame) -> DataFrame:
    """Counts of each kind, the digest of the patterns' spans, and all spans as text."""
    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count(KINDS[3]),
    )

"""SentencePiece encoding and decoding through a relational lattice.

A text is normalised as the model says (a space in front, spaces written as U+2581) and falls into units that no piece
crosses: spaces with the letters or with the other characters that follow, or a line feed (loading a table checks that
its pieces keep to that). Each distinct unit of the corpus is encoded once:

1. its substrings of at most the longest piece's length are exploded and joined to the piece table;
2. the matches are edges from a start to an end with a score; those of a unit stay together;
3. a fold turns the edges into ids. ``viterbi``, for unigram tables, goes with ``aggregate`` over the edges in order of
   their ends, keeps the best score and last edge for each end, and walks back; of equal scores the edge that starts
   first wins. ``merges``, for tables of merged pairs, starts from single characters and takes, again and again, the edge
   with the best score (then the first) that joins two neighbours; scores of such tables are ranks, and their best sum
   is not the model's encoding. It folds the edges of many units at once, a merge of each in a step (numpy on Arrow batches).

Characters without a piece become their UTF-8 bytes.

Way back to the documents: units of a bounded dictionary of frequent ones are encoded where the document stands; the
others are joined. The result has a row for each *segment*: a maximal run of frequent units, or one other unit. The
segments of a document in order of ``seg`` are its ids. So no text is shuffled, and no row is larger than a document.

* Null and empty texts give one segment without ids. Repeated rows give repeated segments. An empty table gives none.
* Only id and text are read, so other columns may have any names; ids are whole numbers or text, other types raise.
* Units of over ``LONG`` characters are folded over the same edges in Python, in time in proportion to their length.
* Decoding gives the text back, but for U+2581 itself, which decodes to a space as in the model's library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.llm.common import bound
from shopgrain.llm.vocabulary import count_units, frequent
from shopgrain.session import materialize

SPACE = "▁"
UNIT = regex.compile(r"▁*\p{L}+|▁*[^\p{L}▁\n]+|▁+|\n")
WORD = re.compile(" *[^ ]+| +")
LONG = 1_000
PART = 20_000  # units
EDGES = 500_000  # folded at once
CACHE = 200_000  # words
GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """A piece table: text and score of pieces by id, and the ids of the 256 bytes."""

    table: dict[int, tuple[str, float]]
    byte_ids: tuple[int, ...]
    size: int

    @property
    def longest(self) -> int:
        return max(len(piece) for piece, _ in self.table.values())

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.table.values()) - UNKNOWN_PENALTY

    def raw(self) -> list[bytes]:
        """What each id decodes to."""
        out = [b""] * self.size
        for i, (piece, _) in self.table.items():
            out[i] = piece.replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        return out


def load_pieces(model_file: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    byte_ids = tuple(i for i in range(size) if model.is_byte(i))
    if len(byte_ids) != 256:
        raise ValueError("the piece table needs the 256 bytes as fallback")
    usual = (i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    table = {i: (model.id_to_piece(i), model.get_score(i)) for i in usual}
    if not all(UNIT.fullmatch(piece) for piece, _ in table.values()):
        raise ValueError("pieces that cross units are not supported")
    return Pieces(table, byte_ids, size)


def words_of(text: str | None) -> list[str]:
    """What stands between single spaces; further spaces stay in front of a word."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [word[1:] for word in WORD.findall(" " + text)]
    return text.split(" ")


def units_of(word: str) -> list[str]:
    """The units of a word and the space before it."""
    if word.isascii() and word.isalpha():
        return [SPACE + word]
    return UNIT.findall(SPACE + word.replace(" ", SPACE))


class WordCodes(dict):
    """Ids of words, as bytes, from those of their units; None for words with a unit that is not among the known."""

    def __init__(self, known: dict[str, bytes]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= CACHE:
            self.clear()
        parts = [self.known.get(unit) for unit in units_of(word)]
        self[word] = code = None if None in parts else b"".join(parts)
        return code

    def parts_of(self, word: str) -> list[bytes | str]:
        """Ids of runs of known units, and the other units."""
        units = units_of(word)
        if len(units) == 1:
            return [self.known.get(units[0], units[0])]
        parts: list[bytes | str] = []
        for unit in units:
            code = self.known.get(unit)
            if code is not None and parts and isinstance(parts[-1], bytes):
                parts[-1] += code
            else:
                parts.append(unit if code is None else code)
        return parts

    def runs(self, text: str | None) -> list[bytes | str]:
        """The segments of a text: ids of a run of known units, or else one other unit."""
        words = words_of(text)
        codes = list(map(self.__getitem__, words))
        out: list[bytes | str] = []
        run: list[bytes] = []
        at = 0
        for _ in range(codes.count(None)):
            end = codes.index(None, at)
            run += codes[at:end]
            for part in self.parts_of(words[end]):
                if isinstance(part, bytes):
                    run.append(part)
                    continue
                if run:
                    out.append(b"".join(run))
                    run = []
                out.append(part)
            at = end + 1
        run += codes[at:]
        return [*out, b"".join(run)] if run or not out else out


def matches_of(units: DataFrame, pieces: Pieces) -> DataFrame:
    """Substrings of units that are pieces, with start ``s``, length ``l``, id and score, and all single characters.

    The rows of a unit come one after another, by start and length: the explosion and the broadcast join keep the order.
    """
    spark = units.sparkSession
    table = spark.createDataFrame(
        pd.DataFrame([(p, i, s) for i, (p, s) in pieces.table.items()], columns=["piece", "id", "score"]),
        "piece string, id int, score double",
    )
    # The units are dealt out once; neither the explosion nor the join with the bounded piece table moves them again.
    # A part holds so few that its edges are sorted in memory.
    parts = max(1, -(-units.count() // PART))
    n = F.length("unit")
    starts = units.select("unit").repartition(parts, "unit").select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))
    substrings = starts.select("unit", "s", F.explode(lengths).alias("l"))
    substrings = substrings.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("l")))
    return substrings.join(F.broadcast(table), "piece", "left").where(F.col("id").isNotNull() | (F.col("l") == 1))


def edges_of(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The lattice of each unit: its edges (end, start, id, score) in order. Unknown characters have id -1 - start."""
    edge = F.struct(
        (F.col("s") + F.col("l")).alias("e"), "s", F.coalesce("id", -1 - F.col("s")).alias("id"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )
    return matches_of(units, pieces).groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges: Column) -> Column:
    """The ids on the best path; edges come in order of end and start, and every end has one."""
    start = F.struct(
        F.array(F.lit(0.0)).alias("best"), F.array().cast("array<struct<s:int,id:int>>").alias("back"),
        F.lit(1).alias("e"), F.lit(-1).alias("s"), F.lit(-1).alias("id"), F.lit(float("-inf")).alias("v"),
    )

    def step(a: Column, x: Column) -> Column:
        moved = x["e"] > a["e"]
        value = x["score"] + F.when(moved & (x["s"] == a["e"]), a["v"]).otherwise(F.get(a["best"], x["s"]))
        better = moved | (value > a["v"])
        return F.struct(
            F.when(moved, F.concat(a["best"], F.array(a["v"]))).otherwise(a["best"]).alias("best"),
            F.when(moved, F.concat(a["back"], F.array(F.struct(a["s"], a["id"])))).otherwise(a["back"]).alias("back"),
            x["e"].alias("e"), F.when(better, x["s"]).otherwise(a["s"]).alias("s"),
            F.when(better, x["id"]).otherwise(a["id"]).alias("id"), F.when(better, value).otherwise(a["v"]).alias("v"),
        )

    def walk(a: Column) -> Column:
        back = F.concat(a["back"], F.array(F.struct(a["s"], a["id"])))
        return bound(back, lambda b: F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.struct(F.size(b).alias("at"), F.array().cast("array<int>").alias("ids")),
            lambda w, _: F.when(w["at"] == 0, w).otherwise(F.struct(
                F.get(b, w["at"] - 1)["s"].alias("at"), F.concat(F.array(F.get(b, w["at"] - 1)["id"]), w["ids"]).alias("ids"),
            )),
            lambda w: w["ids"],
        ))

    return F.aggregate(edges, start, step, walk)


def merges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit`` and ``ids`` after all merges; unknown characters have id -1 - start."""
    # A piece is named by its place in the order of scores.
    order = sorted(pieces.table, key=lambda i: -pieces.table[i][1])
    scores = np.array([pieces.table[i][1] for i in order])
    ids, ranks = np.array(order, np.int32), np.concatenate([[0], np.cumsum(np.diff(scores) != 0)])
    place = np.full(pieces.size, -1, np.int32)
    place[ids] = np.arange(len(ids), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def folded(rows: pa.Table) -> pa.RecordBatch:
            names = pa.concat_arrays(rows.column("unit").drop_null().chunks)
            edge = rows.column("edge").to_numpy()
            first = rows.column("unit").is_valid().to_numpy()
            if not np.all(first[1:] | (edge[1:] >> 32 > edge[:-1] >> 32)):
                raise RuntimeError("the edges of a unit came out of order")
            s, l, i = (edge >> 44).astype(np.int32), (edge >> 32).astype(np.int32) & 0xFFF, edge.astype(np.int32) - 1
            found, counts = merged(first, s, l, np.where(i >= 0, i, -1 - s), np.where(i >= 0, ranks[place[np.maximum(i, 0)]], 0))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(offsets), pa.array(found))], ["unit", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES:
                rows = pa.Table.from_batches(held)
                end = int(np.flatnonzero(rows.column("unit").is_valid().to_numpy())[-1])  # the last unit may go on
                held, size = rows.slice(end).to_batches(), rows.num_rows - end
                if end:
                    yield folded(rows.slice(0, end))
        if held:
            yield folded(pa.Table.from_batches(held))

    # Start, length and id go in one number, and a unit with its first row.
    s, l = F.col("s").cast("long"), F.col("l").cast("long")
    rows = matches_of(units, pieces).select(
        (F.shiftleft(s, 44) + F.shiftleft(l, 32) + F.coalesce(F.col("id") + 1, F.lit(0))).alias("edge"),
        F.when((F.col("s") == 0) & (F.col("l") == 1), F.col("unit")).alias("unit"),
    )
    return rows.mapInArrow(run, "unit string, ids array<int>")


def merged(first: np.ndarray, s: np.ndarray, l: np.ndarray, ids: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units one after another, and how many each has, from the edges of whole units, which begin at ``first``.

    Each step joins two neighbours in every unit: by its edge of the best rank, then the first.
    """
    unit = np.cumsum(first) - 1
    single = l == 1
    n = np.bincount(unit[single])
    base = np.concatenate([[0], np.cumsum(n + 1)])  # one more place for the end of each unit
    start = base[unit] + s
    alive, after, at = np.ones(base[-1], bool), np.arange(1, base[-1] + 1), np.zeros(base[-1], np.int32)
    at[start[single]] = ids[single]
    pairs = np.flatnonzero(~single)
    if len(pairs):
        width = int(s.max()) + 1
        pairs = pairs[np.argsort((unit[pairs] * (int(ranks.max()) + 1) + ranks[pairs]) * width + s[pairs], kind="stable")]
    S, E, U, C = start[pairs], start[pairs] + l[pairs], unit[pairs], ids[pairs]
    while len(S):
        middle = after[S]
        hits = np.flatnonzero(after[middle] == E)
        if not len(hits):
            break
        best = hits[np.concatenate([[True], U[hits[1:]] != U[hits[:-1]]])]
        alive[middle[best]] = False
        after[S[best]], at[S[best]] = E[best], C[best]
        going = np.zeros(len(n), bool)
        going[U[best]] = True
        kept = going[U] & alive[S] & alive[E] & (after[S] < E)
        S, E, U, C = S[kept], E[kept], U[kept], C[kept]
    alive[base[1:] - 1] = False
    places = np.flatnonzero(alive)
    return at[places], np.bincount(np.repeat(np.arange(len(n)), n + 1)[places], minlength=len(n))


def viterbi_of_long(edges: pd.Series) -> pd.Series:
    """The same over the same edges, for long units."""
    out = []
    for rows in edges:
        best, back = {0: 0.0}, {}
        for x in rows:
            value = best[x["s"]] + x["score"]
            if x["e"] not in best or value > best[x["e"]]:
                best[x["e"]], back[x["e"]] = value, (x["s"], x["id"])
        ids, at = [], max(best)
        while at:
            at, i = back[at]
            ids.append(i)
        out.append(ids[::-1])
    return pd.Series(out)


def merges_of_long(edges: pd.Series) -> pd.Series:
    """The same over the same edges, for long units: a queue holds the edges that join two neighbours."""
    out = []
    for rows in edges:
        ids = {(x["s"], x["e"]): x["id"] for x in rows}
        scores = {(x["s"], x["e"]): x["score"] for x in rows}
        n = max(e for _, e in ids)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        queue: list[tuple[float, int, int, int]] = []

        def offer(s: int) -> None:
            middle = after[s]
            if middle < n and (s, after[middle]) in ids:
                heapq.heappush(queue, (-scores[s, after[middle]], s, middle, after[middle]))

        for s in range(n - 1):
            offer(s)
        while queue:
            _, s, middle, e = heapq.heappop(queue)
            if before[middle] == s and after[s] == middle and after[middle] == e:
                after[s], before[middle] = e, -9
                if e <= n - 1:
                    before[e] = s
                offer(s)
                if s:
                    offer(before[s])
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        out.append([ids[c] for c in zip(cuts, cuts[1:])])
    return pd.Series(out)


FOLDS = {
    "viterbi": (lambda units, pieces: edges_of(units, pieces).select("unit", viterbi(F.col("edges")).alias("ids")), viterbi_of_long),
    "merges": (merges, merges_of_long),
}


def with_bytes(unit: Column, ids: Column, byte_ids: tuple[int, ...]) -> Column:
    """Unknown characters as ids of their bytes."""
    known = F.array(*map(F.lit, byte_ids))

    def expanded(i: Column) -> Column:
        digits = F.hex(F.encode(F.substring(unit, -i, 1), "UTF-8"))
        return F.when(i >= 0, F.array(i)).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)),
            lambda k: F.get(known, F.conv(F.substring(digits, k, 2), 16, 10).cast("int")),
        ))

    return F.when(F.exists(ids, lambda i: i < 0), F.flatten(F.transform(ids, expanded))).otherwise(ids)


def encode_units(units: DataFrame, pieces: Pieces, fold: str = "merges", long_from: int = LONG) -> DataFrame:
    """``unit`` and ``ids`` of distinct units."""
    of_short, of_long = FOLDS[fold]
    short = of_short(units.where(F.length("unit") <= long_from), pieces)
    long = edges_of(units.where(F.length("unit") > long_from), pieces).withColumn(
        "ids", F.pandas_udf(of_long, "array<int>")("edges")
    )
    both = short.select("unit", "ids").unionByName(long.select("unit", "ids"))
    return both.select("unit", with_bytes(F.col("unit"), F.col("ids"), pieces.byte_ids).alias("ids"))


def _segments(documents: DataFrame, frequent_ids, others: bool) -> DataFrame:
    """Either the runs of frequent units with their ids, or the other units."""
    shape = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    id_type = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(frequent_ids.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, segs, values = [], [], []
                for row, text in enumerate(part.column(1)):
                    for seg, found in enumerate(codes.runs(text.as_py())):
                        if isinstance(found, str) == others:
                            rows.append(row)
                            segs.append(seg)
                            values.append(found)
                if others:
                    last = pa.array(values, pa.string())
                else:
                    offsets = np.zeros(len(values) + 1, dtype=np.int32)
                    np.cumsum([len(v) // 4 for v in values], out=offsets[1:])
                    flat = pa.array(np.frombuffer(b"".join(values), dtype=np.int32))
                    last = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(segs, pa.int32()), last],
                    ["doc_id", "seg", "unit" if others else "ids"],
                )

    if id_type not in shape:
        raise TypeError(f"doc_id of type {id_type}")
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, seg int, " + ("unit string" if others else "ids array<int>")
    )


def codes_of(encoded: DataFrame) -> dict[str, bytes]:
    """Ids of units as bytes. They come to the driver as Arrow arrays: rows and lists of numbers take many times the memory."""
    out = {}
    for batch in encoded.select("unit", "ids").toArrow().to_batches():
        lengths = batch.column(1).value_lengths().to_numpy()
        flat = batch.column(1).flatten().to_numpy().astype(np.int32).tobytes()
        ends = 4 * np.cumsum(lengths)
        for unit, start, end in zip(batch.column(0), (ends - 4 * lengths).tolist(), ends.tolist()):
            out[unit.as_py()] = flat[start:end]
    return out


def encode(
    documents: DataFrame, model_file: str, fold: str = "merges", frequent_units: int = 200_000,
) -> DataFrame:
    """Segments of all documents: doc_id, seg, ids."""
    spark: SparkSession = documents.sparkSession
    pieces = load_pieces(model_file)
    counts = materialize(count_units(documents.select("text"), words_of, units_of), "units")
    # A part's units fit in a hash map, so their edges need not be sorted.
    before = spark.conf.get(GROUPS)
    spark.conf.set(GROUPS, str(2 * PART))
    try:
        encoded = materialize(encode_units(counts, pieces, fold), "encoded")
    finally:
        spark.conf.set(GROUPS, before)
    chosen = frequent(counts, frequent_units).select("unit")
    known = spark.sparkContext.broadcast(codes_of(encoded.join(chosen, "unit", "left_semi")))  # at most frequent_units rows
    runs = _segments(documents, known, others=False)
    others = _segments(documents, known, others=True).join(encoded, "unit").select("doc_id", "seg", "ids")
    return runs.unionByName(others)


def decode(segments: DataFrame, model_file: str) -> DataFrame:
    """The text of every segment beside its ids; the space that encoding put in front goes."""
    raw = pa.array(load_pieces(model_file).raw(), pa.large_binary())

    @F.arrow_udf("string")
    def text_of(ids: pa.Array, seg: pa.Array) -> pa.Array:
        # The bytes of all segments stand one after another; each segment is a stretch of them.
        flat = raw.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        _, offsets, data = flat.buffers()
        if len(flat):
            ends = np.frombuffer(offsets, np.int64)[flat.offset:][ends]
        buffers = [None, pa.py_buffer(ends.astype(np.int64)), data or pa.py_buffer(b"")]
        texts = pa.Array.from_buffers(pa.large_string(), len(ids), buffers)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # segments that are not whole characters
            whole = pa.Array.from_buffers(pa.large_binary(), len(ids), buffers)
            texts = pa.array([x.as_py().decode("utf-8", "replace") for x in whole], pa.large_string())
        first = pc.and_(pc.fill_null(pc.equal(seg, 0), False), pc.starts_with(texts, " "))
        return pc.if_else(first, pc.utf8_slice_codeunits(texts, 1), texts).cast(pa.string())

    return segments.withColumn("text", text_of("ids", "seg"))


def joined(segments: DataFrame) -> DataFrame:
    """One row for each document: ids and text of its segments in order."""
    grouped = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg", "ids", "text"))).alias("x"))
    return grouped.select("doc_id", F.flatten("x.ids").alias("ids"), F.array_join("x.text", "").alias("text"))

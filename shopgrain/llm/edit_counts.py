"""Token counts that follow edits.

For every document the pre-tokens stand in buckets, and a segment tree over the buckets holds the sums of code points
and of tokens. An edit finds its place by descending the tree, encodes only pre-tokens from a little before the edit to
where the new pre-token boundaries meet the old ones again, and updates the sums above the buckets it changed.

Why that is exact: the pattern looks at most one character behind the end of a match plus one, and has no look-behind,
so a pre-token that ends three characters before an edit cannot change, and once a new boundary falls on an old one
behind the edit, all later ones do.

* Null and empty texts have no pre-tokens; edits may still insert. Edits apply in array order, each to the text that the
  ones before left; positions are code points, cut to the text; a null edit or null replacement counts as a deletion or
  as nothing. Documents without edits keep their counts. Repeated rows are counted apart.
* Narrow: one document in memory at a time. ``attach_edits`` is the one shuffle, for edits that come as a table.
* ``write_trees`` keeps the buckets of every document beside its text; ``revise_trees`` then applies tables of edits, one
  after the other, and encodes nothing but the regions they touch. Documents are dealt to parts by a hash of their id; only
  parts with an edited document are read and written again.
* Texts of any length are handled whole. An empty table gives no rows. Only the columns named here are read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopgrain.session import materialize

CONTEXT = 3
BUCKET = 64
CACHE = 400_000

EDITS = "array<struct<start:bigint,stop:bigint,replacement:string>>"


class Counts(dict):
    """Tokens of a pre-token; emptied when it grows too large."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = len(self.encode(piece.encode("utf-8", "surrogatepass")))
        return n


@lru_cache(maxsize=2)
def tokenizer(file: str, pattern: str) -> tuple[Callable[[str], list[str]], Counts]:
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern).findall, Counts(encoding._encode_single_piece)


class TokenTree:
    """Buckets of (length, tokens) pairs under a complete binary tree of sums."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.lengths = [lengths[i: i + BUCKET] for i in range(0, len(lengths), BUCKET)] or [[]]
        self.tokens = [tokens[i: i + BUCKET] for i in range(0, len(tokens), BUCKET)] or [[]]
        self._build()

    @classmethod
    def kept(cls, lengths: list[list[int]], tokens: list[list[int]]) -> TokenTree:
        """The tree over buckets that were stored."""
        tree = cls([], [])
        tree.lengths, tree.tokens = lengths or [[]], tokens or [[]]
        tree._build()
        return tree

    def _build(self) -> None:
        self.width = 1 << max(0, len(self.lengths) - 1).bit_length()
        self.chars_in = np.zeros(2 * self.width, dtype=np.int64)
        self.tokens_in = np.zeros(2 * self.width, dtype=np.int64)
        self.chars_in[self.width: self.width + len(self.lengths)] = [sum(b) for b in self.lengths]
        self.tokens_in[self.width: self.width + len(self.tokens)] = [sum(b) for b in self.tokens]
        step = self.width
        while step > 1:
            for sums in (self.chars_in, self.tokens_in):
                sums[step // 2: step] = sums[step: 2 * step].reshape(-1, 2).sum(1)
            step //= 2

    @property
    def n_chars(self) -> int:
        return int(self.chars_in[1])

    @property
    def n_tokens(self) -> int:
        return int(self.tokens_in[1])

    def find(self, position: int) -> tuple[int, int, int]:
        """Bucket, index in it and start of the pre-token that holds a position (the last one, if behind the end)."""
        node, start = 1, 0
        position = min(position, max(self.n_chars - 1, 0))
        while node < self.width:
            node *= 2
            if position - start >= self.chars_in[node]:
                start += int(self.chars_in[node])
                node += 1
        bucket = min(node - self.width, len(self.lengths) - 1)
        ends = list(accumulate(self.lengths[bucket]))
        index = min(bisect_right(ends, position - start), max(len(ends) - 1, 0))
        return bucket, index, start + (ends[index - 1] if index else 0)

    def replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], tokens: list[int]) -> None:
        """Put new pre-tokens in place of those from ``first`` up to ``last`` (bucket and index, exclusive)."""
        (a, i), (b, j) = first, last
        self.lengths[a: b + 1] = [self.lengths[a][:i] + lengths + self.lengths[b][j:]]
        self.tokens[a: b + 1] = [self.tokens[a][:i] + tokens + self.tokens[b][j:]]
        if a != b or len(self.lengths[a]) > 2 * BUCKET:
            whole, counted = self.lengths[a], self.tokens[a]
            parts = range(0, max(len(whole), 1), BUCKET)
            self.lengths[a: a + 1] = [whole[k: k + BUCKET] for k in parts]
            self.tokens[a: a + 1] = [counted[k: k + BUCKET] for k in parts]
            if len(parts) != b - a + 1:
                self._build()
                return
        for bucket in range(a, b + 1):
            self._update(bucket)

    def _update(self, bucket: int) -> None:
        node = self.width + bucket
        self.chars_in[node], self.tokens_in[node] = sum(self.lengths[bucket]), sum(self.tokens[bucket])
        while node > 1:
            node //= 2
            for sums in (self.chars_in, self.tokens_in):
                sums[node] = sums[2 * node] + sums[2 * node + 1]


def build_tree(text: str, split, counts: Counts) -> TokenTree:
    pieces = split(text)
    return TokenTree(list(map(len, pieces)), list(map(counts.__getitem__, pieces)))


def apply_edit(text: str, tree: TokenTree, start: int, stop: int, new: str, split, counts: Counts) -> tuple[str, int]:
    """The edited text and how many pre-tokens were encoded; the tree then fits the new text."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    edited = text[:start] + new + text[stop:]
    shift = len(new) - (stop - start)
    if not text:
        pieces = split(edited)
        tree.replace((0, 0), (0, 0), list(map(len, pieces)), list(map(counts.__getitem__, pieces)))
        return edited, len(pieces)
    bucket, index, begin = tree.find(max(0, start - CONTEXT))
    # Old boundaries behind the edit, found bucket by bucket as the new ones reach them.
    end_bucket, end_index, old = bucket, index, begin
    lengths: list[int] = []
    tokens: list[int] = []
    at, reach = begin, 256
    while True:
        window = edited[at: at + reach]
        whole = at + reach >= len(edited)
        pieces = split(window)
        if not whole:
            pieces = pieces[:-2]  # what lies behind the window may still change the last ones
            if not pieces:
                reach *= 4
                continue
        met = False
        for piece in pieces:
            lengths.append(len(piece))
            tokens.append(counts[piece])
            at += len(piece)
            while old < at - shift and end_bucket < len(tree.lengths):
                if end_index < len(tree.lengths[end_bucket]):
                    old += tree.lengths[end_bucket][end_index]
                    end_index += 1
                else:
                    if end_bucket + 1 == len(tree.lengths):
                        break
                    end_bucket, end_index = end_bucket + 1, 0
            if old == at - shift and old >= stop:
                met = True
                break
        if met or at >= len(edited):
            break
    if at >= len(edited):
        end_bucket, end_index = len(tree.lengths) - 1, len(tree.lengths[-1])
    tree.replace((bucket, index), (end_bucket, end_index), lengths, tokens)
    return edited, len(lengths)


def recount(df: DataFrame, file: str, pattern: str) -> DataFrame:
    """Counts before and after ``edits`` (an array of start, stop, replacement) for rows of doc_id, text, edits."""

    id_type = dict(df.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = tokenizer(file, pattern)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                tree = build_tree(text, split, counts)
                before, pieces = tree.n_tokens, sum(map(len, tree.lengths))
                n_edits = encoded = 0
                for edit in edits.as_py() or ():
                    if edit is not None and edit["start"] is not None:
                        stop = edit["start"] if edit["stop"] is None else edit["stop"]
                        text, n = apply_edit(text, tree, edit["start"], stop, edit["replacement"] or "", split, counts)
                        n_edits, encoded = n_edits + 1, encoded + n
                out.append((n_edits, pieces, before, encoded, sum(map(len, tree.lengths)), tree.n_tokens, len(text)))
            columns = zip(*out) if out else [()] * (len(NAMES) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], NAMES)

    return df.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(
        run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in NAMES[1:])
    )


NAMES = ["doc_id", "n_edits", "n_pretokens", "n_tokens", "n_encoded", "n_pretokens_after", "n_tokens_after", "n_chars_after"]


def attach_edits(documents: DataFrame, edits: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """Documents with their rows of an edit table (doc_id, seq, start, stop, replacement) as an array in order of seq."""
    entry = F.struct("seq", "start", "stop", "replacement")
    ordered = F.sort_array(F.collect_list(entry))
    plain = F.transform(ordered, lambda x: F.struct(x["start"], x["stop"], x["replacement"]))
    grouped = edits.groupBy("doc_id").agg(plain.cast(EDITS).alias("edits"))
    return documents.select(*columns).join(grouped, "doc_id", "left")


def revisions(documents: DataFrame) -> DataFrame:
    """Three edits for every document, placed by a hash of its id: a word written over, a passage added, a cut."""
    def place(salt: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(F.length("text"), F.lit(1)).cast("long"))

    def edit(salt: int, width: int, text: str):
        start = place(salt)
        return F.struct(start.alias("start"), (start + width).alias("stop"), F.lit(text).alias("replacement"))

    return documents.select("doc_id", "text", F.array(
        edit(1, 6, "revised"), edit(2, 0, "\n\nIt's an added passage, 2nd draft.  "), edit(3, 9, ""),
    ).cast(EDITS).alias("edits"))


STORED = "doc_id long, text string, lengths array<array<int>>, tokens array<array<int>>, part int"
REVISED = "n_edits long, n_encoded long, n_tokens long, n_tokens_after long, n_chars_after long"


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def write_trees(documents: DataFrame, path: str, file: str, pattern: str, parts: int = 256) -> None:
    """Store text and buckets of every document under ``path``, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = tokenizer(file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                trees = [build_tree(text.as_py() or "", split, counts) for text in rows.column("text")]
                nested = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), rows.column("text"), pa.array([t.lengths for t in trees], nested),
                    pa.array([t.tokens for t in trees], nested), rows.column("part"),
                ], ["doc_id", "text", "lengths", "tokens", "part"])

    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn("part", _part(parts))
    rows.mapInArrow(run, STORED).hint("rebalance", "part").write.partitionBy("part").parquet(path)


def revise_trees(spark: SparkSession, path: str, edits: DataFrame, file: str, pattern: str, parts: int = 256) -> DataFrame:
    """Apply a table of edits (doc_id, seq, start, stop, replacement) to stored documents; returns the counts of those edited.

    ``parts`` is that of ``write_trees``. Rows that repeat an id are all edited. Edits of unknown or null ids have no effect.
    """
    edits = edits.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "start", "stop", "replacement").where("doc_id is not null")
    touched = [r["part"] for r in edits.select(_part(parts).alias("part")).distinct().collect()]  # at most ``parts``
    stored = spark.read.schema(STORED).parquet(path).where(F.col("part").isin(touched))
    joined = attach_edits(stored, edits, ["doc_id", "text", "lengths", "tokens", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = tokenizer(file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for row in batch.slice(at, 200).to_pylist():
                    tree, text, n_edits, encoded = TokenTree.kept(row["lengths"], row["tokens"]), row["text"], 0, 0
                    before = tree.n_tokens
                    for edit in row["edits"] or ():
                        if edit["start"] is not None:
                            stop = edit["start"] if edit["stop"] is None else edit["stop"]
                            text, n = apply_edit(text or "", tree, edit["start"], stop, edit["replacement"] or "", split, counts)
                            n_edits, encoded = n_edits + 1, encoded + n
                    out.append(row | {
                        "text": text, "lengths": tree.lengths, "tokens": tree.tokens, "edited": row["edits"] is not None, "n_edits": n_edits,
                        "n_encoded": encoded, "n_tokens": before, "n_tokens_after": tree.n_tokens, "n_chars_after": len(text or ""),
                    })
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in shape.names} for r in out], shape)

    nested = pa.list_(pa.list_(pa.int32()))
    numbers = [(name.split()[0], pa.int64()) for name in REVISED.split(", ")]
    shape = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("lengths", nested), ("tokens", nested), ("part", pa.int32()), ("edited", pa.bool_()), *numbers,
    ])
    revised = materialize(joined.mapInArrow(run, f"{STORED}, edited boolean, {REVISED}"), "revised")
    stored_again = revised.select("doc_id", "text", "lengths", "tokens", "part").hint("rebalance", "part")
    stored_again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return revised.where("edited").select("doc_id", *[name for name, _ in numbers])

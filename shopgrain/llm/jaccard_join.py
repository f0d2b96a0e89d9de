"""N-gram Jaccard join: documents whose shingle sets are similar enough, as classes of documents.

Candidates come from PartEnum signatures (``partenum``): sets that are similar enough share one. The steps:

1. Every text becomes a set of 64-bit hashes of word n-grams; texts of equal sets are one *class*, identified by a hash
   of the set, before anything is compared. A third of all rows being copies costs one row here.
2. Signatures that occur in two classes or more are found by an aggregation that combines before its shuffle; only
   those, few, are kept as pairs (signature, class).
3. Rounds of stars: each signature has one pivot class, another in each round, and its other classes are compared with
   that. Linked classes are merged into components, and signatures whose classes are all in one component are done. So
   a large group of near copies is never expanded into all its pairs.
4. What is left: in each signature, the classes outside its main component are compared with those of other
   components. After that every pair that shares a signature is either compared or inside one component: no link is
   lost.

Comparing: a parity sketch (1,024 bits, each flipped by the elements that hash to it; for large sets a second one of
16,384 bits) bounds the symmetric difference of two sets from below, so unlinked pairs are ruled out exactly, but for
few, before their sets are made; all others are intersected.

* Texts that are null, empty or without words have an empty set and are linked with nothing; fewer words than an n-gram
  are one shingle. A null doc_id is linked with nothing and has a null component.
* Rows that repeat an id are one document; if their texts differ, it is linked by any of them.
* Texts are never shuffled while the classes that share a signature number less than ``BROADCAST``: their ids are then
  broadcast to the scan (16 bytes each); above it they are joined by shuffle.
* Texts of any length are compared whole. Ids must be numbers (a text that is none fails in the cast). Only id and text are
  read; ``keep_one`` carries other columns, whatever their names. An empty table gives an empty result.
* Hashes have 64 bits: classes and shingles are taken as equal if their hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.partenum import Similarity, mixed, signatures
from shopgrain.operators import lookup_join
from shopgrain.session import discard, materialize, release, staged

SKETCH_WORDS, WIDE_WORDS = 16, 256
LARGE = 500  # sets of more elements have the wide sketch too
BROADCAST = 1_000_000
CACHE = 500_000
SLICES = 8  # of the signatures, counted one after the other, so that the shuffle of one is gone before the next


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of word n-grams, A to Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # at x20 and x09 to x0D, as bytes do
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    last = len(h) - width + 1
    grams = np.full(last, width, np.uint64)
    for k in range(width):
        grams = mixed(grams) + h[k: k + last]
    return np.unique(mixed(grams))


def class_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def sketch_of(grams: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of the elements at each of ``64 * words`` places, as longs."""
    bits = 64 * words
    place = (mixed(grams + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _per_text(documents: DataFrame, n: int, make, fields: dict[str, pa.DataType], chunk: int) -> DataFrame:
    """One row of ``make(doc_id, grams)`` for each text."""
    names = {pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = [make(i.as_py(), shingles(t.as_py(), n, hashes)) for i, t in zip(part.column(0), part.column(1))]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), fields.values())]
                yield pa.RecordBatch.from_arrays(columns, list(fields))

    schema = ", ".join(f"{name} {names[kind]}" for name, kind in fields.items())
    return documents.select("doc_id", "text").mapInArrow(run, schema)


LONG, LONGS = pa.int64(), pa.list_(pa.int64())


def described_texts(documents: DataFrame, n: int, similarity: Similarity) -> DataFrame:
    """doc_id, n (size of the set), class and sigs of every text; rows without id have no signatures."""
    none = np.zeros(0, np.int64)

    def make(doc_id, grams):
        found = none if doc_id is None else signatures(grams, similarity).view(np.int64)
        return doc_id, len(grams), class_of(grams), found

    return _per_text(documents, n, make, {"doc_id": LONG, "n": LONG, "class": LONG, "sigs": LONGS}, 500)


def sketches(documents: DataFrame, n: int) -> DataFrame:
    def make(doc_id, grams):
        wide = sketch_of(grams, WIDE_WORDS) if len(grams) > LARGE else None
        return class_of(grams), len(grams), sketch_of(grams), wide

    return _per_text(documents, n, make, {"class": LONG, "n": LONG, "sketch": LONGS, "wide": LONGS}, 200)


def whole_sets(documents: DataFrame, n: int) -> DataFrame:
    def make(doc_id, grams):
        return class_of(grams), grams.view(np.int64)

    return _per_text(documents, n, make, {"class": LONG, "grams": LONGS}, 200)


def only(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Rows with (or without) a key; the keys are broadcast only while they are few."""
    few = keys.limit(BROADCAST + 1).count() <= BROADCAST
    return df.join(F.broadcast(keys) if few else keys, on, how)


def allowed(similarity: Similarity, n: Column, m: Column) -> Column:
    """The largest symmetric difference of linked sets."""
    return F.floor((n + m) * (similarity.bottom - similarity.top) / (similarity.bottom + similarity.top) + 1e-9)


def may_link(similarity: Similarity, a: str, b: str) -> Column:
    """False only for pairs that are not linked; reads sizes and sketches."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    different = F.lit(0)
    for k in range(SKETCH_WORDS):
        different = different + F.bit_count(F.get(F.col(f"{a}.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{b}.sketch"), F.lit(k))))
    return (different <= allowed(similarity, n, m)) & (F.least(n, m) * similarity.bottom >= F.greatest(n, m) * similarity.top)


def wide_may_link(similarity: Similarity) -> Column:
    """The same by the wide sketches of large sets."""
    n, m = F.col("x.n"), F.col("y.n")
    different = F.aggregate(
        F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k
    )
    return F.coalesce(different <= allowed(similarity, n, m), F.lit(True))


def verified(
    pairs: DataFrame, documents: DataFrame, ids: DataFrame, sketched: DataFrame, n: int, similarity: Similarity,
) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of classes; ``ids`` names a document of each class."""
    x, y = sketched.alias("x"), sketched.alias("y")
    on_x, on_y = F.col("a") == F.col("x.class"), F.col("b") == F.col("y.class")
    small = sketched.select("class", "n", "sketch")
    pairs = (
        pairs.join(small.alias("x"), on_x).join(small.alias("y"), on_y).where(may_link(similarity, "x", "y"))
        .select("a", "b")
    )
    pairs = before = materialize(pairs, "pairs")
    large = sketched.where(F.col("wide").isNotNull()).select("class", "n", "wide")
    x, y = large.alias("x"), large.alias("y")
    pairs = pairs.join(x, on_x, "left").join(y, on_y, "left").where(wide_may_link(similarity)).select("a", "b")
    pairs = materialize(pairs, "pairs")
    discard(before)
    named = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = materialize(ids.join(named, "class"), "wanted")
    sets = whole_sets(only(documents, wanted.select("doc_id").distinct(), "doc_id"), n)
    sets = materialize(only(sets, wanted.select("class"), "class").dropDuplicates(["class"]), "sets")
    both = pairs.join(sets.alias("x"), on_x).join(sets.alias("y"), on_y)
    shared = F.size(F.array_intersect("x.grams", "y.grams"))
    union = F.size("x.grams") + F.size("y.grams") - shared
    links = materialize(both.where(similarity.bottom * shared >= similarity.top * union).select("a", "b"), "links")
    for table in (sets, wanted, pairs):
        discard(table)
    return links


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it reaches, by smallest labels of neighbours and pointer jumping."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = lower.join(further, "label", "left").select("node", F.coalesce(F.least("far", "label"), "label").alias("label"), "old")
        step = materialize(step, "labels")
        discard(labels)
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            discard(both)
            return labels


def merged(components_of: DataFrame, links: DataFrame) -> DataFrame:
    """Classes and their components after new links."""
    named = components_of.select(F.col("class").alias("a"), F.col("component").alias("ca"))
    other = components_of.select(F.col("class").alias("b"), F.col("component").alias("cb"))
    edges = links.join(named, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    labels = components(edges.where("a <> b"))
    renamed = components_of.join(labels.withColumnRenamed("node", "component"), "component", "left")
    return materialize(renamed.select("class", F.coalesce("label", "component").alias("component")), "components")


def open_members(members: DataFrame, components_of: DataFrame) -> DataFrame:
    """Members of signatures whose classes are not yet in one component, with the signature's main component, written once.

    Signatures of many classes are split by the lookup join.
    """
    rows = materialize(members.join(components_of, "class"), "members")
    counts = rows.groupBy("sig", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("sig").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("sig", F.col("most.component").alias("main"))
    found = materialize(lookup_join(rows, main, "sig").where(F.col("main").isNotNull()), "open")
    discard(rows)
    return found


def shared_signatures(rows: DataFrame) -> DataFrame:
    """The distinct rows (sig, class) whose signature occurs in two classes or more, written."""
    members = None
    for part in range(SLICES):
        own = rows.where(F.pmod(F.col("sig"), F.lit(SLICES)) == part)
        shared = own.groupBy("sig").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
        shared = materialize(shared.select("sig"), "shared")
        found = materialize(only(own, shared, "sig").distinct(), "signatures")
        discard(shared)
        members = found if members is None else members.unionByName(found)
        release(rows.sparkSession)
    return members


def link_classes(
    documents: DataFrame, members: DataFrame, classes: DataFrame, n: int, similarity: Similarity, rounds: int = 3,
) -> DataFrame:
    """``class`` and ``component`` of the classes that share a signature with another one, from ``shared_signatures``."""
    named = members.select("class").distinct()
    ids = materialize(classes.join(named, "class").select(F.col("rep").alias("doc_id"), "class"), "candidates")
    found = sketches(only(documents, ids.select("doc_id"), "doc_id"), n)
    sketched = materialize(only(found, ids.select("class"), "class").dropDuplicates(["class"]), "sketches")
    components_of = materialize(named.select("class", F.col("class").alias("component")), "components")
    for step in range(rounds):
        release(documents.sparkSession)
        rows = open_members(members, components_of)
        pivots = rows.groupBy("sig").agg(F.min(F.struct(F.xxhash64("class", F.lit(step)).alias("h"), "class", "component")).alias("p"))
        pairs = lookup_join(rows, pivots, "sig").where("component <> p.component").select(
            F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")
        ).distinct()
        links = verified(pairs, documents, ids, sketched, n, similarity)
        discard(rows)
        if links.limit(1).count():
            components_of = merged(components_of, links)
    release(documents.sparkSession)
    rows = materialize(open_members(members, components_of).join(sketched.select("class", "n", "sketch"), "class"), "open")
    left, right = rows.where("component <> main").alias("x"), rows.alias("y")
    pair = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.main")) | (F.col("x.class") < F.col("y.class"))
    )
    pairs = left.join(right, (F.col("x.sig") == F.col("y.sig")) & pair & may_link(similarity, "x", "y")).select(
        F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")
    ).distinct()
    links = verified(pairs, documents, ids, sketched, n, similarity)
    return merged(components_of, links) if links.limit(1).count() else components_of


def join(documents: DataFrame, n: int = 5, similarity: Similarity = Similarity(4, 5)) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reached by links) of every document row.

    Everything that is staged on the way is deleted; the result is written.
    """
    with staged(documents.sparkSession):
        return materialize(_joined(documents, n, similarity), "joined", outlive=True)


def _joined(documents: DataFrame, n: int, similarity: Similarity) -> DataFrame:
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(described_texts(documents, n, similarity), "signed")
    described = materialize(signed.drop("sigs"), "classes")
    filled = described.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("class").agg(F.min("doc_id").alias("rep")), "reps")
    # Rows that repeat an id with another text link their classes.
    twice = filled.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    members = shared_signatures(signed.select(F.explode("sigs").alias("sig"), "class"))
    discard(signed)  # larger than the texts
    linked = link_classes(documents, members, classes, n, similarity)
    release(documents.sparkSession)
    whole = classes.join(linked, "class", "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    if twice.limit(1).count():
        repeated = filled.join(twice.select("doc_id", F.col("a").alias("first")), "doc_id").select(F.col("first").alias("a"), F.col("class").alias("b"))
        whole = classes.join(merged(whole.select("class", "component"), repeated), "class")
    whole = materialize(whole, "linked")
    smallest = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(whole.join(smallest, "component").select("class", "component_id"), "named")
    joined = described.select("doc_id", "n", "class").join(named, "class", "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(documents: DataFrame, n: int = 5, similarity: Similarity = Similarity(4, 5)) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id. Rows without id stay."""
    found = join(documents, n, similarity)
    release(documents.sparkSession)  # what the join shuffled goes before the documents are written
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = only(documents, dropped, "doc_id", "left_anti")
    twice = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return kept
    return only(kept, twice, "doc_id", "left_anti").unionByName(only(kept, twice, "doc_id").dropDuplicates(["doc_id"]))

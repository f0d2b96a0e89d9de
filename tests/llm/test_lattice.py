import random

import pytest

from shopgrain.llm import lattice as l
from shopgrain.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "Hello world, the thing\nof é 漢字 and 🙂", "naïve   spaces  x\n\n y ", "", None, " ", "the the of and",
    "tab\there\r\nnull\x00", "ab" * 700 + " tail", "x",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def round_trip(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, seg int")
    return {r.doc_id: r for r in l.joined(l.decode(l.encode(docs, MODEL, **options), MODEL)).collect()}


@pytest.mark.parametrize("frequent_units", [0, 3, 10_000])
def test_ids_are_the_library_s_and_texts_come_back(spark, library, frequent_units):
    got = round_trip(spark, list(enumerate(TEXTS)), frequent_units=frequent_units)
    for i, text in enumerate(TEXTS):
        assert list(got[i].ids) == library.encode(text or "")
        assert got[i].text == (text or "")


def test_all_documents(spark, library, smallest_dir):
    docs = spark.read.parquet(f"{smallest_dir}/documents.parquet").select("doc_id", "text").collect()
    got = round_trip(spark, [tuple(r) for r in docs], frequent_units=500)
    assert len(got) == len(docs)
    for i, text in docs:
        assert list(got[i].ids) == library.encode(text) and got[i].text == text


def best_score(unit, scores, unknown):
    best = [0.0] + [float("-inf")] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - 16), e):
            score = scores.get(unit[s:e], unknown if e - s == 1 else float("-inf"))
            best[e] = max(best[e], best[s] + score)
    return best[-1]


def test_viterbi_path_has_the_best_score(spark):
    draw = random.Random(8)
    alphabet = "abcd"
    table = {k: ("".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 5))), -draw.randrange(1, 30) / 1.0) for k in range(60)}
    scores = {}
    table = {300 + k: (p, s) for k, (p, s) in table.items() if not (p in scores or scores.update({p: s}))}
    pieces = l.Pieces(table, tuple(range(256)), 400)
    units = list({"".join(draw.choice(alphabet + "é") for _ in range(draw.randrange(1, 14))) for _ in range(150)})
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for long_from in (l.LONG, 0):
        for r in l.encode_units(df, pieces, "viterbi", long_from).collect():
            raw = pieces.raw()
            assert b"".join(raw[i] for i in r.ids).decode() == r.unit
            known = sum(table[i][1] for i in r.ids if i in table)
            unknown = sum(c not in scores for c in r.unit if c not in scores and not any(True for _ in ()))
            n_bytes = sum(i < 256 for i in r.ids)
            # Unknown characters are single bytes but for the accented one, which is two.
            n_unknown = n_bytes - sum(1 for k in range(len(r.ids) - 1) if r.ids[k] == 0xC3)
            assert known + n_unknown * pieces.unknown_score == pytest.approx(best_score(r.unit, scores, pieces.unknown_score))
            assert unknown >= n_unknown


@pytest.mark.parametrize("fold", ["viterbi", "merges"])
def test_long_units_fold_alike(spark, fold):
    draw = random.Random(9)
    pieces = l.load_pieces(MODEL)
    units = ["▁" + "".join(draw.choice("thein.") for _ in range(draw.randrange(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in set(units)], "unit string")
    short = {r.unit: r.ids for r in l.encode_units(df, pieces, fold).collect()}
    long = {r.unit: r.ids for r in l.encode_units(df, pieces, fold, long_from=0).collect()}
    assert short == long and len(short) == len(set(units))


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert l.encode(docs, MODEL).count() == 3
    assert l.encode(docs.limit(0), MODEL).count() == 0


def merged_one_by_one(unit, scores):
    cuts = list(range(len(unit) + 1))
    while True:
        joins = [(-scores[unit[s:e]], s, m) for s, m, e in zip(cuts, cuts[1:], cuts[2:]) if unit[s:e] in scores]
        if not joins:
            return [unit[s:e] for s, e in zip(cuts, cuts[1:])]
        cuts.remove(min(joins)[2])


def test_merges_of_many_units_at_once(spark, monkeypatch):
    """Ties go to the first edge; units that cross the borders of what is folded at once stay whole."""
    monkeypatch.setattr(l, "EDGES", 7)
    draw = random.Random(10)
    scores = {c: -99.0 for c in "abc"}
    while len(scores) < 40:
        scores["".join(draw.choice("abc") for _ in range(draw.randrange(2, 5)))] = -float(draw.randrange(8))
    table = {300 + k: item for k, item in enumerate(scores.items())}
    pieces = l.Pieces(table, tuple(range(256)), 400)
    units = {"".join(draw.choice("abcé🙂") for _ in range(draw.randrange(1, 14))) for _ in range(300)}
    got = l.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces)
    rows = got.collect()
    assert {r.unit for r in rows} == units and len(rows) == len(units)
    for r in rows:
        expected = []
        for part in merged_one_by_one(r.unit, scores):
            ids = [i for i, (piece, _) in table.items() if piece == part]
            expected += ids or list(part.encode())
        assert list(r.ids) == expected, r.unit


def test_segments_that_are_not_whole_characters_are_decoded(spark):
    pieces = l.load_pieces(MODEL)
    first, second = (pieces.byte_ids[x] for x in "é".encode())
    space = next(i for i, (piece, _) in pieces.table.items() if piece == l.SPACE)
    rows = [(1, 0, [space, first, second]), (1, 1, [space, first]), (2, 0, [second]), (3, 0, []), (4, 1, [space])]
    df = spark.createDataFrame(rows, "doc_id long, seg int, ids array<int>")
    got = {(r.doc_id, r.seg): r.text for r in l.decode(df.coalesce(1), MODEL).collect()}
    assert got == {(1, 0): "é", (1, 1): " �", (2, 0): "�", (3, 0): "", (4, 1): " "}


def test_runs_of_words_with_known_and_other_units():
    codes = l.WordCodes({"▁a": b"1111", "▁b": b"2222", ".": b"3333"})
    assert codes.runs("a b a.") == [b"11112222" + b"11113333"]
    assert codes.runs("a x. b. zz") == [b"1111", "▁x", b"3333" + b"22223333", "▁zz"]
    assert codes.runs(None) == codes.runs("") == [b""]


def test_ids_of_frequent_units_come_as_arrow(spark):
    df = spark.createDataFrame([("▁a", [1, 2]), ("b", [3])], "unit string, ids array<int>").repartition(2)
    assert l.codes_of(df) == {"▁a": bytes([1, 0, 0, 0, 2, 0, 0, 0]), "b": bytes([3, 0, 0, 0])}

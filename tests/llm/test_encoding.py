"""Token counts and encoding against the tokenizer library itself, run as a unigram model."""

import random
from collections import Counter

import pytest
import sentencepiece

from tabulens.llm import piece_lattice, token_count, vocabulary

TEXTS = [
    None, "", " ", "a", "Hello  world", "\n", "x\ny\n\nz ", "  two  spaces ", "tab\there", "123 4.5e6", "don't stop", "漢字 kanji ☃ snow", "ñandú ÉCOLE straße", "$$$ *** &&& ###", "token = \"24be64439e\"",
    "emoji 😀😀 end", "▁literal mark", "a" * 70, "the " * 50, "Thntblere of then, edtioner in inea that esly ndstnd", "ﬁ ligature", "ê̂ combining",
]


def texts():
    rng = random.Random(3)
    alphabet = "aabcdehinorst  \n.,-É漢9$▁"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(150)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=vocabulary.as_unigram())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts())], "doc_id long, text string, n_tokens int").repartition(3)


def test_counts_are_the_librarys(docs, library):
    rows = {r["doc_id"]: r for r in token_count.token_counts(docs).collect()}
    for i, t in enumerate(texts()):
        assert rows[i]["n_tokens"] == len(library.encode(t or "")), repr(t)
        assert (rows[i]["n_chars"], rows[i]["n_bytes"]) == (len(t or ""), len((t or "").encode()))


def test_ids_are_the_librarys_and_decode_to_the_text(docs, library):
    rows = {r["doc_id"]: r for r in piece_lattice.encoded_corpus(docs).collect()}
    assert len(rows) == len(texts())
    for i, t in enumerate(texts()):
        assert rows[i]["ids"] == library.encode(t or ""), repr(t)
        if "▁" not in (t or ""):  # the mark of a space, written out, is read as a space
            assert rows[i]["round_trip"], repr(t)


def test_long_texts_and_repeated_rows(spark, library):
    text = " ".join(random.Random(1).choice(["thention", "of", "eaou", "Anwh.", "ñaé"]) for _ in range(20000))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "b"), (None, "c d")], "doc_id long, text string")
    counts = sorted(r["n_tokens"] for r in token_count.token_counts(docs).collect())
    words = sum(len(library.encode(w)) for w in text.split(" "))
    assert counts == sorted([words, words, len(library.encode("b")), len(library.encode("c d"))])
    got = sorted(len(r["ids"]) for r in piece_lattice.encode(docs).collect())
    assert got == counts


def test_every_unit_of_the_test_tables(spark, library):
    """Ids and counts of each distinct unit are what the library gives for it alone, and short texts' as a whole."""
    known = vocabulary.load()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = piece_lattice.corpus_units(texts, known)
    counter = token_count.Counter(known)
    every = Counter(u for r in texts.collect() if r["text"] for u in counter.split("▁" + r["text"].replace(" ", "▁")))
    assert {r["unit"]: r["count"] for r in found.collect()} == every
    rows = piece_lattice.unit_ids(found, known).collect()
    assert len(rows) > 50_000
    # The library puts a mark of space before a text: a unit has it already, or else is asked for behind a line end.
    for r in rows:
        unit = r["unit"]
        want = library.encode(unit[1:].replace("▁", " ")) if unit[0] == "▁" else library.encode("\n" + unit)[len(library.encode("\n")) :]
        assert (r["ids"], counter[unit]) == (want, len(want)), unit
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(texts).collect()}
    got = {r["doc_id"]: r for r in piece_lattice.encoded_corpus(texts).collect()}
    assert {i: r["n_pieces"] for i, r in got.items()} == counts
    short = 0
    for r in texts.collect():
        if len(r["text"] or "") < 2000 and "▁" not in (r["text"] or ""):  # longer texts' sums leave the range that single precision holds exactly
            short += 1
            assert got[r["doc_id"]]["ids"] == library.encode(r["text"] or "")
    assert short > 100


def test_units_beyond_the_broadcast(spark, library, monkeypatch):
    """Whatever is broadcast, nothing or all, the ids are the same; so they are for units longer than a block, and for copies."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(500 + i, "rareword " * 3 + "andother" * 200) for i in range(4)] + [(None, "the ab" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (0, 300, 1 << 25):
        monkeypatch.setattr(piece_lattice, "COMMON_BYTES", size)
        got = {r["doc_id"]: r["ids"] for r in piece_lattice.encode(docs).collect()}
        assert len(got) == len(rows)
        for i, t in rows[:-1]:
            assert got[i] == library.encode(t or ""), repr(t)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.token_counts(none).count() == piece_lattice.encoded_corpus(none).count() == 0


@pytest.mark.parametrize("n", [100_000, 1_000_000])
def test_units_without_end(spark, n):
    """One unit of very many characters, of few pieces and of many, known and unknown: as many pieces as the count of operator 4 finds, and the text again."""
    rng = random.Random(n)
    rows = [(0, "a" * n), (1, "ab c" * 3), (2, "".join(rng.choice("thentionsé") for _ in range(n // 4))), (3, "漢☃" * (n // 40)), (4, "=" * (piece_lattice.BLOCK + 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs).collect()}
    got = piece_lattice.encoded_corpus(docs).select("doc_id", "n_pieces", "round_trip").collect()
    assert {r["doc_id"]: r["n_pieces"] for r in got} == want and all(r["round_trip"] for r in got)


def test_both_ways_give_the_same(spark, monkeypatch):
    """Units cut into windows of a few places have the ids of whole ones."""
    known = vocabulary.load()
    found = piece_lattice.corpus_units(spark.createDataFrame([(t,) for t in texts()], "text string"), known)
    want = {r["unit"]: r["ids"] for r in piece_lattice.unit_ids(found, known).collect()}
    monkeypatch.setattr(piece_lattice, "BLOCK", 5)
    assert {r["unit"]: r["ids"] for r in piece_lattice.unit_ids(found, known).collect()} == want

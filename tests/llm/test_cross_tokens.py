"""Alignment of two tokenizers against the libraries and a slow search of overlaps."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabulens.llm import cross_tokens, queries

SCHEMA = "doc_id long, text string, groups string, batch long, n_a string"


def texts():
    rng = random.Random(8)
    words = ["the", "of", "Thention", "ndedti", "über", "漢字", "don't", "42", "3.14", "<|endoftext|>", "</s>", "<0x41>", "x" * 40, "😀", ",", "...", " ", "é", "naïve", "\t", "  "]
    fixed = [None, "", " ", "  ", "a", " a", "a ", "\n", "\r\n x", "▁", "a▁b", "<s>", "\u0000", "é", " ", "the the the", "=" * 3000, "ﬁ"]
    return fixed + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(120)] + ["the cat, the dog"] * 5


def token_bytes():
    a = Tokenizer.from_file(cross_tokens.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=cross_tokens.B_PATH)
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    code, n = {}, 0
    for x in range(256):
        code[chr(x) if x in plain else chr(256 + n)] = x
        n += x not in plain
    def of_b(i):
        t = b.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode()
    return (lambda t: [(i, bytes(code[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]), (lambda t: [(i, of_b(i)) for i in b.encode(t)])


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def slow(rows):
    side_a, side_b = token_bytes()
    links, found, counts = [], [], Counter()
    for _, t in rows:
        a, b = (side(t) if t else [] for side in (side_a, side_b))
        if t and not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
            a, b = [], []
        a, b = spans(a), spans(b)
        own = [(i, j) for s, e, i in a for u, v, j in b if s < v and u < e]
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = ";".join(",".join(str(i) for s, e, i in a if low < e <= high) + "|" + ",".join(str(j) for s, e, j in b if low < e <= high) for low, high in zip([0, *ends], ends))
        counts.update(set(own))
        links.append(own)
        found.append((len(a), len(b), len(ends), len(own), groups))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = [(d, *f[:4], sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), f[4]) for (d, _), f, own in zip(rows, found, links)]
    return out, counts, best


@pytest.mark.parametrize(("size", "pairs", "rows_"), [(2 << 20, 1 << 21, 128), (300, 40, 2)])
def test_alignment_is_that_of_slow_search(spark, monkeypatch, size, pairs, rows_):
    for name, v in (("BYTES", size), ("PAIRS", pairs), ("ROWS", rows_)):
        monkeypatch.setattr(cross_tokens, name, v)
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "the of"), (None, "the of"), (None, None)]
    docs = spark.createDataFrame([(i, t, "g", 1, "n") for i, t in rows], SCHEMA).repartition(3)
    want, counts, best = slow(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, cross_tokens.align(docs).collect()), key=key) == sorted(want, key=key)
    got = cross_tokens.align(docs, digest=True).collect()
    digests = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in want]
    assert sorted(map(tuple, got), key=key) == sorted(digests, key=key)
    table = cross_tokens.pair_counts(docs).collect()
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in table} == {p: (n, n == best[p[0]]) for p, n in counts.items()}
    assert len(table) == len(counts)


def test_long_texts_are_encoded_as_a_whole(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice(["thention", "of", "  two", "3.5", "漢字", "x\ny", "(a", "don't", " z"])
    rows = [(k, " ".join(word() for _ in range(4000))) for k in range(3)] + [(9, "y" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, cross_tokens.align(docs).collect()))
    a = Tokenizer.from_file(cross_tokens.A_PATH)
    assert [r[1] for r in whole] == [len(a.encode(" " + t, add_special_tokens=False).ids) for _, t in rows]
    for run in (1, 3):
        monkeypatch.setattr(cross_tokens, "RUN", run)
        assert sorted(map(tuple, cross_tokens.align(docs).collect())) == whole


def test_units_are_those_of_the_libraries(monkeypatch):
    """Encoded many at once, one by one because one of them does not fit, or by themselves: ids are those of each unit alone."""
    known = cross_tokens.Tokenizers(*(cross_tokens.read_file(p) for p in (cross_tokens.A_PATH, cross_tokens.B_PATH)))
    units = ["the", "of", " x", "y ", "a▁b", "x\ny", "z" * 300, "漢字", "<s>", "\u00a0q", "<|endoftext|>"]
    for k in range(2):
        if k:  # nothing fits
            monkeypatch.setattr(cross_tokens.np, "isin", lambda *a: cross_tokens.np.zeros(1, bool))
        sides, good = known.units(units)
        assert [units[i] for i in range(len(units)) if not good[i]] == ["a▁b"]
        for (ids, start, size), encode in zip(sides, (lambda u: known.a.encode(" " + u, add_special_tokens=False).ids, known.b.encode), strict=True):
            assert [ids[s : s + n].tolist() for s, n in zip(start, size, strict=True)] == [encode(u) for u in units]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert cross_tokens.align(none).count() == cross_tokens.pair_counts(none).count() == 0


def test_query_over_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_cross_tokens(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    a, b = token_bytes()
    totals = {r["doc_id"]: r for r in got.collect()}
    assert len(totals) == len(rows)
    for i, t in rows:
        n_a, n_b = (len(side(t)) if t else 0 for side in (a, b))
        assert (totals[i]["n_a"], totals[i]["n_b"], totals[i]["n_links"]) == (n_a, n_b, n_a + n_b - totals[i]["n_groups"])

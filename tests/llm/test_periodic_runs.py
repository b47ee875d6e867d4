"""Periodic runs against a brute-force search of every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tabulens.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, least=12):
    """Of every stretch of constant distance-q equality that cannot grow: kept if q is its smallest period."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e - s >= max(least - q, q) and all(words[s + d : e + q] != words[s : e + q - d] for d in range(1, q)):
                out.append((s, e + q - s, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def cases():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a b " * 6, " a b" * 5 + " a", "\x0b".join("abcabd" * 9), "é ß " * 10 + "x", "\x1c  y" * 13, "x" * 5000]
    for n in (5, 30, 90):
        for k in (1, 2, 3, 5):
            out += [" ".join(rng.choice("abcde"[:k]) for _ in range(rng.randrange(n // 2, n))) for _ in range(25)]
    for _ in range(80):  # planted stretches, side by side, within each other, at the ends, and two words off
        parts = []
        for _ in range(rng.randrange(1, 5)):
            root = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] * rng.choice((1, 2, 3))
            parts += [rng.choice("uvwxyz") for _ in range(rng.choice((0, 0, 3, 9)))] + (root * rng.randrange(2, 7))[: rng.randrange(4, 60)]
        out.append(" ".join(parts))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    out += [" ".join(fib[-1]), " ".join("ab"[bin(i).count("1") % 2] for i in range(300)), " ".join("a" * 300)]
    return out


def check(rows, texts):
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        want = slow_runs(words)
        assert [tuple(r) for r in rows[i]["runs"]] == want, repr(t)
        assert rows[i]["collapsed"] == collapse(words, want), repr(t)


def test_runs_are_those_of_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, start int, runs string").repartition(3)
    check({r["doc_id"]: r for r in periodic_runs.find_runs(docs).collect()}, texts)


@pytest.mark.parametrize(("size", "visits"), [(1, 8), (400, 1 << 21)])
def test_texts_in_small_parts(spark, monkeypatch, size, visits):
    monkeypatch.setattr(periodic_runs, "BYTES", size)
    texts = cases()[::7]
    b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(b).collect()}
    check(found, texts)
    monkeypatch.setattr(periodic_runs, "VISITS", visits)
    words = np.array([1, 2, 3] * 30 + [1] * 20)
    assert periodic_runs.word_runs(words, np.zeros(110, np.int64)).tolist() == [[s, s + n, q] for s, n, q in slow_runs(words.tolist())]


def test_long_text_repeated_rows_and_no_rows(spark):
    rng = random.Random(2)
    head = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    root = [f"r{rng.randrange(10**6)}" for _ in range(30_001)]
    text = " ".join(head + root * 3 + ["end"] + ["x"] * 50_000)
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b c d e f " * 2), (None, None)], "doc_id long, text string")
    got = sorted(([tuple(r) for r in x["runs"]] for x in periodic_runs.find_runs(docs).collect()), key=len)
    assert got == [[], [(0, 12, 6)], *[[(40_000, 90_003, 30_001), (130_004, 50_000, 1)]] * 2]
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, tmp_path):
    texts = [t for t in cases() if t is None or len(t) < 300][:250]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"w{j}" for j in range(i * 7 % 90))) for i in range(300)] + [(None, "a b " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for i, t in rows:
        words = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        runs = slow_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapse(words, runs))
    assert changed > 20

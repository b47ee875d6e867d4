"""Votes against a slow exact search, and the same scores however rows lie."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tabulens.llm import knn_quality


def corpus(seed=3, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlué", k=rng.randrange(2, 9)))
    rows = []
    for i in range(n):
        text = " ".join(word().upper() + "$" if i % 4 == 0 else word() for _ in range(rng.randrange(1, 60)))
        rows.append((i, text))
        if i % 3 == 0:  # ids that several texts share
            rows += [(i, text + " " + word()), (i, rng.choice([None, "", "ab", text]))]
    return rows + [(None, "no id"), (n + 1, "x" * 100_000)]


def frames(spark, rows, parts):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    labels = [(i, int(i % 4 != 0)) for i in range(0, 320, 2)] + [(4, 1), (8, None), (None, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), labels


def test_scores_are_those_of_a_slow_vote(spark):
    rows = corpus()
    docs, labels, marked = frames(spark, rows, 5)
    voters = knn_quality.fit(docs, labels)
    marks = defaultdict(list)
    for i, q in marked:
        if i is not None and q is not None:
            marks[i].append(q)
    have = {i for i, _ in rows}
    learned = sorted(i for i in marks if i in have and not knn_quality_held(i))
    assert voters.labels.tolist() == [sum(marks[i]) / len(marks[i]) for i in learned]
    vectors = [v.astype(np.float64).tolist() for v in voters.vectors]
    got = defaultdict(list)
    for r in knn_quality.quality(docs, labels).collect():
        got[r["doc_id"]].append(r["score"])
    want = defaultdict(list)
    for i, text in rows:
        x = knn_quality.trigrams(text)
        if not x.any():
            want[i].append(voters.prior)
            continue
        z = voters.latent(x[None])[0].astype(np.float64).tolist()
        near = sorted(((sum(a * b for a, b in zip(z, v, strict=True)), -k) for k, v in enumerate(vectors)), reverse=True)[: knn_quality.VOTERS]
        votes = [(max(c / knn_quality.STEPS**2, 0) + 1e-6, voters.labels[-k]) for c, k in near]
        want[i].append(sum(w * y for w, y in votes) / sum(w for w, _ in votes))
    assert set(got) == set(want)
    for i in want:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), abs=1e-9)


def knn_quality_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_reruns_agree_where_texts_share_an_id(spark):
    rows = corpus()
    found = []
    for seed, parts in ((1, 3), (2, 7)):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        docs, labels, _ = frames(spark, mixed, parts)
        found.append(sorted(map(tuple, knn_quality.quality(docs, labels).collect()), key=repr))
    assert found[0] == found[1]


def test_labels_without_a_document_take_no_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(knn_quality, "SAMPLE", 20)
    docs, labels, _ = frames(spark, corpus(), 3)
    more = labels.unionByName(spark.range(10_000, 12_000).selectExpr("id AS doc_id", "1 AS quality"))
    assert len(knn_quality.fit(docs, more).labels) == 20


def test_letters_are_told_apart():
    a, b = (knn_quality.trigrams(t) for t in ("The physicist measured, with care, the orbit of Mars.", "Tmu bmzxodoxk nuixavuf, tokm divu, kmu evpok eg Mivx."))
    assert a @ b < 0.5

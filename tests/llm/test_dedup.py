"""Exact, near and substring dedup, and links between embeddings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tabulens.llm import common, e8_neardup, exact_dedup, simhash_ball, unit_dedup

SCHEMA = "doc_id long, text string, Digest string, key long, keep_id long"


def fold(text):
    return (text or "").encode().lower().decode()


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda b: b[:1]], ids=["sha256", "colliding"])
def test_exact_dedup(spark, digest):
    rng = random.Random(5)
    texts = ["Hot copy É"] * 40 + ["hot COPY É"] * 20 + ["hot copy é", "", None, "é", "É", "x" * 200_000, "X" * 200_000] + [rng.choice(["a", "A", "ab", "Ab", "abc", "b"]) for _ in range(60)]
    rows = [(i, t, "d", i, 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), digest).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(fold(t), []).append(i)
    for i, t in enumerate(texts):
        own = groups[fold(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
        assert bytes(got[i]["digest"]) == digest(fold(t).encode())


def test_keep_unique_has_rows_whole(spark):
    rows = [(1, "a", "d", 1, 1), (1, "a", "d", 1, 1), (1, "b", "e", 2, 2), (2, "A", "f", 3, None), (3, None, None, None, None), (None, "", "g", 4, 4), (None, "z", "h", 5, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.keep_unique(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[2], rows[3], rows[4], rows[6]]))
    twice = spark.createDataFrame([rows[0], rows[0]], SCHEMA)
    assert [tuple(r) for r in exact_dedup.keep_unique(twice).collect()] == [rows[0]]


def slow_fingerprint(text):
    words = [w for w in fold(text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "one two", "One  TWO\tthree", "Élan élan ÉLAN a b", "a b c d e a b c", "x y z w v"] + [" ".join(random.Random(i).choices("abcdefg", k=i)) for i in range(60)]
    for t in texts:
        assert simhash_ball.fingerprint(t) == slow_fingerprint(t), repr(t)
    # A shingle's hash is Spark's own, too.
    assert spark.sql("SELECT xxhash64('one two three') AS h").first()["h"] % 2**64 == xxhash.xxh64(b"one two three", seed=42).intdigest()


def test_near_duplicates(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(60, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "one", "One", texts[0], texts[0]]
    rng.shuffle(texts)
    rows = [(i * 3, t, "d", 1, 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash_ball.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows}
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == fps
    assert len(set(want.values())) < len(want) - 10
    kept = simhash_ball.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and len(kept.columns) == 5


def test_links_of_fingerprints(spark):
    rng = random.Random(2)
    fps = {0, 2**63, 2**64 - 1, 1, 3, 7}
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1 << rng.randrange(64), x ^ 3 << rng.randrange(63), x ^ 7 << rng.randrange(60)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash_ball.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert components(fps, got) == components(fps, every)


def test_components(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    mixed = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    edges = path + star + mixed + [(5, 5), (-3, -9), (1, 0)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    assert len(np.unique(e8_neardup.ROOTS, axis=0)) == 240 and ((e8_neardup.ROOTS**2).sum(axis=1) == 2).all()
    x = rng.standard_normal((200, 8)) * 3
    c = e8_neardup.decode_e8(x)
    twice = np.rint(2 * c).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1)).all() and (c.sum(axis=1) % 2 == 0).all()
    # No neighbour of the point is nearer, which for E8 makes it the nearest of all.
    d = ((x - c) ** 2).sum(axis=1)
    near = ((x[:, None] - c[:, None] - e8_neardup.ROOTS) ** 2).sum(axis=2).min(axis=1)
    assert (d <= near + 1e-9).all() and d.max() <= 1 + 1e-9


def planted(rng, groups, noise):
    out = []
    for _ in range(groups):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        for _ in range(rng.integers(2, 6)):
            v = base + rng.standard_normal(64) / 8 * noise
            out.append(v * rng.uniform(0.5, 2))
    return out


def test_embedding_links_are_found(spark):
    rng = np.random.default_rng(9)
    vectors = [v.astype(np.float32) for noise in (0.05, 0.2, 0.3, 0.33) for v in planted(rng, 60, noise)] + [rng.standard_normal(64).astype(np.float32) for _ in range(300)]
    rows = [(i * 2 + 1, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in e8_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    y = np.stack([v.astype(np.float64) for v in vectors])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    found, there = sum(r["n_links"] for r in got.values()), int(close.sum())
    assert there > 1000 and found >= 0.97 * there, (found, there)
    for i in range(len(vectors)):
        assert got[2 * i + 1]["n_links"] <= close[i].sum()
    # Whatever is connected in truth is, where all links are well above the threshold.
    tight = close & (y @ y.T >= 0.96)
    pairs = [(2 * a + 1, 2 * b + 1) for a, b in zip(*np.nonzero(tight), strict=True)]
    for n, c in components(got, pairs).items():
        assert got[n]["component_id"] <= c
        assert got[n]["kept"] == (got[n]["component_id"] == n)


def test_embedding_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [1.0, 2.0] + [0.5] * 62, [-x for x in [1.0, 2.0] + [0.5] * 62]
    rows = [(5, v), (3, v), (9, [2 * x for x in v]), (4, w), (1, None), (2, []), (6, [0.0] * 64), (7, [nan] * 64), (8, [inf] + [1.0] * 63), (10, [None] + [1.0] * 63), (None, v), (11, [1.0, 2.0]), (12, v), (12, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in e8_neardup.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 7, 8, 10, 11)]
    assert got == sorted([(-1, 0, None, False), (3, 4, 3, True), (5, 4, 3, False), (9, 4, 3, False), (12, 4, 3, False), (12, 4, 3, False), *alone])
    assert e8_neardup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_finite_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.1e200]), (3, [5e-324, 5e-324]), (4, [1e-200, 1.05e-200]), (5, [-1e200, 1e200])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e8_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


@pytest.mark.parametrize("size", [0, 1])
@pytest.mark.parametrize(("low", "high", "least"), [(0.9, 0.92, 0.9), (0.92, 0.95, 0.97)])
def test_recall_by_cosine(size, low, high, least):
    """Pairs of each band meet in some table, whatever the number of vectors that the tables are for."""
    _, tables, lattices = e8_neardup.SIZES[size]
    rng = np.random.default_rng(5)
    n = 1200
    a, b = e8_neardup.unit(rng.standard_normal((n, 64))), rng.standard_normal((n, 64))
    b = e8_neardup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(low, high, (n, 1))
    lattice = e8_neardup.Lattice.of(64, tables, lattices)
    x, y = lattice.codes(a), lattice.codes(c * a + np.sqrt(1 - c * c) * b)
    met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2))
    assert met.mean() >= least, met.mean()


def test_embedding_blocks_count_once(spark, monkeypatch):
    """A cell of many sub-blocks gives the same counts as brute force."""
    monkeypatch.setattr(e8_neardup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    y = np.stack([base + 0.05 * rng.standard_normal(64) for _ in range(150)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(y)]
    got = e8_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
    assert {r["component_id"] for r in got} == {0}


def slow_repeats(rows):
    """(row, start, end, first's doc_id, first's start); rows of one doc_id, or of none, go by the hash that Spark gives their texts."""
    mark = lambda t: 42 if t is None else (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, mark(rows[k][1])))
    first, gone = {}, []
    for k in order:
        i, t = rows[k]
        for s, e, _, d in sorted(unit_dedup.units(t or ""), key=lambda u: u[0]):
            if d in first:
                gone.append((k, s, e, *first[d]))
            else:
                first[d] = (i, s)
    left = [g for g in gone if not any(o[0] == g[0] and o[1] <= g[1] and g[2] <= o[2] and o[1:3] != g[1:3] for o in gone)]
    return Counter((rows[k][0], *g) for k, *g in left)


@pytest.mark.parametrize("hot", [1, 4096])
def test_units_of_rows_that_share_a_doc_id(spark, monkeypatch, hot):
    monkeypatch.setattr(unit_dedup, "HOT", hot)
    line, other, third = "one line of some words here", "quite another line of words", "and a third one of them"
    rows = [(0, line), (1, other), (5, line), (5, f"x\n{other}"), (None, third), (None, f"y\n{third}"), (None, f"{third}\nz"), (7, line), (7, line), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "d", 1, 1) for i, t in rows], SCHEMA).repartition(4)
    got = Counter((r["doc_id"], r["start"], r["end"], r["keep_id"], r["keep_start"]) for r in unit_dedup.repeats(docs).collect())
    assert got == slow_repeats(rows)
    assert got[5, 2, 2 + len(other), 1, 0] == 1 and got[7, 0, len(line), 0, 0] == 2 and sum(n for (i, *_), n in got.items() if i is None) == 2
    left = Counter((r["doc_id"], r["text"]) for r in unit_dedup.remove(docs).collect())
    assert sum(left.values()) == len(rows) and left[5, "x\n"] == 1 and left[5, ""] == 1 and left[7, ""] == 2 and left[0, line] == left[None, None] == 1


def test_units_cover_whole_sentences():
    text = "One two three four five six seven eight. And a b c d e f g h i!\nshort line\n A B C D E F G H I j "
    found = [(text[s:e], n) for s, e, n, _ in unit_dedup.units(text)]
    assert found[0] == (text.split("\n")[0], 18) and found[1] == ("One two three four five six seven eight. ", 8) and found[2][0].startswith("And a b")
    a, b = (next(iter(unit_dedup.units(x)))[3] for x in ("A, b c d e f g: H!", "  a b c d  e f g h"))
    assert a == b == hashlib.sha256(b"a b c d e f g h").digest()[:16]


def test_substring_dedup(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    sentence = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    line = sentence(20)
    rows = []
    for i in range(40):
        parts = [" ".join(sentence(rng.randrange(3, 15)) for _ in range(4)) for _ in range(3)]
        if i % 3 == 0:
            parts[1] += " " + passage + " " + sentence(9)
        if i % 4 == 1:
            parts.insert(1, line.upper() if i % 8 == 1 else line)
        rows.append((100 - i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[0][1]), (300, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "d", 1, 1) for i, t in rows], SCHEMA).repartition(4)
    got = [(r["doc_id"], r["start"], r["end"], r["keep_id"], r["keep_start"]) for r in unit_dedup.repeats(docs).collect()]
    assert Counter(got) == slow_repeats(rows)
    flagged = {i for i, *_ in got}
    with_passage = {i for i, t in rows if t and passage in t}
    assert with_passage - flagged == {min(with_passage)}
    clean = {100 - i for i in range(40) if i % 3 and i % 4 != 1}
    assert not clean & flagged
    cut = {r["doc_id"]: r["text"] for r in unit_dedup.remove(docs).collect()}
    for i, t in rows:
        spots = sorted((s, e) for j, s, e, *_ in got if j == i)
        left = t
        for s, e in reversed(spots):
            left = left[:s] + left[e:]
        assert cut[i] == left
    assert unit_dedup.repeats(docs.limit(0)).count() == 0

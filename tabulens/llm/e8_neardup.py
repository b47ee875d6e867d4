"""Embedding near-dedup by lattice hashing.

Vectors are projected at random to 8-dimensional spaces and decoded there to the nearest point of
the E8 lattice; the points' cells are hash keys, in several tables. Each vector also probes
neighbouring cells, those the nearest to it. Pairs that meet are verified by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, setting

#: Least cosine of a link; neighbouring cells probed; lattice units in a unit of projected distance.
LEAST, PROBES, SCALE = 0.9, 6, 0.65
#: By number of distinct vectors, tables and the lattices whose cells make up a key. A pair whose cosine is just LEAST
#: meets with probability 0.92, one of 0.92 with 0.99, and from 0.95 on all but surely. Unrelated vectors share a cell of a table
#: about once in 2**21 pairs with two lattices, and once in 2**31 with three, which need more tables for the same pairs to meet; so
#: chance meetings of a vector stay within some hundreds up to 2**34 vectors.
SIZES = ((1 << 24, 16, 2), (1 << 62, 80, 3))
#: Most vectors of a cell that meet as one block, and vectors hashed at once.
BLOCK, CHUNK = 1024, 2048


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


ROOTS = roots()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point of whole coordinates with an even sum: if rounding gives an odd sum, the
    coordinate that it moved the farthest goes the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(axis=1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] < 0, -1, 1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: E8 is those points and their copy moved by a half."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    """Projections of one dimension to all tables, drawn from a fixed seed."""

    projections: np.ndarray  # tables, lattices, dimension, 8
    mixers: np.ndarray

    @staticmethod
    def of(dimension: int, tables: int, lattices: int) -> Lattice:
        rng = np.random.default_rng(11)
        return Lattice(rng.standard_normal((tables, lattices, dimension, 8)) * SCALE, rng.integers(1, 1 << 62, (lattices, 8), dtype=np.int64) | 1)

    def codes(self, y: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + PROBES): keys of each vector's own cell and of its probes, as longs.

        Probes change one lattice's point to a neighbour: of all, those to which the vector is nearest.
        """
        tables, lattices = self.projections.shape[:2]
        out = np.empty((len(y), tables, 1 + PROBES), np.int64)
        with np.errstate(over="ignore"):
            steps = [(2 * ROOTS).astype(np.int64) @ m for m in self.mixers]
            for t in range(tables):
                key, gain = np.full(len(y), t, np.int64) * np.int64(0x9E3779B97F4A7C1), []
                for k in range(lattices):
                    x = y @ self.projections[t, k]
                    c = decode_e8(x)
                    key += (2 * c).astype(np.int64) @ self.mixers[k]
                    gain.append((x - c) @ ROOTS.T)
                best = np.argsort(-np.concatenate(gain, axis=1), axis=1, kind="stable")[:, :PROBES]
                out[:, t, 0] = key
                out[:, t, 1:] = key[:, None] + np.concatenate(steps)[best]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, whose square may be out of range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: pa.Array) -> np.ndarray | None:
    x = np.array(vector.as_py() or [np.nan], np.float64) if vector.is_valid and None not in vector.as_py() else np.array([np.nan])
    return x if np.isfinite(x).all() and x.any() else None


def packed(x: np.ndarray) -> bytes:
    """Single precision where it holds the numbers exactly, behind a byte that says which it is."""
    single = x.astype(np.float32)
    return b"f" + single.tobytes() if (single == x).all() else b"d" + x.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, x[:1].decode(), offset=1).astype(np.float64)


def plan(vectors: int) -> tuple[int, int]:
    """Tables and lattices for so many distinct vectors."""
    return next((t, k) for most, t, k in SIZES if vectors <= most)


def hashed(vectors: DataFrame, tables: int, lattices: int) -> DataFrame:
    """(rep, embedding), usable vectors -> (rep, vector binary, codes binary, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for b in batches:
            for k in range(0, len(b), CHUNK):
                part = b.slice(k, CHUNK)
                found = [(i, x) for i, v in enumerate(part.column(1)) if (x := usable(v)) is not None]
                by_size: dict[int, list] = {}
                for i, x in found:
                    by_size.setdefault(len(x), []).append((i, x))
                for d, rows in by_size.items():
                    y = np.stack([x for _, x in rows])
                    codes = made.setdefault(d, Lattice.of(d, tables, lattices)).codes(unit(y)).reshape(len(y), -1) + np.int64(d)
                    at = pa.array([i for i, _ in rows])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array([packed(r) for r in y]), pa.array([c.tobytes() for c in codes]), pa.array(list(codes))], ["rep", "vector", "codes", "keys"]
                    )

    return vectors.mapInArrow(run, "rep long, vector binary, codes binary, keys array<long>")


def block_links(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, codes: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, home: np.ndarray, same: bool) -> list[np.ndarray] | None:
    """Links between the rows left and right of a block of a cell: for each row the number of
    vectors linked, counting a pair only in the first cell in which it meets, and the smallest id
    that links lead to within the block. No pair leaves this function."""
    y = unit(x)
    near = (y[left] @ y[right].T) >= LEAST
    near &= home[left][:, None] | home[right][None, :]
    if same:
        near = np.triu(near, 1)
    i, j = (part[at] for part, at in zip((left, right), np.nonzero(near), strict=True))
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    if not len(i):
        return None
    # A pair that meets in an earlier table, or in both own cells of this one, has been counted once elsewhere.
    fresh = np.ones(len(i), bool)
    for k in range(0, len(i), CHUNK):
        p, q = i[k : k + CHUNK], j[k : k + CHUNK]
        a, b = codes[p, : table + 1], codes[q, : table + 1]
        to_a, to_b = (b == a[:, :, :1]).any(axis=2), (a == b[:, :, :1]).any(axis=2)  # in a's own cell, in b's
        both = to_a[:, table] & to_b[:, table] & (a[:, table, 0] != b[:, table, 0])
        fresh[k : k + CHUNK] = ~(to_a | to_b)[:, :table].any(axis=1) & (~both | (home[p] == (ids[p] < ids[q])))
    n = np.bincount(i, fresh * sizes[j], len(ids)) + np.bincount(j, fresh * sizes[i], len(ids))
    label = ids.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        if (low == label).all():
            break
        label = low
    some = (n > 0) | (label != ids)
    return [ids[some], n[some].astype(np.int64), label[some]]


def links(reps: DataFrame) -> DataFrame:
    """(rep, vector, codes, keys, size) -> (rep, n, label), partial: to be summed and joined up.

    A cell's rows are dealt into sub-blocks of at most BLOCK or so, and each pair of sub-blocks is one
    unit of work, so that a cell that holds a third of all vectors is spread over many tasks and
    bounded in each of them.
    """
    per = 1 + PROBES
    places = reps.select("rep", F.posexplode("keys").alias("at", "key")).selectExpr("rep", f"CAST(at DIV {per} AS INT) AS table", f"at % {per} = 0 AS home", "key")
    cells = places.groupBy("table", "key").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    # A cell without another row, or that is nobody's own, links nothing.
    cells = cells.filter("rows > 1 AND homes > 0").selectExpr("table", "key", f"CAST((rows - 1) DIV {BLOCK} + 1 AS INT) AS blocks")
    met = places.join(cells, ["table", "key"])
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", "table", "home", "key", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    full = met.join(reps.select("rep", "vector", "codes", "size"), "rep")
    dealt = full.repartition("table", "key", "p", "q").sortWithinPartitions("table", "key", "p", "q", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(g: dict, at: slice) -> list[np.ndarray] | None:
            x = np.stack([unpacked(v) for v in g["vector"][at]])
            codes = np.stack([np.frombuffer(v, np.int64) for v in g["codes"][at]]).reshape(len(x), -1, per)
            table, p, q = (g[c][at.start] for c in ("table", "p", "q"))
            left, right = np.flatnonzero(g["mine"][at] == p), np.flatnonzero(g["mine"][at] == q)
            return block_links(g["rep"][at], g["size"][at], x, codes, table, left, right, g["home"][at].astype(bool), p == q)

        def cells(b: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            g = {c: b[c].to_numpy() for c in b.columns}
            found = [out for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1 and (out := work(g, slice(s, e))) is not None]
            if found:
                yield pd.DataFrame(dict(zip(("rep", "n", "label"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            keys = rest[["table", "key", "p", "q"]].to_numpy()
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
            yield from cells(rest, starts)
            rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield from cells(rest, np.array([0, len(rest)]))

    return dealt.mapInPandas(run, "rep long, n long, label long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row for each row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing, and so do
    rows with a null vec_id, whose component_id is null. Vectors of different lengths never link.
    Equal vectors are one class, found by grouping, and always linked; n_links counts all rows
    linked directly, component_id is the smallest vec_id reachable, kept says that it is the row's
    own. A vec_id given to several vectors is one node with the links of all. An empty table gives an
    empty result; other columns are ignored. Links can be missed, though never made up: the share
    of them that is found is measured in the tests.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    batches = lambda: setting(vectors.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)
    good &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.filter("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = cut(classes)
    tables, lattices = plan(classes.count())
    with batches():
        reps = cut(hashed(classes.select("rep", "embedding"), tables, lattices).join(classes.groupBy("rep").agg(F.sum("size").alias("size")), "rep"))
        found = cut(links(reps))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found.selectExpr("rep AS a", "label AS b"))
    per_rep = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = cut(per_rep.select("embedding", F.coalesce("n", F.lit(0)).alias("n"), "size", F.coalesce("component", "rep").alias("component_id")))
    linked = rows.filter("good").join(per_rep, "embedding").select("vec_id", (F.col("n") + F.col("size") - 1).alias("n_links"), "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Exact top-k search by inner product from sorted lists, without random access.

Vectors are dealt into blocks. Each component of a block has its vectors listed from the largest
value down and from the smallest up; a query reads the list in which its products fall. A vector's
score lies between bounds: what has been read of it, with the least that its other components can
give and the most, which is what each list gives where reading stopped. Reading ends once no vector
but a few has an upper bound that reaches the k-th best lower bound; the few get their final scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Vectors of a block and queries that read it together, at most, and blocks that are read one after another by the same queries.
BLOCK, QUERIES, STRIPE = 2048, 1024, 4
#: Components of a block at most, or one vector.
COMPONENTS = 1 << 18
#: Shares of the lists after which bounds are compared, and the share of a block that gets final scores at most before the lists end.
READ, FEW = (1 / 2, 3 / 4, 7 / 8, 1), 1 / 16
LONG = np.iinfo(np.int64)


def packed(rows: DataFrame, group: str) -> DataFrame:
    """(row, vec_id, values array<long>, group) -> blocks of vectors of one group and one length, whose numbers are held in as few bytes as they need."""

    def write(group: int, d: int, parts: list[tuple]) -> pa.RecordBatch:
        row, vec, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(row)
        kind = next(t for t in (np.int16, np.int32, np.int64) if not x.size or np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
        data = [row[order].tobytes(), vec[order].tobytes(), x[order].astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([d], pa.int32()), *(pa.array([v], pa.binary()) for v in data)], ["group", "length", "row", "vec_id", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        last = None  # groups come one after another
        for b in batches:
            groups, sizes = b.column(3).to_numpy(), pc.list_value_length(b.column(2)).to_numpy()
            for g, d in sorted(set(zip(groups.tolist(), sizes.tolist(), strict=True))):
                if g != last:
                    yield from (write(*key, parts) for key, parts in held.items())
                    held, last = {}, g
                at, most = np.flatnonzero((groups == g) & (sizes == d)), max(1, min(BLOCK, COMPONENTS // max(d, 1)))
                while len(at):
                    parts = held.setdefault((g, d), [])
                    take, at = np.split(at, [most - sum(len(p[0]) for p in parts)])
                    part = b.take(pa.array(take))
                    parts.append((part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy().reshape(len(take), d)))
                    if len(at) or sum(len(p[0]) for p in parts) == most:
                        yield write(g, d, held.pop((g, d)))
        yield from (write(*key, parts) for key, parts in held.items())

    dealt = rows.select("row", "vec_id", "values", F.col(group).alias("group")).repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "group long, length int, row binary, vec_id binary, values binary")


def numbers(row: np.ndarray, values: bytes, d: int) -> np.ndarray:
    width = len(values) // (len(row) * d) if d else 8
    return np.frombuffer(values, f"i{width}").reshape(len(row), d)


def contenders(q: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, vectors): pairs of rows of q and c among which are the k best of c for each query, but those whose score is under `least`.

    own: pairs that do not count. Numbers are exact, whatever their type. Lists are read by runs of equal values.
    """
    listed, n = np.sort(c, axis=0), len(c)
    both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    left, found = np.arange(len(q)), [(np.zeros(0, np.int64),) * 2]
    for share in READ:
        depth = math.ceil(n * share)
        high, low = listed[n - depth], listed[depth - 1]  # where reading has come to, from above and from below
        most = both[left] @ np.concatenate([np.maximum(c, high), np.minimum(c, low)], axis=1).T
        worst = both[left] @ np.concatenate([np.where(c >= high, c, listed[0]), np.where(c <= low, c, listed[-1])], axis=1).T
        place = np.full(len(q), -1)
        place[left] = np.arange(len(left))
        mine = place[own[0]] >= 0
        skip = place[own[0][mine]], own[1][mine]
        worst[skip] = -math.inf
        if n >= k:
            least[left] = np.maximum(least[left], np.partition(worst, n - k, axis=1)[:, n - k])
        can = most >= least[left][:, None]
        can[skip] = False
        done = (can.sum(axis=1) <= max(k, n * FEW)) | (depth == n)
        i, j = np.nonzero(can[done])
        found.append((left[done][i], j))
        left = left[~done]
        if not len(left):
            break
    return tuple(map(np.concatenate, zip(*found, strict=True)))


class Reading:
    """Queries that read blocks one after another, and the k best of each so far."""

    def __init__(self, row: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int) -> None:
        self.row, self.vec, self.x, self.k = row, vec, x, k
        self.best = np.zeros((0, 4), np.int64)  # query, score, vec_id, row

    def read(self, row: np.ndarray, vec: np.ndarray, c: np.ndarray) -> None:
        q, c = self.x.astype(np.int64), c.astype(np.int64)
        reach = max((int(abs(int(v)) + 1) for x in (q, c) if x.size for v in (x.min(), x.max())), default=1)
        kind = np.float64 if reach * reach * max(1, q.shape[1]) < 1 << 53 else object  # in both, sums are exact
        q, c = q.astype(kind), c.astype(kind)
        at = np.minimum(np.searchsorted(row, self.row), len(row) - 1)
        own = np.flatnonzero(row[at] == self.row)
        least = np.full(len(q), -math.inf, kind)
        have = np.bincount(self.best[:, 0], minlength=len(q)) == self.k
        least[have] = self.best[np.cumsum(np.bincount(self.best[:, 0], minlength=len(q)))[have] - 1, 1]
        i, j = contenders(q, c, (own, at[own]), least, self.k)
        step = max(1, COMPONENTS * 4 // max(1, q.shape[1]))
        scores = [np.asarray((q[i[s : s + step]] * c[j[s : s + step]]).sum(axis=1)) for s in range(0, len(i), step)]
        score = np.clip(np.concatenate(scores), LONG.min, LONG.max).astype(np.int64) if scores else np.zeros(0, np.int64)
        every = np.concatenate([self.best, np.stack([i, score, vec[j], row[j]], axis=1)])
        every = every[np.lexsort((every[:, 3], every[:, 2], ~every[:, 1], every[:, 0]))]
        rank = np.arange(len(every)) - np.searchsorted(every[:, 0], every[:, 0])
        self.best = every[rank < self.k]

    def result(self) -> pa.RecordBatch:
        of, score, vec, row = self.best.T
        return pa.RecordBatch.from_arrays(list(map(pa.array, (self.row[of], self.vec[of], row, vec, score))), ["query", "query_id", "row", "vec_id", "score"])


def top_k(vectors: DataFrame, asked: Column, k: int = 5, factor: int = 256) -> DataFrame:
    """The k best rows of vectors(vec_id, embedding) for each row where asked holds: query_id, rank (from 1), vec_id, score.

    A component x counts as floor(factor * x), held at a long's ends; a score is the inner product of these whole numbers, exact, held at a
    long's ends. A query's own row is no candidate; other rows are, its repetitions among them. Equal scores rank by vec_id, then as the rows lie.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id; vectors of different lengths
    never meet, empty ones meet with score 0. With fewer than k candidates a query has them all. An empty table gives an empty result; other
    columns are ignored.

    Every block of queries meets every block of vectors: queries and vectors are dealt into blocks of fixed size, sent once for each pair of a
    block of queries and a stripe of STRIPE blocks, and a task holds one block of each. Bounds go on from block to block of a stripe.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * factor)).alias("values"), good.alias("good"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = cut(chosen.filter("good").drop("good"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).first()
    stripes, buckets = max(1, -(-sizes["n"] // (BLOCK * STRIPE))), max(1, -(-sizes["asked"] // QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every = cut(packed(rows.withColumn("stripe", dealt(stripes)), "stripe"))
    queries = cut(packed(rows.filter("asked").withColumn("bucket", dealt(buckets)), "bucket"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["stripe", "bucket", "length", "is_block", "row", "vec_id", "values"]
    asking = queries.withColumns({"bucket": F.col("group"), "is_block": F.lit(False)}).withColumn("stripe", to(stripes)).select(*columns)
    read = every.withColumns({"stripe": F.col("group"), "is_block": F.lit(True)}).withColumn("bucket", to(buckets)).select(*columns)
    met = asking.unionByName(read).repartition("stripe", "bucket", "length").sortWithinPartitions("stripe", "bucket", "length", "is_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, reading = None, [], None
        for b in batches:
            for stripe, bucket, d, is_block, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (stripe, bucket, d):
                    if reading:
                        yield reading.result()
                    key, parts, reading = (stripe, bucket, d), [], None
                row, vec = (np.frombuffer(v, np.int64) for v in data[:2])
                block = row, vec, numbers(row, data[2], d)
                if not is_block:
                    parts.append(block)
                elif parts:  # else nobody asks for vectors of this length here
                    reading = reading or Reading(*map(np.concatenate, zip(*parts, strict=True)), k)
                    reading.read(*block)
        if reading:
            yield reading.result()

    found = cut(met.mapInArrow(run, "query long, query_id long, row long, vec_id long, score long"))
    for table in (rows, every, queries):
        discard(table)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

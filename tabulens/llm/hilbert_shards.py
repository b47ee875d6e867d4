"""Shards along a Hilbert curve through several metadata dimensions.

Rows near each other on the curve are near each other in every dimension, so that each shard has a
narrow range of all of them and a reader can skip shards by any. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of each dimension, and cuts of the curve at which rows are ranked.
BITS, CUTS = 6, 1023


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell, whose coordinates have so many bits each.

    Of each level of the curve one digit is taken: the cell's orthant as seen from that level's
    entry corner and axis, ranked by Gray code; both then move on to the chosen sub-cube.
    """
    n = len(dims)
    full = (1 << n) - 1
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    rank = [gray.index(g) for g in range(1 << n)]
    corner = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << n)]
    ones = lambda w: next(k for k in range(n + 1) if not w >> k & 1)
    axis = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    table = lambda xs: F.array(*[F.lit(x) for x in xs])
    # turned[axis][value]: value's bits rotated right (left for back) by axis + 1.
    turn = lambda v, k: ((v >> k) | (v << (n - k))) & full
    right = table([turn(v, (d + 1) % n) for d in range(n) for v in range(1 << n)])
    left = table([turn(v, (n - d - 1) % n) for d in range(n) for v in range(1 << n)])
    digits = F.array(
        *[
            sum((F.shiftright(x, k).bitwiseAND(F.lit(1)) * (1 << j) for j, x in enumerate(dims)), F.lit(0)).cast("int")
            for k in range(bits - 1, -1, -1)
        ]
    )
    state = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    at = lambda xs, i: F.get(xs, i)

    def step(s: Column, digit: Column) -> Column:
        w = at(table(rank), at(right, s["d"] * (1 << n) + digit.bitwiseXOR(s["e"])))
        turned = lambda x: at(left, s["d"] * (1 << n) + x)
        return F.struct(
            (s["h"] * (1 << n) + w).alias("h"),
            s["e"].bitwiseXOR(turned(at(table(corner), w))).alias("e"),
            F.pmod(s["d"] + at(table(axis), w) + 1, F.lit(n)).cast("int").alias("d"),
        )

    return F.aggregate(digits, state, step)["h"]


def bins(x: Column, cuts: list) -> Column:
    """Number of cuts at or below x, of 2**k - 1 ascending cuts, by binary search; null counts as below all."""
    steps, k = [], (len(cuts) + 1) // 2
    while k:
        steps.append(k)
        k //= 2
    table = F.array(*[F.lit(c) for c in cuts])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda a, s: F.when(x >= F.get(table, a + s - 1), a + s).otherwise(a))


def parts(df: DataFrame, column: str, count: int) -> DataFrame:
    """(value, part) of each distinct value of a column but null: the values in order, cut by exact counts of their
    rows into count parts as near equal as whole values let them be; part is from 0 to count - 1.

    Counts are per value, summed along ranges of values, so that no task sees all of them; the ranges only
    spread the work, and the parts are the same however they or the rows fall.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("n"))  # a row a range
    starts = ranges.selectExpr("range", "sum(n) OVER (ORDER BY range) - n AS start", "sum(n) OVER () AS total")
    inside = F.expr("sum(n) OVER (PARTITION BY range ORDER BY value) - n")
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(starts), "range")
    # A value belongs where the middle of its rows does.
    return ranked.selectExpr("value", f"CAST((2 * (start + inside) + n) * {count} div (2 * total) AS INT) AS part")


def quantiles(df: DataFrame, column: str, cuts: int) -> list:
    """Approximate quantiles of a column: so many values, whatever the table's size."""
    at = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    return list(df.agg(F.percentile_approx(column, at, 10 * (cuts + 1))).first()[0] or [0] * cuts)


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang, source): doc_id, size, text_crc32, cell,
    shard, slot.

    size is the text's bytes in UTF-8 plus 1, text_crc32 its checksum (null counts as empty). The
    rows in order of the curve are cut into count runs of which no two differ by more than one row
    (law `rows`); slot numbers a shard's rows from 0. The dimensions are source, language, size and
    doc_id, each cut by the rank of its whole values into parts of near equal counts; nulls come first. Rows of a cell follow a hash of doc_id
    and checksum, then doc_id, size and checksum; rows alike in all of these are interchangeable. An empty table
    gives an empty result; other columns are ignored.
    """
    body = F.coalesce("text", F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            "lang",
            "source",
        )
    )
    # Part 0 is null's.
    dims = {"source": "source", "lang": "lang", "bytes": "size", "id": "doc_id"}
    for dim, column in dims.items():
        found = parts(rows.select(column), column, (1 << BITS) - 1)
        found = found.select(F.col("value").alias(f"{dim}_value"), (F.col("part") + 1).alias(f"{dim}_part"))
        rows = rows.join(found, rows[column] == found[f"{dim}_value"], "left").drop(f"{dim}_value")
    spread = F.shiftright(F.xxhash64("doc_id", "text_crc32"), 25).bitwiseAND(F.lit((1 << 39) - 1))
    cell = hilbert_index([F.coalesce(f"{d}_part", F.lit(0)) for d in dims], BITS)
    placed = cut(rows.select("doc_id", "size", "text_crc32", cell.alias("cell")).withColumn("place", F.col("cell") * (1 << 39) + spread))
    # Ranks without one task that sees all rows: rows before a run of the curve, plus the rank within it.
    edges = quantiles(placed, "place", CUTS)
    runs = placed.withColumn("run", bins(F.col("place"), edges))
    inside = "row_number() OVER (PARTITION BY run ORDER BY place, doc_id, size, text_crc32) - 1"
    per_run = runs.groupBy("run").count().selectExpr(  # CUTS + 1 rows at most
        "run", "sum(count) OVER (ORDER BY run) - count AS before", "sum(count) OVER () AS total"
    )
    ranked = runs.withColumn("inside", F.expr(inside)).join(F.broadcast(per_run), "run")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside"))
    n = int(count)
    return ranked.selectExpr(
        "doc_id", "size", "text_crc32", "cell",
        f"CAST(rank * {n} div total AS INT) AS shard",
        f"rank - ((rank * {n} div total) * total + {n - 1}) div {n} AS slot",
    )

"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits both lie within 1 bit of some third value. So every
fingerprint is sent to itself and its 64 one-bit neighbours, and those that meet are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from .common import components, cut, fresh, small_batches

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # on bytes: ASCII only, in case and in white space
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), BLOCK):
        part = shingles[k : k + BLOCK]
        h = np.fromiter((xxh64_intdigest(x, SEED) for x in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


@arrow_udf(LongType())
def signed_fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x.as_py()) for x in text], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """docs with its texts' fingerprints as signed longs in one more column."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, signed_fingerprint("text"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints (fp): pairs at most 2 bits apart, enough of them to
    connect whatever such pairs connect.

    Those that meet in a value are at most 65, itself and its neighbours, and any two of them are
    within 2 bits. A group is summed up in one 64-bit mask, which combines before the shuffle, and
    gives a star of links rather than all its pairs.
    """
    places = F.array(*[F.lit(i) for i in range(64)])
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    sent = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    met = (
        sent.select(
            F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit("i"))).alias("variant"),
            F.when(F.col("i") < 0, F.lit(0)).otherwise(bit("i")).alias("mask"),
            F.when(F.col("i") < 0, 1).otherwise(0).alias("self"),
        )
        .groupBy("variant")
        .agg(F.bit_or("mask").alias("mask"), F.max("self").alias("self"))
        .filter("bit_count(mask) + self > 1")
    )
    members = F.concat(
        F.when(F.col("self") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
        F.transform(F.filter(places, lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0), lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )
    star = met.select(members.alias("m")).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return star.filter(F.col("a") != F.col("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id that links lead to, the document's own included. Equal
    fingerprints are linked, texts without words (fingerprint 0, null texts too) among them and
    with any fingerprint of at most 2 bits. Rows that share a doc_id but not a text keep their own
    fingerprints; a null doc_id never names a component unless it has no other. An empty table
    gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(docs))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(classes.select("fp")))
    linked = classes.join(groups, classes["fp"] == groups["node"])
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(named, "component").select("fp", "component_id")
    label = cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, so that one document of each group of
    near copies stays, with all its columns; rows with a null doc_id stay only in a group of nulls.

    Decided by doc_id and fingerprint, so that a row neither takes others of its doc_id along nor
    those of another group; the rows of a group that share the doc_id which names it all stay.
    """
    gone = near_duplicates(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, print_ = fresh(docs.columns, "key"), fresh(docs.columns, "fp")
    other = fresh([*docs.columns, print_], "fp")
    drop = cut(gone.select(F.col("doc_id").alias(key), F.col("fp").alias(other)).distinct())
    rows = with_fingerprint(docs, print_)
    return rows.join(drop, rows["doc_id"].eqNullSafe(drop[key]) & (rows[print_] == drop[other]), "left_anti").select(*docs.columns)

"""Exact dedup by skew-safe combining.

Copies are combined three times, each time by whole content and not by digest alone: within each
input partition, within salted digest groups, and across the salts of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from .common import cut, folded, fresh, small_batches

#: Groups with more than this share of all rows are salted; there are at most HOT of them.
HOT, SALTS = 4096, 64


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def digests(of: Callable[[bytes], bytes]):
    @arrow_udf(BinaryType())
    def digest(text: pa.Array) -> pa.Array:
        return pa.array([of(x.as_py().encode()) for x in text], pa.binary())

    return digest


def exact_dedup(docs: DataFrame, of: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, digest, keep_id, group_size, kept.

    Texts are equal when they are identical after A-Z are lower-cased; null counts as empty, so
    null and empty texts form one group. The row with the largest doc_id stays. Rows with the same
    doc_id share its fate, so a row repeated whole counts in group_size and is kept with its twin;
    a null doc_id loses to any other, and a group of nulls keeps them. An empty table gives an
    empty result; other columns are ignored.

    of: the digest. Two texts that share a digest are told apart by their content.
    """
    small_batches(docs.sparkSession)
    text = docs.select("doc_id", folded("text").alias("body"))
    ids = cut(text.select("doc_id", digests(of)("body").alias("digest")))
    sizes = ids.groupBy("digest").count()
    total = sizes.agg(F.sum("count").alias("total"))
    # More than total / HOT rows each, so at most HOT digests: small whatever the corpus.
    hot = cut(sizes.join(F.broadcast(total), F.col("count") * HOT > F.col("total")).filter("count > 1").select("digest", F.lit(True).alias("hot")))

    # Each task keeps one row of a content and salt (the partial aggregate), so its salt may be its number.
    full = text.withColumn("digest", digests(of)("body")).join(F.broadcast(hot), "digest", "left")
    salted = full.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1))
    by_salt = salted.groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    once = cut(by_salt.select("digest", "salt", F.when(F.col("salt") >= 0, F.col("body")).alias("body"), "keep_id", "n"))
    merged = once.filter("salt >= 0").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    winners = cut(once.filter("salt < 0").select("digest", "keep_id", "n").unionByName(merged.select("digest", "keep_id", "n")))
    shared = cut(winners.groupBy("digest").count().filter("count > 1").select("digest"))
    if shared.isEmpty():
        out = ids.join(winners, "digest")
    else:  # contents that share a digest: by digest and content, for these digests only
        pairs = text.withColumn("digest", digests(of)("body")).join(shared, "digest")
        per_text = pairs.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
        theirs = pairs.join(per_text, ["digest", "body"]).select("digest", "doc_id", "keep_id", "n")
        out = ids.join(shared, "digest", "left_anti").join(winners, "digest").unionByName(theirs)
    return out.select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of a row repeated whole
    (same doc_id, equal text) one stays."""
    found = exact_dedup(docs)
    key, digest = fresh(docs.columns, "key"), fresh(docs.columns, "digest")
    keep = cut(found.filter("kept").groupBy(F.col("doc_id").alias(key), F.col("digest").alias(digest)).agg(F.count("*").alias("rows")))
    rows = docs.withColumn(digest, digests(sha256)(folded("text")))
    stay = rows.join(keep, (rows["doc_id"].eqNullSafe(keep[key])) & (rows[digest] == keep[digest]), "left_semi")
    if not keep.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id", digest])
    return stay.select(*docs.columns)

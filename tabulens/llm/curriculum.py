"""Mixing sources to target weights under a curriculum that varies over training.

Each source's share of the mix is a rate over training time that rises or falls in a line. Its
integral is the source's cumulative demand; a document is trained on when demand reaches the words
that stand before it in its source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Most passes over a source, and the buckets of each source within which words are summed up.
PASSES, BUCKETS = 3, 1024
#: A source's rate at the start of training, over its mean rate, by its weight: low weights fade
#: out and high weights fade in. The rate at the end is 2 minus it.
START = {1: 1.5, 2: 1.0, 3: 0.5}


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight, target and start, one row a source.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating. Of all words, each gets
    its weight's share, but at most PASSES times its own words; what is cut off goes to the others
    by weight. Sources reach that limit in order of size over weight. The words left for a unit of
    weight rise with each full source that is set aside and fall with each other, so that the
    largest such level is the one sought. Windows here see one row a source, not the documents.
    """
    ranked = sizes.withColumn("weight", F.expr("pmod(row_number() OVER (ORDER BY source IS NULL, source) - 1, 3) + 1"))
    order = "ORDER BY source_size / weight, source IS NULL, source ROWS"
    level = ranked.selectExpr(
        "*",
        "sum(source_size) OVER () AS total",
        f"coalesce(sum({PASSES} * source_size) OVER ({order} BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full",
        f"sum(weight) OVER ({order} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open",
    ).withColumn("level", F.expr("(total - full) / open"))  # words for a unit of weight, if all sources before are full
    share = level.withColumn("share", F.expr("max(level) OVER ()"))
    target = F.expr(f"least(share * weight, CAST({PASSES} * source_size AS DOUBLE))")
    start = F.create_map(*[F.lit(x) for pair in START.items() for x in pair])
    return share.select("source", "source_size", "weight", target.alias("target"), F.try_element_at(start, F.col("weight")).alias("start"))


def mix(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, size, source, source_size,
    target, copies, taken, first_position.

    size counts the text's words (null: 0). A source's documents stand in the order of a hash and
    are gone through up to PASSES times; each pass over a document is taken if its middle word comes
    before the target, so that a source's taken words are within half a document of its target.
    first_position is the training time, from 0 to 1, of its first pass (null if none is taken).
    Null is a source of its own. Rows alike in doc_id, source and text are interchangeable;
    documents without words are taken as often as their place says and add nothing. An empty table
    gives an empty result; other columns are ignored. The order depends on doc_id and size alone, so
    reruns agree.
    """
    rows = cut(docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size")).fillna(0, ["size"]))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "source"), F.lit(BUCKETS))
    rows = rows.withColumn("bucket", bucket)
    per_bucket = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    before = per_bucket.selectExpr("source AS s", "bucket AS b", "sum(words) OVER (PARTITION BY source ORDER BY bucket) - words AS before")
    source = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))
    head = before.join(source, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = "sum(size) OVER (PARTITION BY source, bucket ORDER BY xxhash64(size, doc_id), doc_id, size ROWS UNBOUNDED PRECEDING) - size"
    placed = rows.withColumn("inside", F.expr(inside)).join(head, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("at", F.col("before") + F.col("inside"))
    taken = [f"CASE WHEN 2 * (at + {k} * source_size) + size <= 2 * target THEN 1 ELSE 0 END" for k in range(PASSES)]
    out = placed.withColumn("copies", F.expr(" + ".join(taken)))
    return out.select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        "at", "start",
        F.when(F.col("copies") > 0, position(F.col("at"))).alias("first_position"),
    )


def schedule(docs: DataFrame) -> DataFrame:
    """mix(), written and range-sorted by training position: documents in the order of their first pass, then by doc_id those that are not taken."""
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")]
    return cut(mix(docs)).repartitionByRange(*order).sortWithinPartitions(*order)


def position(words: Column) -> Column:
    """Training time at which a source's demand reaches so many words: its rate is start at time 0
    and 2 - start at time 1, in parts of target, so that demand start*t + (1 - start)*t*t is solved for t."""
    x = F.when(F.col("target") > 0, F.least(F.lit(1.0), words / F.col("target"))).otherwise(0.0)
    a, b = F.col("start"), 1 - F.col("start")
    bent = (F.sqrt(F.greatest(a * a + 4 * b * x, F.lit(0.0))) - a) / (2 * F.when(b != 0, b).otherwise(1.0))
    return F.when(b == 0, x).otherwise(bent) + 0.0  # no negative zero


def curriculum(docs: DataFrame, ordered: bool = True) -> DataFrame:
    """The rows of docs that mix() takes, each as often as it is taken, in order of training time.

    Has the columns of docs alone. Rows of docs that share a doc_id, source and size share their
    counts: of such rows each is taken as often as the most taken of them. Range-sorted, so that
    reading the written files in order is the schedule.
    """
    names = {x: fresh(docs.columns, x) for x in ("mix_id", "mix_source", "mix_size", "mix_copies", "mix_at")}
    plan = mix(docs)
    times = F.expr(f"filter(transform(sequence(0, {PASSES - 1}), k -> IF(2 * (at + k * source_size) + size <= 2 * target, at + k * source_size, NULL)), x -> x IS NOT NULL)")
    plan = plan.withColumn("at_words", times).filter("copies > 0").select("*", F.transform("at_words", position).alias("when"))
    plan = plan.groupBy(F.col("doc_id").alias(names["mix_id"]), F.col("source").alias(names["mix_source"]), F.col("size").alias(names["mix_size"])).agg(
        F.max_by("when", F.size("when")).alias(names["mix_copies"])
    )
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    same = docs["doc_id"].eqNullSafe(F.col(names["mix_id"])) & docs["source"].eqNullSafe(F.col(names["mix_source"])) & (size == F.col(names["mix_size"]))
    out = docs.join(plan, same).withColumn(names["mix_at"], F.explode(names["mix_copies"]))
    if ordered:
        out = out.repartitionByRange(F.col(names["mix_at"]), F.col(names["mix_id"])).sortWithinPartitions(names["mix_at"], names["mix_id"])
    return out.select(*docs.columns)

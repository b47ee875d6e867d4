"""Substring dedup by hashing paragraphs, lines and the sentences within them.

Units are normalised and their digests grouped over the whole corpus; the earliest occurrence by
rank stays and all others are removed, with their places in the original text retained.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches

#: Most units that are met by broadcast.
HOT = 4096
#: Words of the shortest sentence that is a unit; lines and paragraphs are units at any length. With 1 sentences are, too.
SENTENCE = 8
LINE = re.compile(r"[^\n]+")
BREAK = re.compile(r"(?<=[.!?])\s+")


def normalised(unit: str) -> list[str]:
    """The unit's words, lower-cased, without marks at their ends; those of marks alone go."""
    return [w for w in (x.strip(".,;:!?\"'()[]|*#$%&") for x in unit.lower().split()) if w]


def hashed(words: list[str]) -> bytes:
    return hashlib.sha256(" ".join(words).encode()).digest()[:16]


def units(text: str, sentence: int = SENTENCE) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each line that is not blank, of each sentence of at least so many words of a line that has several,
    and of each paragraph (lines between blank ones) that has several lines; places count code points.

    Short sentences recur in prose by chance; lines and paragraphs have no least length. A line of marks alone is compared by its marks. Sentences and lines
    without words do not make several, so that a unit never has the words of one within it alone.
    """
    paragraphs, now = [], []
    for line in LINE.finditer(text):
        a, b = line.span()
        words = normalised(line[0])
        if not words and not line[0].strip():
            continue
        if now and text.count("\n", now[-1][1], a) != 1:
            paragraphs.append(now)
            now = []
        now.append((a, b, words))
        yield a, b, len(words), hashed(words or line[0].split())
        ends = [*(m.end() for m in BREAK.finditer(text, a, b)), b]
        parts = [(s, e, normalised(text[s:e])) for s, e in zip([a, *ends], ends, strict=False) if s < e]
        parts = [x for x in parts if x[2]]
        if len(parts) > 1:
            yield from ((s, e, len(words), hashed(words)) for s, e, words in parts if len(words) >= sentence)
    for lines in [*paragraphs, now]:
        if sum(1 for *_, words in lines if words) > 1:
            words = [w for *_, some in lines for w in some]
            yield lines[0][0], lines[-1][1], len(words), hashed(words)


def corpus_units(docs: DataFrame, sentence: int = SENTENCE) -> DataFrame:
    """docs(rid, doc_id, mark, text) -> (rid, doc_id, mark, start, end, words, digest): the units of every whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "mark", "start", "end", "words", "digest"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            rows, of = [], []
            for i, x in enumerate(b.column(3)):
                found = list(units(x.as_py() or "", sentence))
                rows += found
                of += [i] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return docs.select("rid", "doc_id", "mark", "text").mapInArrow(run, f"rid long, doc_id {kind.simpleString()}, mark long, start int, end int, words int, digest binary")


def repeats_of_rows(rows: DataFrame, sentence: int) -> DataFrame:
    """repeats(), for docs(rid, doc_id, text) whose rids are written and of one row each; with the rid."""
    every = cut(corpus_units(rows.withColumn("mark", F.xxhash64("text")), sentence))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "rid", "start")
    groups = cut(every.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    # Units in more than a share of 1 / HOT of all occurrences are HOT at most, and meet theirs by broadcast.
    total = every.agg(F.count("*").alias("total"))
    hot = cut(groups.join(F.broadcast(total), F.col("copies") * HOT > F.col("total")).drop("total"))
    by_hot = every.join(F.broadcast(hot), "digest")
    others = every.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    gone = by_hot.unionByName(others.join(groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti"), "digest")).filter(rank > F.col("first"))
    found = cut(gone.select("rid", "doc_id", "start", "end", "words", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"), "copies"))
    # A removed paragraph covers its lines, a removed line its sentences; units nest, so that one is covered
    # if any at or before its start reaches as far as it does.
    reach = "max(end) OVER (PARTITION BY rid ORDER BY start, end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return found.withColumn("reach", F.expr(reach)).filter("reach IS NULL OR end > reach").drop("reach")


def repeats(docs: DataFrame, sentence: int = SENTENCE) -> DataFrame:
    """The units to remove, a row each: doc_id, start, end, words, digest, keep_id, keep_start, copies.

    A unit is removed if one with the same digest comes before it: in a row before its own, or before it in its row.
    Rows go by doc_id, null last; of rows that share a doc_id, or have none, by a hash of the text, and a row repeated
    whole comes after its twin, which of the two being the same. keep_id and keep_start name the first, copies counts all.
    sentence: the least words of a sentence that is a unit, 1 for all. Lines and sentences within a removed unit are not listed again. Words are compared
    lower-cased and without marks at their ends. Digests have 128 bits. Empty or null texts have no
    units; an empty table gives an empty result; other columns are ignored.
    """
    return repeats_of_rows(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), sentence).drop("rid")


def remove(docs: DataFrame, sentence: int = SENTENCE) -> DataFrame:
    """The rows of docs with all their columns, the units that repeats() names cut out of text.

    Rows are numbered and written once, so that each loses its own units, whether doc_ids are shared, null or
    not. A text whose units all go becomes empty; null stays null. An empty table stays so.
    """
    rid, key, holes = (fresh(docs.columns, x) for x in ("rid", "key", "holes"))
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()))
    spans = repeats_of_rows(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), sentence)
    spans = spans.groupBy(F.col("rid").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(holes))
    joined = rows.join(spans, rows[rid] == spans[key], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    h = F.coalesce(F.col(holes), none)
    starts = F.concat(F.array(F.lit(0)), F.transform(h, lambda x: x["end"]))
    ends = F.concat(F.transform(h, lambda x: x["start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return joined.withColumn("text", F.when(F.size(h) > 0, kept).otherwise(F.col("text"))).select(*docs.columns)

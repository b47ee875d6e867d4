"""Shards of skewed metadata: a value far off or a null takes no dimension's parts away."""

from collections import Counter

from pyspark.sql import functions as F

from tabulens.llm import hilbert_shards


def found(spark, rows, column, count=63):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("size", F.octet_length("text")).repartition(5)
    return {r["value"]: r["part"] for r in hilbert_shards.parts(df, column, count).collect()}


def test_parts_of_skewed_values(spark):
    rows = [(i, "x" * (i % 40 + 1), "en", None if i == 0 else f"https://site.org/{i % 20:02}") for i in range(4000)] + [(10**15, "y" * 3_000_000, "de", "hot")]
    source, size, ids = (found(spark, rows, c) for c in ("source", "size", "doc_id"))
    assert len(source) == 21 and len(set(source.values())) >= 20
    assert len(size) == 41 and len(set(size.values())) >= 40
    held = Counter(ids.values())
    assert set(held) == set(range(63)) and max(held.values()) - min(held.values()) <= 2
    for parts in (source, size, ids):
        assert [parts[v] for v in sorted(parts)] == sorted(parts.values())


def test_skewed_sources_have_cells_of_their_own(spark):
    rows = [(5, "same", "en", f"https://site.org/{i:02}") for i in range(20)] + [(5, "same", "en", None), (5, "same", "en", "a far one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert len({r["cell"] for r in hilbert_shards.shards(df, 4).collect()}) == 22

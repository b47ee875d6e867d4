"""Near dedup by row: null and repeated doc_ids."""

from collections import Counter

from tabulens.llm import simhash_ball


def words(seed, n=80):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def test_keep_one_decides_by_row(spark):
    a, b, c, d, e = (words(k) for k in range(1, 6))
    rows = [(1, a, 0), (None, a, 1), (None, b, 2), (None, c, 3), (None, c, 4), (2, d, 5), (3, d, 6), (3, e, 7), (9, e, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP int")
    kept = simhash_ball.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r["FP"] for r in kept.collect()) == Counter([0, 2, 3, 4, 5, 7])
    assert simhash_ball.keep_one(df.limit(0)).count() == 0

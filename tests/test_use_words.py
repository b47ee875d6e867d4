"""Places of use as words of 64 bits: an object of few uses takes few bytes wherever its places are numbered."""

from tabulens.operators import usage


def test_one_place_among_many_is_one_word(spark):
    used = spark.range(30_000).selectExpr("'p' AS project_id", "IF(id = 29999, 'b', 'a') AS canonical", "'page' AS page_name", "id AS visual_id")
    rows = usage.used_by_root(used).filter("root = 'b'").drop("project_id", "root").collect()
    assert len(rows) == 1 and rows[0]["uses"] == 1
    assert sum(len(x) if isinstance(x, (bytes, bytearray)) else 8 for x in rows[0]) <= 24

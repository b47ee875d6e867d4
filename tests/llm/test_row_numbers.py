"""Encoding whose scans are cut anew."""

import pytest

from tabulens.llm import piece_lattice


@pytest.mark.parametrize("size", ["1k", "64m"])
def test_encode_does_not_depend_on_how_scans_are_cut(spark, tmp_path, size):
    """Rows are told apart by their texts and not by numbers made in a scan, which change when the files are cut anew, as on
    a cluster that gains or loses cores; the files are cut anew here between the steps and the result's reading."""
    rows = [(i, f"common text {i} and rare w{i * 7919}x{i}") for i in range(100)] + [(7, "common text 3 again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    out = piece_lattice.encoded_corpus(spark.read.parquet(str(tmp_path / "docs")))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    got = out.collect()
    spark.conf.set(key, old)
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows) and all(r["round_trip"] for r in got)

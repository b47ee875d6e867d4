"""The fold over one number a place finds what the general one does; plans are described briefly."""

import random

from pyspark.sql import functions as F

from tabulens.llm import common, piece_lattice, vocabulary


def test_both_folds_agree(spark):
    known = vocabulary.load()
    rng = random.Random(5)
    units = ["▁" + "".join(rng.choice("aabcdehinorst漢9$") for _ in range(rng.randrange(1, 60))) for _ in range(200)] + ["x" * 256, "a", "☃", "▁"]
    found = piece_lattice.lattice(spark.createDataFrame([(u, 1) for u in set(units)], "unit string, count long"), known)
    pairs = lambda path: F.transform(path, lambda e: F.struct(piece_lattice.end_of(e), piece_lattice.id_of(e)))
    both = found.select("unit", pairs(piece_lattice.best_path(F.col("blocks"), known)).alias("a"), pairs(piece_lattice.best_short_path(F.element_at("blocks", 1), known)).alias("b")).collect()
    assert piece_lattice.whole_scores(known) and len(both) == len(set(units)) and all(r["a"] == r["b"] and r["a"] for r in both)


def test_plans_are_described_briefly(spark):
    docs = spark.createDataFrame([(1, "the end of it")], "doc_id long, text string")
    piece_lattice.encoded_corpus(docs).collect()
    listed = spark._jsparkSession.sharedState().statusStore().executionsList()
    last = [listed.apply(k) for k in range(max(0, listed.size() - 5), listed.size())]
    assert max(len(x.physicalPlanDescription()) for x in last) <= common.PLAN + 200

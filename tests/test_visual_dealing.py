"""Visuals are dealt once, to as many tasks as are set, and all else is done where they lie."""

import json

from pyspark.sql import functions as F

from tabulens.functions import visuals as V
from tabulens.operators import graph, report
from tabulens.plans import queries

TABLES = "/root/testdata/sf0.001"


def test_visuals_go_to_all_tasks(spark):
    found = queries.bound_visuals(spark, TABLES)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_references_need_no_table_and_no_second_shuffle(spark):
    tables = list(graph.TABLES)
    rows = report.field_references(queries.bound_visuals(spark, TABLES))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert graph.TABLES == tables
    assert plan.count("Exchange") == 1 and "Window" in plan


def test_deep_documents_in_one_plan(spark):
    raw = '{"x":[' * 300 + json.dumps({"queryRef": "Deep.Field", "y": "{[" * 50}) + "]}" * 300
    df = spark.createDataFrame([("p", 0, None, raw), ("p", 1, "[M]", "{" * 300)], "project_id string, ord int, visual_title string, raw string")
    tables = list(graph.TABLES)
    got = sorted((r["ord"], r["f"]["table"], r["f"]["name"]) for r in report.field_references(df).collect())
    assert got == [(0, "Deep", "Field"), (1, None, "M")] and graph.TABLES == tables


def test_types_in_title_case(spark):
    types = ["some3dNewType", "ALL CAPS", "x-y_zW", "a1B2c3", " LineChart ", "grünBlau été", "ßtraße ǆx", "日本abcДом", "don't", ""]
    df = spark.createDataFrame([(t,) for t in types], "t string")
    runs = F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    rows = df.select("t", V.title_case(F.col("t")).alias("got"), F.array_join(F.transform(runs, F.initcap), "").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and rows[0]["got"] == "Some3Dnewtype"

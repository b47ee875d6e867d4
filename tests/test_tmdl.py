"""The reader of TMDL as a table function."""

from pyspark.sql import functions as F

from tabulens.sources import tmdl

FILE = "table T\n\tcolumn A = 1 +\n\t\t2\n\t\tdataType: int64\n\n\tmeasure M = ```\n\t\tx\n\n\t\t```\n\t\tformatString: 0\n"


def test_called_from_sql_with_keys_of_any_kind(spark):
    tmdl.register(spark)
    files = spark.createDataFrame([(k, f"p{k % 2}", FILE.replace("A", f"A{k}")) for k in range(20)], "number long, place string, text string")
    lines = files.select("number", "place", F.posexplode(F.split("text", "\n")).alias("n", "line")).repartition(5)
    lines.createOrReplaceTempView("tmdl_lines")
    got = spark.sql("SELECT * FROM tmdl_events(TABLE(tmdl_lines)) WHERE role = 'head' AND section = 'column'").collect()
    assert sorted((r["number"], r["place"], r["line"], r["value"]) for r in got) == [(k, f"p{k % 2}", 1, f"A{k}") for k in range(20)]
    reader = tmdl.Reader()
    want = [e for k, line in enumerate(FILE.replace("A", "A0").split("\n")) for e in reader.read(k, line)]
    events = spark.sql("SELECT line, item, section, role, chunk, value FROM tmdl_events(TABLE(tmdl_lines)) WHERE number = 0").collect()
    assert len(want) == 10 and sorted(map(tuple, events)) == sorted(want)


def test_expressions_over_many_lines(spark):
    files = spark.createDataFrame([("p", "a.tmdl", "tables/a.tmdl", FILE), ("p", "b.tmdl", "tables/b.tmdl", ""), ("p", "c.tmdl", "tables/c.tmdl", None)], "project_id string, path string, rel string, text string")
    raw = {r["name"]: r for r in tmdl.raw_tables(files).collect()}
    (column,), (measure,) = raw["T"]["columns"], raw["T"]["measures"]
    assert (column["name"], column["expression"], column["dataType"], column["type"]) == ("A", "1 +\n\t\t2", "int64", "calculated")  # lines are stripped of what all begin with
    assert (measure["name"], measure["expression"], measure["formatString"]) == ("M", "x", "0")


def test_a_file_of_many_lines(spark):
    body = "\n".join(f"\tmeasure M{k} = [M{k - 1}] + 1\n\t\tformatString: 0" for k in range(5000))
    files = spark.createDataFrame([("p", "a", "tables/a.tmdl", f"table Big\n{body}")], "project_id string, path string, rel string, text string")
    assert tmdl.raw_tables(files).select(F.size("measures"), F.element_at("measures", -1)["expression"]).first() == (5000, "[M4998] + 1")


def test_files_are_numbered_without_what_they_hold(spark):
    """A project's files meet in one task to be numbered; their lists of objects must not be there. Objects alone come a row each, as in the lists."""
    files = spark.createDataFrame([("p", f"{k}.tmdl", f"tables/{k}.tmdl", FILE if k % 2 else "column B\n") for k in range(4)], "project_id string, path string, rel string, text string")
    raw = tmdl.raw_tables(files)
    plan = raw._jdf.queryExecution().optimizedPlan().toString().splitlines()
    window = next(k for k, line in enumerate(plan) if line.lstrip(" :+-").startswith("Window"))
    above = plan[window - 1]
    assert "Project [project_id" in above and "measures" not in above and "measures" not in plan[window + 1]
    chosen = tmdl.table_files(files)
    got = tmdl.table_objects(chosen, tmdl.table_items(chosen)).selectExpr("table_name", "coalesce(column.name, measure.name) AS name").collect()
    want = [(r["name"], x["name"]) for r in raw.collect() for x in [*r["columns"], *r["measures"]]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 6

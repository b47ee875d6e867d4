"""Advice by a provider, the check of an answer's references, and columns in prompts."""

from pyspark.sql import functions as F

from tabulens.assist import advice, prompts
from tabulens.assist.providers import NullProvider, Provider, unknown_references
from tabulens.operators import health, resolve


class Adviser(Provider):
    def __init__(self, replies):
        self.replies, self.asked = replies, []

    def is_available(self):
        return True

    def analyze_expression(self, context):
        return None

    def chat(self, messages):
        return None

    def advise(self, context):
        self.asked.append(context)
        reply = self.replies[context["counts"]["tables" if context["subject"] == "model" else "pages"]]
        if isinstance(reply, Exception):
            raise reply
        return reply


def found(spark, projects):
    rows = spark.createDataFrame([(p, n) for n, p in enumerate(projects)], "project_id string, n long")
    return health.health(rows.select("project_id", *[(F.col("n") if c in ("tables", "pages") else F.lit(7).cast("long")).alias(c) for c in health.COUNTS]))


def test_advice_is_the_providers_where_it_gives_any(spark):
    models = found(spark, "abcde")
    listed = [{"type": "Size", "severity": "Odd", "description": "Too large", "extra": 1}, "no object", {"type": "Names", "severity": "Low", "recommendation": None}]
    fake = Adviser([{"issues": listed}, '```json\n{"issues": []}\n```', {"category": "no list"}, RuntimeError("down"), "not json"])
    got = {}
    for r in advice.model_advice(fake, models).orderBy("project_id", "place").collect():
        got.setdefault(r["project_id"], []).append((r["type"], r["severity"], r["description"], r["recommendation"]))
    rules = {}
    for r in health.model_advice(models).orderBy("project_id", "place").collect():
        rules.setdefault(r["project_id"], []).append((r["type"], r["severity"], r["description"], r["recommendation"]))
    assert got == {"a": [("Size", "Medium", "Too large", ""), ("Names", "Low", "", "")], "c": rules["c"], "d": rules["d"], "e": rules["e"]}
    assert len(fake.asked) == 5 and set(fake.asked[0]["counts"]) == set(advice.ON_MODELS)
    assert "- unused: 7" in prompts.advice(fake.asked[0])

    uses = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "")], "project_id string, object_name string")
    fake = Adviser([None, {"issues": [{"type": "Pages", "severity": "High"}]}])
    reports = {r["project_id"]: r["type"] for r in advice.report_advice(fake, found(spark, "ab"), uses).collect()}
    assert reports == {"a": "Report Design", "b": "Pages"}
    assert [a["counts"]["objects_used"] for a in sorted(fake.asked, key=lambda a: a["counts"]["pages"])] == [2, 0]
    assert advice.report_advice(NullProvider(), models, uses).collect() == health.report_advice(models).collect()


def test_references_of_an_answer(spark):
    tables = spark.createDataFrame([("p", 0, "Sales")], "project_id string, ord int, table_name string")
    columns = spark.createDataFrame([("p", 0, "Sales", "Amount")], "project_id string, ord int, table_name string, column_name string")
    measures = spark.createDataFrame([("p", 0, "Sales", "Total")], "project_id string, ord int, table_name string, measure_name string")
    cat = resolve.catalog(tables, columns, measures, columns.limit(0))
    assert unknown_references(spark, "p", "CALCULATE(SUM(Sales[Amount]), [Total])", cat) == ""
    assert "Sales[Price]" in unknown_references(spark, "p", "DIVIDE(SUM(Sales[Price]), [Total])", cat)


def test_columns_in_a_prompt():
    context = {"object_name": "[m]", "object_type": "Measure", "table": "T", "original_dax": "1", "dependencies": [], "static_issues": [], "known_columns": [f"c{i}" for i in range(20)]}
    assert "c14" in prompts.expression(context) and "c15" not in prompts.expression(context)

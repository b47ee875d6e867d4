"""Whole analyses of archives, against results worked out by hand."""

import zipfile
from collections import Counter
from xml.etree import ElementTree

import projects as P
import pytest
from pyspark.sql import functions as F

import tabulens
from tabulens.assist.chat import Assistant, build_context
from tabulens.assist.providers import NullProvider, Provider, parse_reply, provider_from
from tabulens.sources import archive


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    P.write(at / "shop.zip", P.SHOP)
    P.write(at / "ledger.zip", P.LEDGER)
    P.write(at / "empty.zip", {"readme.txt": "x"})
    P.write(at / "evil.zip", {"a.pbip": "{}", "../out.txt": "x"})
    (at / "broken.zip").write_bytes(b"not an archive")
    return at


@pytest.fixture(scope="session")
def found(spark, folder):
    return tabulens.analyze(spark, str(folder))


def of(found, name, project, *columns):
    return [tuple(r) for r in found[name].filter(F.col("project_id").endswith(f"/{project}.zip")).select(*columns).collect()]


def test_projects_and_errors(found):
    rows = {r["project_id"].rsplit("/", 1)[1]: r for r in found["projects"].collect()}
    shop, ledger = rows["shop.zip"], rows["ledger.zip"]
    assert (shop["project_name"], shop["model_format"], shop["report_format"], shop["error"]) == ("Shop", "TMDL", "PBIR_PAGES", None)
    assert (ledger["project_name"], ledger["model_format"], ledger["report_format"], ledger["error"]) == ("Ledger", "BIM_JSON", "LEGACY_REPORT_JSON", None)
    assert "project file" in rows["empty.zip"]["error"]
    assert "Unsafe path" in rows["evil.zip"]["error"]
    assert "ZIP" in rows["broken.zip"]["error"]


def test_unsafe_paths():
    assert all(map(archive.unsafe, ["/a", "a/../b", "..\\b", "\\a", "C:\\a"]))
    assert not any(map(archive.unsafe, ["a/b", "a..b/c", "a/.b"]))


def test_model_info(found):
    assert of(found, "model_info", "shop", "model_name", "culture", "compatibility_level", "source_query_culture") == [("Shop", "en-US", "Unknown", "de-DE")]
    assert of(found, "model_info", "ledger", "model_name", "culture", "compatibility_level") == [("LedgerModel", "en-GB", "1567")]


def test_tables_and_columns(found):
    assert sorted(of(found, "tables", "shop", "table_name", "table_type", "is_hidden")) == [("Client", "Data", "No"), ("Days", "Data", "No"), ("Orders", "Data", "No")]
    assert Counter(t for t, in of(found, "columns", "shop", "table_name")) == {"Client": 5, "Orders": 7, "Days": 3}
    calc = {(t, c): d for t, c, d in of(found, "calculated_columns", "shop", "table_name", "column_name", "dax_expression")}
    assert set(calc) == {("Client", "Client Label"), ("Orders", "Net"), ("Orders", "Size")}
    assert calc["Orders", "Size"] == 'IF(\n    Orders[Amount] > 100 && Orders[Quantity] > 1,\n    "big",\n    "small"\n)'
    assert of(found, "calculated_columns", "ledger", "column_name", "dax_expression") == [("Tax", "Entry[Value]\n* 0.2")]
    assert ("City", "Yes", "Where they live") in of(found, "columns", "shop", "column_name", "is_hidden", "description")


def test_measures(found):
    rows = {m: (d, f, h, t) for m, d, f, h, t in of(found, "measures", "shop", "measure_name", "dax_expression", "format_string", "is_hidden", "description")}
    assert len(rows) == 6
    assert rows["Total"] == ("SUM(Orders[Amount])", "#,0", "No", "All amounts")
    assert rows["Growth"][0] == "VAR a = [Total YTD]\nVAR b = [Total]\nRETURN DIVIDE(a - b, b)" and rows["Growth"][2] == "Yes"


def test_relationships_and_sources(found):
    assert sorted(of(found, "relationships", "shop", "from_column", "to_table", "cardinality", "filter_direction", "status")) == [("ClientKey", "Client", "M:1", "Single", "Active"), ("Ship Day", "Days", "M:1", "Both", "Inactive")]
    assert of(found, "relationships", "ledger", "cardinality", "status") == [("M:M", "Active")]
    assert sorted(of(found, "data_sources", "shop", "source_type", "source_details")) == [("DAX Calculated Table", "Model Internal DAX Expression"), ("Excel", "File: C:/orders.xlsx"), ("SQL Server", "Server: srv1, Database: shop")]
    ledger = {t: (s, e) for t, s, e in of(found, "data_sources", "ledger", "table", "source_type", "m_expression")}
    assert ledger["Entry"][0] == "SharePoint" and 'Password="[REDACTED]"' in ledger["Entry"][1] and ledger["Unit"][0] == "CSV" and "[Shared Expression] Param" in ledger
    assert of(found, "date_tables", "shop", "table_name", "date_column", "marked_reason") == [("Days", "Day", "dataCategory = 'Time'; Key Column 'Day' (dataType=dateTime)")]


def test_dependencies(found):
    edges = of(found, "dax_dependencies", "shop", "source_name", "target_name", "resolved")
    assert len(edges) == 14 and all(r for *_, r in edges)
    assert {t for s, t, _ in edges if s == "Growth"} == {"Total YTD", "Total"}
    assert found["circular_dependencies"].count() == found["unresolved_references"].count() == 0


def test_visuals(found):
    assert sorted(of(found, "visuals", "shop", "visual_id", "visual_type", "visual_title", "visual_name")) == [("v1", "Card", "Growth this year", "Growth this year"), ("v2", "Line Chart", "", "Line Chart 1"), ("v3", "Table", "", "Table 1")]
    assert sorted(of(found, "pages", "shop", "page_id", "page_name")) == [("p1", "Overview"), ("p2", "p2")]
    assert sorted(of(found, "visuals", "ledger", "visual_id", "visual_type", "visual_name")) == [("7", "Clustered Column Chart", "Values"), ("broken", "Unknown", "Unknown 1")]
    assert sorted(of(found, "visual_usage", "ledger", "object_type", "object_name")) == [("Column", "Name"), ("Measure", "Sum Value")]


def test_usage(found):
    rows = {(t, o): (u, d, i, n) for t, o, u, d, i, n in of(found, "object_usage", "shop", "table_name", "object_name", "usage_type", "direct_count", "indirect_count", "location_count")}
    assert len(rows) == 21
    assert rows["Orders", "Growth"] == ("Direct", 1, 0, 1)
    assert rows["Orders", "Total"] == ("Indirect", 0, 1, 1)
    assert rows["Orders", "Amount"] == ("Direct + Indirect", 1, 1, 2)
    assert rows["Days", "Day"] == ("Direct + Indirect", 1, 1, 2)
    assert rows["Orders", "Net"][0] == "Unused"
    assert Counter(u for u, *_ in rows.values()) == {"Unused": 13, "Direct": 3, "Indirect": 3, "Direct + Indirect": 2}
    assert len(of(found, "unused_objects", "shop", "object_name")) == 13
    assert sorted(of(found, "usage_lineage", "shop", "dependency_path", "dependency_level")) == [("Client Count -> ClientKey", 1), ("Growth -> Total", 1), ("Growth -> Total -> Amount", 2), ("Growth -> Total YTD", 1), ("Growth -> Total YTD -> Day", 2)]


def test_health_and_documents(found):
    assert of(found, "model_health", "shop", "score", "grade") == [(85, "B (Good)")]
    assert [t for t, in of(found, "model_advisories", "shop", "type")] == ["Unused Objects", "Bidirectional Relationships"]
    assert "contains 3 tables, 15 columns, and 6 measures serving 2 report pages with 3 total visuals" in of(found, "executive_documentation", "shop", "overview")[0][0]


def test_workbook(found, tmp_path):
    project = found["projects"].filter("project_name = 'Shop'").first()["project_id"]
    path = tabulens.write_workbook(found, project, tmp_path / "out" / "shop.xlsx")
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        names = [s.attrib["name"] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        sheets = [ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")) for i in range(1, 7)]
    assert names == ["Summary", "Model Inventory", "Report Usage", "Relationships & Lineage", "Data Sources", "DAX Analysis"]
    rows = [[c.findtext(".//m:t", None, ns) or c.findtext("m:v", None, ns) for c in r] for r in sheets[1].find("m:sheetData", ns)]
    assert rows[1] == ["Total Items: 24"] and rows[2][:3] == ["Table", "Object", "Object Type"] and len(rows) == 27
    assert sheets[1].find(".//m:pane", ns).attrib["topLeftCell"] == "A5" and sheets[1].find("m:autoFilter", ns).attrib["ref"] == "A4:J28"
    text = "".join(ElementTree.tostring(sheets[0], encoding="unicode"))
    assert "85/100 (B (Good))" in text


def test_workbooks_of_all_projects_from_tasks(found, tmp_path):
    named = {r["project_id"].rsplit("/", 1)[1]: r for r in tabulens.write_workbooks(found, tmp_path / "all").collect()}
    assert set(named) == {"shop.zip", "ledger.zip"}
    assert sorted(map(str, (tmp_path / "all").iterdir())) == sorted(r["file"] for r in named.values())
    for r in named.values():
        alone = tabulens.write_workbook(found, r["project_id"], tmp_path / "alone.xlsx")
        with zipfile.ZipFile(r["file"]) as a, zipfile.ZipFile(alone) as b:
            assert a.namelist() == b.namelist() and all(a.read(n) == b.read(n) for n in a.namelist())


class Fake(Provider):
    name = "Fake"

    def __init__(self, reply):
        self.reply, self.asked = reply, []

    def is_available(self):
        return True

    def analyze_expression(self, context):
        self.asked.append(context)
        if isinstance(self.reply, Exception):
            raise self.reply
        return self.reply

    def chat(self, messages):
        self.asked.append(messages)
        return "An answer"


def test_replies_join_the_rules(spark, folder):
    fake = Fake('```json\n{"issue": "Slow", "severity": "odd", "suggested_dax": "SUM(Entry[Value]) + [Gone] + Nowhere[x]"}\n```')
    found = tabulens.analyze(spark, str(folder / "ledger.zip"), fake)
    rows = found["dax_improvements"].filter("source = 'AI'").collect()
    assert len(rows) == len(fake.asked) == 2
    assert {r["validation_status"] for r in rows} == {"Invalid"} and {r["severity"] for r in rows} == {"Medium"}
    assert all("Nowhere[x], [Gone]" in r["explanation"] for r in rows)
    assert {r["analysis_status"] for r in found["dax_analysis"].collect()} == {"AI Enhanced"}
    failed = tabulens.analyze(spark, str(folder / "ledger.zip"), Fake(RuntimeError("down")))
    assert failed["quality_summary"].select("ai_failures", "ai_requests", "ai_suggestions").first() == (2, 2, 0)
    assert {r["analysis_status"] for r in failed["dax_analysis"].collect()} == {"Static Complete"}


def test_parse_reply():
    assert parse_reply("no json") is None and parse_reply([1]) is None and parse_reply({"has_improvement": False}) is None
    assert parse_reply({"severity": "High", "requires_manual_validation": False})["requires_manual_validation"] is False


def test_provider_from_environment():
    assert provider_from({}).name == "None"
    assert provider_from({"OPENAI_API_KEY": "k"}).name == "OpenAI"
    azure = {"AZURE_OPENAI_ENDPOINT": "https://e/", "AZURE_OPENAI_API_KEY": "k", "AZURE_OPENAI_DEPLOYMENT": "d", "OPENAI_API_KEY": "k"}
    assert provider_from(azure).name == "Azure OpenAI"
    assert provider_from(azure | {"DISABLE_AI": "true"}).name == "None"


def test_questions(found):
    project = found["projects"].filter("project_name = 'Shop'").first()["project_id"]
    context = build_context("Is [Growth] used, and what is the health score?", found, project)
    assert [o["object_name"] for o in context["focused_objects"]] == ["Growth"] and context["model_health"][0]["score"] == 85
    assert "general_model_summary" in build_context("hello", found, project)
    about = build_context("tell me more about days please", found, project)
    assert about["focused_tables"][0]["table_name"] == "Days" and about["focused_tables"][0]["columns_count"] == 3
    back = build_context("how is it computed, what is it ?", found, project, [{"role": "user", "content": "What is [Total YTD]?"}])
    assert "Total YTD" in [o["object_name"] for o in back["focused_objects"]]
    fake = Fake(None)
    bot = Assistant(found, project, fake, most=1)
    assert bot.ask("hello")["status"] == "success" and len(fake.asked) == 1
    assert bot.ask("hello")["status"] == "limit_reached"
    assert Assistant(None, "x", fake).ask("a")["status"] == "no_metadata"
    assert Assistant(found, project, NullProvider()).ask("a")["status"] == "ai_disabled"


def test_stream_of_archives(spark, tmp_path):
    import shutil

    drop = tmp_path / "drop"
    drop.mkdir()
    got = []
    start = tabulens.watch(spark, str(drop), lambda t, n: got.append((n, [r["project_name"] for r in t["projects"].collect()]))).option("checkpointLocation", str(tmp_path / "state"))
    for name, files in (("a.zip", P.SHOP), ("b.zip", P.LEDGER)):
        P.write(tmp_path / name, files)
        shutil.move(tmp_path / name, drop / name)
        query = start.trigger(availableNow=True).start()
        query.awaitTermination()
    assert got == [(0, ["Shop"]), (1, ["Ledger"])]

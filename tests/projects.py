"""Archives of small projects, written for the tests."""

import json
import zipfile

CLIENT = """table Client

\tcolumn ClientKey
\t\tdataType: int64
\t\tisKey
\t\tsourceColumn: ClientKey

\tcolumn 'Client Name'
\t\tdataType: string
\t\tsourceColumn: Name

\tcolumn City
\t\tdataType: string
\t\tisHidden
\t\tdescription: "Where they live"

\tcolumn Joined
\t\tdataType: dateTime

\tcolumn 'Client Label' = [Client Name] & " (" & Client[City] & ")"
\t\tdataType: string

\tmeasure 'Client Count' = DISTINCTCOUNT(Client[ClientKey])
\t\tformatString: "0"

\tpartition Client = m
\t\tmode: import
\t\tsource =
\t\t\tlet
\t\t\t\tSource = Sql.Database("srv1", "shop")
\t\t\tin
\t\t\t\tSource
"""
ORDERS = """table Orders

\tcolumn ClientKey
\t\tdataType: int64

\tcolumn Day
\t\tdataType: dateTime

\tcolumn 'Ship Day'
\t\tdataType: dateTime

\tcolumn Amount
\t\tdataType: decimal
\t\tformatString: "#,0.00"

\tcolumn Quantity
\t\tdataType: int64

\tcolumn Net = Orders[Amount] * 0.8
\t\tdataType: decimal

\tcolumn Size = ```
\t\t\tIF(
\t\t\t    Orders[Amount] > 100 && Orders[Quantity] > 1,
\t\t\t    "big",
\t\t\t    "small"
\t\t\t)
\t\t\t```
\t\tdataType: string

\tmeasure Total = SUM(Orders[Amount])
\t\tformatString: "#,0"
\t\tdescription: "All amounts"

\tmeasure Average = AVERAGE(Orders[Amount])

\tmeasure 'Total YTD' = TOTALYTD([Total], Days[Day])

\tmeasure 'Total LY' = CALCULATE([Total], SAMEPERIODLASTYEAR(Days[Day]))

\tmeasure Growth = ```
\t\t\tVAR a = [Total YTD]
\t\t\tVAR b = [Total]
\t\t\tRETURN DIVIDE(a - b, b)
\t\t\t```
\t\tisHidden

\tpartition Orders = m
\t\tsource = Excel.Workbook(File.Contents("C:/orders.xlsx"), null, true)
"""
DAYS = """table Days
\tdataCategory: Time

\tcolumn Day
\t\tdataType: dateTime
\t\tisKey

\tcolumn Month
\t\tdataType: int64

\tcolumn Year
\t\tdataType: int64

\tpartition Days = calculated
\t\tsource = CALENDARAUTO()
"""
AUTO = "table LocalDateTable_1\n\tisHidden\n\tcolumn Date\n\t\tdataType: dateTime\n"
LINKS = """relationship r1
\tfromColumn: Orders.ClientKey
\ttoColumn: Client.ClientKey

relationship r2
\tisActive: false
\tcrossFilteringBehavior: bothDirections
\tfromColumn: Orders.'Ship Day'
\ttoColumn: Days.Day
"""


def column(entity, name):
    return {"Column": {"Expression": {"SourceRef": {"Entity": entity}}, "Property": name}}


def measure(entity, name):
    return {"Measure": {"Expression": {"SourceRef": {"Entity": entity}}, "Property": name}}


def title(text):
    return {"title": [{"properties": {"text": {"expr": {"Literal": {"Value": text}}}}}]}


def visual(name, kind, fields, shown=None):
    inner = {"visualType": kind, "query": {"queryState": {"Values": {"projections": [{"field": f, "queryRef": ref} for f, ref in fields]}}}}
    if shown:
        inner["visualContainerObjects"] = title(shown)
    return json.dumps({"name": name, "visual": inner})


SHOP = {
    "Shop.pbip": json.dumps({"version": "1.0", "artifacts": [{"type": "report", "path": "Shop.Report"}]}),
    "Shop.SemanticModel/definition.pbism": "{}",
    "Shop.SemanticModel/definition/model.tmdl": "model Shop\n\tculture: en-US\n\tsourceQueryCulture: de-DE\n",
    "Shop.SemanticModel/definition/tables/Client.tmdl": CLIENT,
    "Shop.SemanticModel/definition/tables/Days.tmdl": DAYS,
    "Shop.SemanticModel/definition/tables/Auto.tmdl": AUTO,
    "Shop.SemanticModel/definition/tables/Orders.tmdl": ORDERS,
    "Shop.SemanticModel/definition/relationships.tmdl": LINKS,
    "Shop.Report/definition.pbir": "{}",
    "Shop.Report/definition/report.json": "{}",
    "Shop.Report/definition/pages/p1/page.json": json.dumps({"name": "p1", "displayName": "Overview"}),
    "Shop.Report/definition/pages/p1/visuals/v1/visual.json": visual("v1", "card", [(measure("Orders", "Growth"), "Orders.Growth")], "'Growth this year'"),
    "Shop.Report/definition/pages/p1/visuals/v2/visual.json": visual("v2", "lineChart", [(column("Days", "Day"), "Days.Day"), (column("Orders", "Amount"), "Sum(Orders.Amount)")]),
    "Shop.Report/definition/pages/p2/page.json": "not json",
    "Shop.Report/definition/pages/p2/visuals/v3/visual.json": visual("v3", "tableEx", [(column("Client", "Client Name"), "Client.Client Name"), (measure("Client", "Client Count"), "Client.Client Count")]),
}

LEDGER = {
    "sub/Ledger.pbip": "{}",
    "sub/Ledger.Dataset/model.bim": json.dumps(
        {
            "name": "LedgerModel",
            "compatibilityLevel": 1567,
            "model": {
                "culture": "en-GB",
                "tables": [
                    {
                        "name": "Entry",
                        "columns": [{"name": "Id", "dataType": "int64"}, {"name": "Value", "dataType": "double"}, {"name": "Posted", "dataType": "dateTime"}, {"name": "Tax", "type": "calculated", "expression": ["Entry[Value]", "* 0.2"]}],
                        "measures": [{"name": "Sum Value", "expression": "SUM(Entry[Value])"}],
                        "partitions": [{"name": "e", "source": {"type": "m", "expression": ["let s = SharePoint.Files(\"https://x/y\", [Password = \"p\"])", "in s"]}}],
                        "annotations": {"note": "1"},
                    },
                    {"name": "Unit", "isHidden": True, "columns": [{"name": "Id", "dataType": "int64"}, {"name": "Name"}], "partitions": [{"name": "u", "source": {"expression": "Csv.Document(File.Contents(\"u.csv\"))"}}]},
                ],
                "relationships": [{"name": "x", "fromTable": "Entry", "fromColumn": "Id", "toTable": "Unit", "toColumn": "Id", "fromCardinality": "many", "toCardinality": "many", "isActive": True}],
                "expressions": [{"name": "Param", "kind": "m", "expression": "1"}],
            },
        }
    ),
    "sub/Ledger.Report/report.json": json.dumps(
        {
            "sections": [
                {
                    "name": "s1",
                    "displayName": "Books",
                    "visualContainers": [
                        {
                            "id": 7,
                            "config": json.dumps({"name": "c7", "singleVisual": {"visualType": "clusteredColumnChart", "prototypeQuery": {"From": [{"Name": "e", "Entity": "Entry"}], "Select": [{"Measure": {"Expression": {"SourceRef": {"Source": "e"}}, "Property": "Sum Value"}}]}, "vcObjects": title("'Values'")}}),
                            "filters": [{"expression": column("Unit", "Name")}],
                        },
                        {"name": "broken", "config": "{"},
                    ],
                }
            ]
        }
    ),
}


def write(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return path

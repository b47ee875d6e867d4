"""Where a partition's data comes from, told from its query text, and redaction of secrets in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of match: pattern, kind, text before the first group, text before the second
#: if it is there, or a constant text.
ORIGINS = (
    (r'Sql\.Database\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?', "SQL Server", "Server: ", ", Database: "),
    (r'Sql\.Databases\s*\(\s*"([^"]+)"', "SQL Server", "Server: ", None),
    (r'(?:Excel\.Workbook|Excel\.Sheet)\s*\(\s*File\.Contents\s*\(\s*"([^"]+)"', "Excel", "File: ", None),
    (r"Excel\.Workbook\s*\(", "Excel", None, "Excel Workbook"),
    (r'SharePoint\.(?:Files|Tables|Contents)\s*\(\s*"([^"]+)"', "SharePoint", "URL: ", None),
    (r'Csv\.Document\s*\(\s*File\.Contents\s*\(\s*"([^"]+)"', "CSV", "File: ", None),
    (r"Csv\.Document\s*\(", "CSV", None, "CSV Document"),
    (r'Web\.(?:Contents|Page|BrowserContents)\s*\(\s*"([^"]+)"', "Web", "URL: ", None),
    (r"(?:PowerBI|PowerPlatform)\.Dataflows\s*\(", "Dataflow", None, "Power BI Dataflow"),
    (r'Oracle\.Database\s*\(\s*"([^"]+)"', "Oracle", "Server: ", None),
    (r'PostgreSQL\.Database\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?', "PostgreSQL", "Server: ", ", Database: "),
    (r'MySQL\.Database\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?', "MySQL", "Server: ", ", Database: "),
    (r'Snowflake\.Databases\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?', "Snowflake", "Server: ", ", Warehouse/DB: "),
    (r'AzureStorage\.(?:Blobs|DataLake|Tables)\s*\(\s*"([^"]+)"', "Azure Storage", "Account/URL: ", None),
    (r'Folder\.Files\s*\(\s*"([^"]+)"', "Folder", "Path: ", None),
    (r'OData\.Feed\s*\(\s*"([^"]+)"', "OData", "Feed URL: ", None),
    (r"Salesforce\.(?:Data|Reports)\s*\(", "Salesforce", None, "Salesforce Connection"),
    (r'Sap(?:Hana|BusinessWarehouse)\.(?:Database|Cubes)\s*\(\s*"([^"]+)"', "SAP", "Server: ", None),
    (r'AnalysisServices\.Database\s*\(\s*"([^"]+)"(?:\s*,\s*"([^"]+)")?', "Analysis Services", "Server: ", ", Database: "),
    (r"(?:#table|Table\.FromRows|DATATABLE)\s*\(", "Enter Data", None, "Inline / Entered Data Table"),
)
SECRET_NAMES = "password|pwd|secret|access_token|apikey|api_key|bearer"


def origin(expression: Column, kind: Column) -> Column:
    """struct<source_type, source_details>: the first origin whose pattern is found."""
    pair = lambda a, b: F.struct(F.lit(a).alias("source_type"), (b if isinstance(b, Column) else F.lit(b)).alias("source_details"))
    out = F.when(F.lower(kind).isin("calculated", "calculation"), pair("DAX Calculated Table", "Model Internal DAX Expression"))
    for pattern, name, first, second in ORIGINS:
        p = f"(?i){pattern}"
        if first is None:
            text = F.lit(second)
        else:
            text = F.concat(F.lit(first), F.regexp_extract(expression, p, 1))
            if second is not None:
                more = F.regexp_extract(expression, p, 2)
                text = F.concat(text, F.when(more != "", F.concat(F.lit(second), more)).otherwise(""))
        out = out.when(expression.rlike(p), pair(name, text))
    is_query = F.contains(expression, F.lit("let")) & F.contains(expression, F.lit("in"))
    return out.when(is_query, pair("Other (Power Query M)", "Custom M Query")).otherwise(pair("Unknown", "Unknown"))


def redacted(expression: Column) -> Column:
    double = F.regexp_replace(expression, rf'(?i)({SECRET_NAMES})\s*=\s*"[^"]*"', '$1="[REDACTED]"')
    return F.regexp_replace(double, rf"(?i)({SECRET_NAMES})\s*=\s*'[^']*'", "$1='[REDACTED]'")

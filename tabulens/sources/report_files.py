"""Pages and visuals of reports, in folders of files or in one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.visuals import at

PAGE = r"^(?:definition/)?pages/([^/]+)/"


def folder_pages(files: DataFrame) -> DataFrame:
    """schemas.RAW_PAGE of reports with a folder for each page; a page file that is no JSON counts as empty."""
    rows = files.withColumn("folder", F.regexp_extract("rel", PAGE, 1)).filter("folder <> ''")
    own = F.when(F.col("rel").rlike(PAGE + r"page\.json$"), F.col("text"))
    per = rows.groupBy("project_id", "folder").agg(F.max(own).alias("raw"))
    doc = F.try_parse_json("raw")
    page_id = F.coalesce(at(doc, "$.name"), "folder")
    ord_ = F.expr("CAST(row_number() OVER (PARTITION BY project_id ORDER BY folder) - 1 AS INT)")
    return per.withColumn("ord", ord_).select("project_id", "folder", "ord", page_id.alias("page_id"), F.coalesce(at(doc, "$.displayName"), page_id).alias("page_name"), F.coalesce("raw", F.lit("{}")).alias("raw"))


def folder_visuals(files: DataFrame, pages: DataFrame) -> DataFrame:
    """schemas.RAW_VISUAL: a visual is a folder with a file visual.json, or a JSON file of its own."""
    inner = F.regexp_extract("rel", PAGE + r"visuals/(.*)$", 2)
    rows = files.withColumns({"folder": F.regexp_extract("rel", PAGE, 1), "inner": inner}).filter("inner RLIKE '^[^/]+/visual[.]json$' OR inner RLIKE '(?i)^[^/]+[.]json$'")
    default = F.regexp_replace(F.substring_index("inner", "/", 1), r"(?i)\.json$", "")
    doc = F.try_parse_json("text")
    met = rows.withColumn("place", F.substring_index("inner", "/", 1)).join(pages.select("project_id", "folder", F.col("ord").alias("page_ord"), "page_id", "page_name"), ["project_id", "folder"])
    visual_id = F.coalesce(at(doc, "$.name"), default)
    ord_ = F.expr("CAST(row_number() OVER (PARTITION BY project_id ORDER BY page_ord, place) - 1 AS INT)")
    raw_type = F.coalesce(at(doc, "$.visual.visualType"), at(doc, "$.visualType"), F.lit("Unknown"))
    return met.withColumn("ord", ord_).select(
        "project_id", "page_id", "page_name", "ord", visual_id.alias("visual_id"), visual_id.alias("visual_name"), raw_type.alias("raw_type"), F.when(doc.isNotNull(), F.col("text")).otherwise("{}").alias("raw")
    )


def sections(files: DataFrame) -> DataFrame:
    """(project_id, ord, section variant): the pages of reports in one document."""
    rows = files.filter("rel = 'report.json' OR rel = 'definition/report.json'").groupBy("project_id").agg(F.min_by("text", "rel").alias("text"))
    listed = at(F.try_parse_json("text"), "$.sections", "array<variant>")
    return rows.select("project_id", F.posexplode(listed).alias("ord", "section"))


def document_pages(found: DataFrame) -> DataFrame:
    page_id = F.coalesce(at(F.col("section"), "$.name"), F.lit(""))
    return found.select("project_id", "ord", page_id.alias("page_id"), F.coalesce(at(F.col("section"), "$.displayName"), page_id).alias("page_name"), F.to_json("section").alias("raw"))


def document_visuals(found: DataFrame) -> DataFrame:
    """schemas.RAW_VISUAL of sections: a container's configuration is an object or its text, and what is no JSON counts
    as empty; its filters are put with it."""
    page_id = F.coalesce(at(F.col("section"), "$.name"), F.lit(""))
    rows = found.select("project_id", F.col("ord").alias("page_ord"), page_id.alias("page_id"), F.coalesce(at(F.col("section"), "$.displayName"), page_id).alias("page_name"), F.posexplode(at(F.col("section"), "$.visualContainers", "array<variant>")).alias("place", "v"))
    config = F.coalesce(at(F.col("v"), "$.config"), F.lit("{}"))
    text = F.when(F.startswith(F.to_json(F.try_parse_json(config)), F.lit("{")), F.to_json(F.try_parse_json(config))).otherwise("{}")
    rows = rows.withColumns({"text": text, "filters": F.to_json(at(F.col("v"), "$.filters", "variant"))})
    body = F.substring(F.col("text"), F.lit(2), F.length("text"))
    raw = F.when(F.col("filters").isNull(), F.col("text")).otherwise(F.concat(F.lit('{"filters":'), "filters", F.when(F.col("text") == "{}", "").otherwise(","), body))
    doc = F.try_parse_json("text")
    visual_id = F.coalesce(at(F.col("v"), "$.id"), at(F.col("v"), "$.name"), F.lit("Unknown"))
    ord_ = F.expr("CAST(row_number() OVER (PARTITION BY project_id ORDER BY page_ord, place) - 1 AS INT)")
    return rows.withColumn("ord", ord_).select(
        "project_id", "page_id", "page_name", "ord", visual_id.alias("visual_id"), F.coalesce(at(doc, "$.name"), visual_id).alias("visual_name"),
        F.coalesce(at(doc, "$.singleVisual.visualType"), at(doc, "$.visualType"), F.lit("Unknown")).alias("raw_type"), raw.alias("raw"),
    )

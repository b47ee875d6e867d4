"""Models in JSON: raw tables out of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.visuals import at
from .archive import name_of

PAIR = "struct<name:variant,value:variant>"
COLUMN = "struct<name:string,dataType:string,isHidden:boolean,isKey:boolean,type:string,expression:variant,formatString:string,description:variant,sourceColumn:string,dataCategory:string,summarizeBy:string,variations:variant,annotations:variant>"
MEASURE = "struct<name:string,expression:variant,formatString:string,description:variant,isHidden:boolean,lineageTag:string>"
PARTITION = "struct<name:string,mode:string,source:struct<type:string,expression:variant>>"
TABLE = f"struct<name:string,isHidden:boolean,description:variant,dataCategory:string,markAsDateTable:boolean,annotations:variant,columns:array<{COLUMN}>,measures:array<{MEASURE}>,partitions:array<{PARTITION}>>"
RELATIONSHIP = "struct<name:string,fromTable:string,fromColumn:string,toTable:string,toColumn:string,cardinality:string,fromCardinality:string,toCardinality:string,crossFilteringBehavior:string,isActive:string>"


def text(v: Column) -> Column:
    """A string, or the lines of an array of strings."""
    return F.coalesce(F.array_join(at(v, "$", "array<string>"), "\n"), at(v, "$"))


def annotations(v: Column) -> Column:
    """Names and values, of an array of objects or of one object."""
    listed = F.transform(at(v, "$", f"array<{PAIR}>"), lambda a: F.struct(at(a["name"], "$").alias("name"), at(a["value"], "$").alias("value")))
    mapped = F.transform(F.map_entries(at(v, "$", "map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return F.coalesce(listed, mapped, F.array().cast(schemas.ANNOTATIONS))


def documents(files: DataFrame) -> DataFrame:
    """(project_id, doc variant, model variant): of a project's model files the best named, then the first by path."""
    name = F.lower(name_of(F.col("rel")))
    rank = F.when(F.col("rel") == "model.bim", 0).when(F.col("rel") == "model.json", 1).when(F.lower("rel") == "datamodel.json", 2).when(F.endswith(name, F.lit(".bim")) | (name == "datamodel.json"), 3)
    one = files.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("project_id").agg(F.min_by("text", F.struct("rank", "path")).alias("text"))
    doc = one.withColumn("doc", F.try_parse_json("text"))
    return doc.select("project_id", "doc", F.coalesce(at(F.col("doc"), "$.model", "variant"), F.col("doc")).alias("model"))


def array_at(model: Column, path: str, item: str) -> Column:
    """The array at a path, its items one by one, so that one of odd types does not take the others along."""
    each = F.transform(at(model, path, "array<variant>"), lambda v: at(v, "$", item))
    return F.coalesce(F.filter(each, lambda x: x.isNotNull()), F.array().cast(f"array<{item}>"))


def raw_tables(docs: DataFrame) -> DataFrame:
    t = F.col("t")
    cast = lambda c, kind: c.cast(kind)
    some = lambda a, kind: F.coalesce(a, F.array().cast(kind))
    no = F.lit("")
    column = lambda x, i: F.struct(
        i.alias("ord"), x["name"].alias("name"), x["dataType"].alias("dataType"), x["isHidden"].alias("isHidden"), x["isKey"].alias("isKey"), x["type"].alias("type"), F.coalesce(text(x["expression"]), no).alias("expression"),
        x["formatString"].alias("formatString"), text(x["description"]).alias("description"), x["sourceColumn"].alias("sourceColumn"), x["dataCategory"].alias("dataCategory"), x["summarizeBy"].alias("summarizeBy"),
        F.coalesce(F.nullif(at(x["variations"], "$"), F.lit("[]")).isNotNull(), F.lit(False)).alias("hasDateVariation"), no.alias("defaultHierarchy"), annotations(x["annotations"]).alias("annotations"),
    )
    measure = lambda x, i: F.struct(i.alias("ord"), x["name"].alias("name"), F.coalesce(text(x["expression"]), no).alias("expression"), x["formatString"].alias("formatString"), text(x["description"]).alias("description"), x["isHidden"].alias("isHidden"), x["lineageTag"].alias("lineageTag"))
    partition = lambda x, i: F.struct(i.alias("ord"), x["name"].alias("name"), x["mode"].alias("mode"), F.coalesce(x["source"]["type"], F.lit("m")).alias("type"), F.coalesce(text(x["source"]["expression"]), no).alias("expression"))
    rows = docs.select("project_id", F.posexplode(array_at(F.col("model"), "$.tables", TABLE)).alias("ord", "t"))
    return rows.select(
        "project_id", "ord", F.coalesce(t["name"], no).alias("name"), t["isHidden"].alias("isHidden"), text(t["description"]).alias("description"), t["dataCategory"].alias("dataCategory"), t["markAsDateTable"].alias("markAsDateTable"),
        annotations(t["annotations"]).alias("annotations"), cast(some(F.transform(t["columns"], column), f"array<{schemas.COLUMN}>"), f"array<{schemas.COLUMN}>").alias("columns"),
        cast(some(F.transform(t["measures"], measure), f"array<{schemas.MEASURE}>"), f"array<{schemas.MEASURE}>").alias("measures"), cast(some(F.transform(t["partitions"], partition), f"array<{schemas.PARTITION}>"), f"array<{schemas.PARTITION}>").alias("partitions"),
    )


def raw_relationships(docs: DataFrame) -> DataFrame:
    rows = docs.select("project_id", F.posexplode(array_at(F.col("model"), "$.relationships", RELATIONSHIP)).alias("ord", "r"))
    return rows.select("project_id", "ord", F.col("r.name").alias("id"), *[F.col(f"r.{c}") for c in ("fromTable", "fromColumn", "toTable", "toColumn", "cardinality", "fromCardinality", "toCardinality", "crossFilteringBehavior", "isActive")])


def raw_expressions(docs: DataFrame) -> DataFrame:
    rows = docs.select("project_id", F.posexplode(array_at(F.col("model"), "$.expressions", "struct<name:string,kind:string,expression:variant>")).alias("ord", "e"))
    return rows.select("project_id", "ord", F.col("e.name").alias("name"), F.coalesce(text(F.col("e.expression")), F.lit("")).alias("expression"), F.coalesce("e.kind", F.lit("m")).alias("kind"))


def raw_models(docs: DataFrame) -> DataFrame:
    m, d = F.col("model"), F.col("doc")
    return docs.select(
        "project_id", F.coalesce(at(d, "$.name"), at(m, "$.name")).alias("name"), at(m, "$.culture").alias("culture"), F.coalesce(at(d, "$.compatibilityLevel"), at(m, "$.compatibilityLevel")).alias("compatibilityLevel"),
        at(m, "$.sourceQueryCulture").alias("sourceQueryCulture"), at(m, "$.defaultPowerBIDataSourceVersion").alias("defaultPowerBIDataSourceVersion"),
    )

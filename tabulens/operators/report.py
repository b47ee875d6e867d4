"""Pages and visuals of reports, and the objects that visuals use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import visuals as V
from .resolve import Catalog, resolve_fields

#: Levels of nesting that are walked before a look whether any is left.
LEVELS = 10
#: Columns that visuals are dealt by, once: all that is done with each of them after that is done where it lies.
DEALT = ["project_id", "page_id", "visual_type"]


def visuals(raw: DataFrame) -> DataFrame:
    """Raw visuals (schemas.RAW_VISUAL) with their types, titles and names.

    A visual's name is the one a user gave it, unless that is its id or looks like one; or its title; or
    its type and a number, which counts the visuals of that type on the page that have neither, in order.
    """
    # Dealt before their JSON is read, to as many tasks as are set: by their few bytes, a million of them would be one task or a handful.
    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = raw.withColumn("visual_type", V.visual_type(F.col("raw_type"))).repartition(tasks, *DEALT).withColumn("doc", F.try_parse_json("raw"))
    filled = lambda title: V.bound(title, lambda x: F.when(x != "", x))
    out = out.withColumn("read", V.config(F.col("doc"))).withColumn("inner", V.config(F.col("read.visual")))
    titles = [filled(V.config_title(F.col(c))) for c in ("inner", "read")]
    out = out.withColumns({"own": V.explicit_name(F.col("read"), F.col("inner")), "visual_title": F.coalesce(*titles, F.lit(""))})
    given = F.when((F.col("own") != "") & (F.col("own") != F.col("visual_id")) & ~F.col("own").rlike("(?i)^[0-9a-f]{8,}$"), N.strip(F.col("own")))
    out = out.withColumn("named", F.coalesce(given, F.nullif("visual_title", F.lit(""))))
    sofar = F.sum(F.when(F.col("named").isNull(), 1).otherwise(0)).over(W.partitionBy(*DEALT).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    name = F.coalesce("named", F.concat_ws(" ", "visual_type", sofar))
    return out.withColumn("visual_name", name).select("project_id", "page_id", "page_name", "ord", "visual_id", "visual_name", "visual_type", "visual_title", "raw")


def shown_title(title: Column) -> Column:
    text = N.strip(F.coalesce(title, F.lit("")))
    return F.when(title.isin("", "None", "Untitled") | title.isNull(), "Untitled").otherwise(text)


def each_reference(found: DataFrame) -> DataFrame:
    """found without raw and with f: as field_references(), but for visuals that are alike in all columns."""
    kept = [c for c in found.columns if c != "raw"]
    rows = found.withColumn("doc", F.try_parse_json("raw"))
    rows = rows.select(*kept, V.aliases(F.col("doc")).alias("known"), V.held(F.col("doc"), F.col("raw"), LEVELS).alias("held"))
    fields = F.transform("held", lambda x: V.field_at(x["key"], x["value"], F.col("known")))
    title = F.when(F.col("visual_title").contains("["), V.title_field(F.col("visual_title")))
    return rows.select(*kept, F.explode(F.array_distinct(F.concat(fields, F.array(title)))).alias("f")).filter("f IS NOT NULL")


def field_references(found: DataFrame) -> DataFrame:
    """found without raw and with f (table, name, kind): a row for each distinct field reference anywhere in a visual's JSON (raw), and for that in its title.

    A visual's JSON is walked within its row, as arrays of variants, so that its other columns are not copied for all that is nested in it. What is not JSON
    has no references of its own.
    """
    return each_reference(found).distinct()


def field_uses(found: DataFrame, cat: Catalog) -> DataFrame:
    """A row for each distinct field reference of each visual, resolved or not."""
    rows = each_reference(found)
    flat = rows.select("project_id", "page_id", "page_name", "ord", "visual_id", "visual_name", "visual_type", shown_title(F.col("visual_title")).alias("visual_title"), "f.table", "f.name")
    return resolve_fields(flat.distinct(), cat)


def visual_usage(uses: DataFrame) -> DataFrame:
    """Direct uses: a row for each object of each visual."""
    f = F.col("found")
    keys = ["project_id", "page_id", "page_name", "ord", "visual_id", "visual_name", "visual_type", "visual_title"]
    rows = uses.filter("found IS NOT NULL").select(
        *keys, f["kind"].alias("object_type"), f["table_name"].alias("table_name"),
        F.when(f["name"] != "", f["name"]).otherwise(f["table_name"]).alias("object_name"),
        N.canonical(f["kind"], f["table_name"], f["name"]).alias("canonical"),
    )
    return rows.distinct().withColumn("usage_type", F.lit("Direct"))


def visual_metrics(uses: DataFrame) -> DataFrame:
    """Visuals with a resolved reference, and with an unresolved one; a visual can count as both."""
    per = uses.groupBy("project_id", "page_id", "ord", "visual_id").agg(F.bool_or(F.col("found").isNotNull()).alias("yes"), F.bool_or(F.col("found").isNull()).alias("no"))
    return per.groupBy("project_id").agg(F.count_if("yes").alias("visuals_with_parsed_references"), F.count_if("no").alias("visuals_with_unresolved_references"))

"""Flat tables of a model, out of its raw nested tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import origins

#: Annotations and names that mark a date table.
DATE_ANNOTATIONS = ("isTableDate", "isCustomDateTable", "__PBI_IsDateTable", "isDateTable", "markAsDateTable")
DATE_TYPES, DATE_NAMES = ("datetime", "date"), ("date", "calendardate")


def model_info(projects: DataFrame, raw_model: DataFrame) -> DataFrame:
    joined = projects.join(raw_model, "project_id", "left")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    return joined.select(
        "project_id", "project_name",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("model_name"), F.lit("")), F.lit("Model")).alias("model_name"),
        "model_format", known("culture").alias("culture"), known("compatibilityLevel").alias("compatibility_level"),
        known("sourceQueryCulture").alias("source_query_culture"), known("defaultPowerBIDataSourceVersion").alias("default_data_source_version"),
    )


def user_tables(raw: DataFrame, include_system: bool = False) -> DataFrame:
    """Raw tables that are not the system's."""
    return raw if include_system else raw.filter(~N.is_system_table(F.col("name"), F.col("annotations")))


def tables(raw: DataFrame, include_system: bool = False) -> DataFrame:
    return user_tables(raw, include_system).filter("name <> ''").select(
        "project_id", "ord", F.col("name").alias("table_name"),
        N.table_type(F.col("name")).alias("table_type"),
        N.yes_no(F.coalesce("isHidden", F.lit(False))).alias("is_hidden"),
        N.or_none(F.col("dataCategory")).alias("data_category"),
        N.or_none(F.col("description")).alias("description"),
    )


def items(raw: DataFrame, field: str, include_system: bool = False) -> DataFrame:
    """(project_id, table_name, ord, x): a row for each element of a nested list; ord is (table's, own)."""
    rows = user_tables(raw, include_system).select("project_id", F.col("name").alias("table_name"), F.col("ord").alias("table_ord"), F.posexplode(field).alias("own_ord", "x"))
    return rows.select("project_id", "table_name", F.struct("table_ord", "own_ord").alias("ord"), "x")


def has_variation(x: Column) -> Column:
    return F.coalesce(x["hasDateVariation"], F.lit(False)) | N.is_date_variation(x["expression"])


def is_calculated(x: Column) -> Column:
    typed = F.coalesce(x["type"].isin("calculated", "calculatedTableColumn"), F.lit(False))
    return typed | ((F.coalesce(x["expression"], F.lit("")) != "") & ~has_variation(x))


def columns(raw: DataFrame, include_system: bool = False) -> DataFrame:
    x = F.col("x")
    return items(raw, "columns", include_system).filter(x["name"] != "").select(
        "project_id", "ord", "table_name", x["name"].alias("column_name"),
        F.coalesce(x["dataType"], F.lit("Unknown")).alias("data_type"),
        N.yes_no(F.coalesce(x["isHidden"], F.lit(False))).alias("is_hidden"),
        F.when(is_calculated(x), "Calculated").otherwise("Data").alias("column_type"),
        N.yes_no(has_variation(x)).alias("date_variation"),
        N.or_none(x["formatString"]).alias("format_string"),
        N.or_none(x["sourceColumn"]).alias("source_column"),
        N.or_none(x["description"]).alias("description"),
    )


def expression_or_unknown(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", N.strip(text)).otherwise("Unknown")


def calculated_columns(raw: DataFrame, include_system: bool = False) -> DataFrame:
    x = F.col("x")
    return items(raw, "columns", include_system).filter(is_calculated(x)).select(
        "project_id", "ord", "table_name", F.coalesce(x["name"], F.lit("")).alias("column_name"),
        F.coalesce(x["dataType"], F.lit("Unknown")).alias("data_type"),
        expression_or_unknown(x["expression"]).alias("dax_expression"),
        N.yes_no(F.coalesce(x["isHidden"], F.lit(False))).alias("is_hidden"),
    )


def measures(raw: DataFrame, include_system: bool = False) -> DataFrame:
    x = F.col("x")
    return items(raw, "measures", include_system).filter(x["name"] != "").select(
        "project_id", "ord", "table_name", x["name"].alias("measure_name"),
        expression_or_unknown(x["expression"]).alias("dax_expression"),
        N.or_none(x["formatString"]).alias("format_string"),
        N.yes_no(F.coalesce(x["isHidden"], F.lit(False))).alias("is_hidden"),
        N.or_none(x["description"]).alias("description"),
    )


def partitions(raw: DataFrame, shared: DataFrame, include_system: bool = False) -> DataFrame:
    """Partitions of tables, then shared expressions, which carry a label for a table."""
    x = F.col("x")
    text = lambda c: N.strip(F.coalesce(c, F.lit("")))
    own = items(raw, "partitions", include_system).select(
        "project_id", F.lit(0).alias("part"), "ord", F.col("table_name").alias("table"), F.coalesce(x["name"], F.lit("")).alias("partition"),
        F.coalesce(x["type"], F.lit("m")).alias("type"), text(x["expression"]).alias("expression"),
    )
    rest = shared.select(
        "project_id", F.lit(1).alias("part"), F.struct(F.col("ord").alias("table_ord"), F.lit(0).alias("own_ord")).alias("ord"),
        F.concat(F.lit("[Shared Expression] "), F.coalesce("name", F.lit(""))).alias("table"), F.lit("shared").alias("partition"),
        F.coalesce("kind", F.lit("m")).alias("type"), text(F.col("expression")).alias("expression"),
    )
    return own.unionByName(rest)


def data_sources(parts: DataFrame) -> DataFrame:
    """Origin of each partition that has a query; it is told from the raw text, and shown without secrets."""
    found = parts.filter("expression <> ''").withColumn("origin", origins.origin(F.col("expression"), F.col("type")))
    return found.select(
        "project_id", "part", "ord", "table", "origin.source_type", "origin.source_details",
        N.or_none(origins.redacted(F.col("expression"))).alias("m_expression"),
    )


def raw_relationships(raw: DataFrame) -> DataFrame:
    """Relationships with no system table at either end, told by name alone."""
    return raw.filter(~N.is_system_table(F.col("fromTable")) & ~N.is_system_table(F.col("toTable")))


def relationships(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.filter((text("fromTable") != "") | (text("toTable") != "")).select(
        "project_id", "ord",
        text("fromTable").alias("from_table"), text("fromColumn").alias("from_column"), text("toTable").alias("to_table"), text("toColumn").alias("to_column"),
        N.cardinality(F.col("cardinality"), F.col("fromCardinality"), F.col("toCardinality")).alias("cardinality"),
        N.filter_direction(F.col("crossFilteringBehavior")).alias("filter_direction"),
        N.status(F.col("isActive")).alias("status"),
    )


def key_columns(found: DataFrame) -> DataFrame:
    """Two rows for each relationship, one for each end."""
    c = F.col("cardinality")
    role = lambda side, many, one: F.when(c.isin(*many), f"{side} (Many)").when(c.isin(*one), f"{side} (One)").otherwise(side)
    end = lambda k, a, b, r: F.struct(F.lit(k).alias("side"), F.col(f"{a}_table").alias("table"), F.col(f"{a}_column").alias("column"), r.alias("relationship_role"), F.col(f"{b}_table").alias("related_table"), F.col(f"{b}_column").alias("related_column"))
    ends = F.array(end(0, "from", "to", role("From", ("M:1", "M:M"), ("1:1", "1:M"))), end(1, "to", "from", role("To", ("1:M", "M:M"), ("M:1", "1:1"))))
    return found.select("project_id", "ord", F.inline(ends))


def relationship_metrics(found: DataFrame) -> DataFrame:
    """Counts a project, by state, cardinality and direction."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return found.groupBy("project_id").agg(
        F.count("*").alias("total"),
        count("status", "Active").alias("active"),
        (F.count("*") - count("status", "Active")).alias("inactive"),
        *[count("cardinality", v).alias(a) for v, a in (("1:1", "one_to_one"), ("1:M", "one_to_many"), ("M:1", "many_to_one"), ("M:M", "many_to_many"))],
        count("filter_direction", "Single").alias("single_direction"),
        count("filter_direction", "Both").alias("both_directions"),
    )


def date_tables(raw: DataFrame) -> DataFrame:
    """User tables marked as date tables, with the reasons, in a fixed order, and their date column."""
    lower = lambda c: N.key(F.coalesce(c, F.lit("")))
    dated = lambda x: lower(x["dataType"]).isin(*DATE_TYPES) | F.lower(x["name"]).isin(*DATE_NAMES)
    is_key = lambda x: F.coalesce(x["isKey"], F.lit(False)) & (dated(x) | (lower(x["dataCategory"]) == "time"))
    none = F.array().cast("array<string>")
    first = lambda p: F.get(F.filter("columns", p), F.lit(0))
    key = first(is_key)
    notes = F.transform(
        F.filter(F.coalesce("annotations", F.array().cast("array<struct<name:string,value:string>>")), lambda a: a["name"].isin(*DATE_ANNOTATIONS)),
        lambda a: F.concat(F.lit("Annotation: "), a["name"], F.lit("="), F.lower(F.coalesce(a["value"], F.lit("")))),
    )
    reasons = F.concat(
        F.when(lower(F.col("dataCategory")) == "time", F.array(F.lit("dataCategory = 'Time'"))).otherwise(none),
        notes,
        F.when(F.col("markAsDateTable"), F.array(F.lit("markAsDateTable = True"))).otherwise(none),
        F.when(key.isNotNull(), F.array(F.concat(F.lit("Key Column '"), key["name"], F.lit("' (dataType="), F.coalesce(key["dataType"], F.lit("dateTime")), F.lit(")")))).otherwise(none),
    )
    return user_tables(raw).filter("name <> ''").withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(
        "project_id", "ord", F.col("name").alias("table_name"),
        F.coalesce(key["name"], first(dated)["name"], F.lit("None")).alias("date_column"),
        F.array_join("reasons", "; ").alias("marked_reason"),
        F.when(F.coalesce("isHidden", F.lit(False)), "Yes").otherwise("No").alias("is_hidden"),
        F.greatest(F.size("columns"), F.lit(0)).alias("total_columns"),
    )


def date_summary(raw: DataFrame, found: DataFrame) -> DataFrame:
    """A row a project: whether it has date tables, and their names. Projects without tables are absent."""
    names = found.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", "table_name"))).alias("t"))
    every = raw.select("project_id").distinct().join(names, "project_id", "left")
    joined = F.array_join(F.transform("t", lambda x: x["table_name"]), ", ")
    return every.select("project_id", F.when(F.col("t").isNotNull(), "Yes").otherwise("No").alias("date_table_exists"), F.coalesce(joined, F.lit("None")).alias("date_table_name"))

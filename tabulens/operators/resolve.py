"""Resolution of names against a model's catalogue, as equi-joins on folded names.

A catalogue holds, for each project, tables by name and objects (columns, calculated columns, measures) by
table and name. Where the rules prefer one candidate, the preference is settled on the
catalogue's side before the join, so that a reference meets at most one row of each lookup.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N


@dataclass(frozen=True)
class Catalog:
    """tables (project_id, table_key, table_name): of names alike but for case the last counts.
    objects (project_id, table_name, name, name_key, kind, prio, ord): prio 0 is a column, 1 a measure."""

    tables: DataFrame
    objects: DataFrame


def catalog(tables: DataFrame, columns: DataFrame, measures: DataFrame, calculated: DataFrame) -> Catalog:
    by_key = (
        tables.filter("table_name <> ''")
        .groupBy("project_id", F.lower("table_name").alias("table_key"))
        .agg(F.max_by("table_name", "ord").alias("table_name"))
    )
    marked = calculated.select("project_id", "table_name", "column_name").distinct().withColumn("calculated", F.lit(True))
    cols = columns.filter("table_name <> '' AND column_name <> ''").join(marked, ["project_id", "table_name", "column_name"], "left")
    objects = cols.select(
        "project_id", "table_name", F.col("column_name").alias("name"),
        F.when(F.col("calculated"), "Calculated Column").otherwise("Column").alias("kind"), F.lit(0).alias("prio"), "ord",
    ).unionByName(
        measures.filter("table_name <> '' AND measure_name <> ''").select(
            "project_id", "table_name", F.col("measure_name").alias("name"), F.lit("Measure").alias("kind"), F.lit(1).alias("prio"), "ord"
        )
    )
    return Catalog(by_key, objects.withColumn("name_key", F.lower("name")))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in columns])


def qualified(cat: Catalog) -> DataFrame:
    """(project_id, table_key, name_key) -> found: of a table's objects with a name, columns before measures."""
    own = cat.objects.join(cat.tables.drop("table_key").distinct(), ["project_id", "table_name"], "left_semi")
    best = first_of(own.select("project_id", "table_name", "name_key", "name", "kind", "prio", "ord"), ["project_id", "table_name", "name_key"], ["prio", "ord"])
    keyed = best.join(cat.tables, ["project_id", "table_name"])
    return keyed.select("project_id", "table_key", "name_key", F.struct("table_name", "name", "kind").alias("found"))


def resolve(refs: DataFrame, cat: Catalog) -> DataFrame:
    """refs (project_id, kind, table, name, context, ...) with found struct<table_name, name, kind> added,
    null where nothing is found. kind is column, bracket or table; context is the table that a bracketed
    name stands in.

    A qualified name is looked up in its table. A bracketed one is a measure, that of the context
    table or else the first of the model; or a column of the context table; or the
    only column of its name in the model. Case and white space at the ends do not count.
    """
    measures, cols = cat.objects.filter("prio = 1"), cat.objects.filter("prio = 0")
    pick = F.struct("table_name", "name", "kind")
    # The measure of a table is looked up by that table's own name, in any case, whether or not the table is known.
    here = first_of(measures.select("project_id", F.lower("table_name").alias("own_key"), "name_key", pick.alias("m_here"), "ord"), ["project_id", "own_key", "name_key"], ["ord"]).drop("ord")
    anywhere = first_of(measures.select("project_id", "name_key", pick.alias("m_any"), "ord"), ["project_id", "name_key"], ["ord"]).drop("ord")
    context_col = first_of(cols.join(cat.tables, ["project_id", "table_name"]).select("project_id", F.col("table_key").alias("own_key"), "name_key", pick.alias("c_here"), "ord"), ["project_id", "own_key", "name_key"], ["ord"]).drop("ord")
    only = cols.groupBy("project_id", "name_key").agg(F.count("*").alias("n"), F.first(pick).alias("c_only")).filter("n = 1").drop("n")

    keyed = refs.withColumns({
        "name_key": N.key(F.col("name")),
        "table_key": F.when(F.col("kind") == "column", N.key(F.coalesce("table", F.lit("")))).when(F.col("kind") == "table", N.key(F.col("name"))),
        "own_key": F.lower(F.coalesce("context", F.lit(""))),
    })
    tables = cat.tables.select("project_id", "table_key", F.struct(F.col("table_name"), F.lit("").alias("name"), F.lit("Table").alias("kind")).alias("t_found"))
    out = (
        keyed.join(qualified(cat), ["project_id", "table_key", "name_key"], "left")
        .join(tables, ["project_id", "table_key"], "left")
        .join(here, ["project_id", "own_key", "name_key"], "left")
        .join(anywhere, ["project_id", "name_key"], "left")
        .join(context_col, ["project_id", "own_key", "name_key"], "left")
        .join(only, ["project_id", "name_key"], "left")
    )
    bracket = F.coalesce("m_here", "m_any", "c_here", "c_only")
    found = F.when(F.col("kind") == "column", F.col("found")).when(F.col("kind") == "table", F.col("t_found")).otherwise(bracket)
    return out.withColumn("found", found).withColumn("bracket_found", bracket).select(*refs.columns, "found", "bracket_found", "t_found")


def resolve_fields(fields: DataFrame, cat: Catalog) -> DataFrame:
    """fields (project_id, table, name, ...) of visuals, with found added: qualified by the table, if there is
    one; a table, if its own name is the field; by name alone with the table as context; a table of that name."""
    hinted = F.coalesce("table", F.lit("")) != ""
    refs = fields.withColumns({"kind": F.when(hinted, "column").otherwise("bracket"), "context": F.coalesce("table", F.lit(""))})
    step = resolve(refs, cat).drop("t_found")
    tables = cat.tables.select("project_id", F.col("table_key").alias("as_table"), F.struct(F.col("table_name"), F.lit("").alias("name"), F.lit("Table").alias("kind")).alias("t_found"))
    step = step.withColumn("as_table", N.key(F.col("name"))).join(tables, ["project_id", "as_table"], "left")
    same = F.when(F.col("name") == F.col("table"), F.col("t_found"))
    found = F.when(hinted, F.coalesce("found", same, "bracket_found", "t_found")).otherwise(F.coalesce("bracket_found", "t_found"))
    named = F.when(F.coalesce("name", F.lit("")) != "", found)
    return step.withColumn("found", named).select(*fields.columns, "found")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """A row number from 0 within keys."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)

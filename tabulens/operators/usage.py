"""Use of a model's objects by visuals, direct and through dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from . import graph as G


def object_universe(measures: DataFrame, calculated: DataFrame, columns: DataFrame) -> DataFrame:
    """(project_id, part, ord, object_type, table_name, object_name, canonical): measures, calculated
    columns, and the columns that are none of these. Tables are not objects here."""
    pick = lambda df, part, kind, name: df.select("project_id", F.lit(part).alias("part"), "ord", F.lit(kind).alias("object_type"), "table_name", F.col(name).alias("object_name"))
    plain = columns.join(calculated.select("project_id", "table_name", "column_name"), ["project_id", "table_name", "column_name"], "left_anti")
    every = pick(measures, 0, "Measure", "measure_name").unionByName(pick(calculated, 1, "Calculated Column", "column_name")).unionByName(pick(plain, 2, "Column", "column_name"))
    return every.withColumn("canonical", N.canonical(F.col("object_type"), F.col("table_name"), F.col("object_name")))


def reach(usage: DataFrame, graph: DataFrame, paths: bool = True) -> DataFrame:
    """The closure of all objects that are used, each of which is followed once."""
    return G.closure(graph, usage.select("project_id", F.col("canonical").alias("root")), paths)


def ways(usage: DataFrame, graph: DataFrame) -> G.Ways:
    """The ways from all objects that are used, each of which is followed once."""
    return G.ways(graph, usage.select("project_id", F.col("canonical").alias("root")))


def lineage(usage: DataFrame, ways: G.Ways) -> DataFrame:
    """Distinct paths from a visual's object to another: usage rows and the ways() of their objects in, the first usage row of each path out.

    usage needs page_name, visual_name, visual_title, object_name and ord; rows alike in what is shown meet as one. Paths are written out last, in the
    row of a use, so that none is shuffled; only those that may read like another's are grouped: of objects of one name in one visual, or of trees with ways alike.
    """
    shown = ["project_id", "page_name", "visual_name", "object_name"]
    once = usage.groupBy(*shown, "canonical").agg(F.min(F.struct("ord", "visual_title")).alias("u")).withColumn("objects", F.count("*").over(W.partitionBy(*shown)))
    root = ways.of("root").withColumnRenamed("root_name", "canonical")
    uses = G.written(once.join(root, ["project_id", "canonical"]).drop("canonical"))
    keys = ["project_id", "page_name", "visual_name", "direct_object", "indirect_object", "dependency_path"]
    more = ["visual_title", "dependency_level", "dax_expression"]
    path = G.along(F.col("object_name"), lambda first, label: F.concat_ws(" -> ", first, label))
    dax = F.flatten(F.transform("daxes", lambda x: F.transform(x, lambda k: F.get("exprs", k))))
    each = F.arrays_zip(F.flatten("labels").alias("indirect_object"), path.alias("dependency_path"), G.each_level().alias("dependency_level"), dax.alias("dax_expression"))

    def rows(which: Column) -> DataFrame:
        return uses.join(ways.trees, "root").filter(which).select(*shown, "u.*", F.inline(each)).withColumnRenamed("object_name", "direct_object")

    apart = (F.col("objects") == 1) & ~F.col("alike")
    out = rows(apart).select(*keys, *more)
    if uses.filter("objects > 1").isEmpty() and ways.trees.filter("alike").isEmpty():
        return out
    first = F.min(F.struct("ord", *more)).alias("x")
    return out.unionByName(rows(~apart).groupBy(*keys).agg(first).select(*keys, *(f"x.{c}" for c in more)))


def numbered_places(usage: DataFrame) -> DataFrame:
    """usage with `number`: that of its place, a page's name and a visual's id, among those of the project, from 1.

    Numbers are dense but for gaps where a project's places lie in several partitions of the written table.
    """
    placed = usage.withColumn("place", F.struct("page_name", "visual_id"))
    found = G.written(placed.select("project_id", "place").distinct().sort("project_id").withColumn("id", F.monotonically_increasing_id()))
    first = found.groupBy("project_id").agg(F.min("id").alias("first"))
    numbers = found.join(first, "project_id").select("project_id", "place", (F.col("id") - F.col("first") + 1).alias("number"))
    return placed.join(numbers, ["project_id", "place"]).drop("place")


def used_by_root(usage: DataFrame) -> DataFrame:
    """(project_id, root, word, uses, bits): for each object that is used, its uses and its places as exact bits, a row for each word of 64 place numbers.

    A row has one number for up to 64 places, so that few places take few bytes and many take a bit each.
    """
    number = F.col("number")
    rows = numbered_places(usage).groupBy("project_id", F.col("canonical").alias("root"), F.shiftright(number, 6).alias("word"))
    return rows.agg(F.count("*").alias("uses"), F.bit_or(F.expr("shiftleft(1L, CAST(number & 63 AS INT))")).alias("bits"))


def object_usage(universe: DataFrame, usage: DataFrame, met: DataFrame) -> DataFrame:
    """Each object's counts and class. A location is a page's name and a visual's id; direct and indirect
    uses at one location count it once.

    met: reach() of usage. Uses are summed and their places made bits of words for each object that is used, before these meet what the object
    leads to; sums add up and words are or-ed along the closure, which no row of usage meets.
    """
    own = G.written(used_by_root(usage))
    ways = met.select("project_id", "root", "node", F.lit(False).alias("direct"))
    ways = ways.unionByName(own.select("project_id", "root").distinct().select("project_id", "root", F.col("root").alias("node"), F.lit(True).alias("direct")))
    flow = ways.join(own, ["project_id", "root"]).withColumnRenamed("node", "canonical")
    sums = lambda direct: F.sum(F.when(F.col("direct") == F.lit(direct), F.col("uses")).otherwise(0))
    by_word = flow.groupBy("project_id", "canonical", "word").agg(sums(True).alias("d"), sums(False).alias("i"), F.bit_count(F.bit_or("bits")).alias("places"))
    counts = by_word.groupBy("project_id", "canonical").agg(F.sum("d").alias("direct_count"), F.sum("i").alias("indirect_count"), F.sum("places").alias("location_count"))
    found = universe.join(counts, ["project_id", "canonical"], "left").fillna(0, ["direct_count", "indirect_count", "location_count"])
    direct, other = F.col("direct_count") > 0, F.col("indirect_count") > 0
    kind = F.when(direct & other, "Direct + Indirect").when(direct, "Direct").when(other, "Indirect").otherwise("Unused")
    return found.withColumns({"usage_type": kind, "used": F.when(direct | other, "Yes").otherwise("No")})


def unused_objects(found: DataFrame) -> DataFrame:
    return found.filter("usage_type = 'Unused'").select(
        "project_id", "part", "ord", "object_type", "table_name", "object_name",
        F.lit("No direct or indirect report usage detected").alias("reason"), F.lit("No").alias("direct_usage"), F.lit("No").alias("indirect_usage"),
    )


def usage_summary(found: DataFrame) -> DataFrame:
    """Counts of objects by class, a row a project; both counts of used objects include those used both ways."""
    is_in = lambda *kinds: F.count_if(F.col("usage_type").isin(*kinds))
    return found.groupBy("project_id").agg(
        F.count("*").alias("total_objects"),
        F.count_if(F.col("used") == "Yes").alias("used_objects"),
        is_in("Unused").alias("unused_objects"),
        is_in("Direct", "Direct + Indirect").alias("directly_used_objects"),
        is_in("Indirect", "Direct + Indirect").alias("indirectly_used_objects"),
        is_in("Direct + Indirect").alias("direct_and_indirect_objects"),
    )


def usage_by_name(found: DataFrame) -> DataFrame:
    """(project_id, object_name) -> counts and class of the last object of that name: objects of one name
    share what is shown for them."""
    last = F.max_by(F.struct("used", "usage_type", "direct_count", "indirect_count", "location_count"), F.struct("part", "ord")).alias("x")
    return found.groupBy("project_id", "object_name").agg(last, (F.count("*") > 1).alias("shared_name")).select("project_id", "object_name", "x.*", "shared_name")


def table_usage(tables: DataFrame, found: DataFrame) -> DataFrame:
    """A table's use, through its objects."""
    kinds = found.filter("used = 'Yes'").groupBy("project_id", "table_name").agg(F.collect_set("usage_type").alias("kinds"))
    has = lambda k: F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), k)
    label = (
        F.when(has("Direct + Indirect") | (has("Direct") & has("Indirect")), "Direct + Indirect (via child objects)")
        .when(has("Direct"), "Direct (via child objects)").when(has("Indirect"), "Indirect (via child objects)").otherwise("Unused")
    )
    return tables.join(kinds, ["project_id", "table_name"], "left").withColumn("usage_type", label).withColumn("used", F.when(F.col("usage_type") == "Unused", "No").otherwise("Yes")).drop("kinds")


def locations(usage: DataFrame) -> DataFrame:
    """(project_id, object_type, table_name, object_name) -> pages, visuals: sorted, joined by semicolons.
    A visual is named by its title, or else by its name."""
    shown = F.when(F.coalesce("visual_title", F.lit("")) != "", F.col("visual_title")).otherwise(F.col("visual_name"))
    joined = lambda c: F.array_join(F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")), "; ")
    return usage.withColumn("shown", shown).groupBy("project_id", "object_type", "table_name", "object_name").agg(joined("page_name").alias("pages"), joined("shown").alias("visuals"))


def inventory(tables: DataFrame, columns: DataFrame, measures: DataFrame, calculated: DataFrame, found: DataFrame, usage: DataFrame) -> DataFrame:
    """The model inventory: tables, columns and measures with their use and where they are used."""
    names = ["project_id", "object_type", "table_name", "object_name"]
    calc = calculated.groupBy("project_id", "table_name", "column_name").agg(F.max_by("dax_expression", "ord").alias("dax"))
    cols = columns.join(calc, ["project_id", "table_name", "column_name"], "left")
    is_calc = (F.col("column_type") == "Calculated") | F.col("dax").isNotNull()
    empty = F.lit("")
    rows = cols.select("project_id", F.lit(1).alias("part"), "ord", "table_name", F.col("column_name").alias("object_name"), F.when(is_calc, "Calculated Column").otherwise("Column").alias("object_type"), "data_type", F.coalesce("dax", empty).alias("dax_expression"), "is_hidden").unionByName(
        measures.select("project_id", F.lit(2).alias("part"), "ord", "table_name", F.col("measure_name").alias("object_name"), F.lit("Measure").alias("object_type"), empty.alias("data_type"), "dax_expression", "is_hidden")
    )
    one = found.groupBy(*names).agg(F.max_by(F.struct("used", "usage_type"), "ord").alias("u"))
    out = rows.join(one, names, "left").join(locations(usage), names, "left").select(
        "project_id", "part", "ord", "table_name", "object_name", "object_type", "data_type", "dax_expression", "is_hidden",
        F.coalesce("u.used", F.lit("No")).alias("used"), F.coalesce("u.usage_type", F.lit("Unused")).alias("usage_type"),
        F.coalesce("pages", empty).alias("pages"), F.coalesce("visuals", empty).alias("visuals"),
    )
    heads = table_usage(tables, found).select(
        "project_id", F.lit(0).alias("part"), F.struct(F.col("ord").alias("table_ord"), F.lit(-1).alias("own_ord")).alias("ord"), "table_name", F.col("table_name").alias("object_name"),
        F.lit("Table").alias("object_type"), empty.alias("data_type"), empty.alias("dax_expression"), "is_hidden", "used", "usage_type", empty.alias("pages"), empty.alias("visuals"),
    )
    return heads.unionByName(out)

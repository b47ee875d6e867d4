"""Analysis of expressions: complexity, issues and how they meet with the use of their objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lint

#: Fixed value: stands in where an issue has no suggestion.
NO_REWRITE = "No safe automatic rewrite"


def analysed(objects: DataFrame) -> DataFrame:
    """Objects with references (graph.with_references) and, added, their counts, score, issues and highest severity.

    The counts are put into columns before the rules use them, so that each is computed once.
    """
    text, mask, refs = F.col("text"), F.col("mask"), F.col("refs")
    counted = objects.withColumn("repeats", E.repeated(refs)).withColumns(E.complexity(text, mask, refs))
    counts = {k: F.col(k) for k in E.complexity(text, mask, refs)}
    scored = counted.withColumns({"complexity_score": E.score(counts), "issues": lint.issues(text, mask, F.col("repeats"), counts)})
    return scored.withColumn("highest_severity", lint.highest_severity(F.col("issues")))


def with_replies(found: DataFrame, replies: DataFrame) -> DataFrame:
    """analysed() with the issues of a provider's replies (project_id, kind, table_name, name, reply) put after the rules' own."""
    out = found.join(replies, ["project_id", "kind", "table_name", "name"], "left")
    more = F.when(F.col("reply").isNotNull(), F.array(F.col("reply").cast(lint.ISSUE))).otherwise(F.array().cast(f"array<{lint.ISSUE}>"))
    out = out.withColumns({"issues": F.concat("issues", more), "analysis_status": F.when(F.col("reply").isNotNull(), "AI Enhanced").otherwise("Static Complete")}).drop("reply")
    return out.withColumn("highest_severity", lint.highest_severity(F.col("issues")))


def analysis_records(found: DataFrame, by_name: DataFrame) -> DataFrame:
    """One row an object: its use, taken by bare name, its counts and its issues' number and severity."""
    status = F.col("analysis_status") if "analysis_status" in found.columns else F.lit("Static Complete")
    used = found.join(by_name.withColumnRenamed("object_name", "name"), ["project_id", "name"], "left")
    return used.select(
        "project_id", "ord", F.col("kind").alias("object_type"), "table_name", F.col("name").alias("object_name"), F.col("dax").alias("original_dax"),
        F.coalesce("used", F.lit("No")).alias("used"), F.coalesce("usage_type", F.lit("Unused")).alias("usage_type"),
        F.coalesce("direct_count", F.lit(0)).alias("direct_usage_count"), F.coalesce("indirect_count", F.lit(0)).alias("indirect_usage_count"),
        (F.col("referenced_measures") + F.col("referenced_columns")).alias("dependency_count"), "complexity_score",
        "character_count", "line_count", "function_count", "calculate_count", "filter_count", "iterator_count", "var_count",
        F.size("issues").alias("issue_count"), "highest_severity", status.alias("analysis_status"),
    )


def improvements(found: DataFrame) -> DataFrame:
    """One row an issue, in order within its object (issue_ord).

    The outer form and a filter after it: for the inner form the optimizer makes a filter by the array's size, which
    it pushes below all columns and with which it computes every rule once more for each place where it is used.
    """
    rows = found.select("project_id", "ord", F.col("kind").alias("object_type"), "table_name", F.col("name").alias("object_name"), F.col("dax").alias("original_dax"), F.posexplode_outer("issues").alias("issue_ord", "i")).filter("i IS NOT NULL")
    return rows.select(
        "project_id", "ord", "issue_ord", "object_type", "table_name", "object_name", "original_dax",
        F.col("i.category").alias("issue_category"), "i.severity", "i.issue", "i.explanation", "i.recommendation",
        F.when(F.coalesce("i.suggested_dax", F.lit("")) != "", F.col("i.suggested_dax")).otherwise(NO_REWRITE).alias("suggested_dax"),
        "i.confidence", "i.source", "i.validation_status",
        F.when(F.col("i.requires_manual_validation"), "Yes").otherwise("No").alias("requires_manual_validation"),
    )


def complexity_records(found: DataFrame) -> DataFrame:
    return found.select(
        "project_id", "ord", F.col("kind").alias("object_type"), "table_name", F.col("name").alias("object_name"),
        "character_count", "line_count", "function_count", "referenced_measures", "referenced_columns", "referenced_tables",
        "calculate_count", "filter_count", "iterator_count", "var_count", "nesting_depth", "complexity_score",
    )


def quality_summary(found: DataFrame, requests: int = 0, failures: int = 0) -> DataFrame:
    """Thirteen counters, a row a project; requests and failures are the provider's."""
    each = lambda p: F.size(F.filter("issues", p)).cast("long")
    severity = lambda s: F.sum(each(lambda i: i["severity"] == s))
    return found.groupBy("project_id").agg(
        F.count("*").alias("objects_analyzed"), F.count_if(F.col("kind") == "Measure").alias("measures_analyzed"),
        F.count_if(F.col("kind") == "Calculated Column").alias("calculated_columns_analyzed"), F.count_if(F.size("issues") > 0).alias("objects_with_improvements"),
        severity("High").alias("high_severity"), severity("Medium").alias("medium_severity"), severity("Low").alias("low_severity"), severity("Informational").alias("informational"),
        F.sum(each(lambda i: i["source"] == "AI")).alias("ai_suggestions"), F.sum(each(lambda i: i["source"] == "Static Rule")).alias("static_suggestions"),
        F.lit(failures).cast("long").alias("ai_failures"), F.lit(requests).cast("long").alias("ai_requests"),
        F.sum(each(lambda i: i["requires_manual_validation"])).alias("manual_validation"),
    )


def analysis_sheet(records: DataFrame, found: DataFrame) -> DataFrame:
    """Analysis records with the last improvement of the same table and name, the way the workbook shows them."""
    last = found.groupBy("project_id", "table_name", "object_name").agg(
        F.max_by(F.struct("issue", "suggested_dax", "source", "confidence", "validation_status", "requires_manual_validation"), F.struct("ord", "issue_ord")).alias("i")
    )
    out = records.join(last, ["project_id", "table_name", "object_name"], "left")
    of = lambda c, d: F.coalesce(f"i.{c}", F.lit(d))
    return out.select(
        "project_id", "ord", "table_name", "object_name", "object_type", "original_dax", "complexity_score",
        F.when(F.col("i.source") == "Static Rule", F.col("i.issue")).otherwise("None").alias("static_issues"),
        F.when(F.col("i.source") == "AI", F.col("i.issue")).otherwise("None").alias("ai_issues"),
        of("suggested_dax", NO_REWRITE).alias("suggested_dax"), of("source", "Static Rule").alias("suggestion_source"), of("confidence", "N/A").alias("ai_confidence"),
        of("validation_status", "Validated").alias("validation_status"), F.when(F.col("i").isNotNull(), "Yes").otherwise("No").alias("requires_manual_review"),
        "dependency_count", F.lit("No").alias("unresolved_references"), F.lit("No").alias("circular_dependency"),
        "usage_type", "direct_usage_count", "indirect_usage_count",
    )

"""Health of models: score, grade, deductions and advice, from one row of counts a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts that a health row needs; those absent count as 0.
COUNTS = ("cycles", "unresolved", "objects", "unused", "columns", "calculated", "odd_cardinality", "both_directions", "inactive", "high_severity", "tables", "measures", "pages", "visuals", "sources")

#: Grades from a score on, with their texts.
GRADES = (
    (90, "A (Excellent)", "Model health is excellent with strong compliance to Power BI best practices."),
    (75, "B (Good)", "Model health is good, with minor optimization and cleanup opportunities."),
    (60, "C (Fair)", "Model health has moderate issues requiring review."),
    (45, "D (Poor)", "Model health has notable risks in DAX, usage, or relationships."),
    (0, "F (Critical)", "Model health requires immediate intervention to address structural issues."),
)


def counts(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """projects (project_id) with COUNTS, from tables named by count: their rows a project, or their column of that name."""
    out = projects.select("project_id")
    for name, t in tables.items():
        per = t.select("project_id", F.col(name).cast("long").alias(name)) if name in t.columns else t.groupBy("project_id").agg(F.count("*").alias(name))
        out = out.join(per, "project_id", "left")
    return out.select("project_id", *[F.coalesce(n, F.lit(0)).alias(n) if n in tables else F.lit(0).cast("long").alias(n) for n in COUNTS])


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def penalties() -> list[tuple[Column, Column, str, str, str, Column]]:
    """(applies, points, category, severity, title, description) of each deduction, in order."""
    c = {n: F.col(n) for n in COUNTS}
    ratio = c["unused"] / F.nullif(c["objects"], F.lit(0))
    most = lambda limit, x: F.least(F.lit(limit), x).cast("int")
    many = (c["calculated"] > 5) & (c["columns"] > 0) & ((c["calculated"] > c["columns"] * 0.15) | (c["calculated"] >= 10))
    percent = F.format_string("%.0f%%", ratio * 100)
    # Limits, points and texts.
    return [
        (c["cycles"] > 0, most(25, c["cycles"] * 10), "DAX Lineage", "High", "Circular Dependencies Detected",
         text("Found ", c["cycles"], " circular dependency cycle(s) in DAX formulas. Cycles can cause runtime errors or infinite loops.")),
        (c["unresolved"] > 0, most(15, c["unresolved"] * 3), "DAX Lineage", "High", "Unresolved DAX References",
         text("Found ", c["unresolved"], " unresolved reference(s) to missing tables, columns, or measures.")),
        (ratio > 0.3, most(15, (ratio * 20).cast("int")), "Model Bloat", "Medium", "High Unused Object Ratio",
         text(c["unused"], " out of ", c["objects"], " objects (", percent, ") are not referenced by any report visual or DAX chain.")),
        (many, most(10, c["calculated"]), "Performance", "Medium", "Excessive Calculated Columns",
         text("Model contains ", c["calculated"], " calculated columns. Prefer Power Query / M or source system transformations to save VertiPaq RAM.")),
        (c["odd_cardinality"] > 0, most(10, c["odd_cardinality"] * 4), "Relationships", "Medium", "Many-to-Many / 1:1 Relationships",
         text("Found ", c["odd_cardinality"], " Many-to-Many or 1:1 relationship(s). These can produce unpredictable filter propagation.")),
        (c["both_directions"] > 0, most(10, c["both_directions"] * 3), "Relationships", "Medium", "Bidirectional Cross-Filtering",
         text("Found ", c["both_directions"], " relationship(s) set to Bidirectional filtering. Can introduce ambiguous filter paths and performance drag.")),
        (c["inactive"] > 3, most(5, c["inactive"]), "Relationships", "Low", "Multiple Inactive Relationships",
         text("Found ", c["inactive"], " inactive relationships requiring USERELATIONSHIP() pattern management.")),
        (c["high_severity"] > 0, most(10, c["high_severity"] * 3), "DAX Quality", "High", "High-Severity DAX Quality Issues",
         text(c["high_severity"], " DAX object(s) have high-severity issues (e.g. FILTER over full table, unsafe division, or excessive complexity).")),
    ]


def deductions() -> Column:
    """array<struct<category, severity, points, impact, title, description>>: those that apply, in order."""
    made = [
        F.when(p, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"), n.alias("points"), text("-", n, " pts").alias("impact"), F.lit(title).alias("title"), d.alias("description")))
        for p, n, cat, sev, title, d in penalties()
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def health(found: DataFrame) -> DataFrame:
    """counts() with score, grade, status_text and deductions."""
    out = found.withColumn("deductions", deductions())
    lost = F.aggregate("deductions", F.lit(0), lambda s, x: s + x["points"])
    out = out.withColumn("score", F.greatest(F.lit(0), F.lit(100) - lost))
    pick = lambda i: F.coalesce(*[F.when(F.col("score") >= g[0], g[i]) for g in GRADES])
    return out.withColumns({"grade": pick(1), "status_text": pick(2)})


def health_deductions(found: DataFrame) -> DataFrame:
    return found.select("project_id", F.posexplode("deductions").alias("place", "d")).select("project_id", "place", "d.*")


def advice(*rules: tuple[Column, str, str, Column, str], otherwise: tuple[str, str, str, str]) -> Column:
    fields = lambda kind, severity, d, r: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), (d if isinstance(d, Column) else F.lit(d)).alias("description"), F.lit(r).alias("recommendation"))
    found = F.filter(F.array(*[F.when(p, fields(*x)) for p, *x in rules]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(fields(*otherwise)))


def model_advice(found: DataFrame) -> DataFrame:
    """Advice on each model, without a provider: at least one row a project. Texts are fixed values."""
    unused, both, calc = F.col("unused"), F.col("both_directions"), F.col("calculated")
    rows = advice(
        (unused > 0, "Unused Objects", "Medium", text(unused, " model object(s) have no direct or indirect report usage."), "Review and consider removing unused measures and columns to reduce model size."),
        (both > 0, "Bidirectional Relationships", "Medium", text(both, " relationship(s) use bidirectional cross-filtering."), "Change cross-filtering to single direction where possible or manage via CROSSFILTER()."),
        (calc > 5, "Calculated Columns", "Low", text("Model contains ", calc, " calculated columns."), "Migrate calculated columns to Power Query M transformations for better compression."),
        otherwise=("Model Health", "Informational", "Model architecture adheres to basic structural recommendations.", "Maintain current design patterns."),
    )
    return found.select("project_id", F.posexplode(rows).alias("place", "a")).select("project_id", "place", "a.*")


def report_advice(found: DataFrame) -> DataFrame:
    average = F.col("visuals") / F.nullif("pages", F.lit(0))
    rows = advice(
        (average > 10, "High Visual Density", "Medium", F.format_string("Average of %.1f visuals per page.", average), "Consolidate visuals or use tooltips/drillthroughs to improve page rendering time."),
        otherwise=("Report Design", "Informational", "Report visual distribution is balanced across pages.", "No critical report visual performance bottlenecks detected."),
    )
    return found.select("project_id", F.posexplode(rows).alias("place", "a")).select("project_id", "place", "a.*")


def documentation(found: DataFrame, named: DataFrame) -> DataFrame:
    """A text and three highlights on each project. found: health(); named: project_id, project_name, model_format."""
    c = F.col
    overview = text(
        "The '", c("project_name"), "' semantic model contains ", c("tables"), " tables, ", c("columns"), " columns, and ", c("measures"), " measures serving ",
        c("pages"), " report pages with ", c("visuals"), " total visuals. The Model Health Score is ", c("score"), "/100.",
    )
    return found.join(named, "project_id").select(
        "project_id", overview.alias("overview"),
        F.array(text("Semantic model format: ", c("model_format")), text("Report pages: ", c("pages"), " pages, ", c("visuals"), " visuals"), text("Data sources: ", c("sources"), " extracted queries")).alias("key_highlights"),
    )

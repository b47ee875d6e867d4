"""The analysis of project archives: from files to every table, for all projects in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..assist import advice, providers
from ..assist.replies import Replies
from ..operators import graph, health, model, quality, report, resolve, usage
from ..sources import archive, bim, report_files, tmdl


def raw(files: DataFrame) -> dict[str, DataFrame]:
    """Raw tables of the models and reports among files (archive.FILES), whatever their formats."""
    projects = graph.written(archive.discover(files))
    at = archive.text_files(files, projects, "model")
    lines, docs = at.filter("format = 'TMDL'"), graph.written(bim.documents(at.filter("format = 'BIM_JSON'")))
    there = archive.text_files(files, projects, "report")
    sections = report_files.sections(there)
    pages = report_files.folder_pages(there)
    # A report in pages may lack the folder and hold all in one document.
    old = sections.join(pages.select("project_id").distinct(), "project_id", "left_anti")
    return {
        "projects": projects,
        "raw_tables": graph.written(tmdl.raw_tables(lines).unionByName(bim.raw_tables(docs))),
        "raw_relationships": tmdl.raw_relationships(lines).unionByName(bim.raw_relationships(docs)),
        "raw_expressions": tmdl.raw_expressions(lines).unionByName(bim.raw_expressions(docs)),
        "raw_models": tmdl.raw_models(lines).unionByName(bim.raw_models(docs)),
        "pages": graph.written(pages.drop("folder").unionByName(report_files.document_pages(old).select("project_id", "ord", "page_id", "page_name", "raw"))),
        "raw_visuals": report_files.folder_visuals(there, pages).unionByName(report_files.document_visuals(old)),
    }


def analyze_files(files: DataFrame, provider: providers.Provider | None = None, strict: bool = False, replies: str | None = None) -> dict[str, DataFrame]:
    """Every table of the analysis by name. Tables that several others read are written once. replies: a shared folder for the provider's, by which requests are sent from tasks."""
    table = Replies(files.sparkSession, replies) if replies else None
    provider = provider or providers.NullProvider()
    r = raw(files)
    projects, tables_raw = r["projects"], r["raw_tables"]
    out = {k: r[k] for k in ("projects", "pages")}
    out["model_info"] = model.model_info(projects.filter("error IS NULL"), r["raw_models"])
    tables, columns = graph.written(model.tables(tables_raw)), graph.written(model.columns(tables_raw))
    calculated, measures = graph.written(model.calculated_columns(tables_raw)), graph.written(model.measures(tables_raw))
    relationships = graph.written(model.relationships(model.raw_relationships(r["raw_relationships"])))
    out |= {"tables": tables, "columns": columns, "calculated_columns": calculated, "measures": measures, "relationships": relationships}
    out["key_columns"], out["relationship_metrics"] = model.key_columns(relationships), model.relationship_metrics(relationships)
    out["data_sources"] = graph.written(model.data_sources(model.partitions(tables_raw, r["raw_expressions"])))
    out["date_tables"] = model.date_tables(tables_raw)
    out["date_table_summary"] = model.date_summary(tables_raw, out["date_tables"])

    cat = resolve.catalog(tables, columns, measures, calculated)
    objects = graph.written(graph.with_references(graph.sources(measures, calculated), strict))
    edges = graph.written(graph.edges(objects, cat))
    links = graph.written(graph.numbered_edges(edges))
    first = edges.filter("resolved").groupBy("project_id", "src").agg(F.min(F.struct("ord")).alias("at"))
    order = first.select("project_id", "src", F.expr("row_number() OVER (PARTITION BY project_id ORDER BY at)").alias("at"))
    out["dax_dependencies"] = edges
    out["circular_dependencies"] = graph.written(graph.cycles(links, order))
    out["unresolved_references"] = edges.filter("NOT resolved").select("project_id", F.col("src").alias("source_object"), F.col("raw").alias("referenced_text"), F.col("dax").alias("dax_expression"))

    visuals = graph.written(report.visuals(r["raw_visuals"]))
    uses = graph.written(report.field_uses(visuals, cat))
    direct = graph.written(report.visual_usage(uses))
    ways = usage.ways(direct, links)
    found = graph.written(usage.object_usage(usage.object_universe(measures, calculated, columns), direct, ways.pairs()))
    out |= {"visuals": visuals, "visual_usage": direct, "object_usage": found, "unused_objects": usage.unused_objects(found), "usage_lineage": graph.written(usage.lineage(direct, ways))}
    out["visual_metrics"], out["usage_summary"] = report.visual_metrics(uses), usage.usage_summary(found)

    analysed = graph.written(quality.analysed(objects))
    replies, requests, failures = providers.ask_all(provider, analysed, edges, cat, table=table)
    analysed = quality.with_replies(analysed, replies)
    out["dax_analysis"], out["dax_improvements"] = quality.analysis_records(analysed, usage.usage_by_name(found)), quality.improvements(analysed)
    out["dax_complexity"], out["quality_summary"] = quality.complexity_records(analysed), quality.quality_summary(analysed, requests, failures)

    counted = health.counts(
        projects.filter("error IS NULL"),
        cycles=out["circular_dependencies"], unresolved=out["unresolved_references"], objects=found, unused=out["unused_objects"], columns=columns, calculated=calculated,
        odd_cardinality=relationships.filter("cardinality IN ('M:M', '1:1')"), both_directions=relationships.filter("filter_direction = 'Both'"), inactive=relationships.filter("status = 'Inactive'"),
        high_severity=out["dax_analysis"].filter("highest_severity = 'High'"), tables=tables, measures=measures, pages=out["pages"], visuals=visuals, sources=out["data_sources"],
    )
    out["model_health"] = graph.written(health.health(counted))
    out["model_advisories"] = advice.model_advice(provider, out["model_health"], table)
    out["report_advisories"] = advice.report_advice(provider, out["model_health"], direct, table)
    out["executive_documentation"] = health.documentation(out["model_health"], projects)
    out["inventory"] = usage.inventory(tables, columns, measures, calculated, found, direct)
    out["analysis_sheet"] = quality.analysis_sheet(out["dax_analysis"], out["dax_improvements"])
    return out


def analyze(spark: SparkSession, paths: str | list[str], provider: providers.Provider | None = None, strict: bool = False, replies: str | None = None) -> dict[str, DataFrame]:
    """Analyses all archives at some paths. A project whose archive can't be analysed has an error in projects."""
    return analyze_files(graph.written(archive.read_archives(spark, paths)), provider, strict, replies)


def register(found: dict[str, DataFrame], prefix: str = "") -> None:
    """Makes every table a temporary view."""
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)

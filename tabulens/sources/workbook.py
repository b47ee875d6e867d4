"""Workbooks of an analysis: six sheets a project, written as Office Open XML with the standard library.

write_workbook() writes one project's on the driver, write_workbooks() all projects' from tasks, by a data source
whose writer has a commit; both take the rows of sheet_rows().
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Sheets with their titles and columns (heading, column of the table).
SHEETS = {
    "Model Inventory": ("Semantic Model Inventory & Report Usage", [("Table", "table_name"), ("Object", "object_name"), ("Object Type", "object_type"), ("Data Type", "data_type"), ("DAX Expression", "dax_expression"), ("Hidden", "is_hidden"), ("Used", "used"), ("Usage Type", "usage_type"), ("Pages", "pages"), ("Visuals", "visuals")]),
    "Report Usage": ("Report Visual → Semantic Object Usage", [("Page", "page_name"), ("Visual ID", "visual_id"), ("Visual", "visual_name"), ("Visual Type", "visual_type"), ("Visual Title", "visual_title"), ("Object Type", "object_type"), ("Table", "table_name"), ("Object", "object_name"), ("Usage Type", "usage_type")]),
    "Relationships & Lineage": ("Relationships and DAX Dependency Lineage", [("Type", "type"), ("From", "from"), ("To", "to"), ("Cardinality", "cardinality"), ("Filter Direction", "filter_direction"), ("Status", "status")]),
    "Data Sources": ("Data Sources & Power Query", [("Table", "table"), ("Source Type", "source_type"), ("Source Details", "source_details"), ("Power Query / M Expression", "m_expression")]),
    "DAX Analysis": ("DAX Quality, Complexity, Recommendations & AI Optimization", [("Table", "table_name"), ("Object", "object_name"), ("Object Type", "object_type"), ("Original DAX", "original_dax"), ("Complexity Score", "complexity_score"), ("Static Issues", "static_issues"), ("AI Issues", "ai_issues"), ("Suggested DAX", "suggested_dax"), ("Suggestion Source", "suggestion_source"), ("AI Confidence", "ai_confidence"), ("Validation Status", "validation_status"), ("Requires Manual Review", "requires_manual_review"), ("Dependency Count", "dependency_count"), ("Unresolved References", "unresolved_references"), ("Circular Dependency", "circular_dependency"), ("Usage", "usage_type"), ("Direct Visual Count", "direct_usage_count"), ("Indirect Usage Count", "indirect_usage_count")]),
}
SUMMARY = "Summary"
FINDINGS = "Findings"  # stand on the summary's sheet
#: A sheet holds so many rows, and a cell so many characters.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
HEAD, DATA = 4, 5


def lineage_sheet(relationships: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationships, then dependencies, as rows of one sheet."""
    end = lambda t, c: F.concat(t, F.lit("["), c, F.lit("]"))
    shown = F.when(F.col("target_name") != "", F.col("target_name")).otherwise(F.col("target_table"))
    first = relationships.select("project_id", F.lit(0).alias("part"), F.struct(F.col("ord").cast("string").alias("a"), F.lit(0).alias("b")).alias("at"), F.lit("Relationship").alias("type"), end("from_table", "from_column").alias("from"), end("to_table", "to_column").alias("to"), "cardinality", "filter_direction", "status")
    none = F.lit("")
    rest = edges.select("project_id", F.lit(1).alias("part"), F.struct(F.col("src").alias("a"), F.col("ref_ord").alias("b")).alias("at"), F.lit("DAX Dependency").alias("type"), end("source_table", "source_name").alias("from"), end("target_table", shown).alias("to"), none.alias("cardinality"), none.alias("filter_direction"), F.when(F.col("resolved"), "Resolved").otherwise("Unresolved").alias("status"))
    return first.unionByName(rest)


def findings(health: DataFrame, summary: DataFrame) -> DataFrame:
    """(project_id, place, category, text): what the summary sheet points out, in order."""
    rows = health.join(summary, "project_id", "left")
    item = lambda p, c, t: F.when(p, F.array(F.struct(F.lit(c).alias("category"), t.alias("text")))).otherwise(F.array().cast("array<struct<category:string,text:string>>"))
    more = F.transform("deductions", lambda d: F.struct(d["category"].alias("category"), F.concat(F.lit("["), d["impact"], F.lit("] "), d["title"], F.lit(": "), d["description"]).alias("text")))
    every = F.concat(
        item(F.col("unresolved") > 0, "DAX", F.lit("Unresolved DAX references require review.")), item(F.col("cycles") > 0, "DAX", F.lit("Circular dependencies detected.")),
        item(F.col("unused") > 0, "Usage", F.concat(F.col("unused").cast("string"), F.lit(" objects have no direct or indirect report usage."))), more,
    )
    none = F.array(*[F.struct(F.lit("Status").alias("category"), F.lit(t).alias("text")) for t in ("No major findings detected by deterministic checks.", "No major risk factors detected by deterministic checks.")])
    return rows.select("project_id", F.posexplode(F.when(F.size(every) > 0, every).otherwise(none)).alias("place", "f")).select("project_id", "place", "f.*")


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell(row: int, column: int, value: object) -> str:
    at = f"{column_letters(column)}{row}"
    if value is None or value == "":
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = "".join(ch for ch in str(value)[:MOST_CHARS] if ch in "\t\n\r" or ord(ch) >= 32)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def sheet_xml(rows: Iterable[tuple[int, Iterable[object]]], widths: list[int], frozen: bool, filtered: str | None) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0">'
    yield f'<pane ySplit="{HEAD}" topLeftCell="A{DATA}" activePane="bottomLeft" state="frozen"/>' if frozen else ""
    yield "</sheetView></sheetViews><cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)) + "</cols><sheetData>"
    for n, values in rows:
        yield f'<row r="{n}">' + "".join(cell(n, k, v) for k, v in enumerate(values, 1)) + "</row>"
    yield "</sheetData>" + (f'<autoFilter ref="{filtered}"/>' if filtered else "") + "</worksheet>"


def write(file: BinaryIO, summary: list[tuple[str, object]], found: list[tuple[str, str]], sheets: dict[str, list[dict]]) -> None:
    """One workbook, of a project's rows, into a file that need not be able to seek."""
    names = [SUMMARY, *SHEETS]
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        start = HEAD + len(summary) + 2
        first = [(1, ["Model Summary & Governance"]), (2, ["Semantic Model Governance, Health Score & Report Usage Summary"]), *((HEAD + i, [k, str(v)]) for i, (k, v) in enumerate(summary)), (start, ["Model Health & Governance Deductions"]), *((start + 1 + i, f) for i, f in enumerate(found))]
        z.writestr("xl/worksheets/sheet1.xml", "".join(sheet_xml(first, [36, 90], False, None)))
        for i, (name, (title, columns)) in enumerate(SHEETS.items(), 2):
            rows = sheets[name]
            if len(rows) > MOST_ROWS - HEAD:
                raise ValueError(f"{len(rows)} rows are more than the sheet '{name}' can hold")
            body = [[r.get(c) for _, c in columns] for r in rows]
            longest = [max([len(h), *(min(len(str(v or "").split("\n")[0]), 60) for v in vs)]) for (h, _), vs in zip(columns, zip(*body, strict=True) if body else [()] * len(columns), strict=True)]
            lines = [(1, [title]), (2, [f"Total Items: {len(rows)}"]), (HEAD, [h for h, _ in columns]), *((DATA + k, b) for k, b in enumerate(body))]
            z.writestr(f"xl/worksheets/sheet{i}.xml", "".join(sheet_xml(lines, [min(max(n + 3, 14), 55) for n in longest], True, f"A{HEAD}:{column_letters(len(columns))}{HEAD + len(rows)}")))


def summary_rows(found: dict[str, DataFrame], provider_name: str) -> DataFrame:
    """(project_id, place, record): the lines of the summary's sheet, a project's in order; record is JSON (label, value)."""
    parts = {"health": "model_health", "uses": "usage_summary", "dax": "quality_summary", "rel": "relationship_metrics"}
    rows = found["projects"]
    for name, table in parts.items():
        rows = rows.join(found[table].select("project_id", F.struct("*").alias(name)), "project_id", "left")
    edges = found["dax_dependencies"].groupBy("project_id").agg(F.count("*").alias("n_edges"))
    rows = rows.join(edges, "project_id", "left")
    of = lambda c, default=0: F.coalesce(F.col(c), F.lit(default))
    health = lambda c: of(f"health.{c}")
    uses = lambda c: of(f"uses.{c}")
    values = [
        ("Project Name", of("project_name", "Unknown")), ("Model Format", of("model_format", "Unknown")), ("Report Format", of("report_format", "Unknown")),
        ("Model Health Score", F.concat(of("health.score", 100).cast("string"), F.lit("/100 ("), of("health.grade", "A"), F.lit(")"))), ("Tables", health("tables")), ("Columns", health("columns")), ("Measures", health("measures")), ("Calculated Columns", health("calculated")),
        ("Relationships", of("rel.total")), ("Active Relationships", of("rel.active")), ("Pages", health("pages")), ("Visuals", health("visuals")), ("Used Objects", uses("used_objects")), ("Unused Objects", uses("unused_objects")),
        ("Directly Used Objects", uses("directly_used_objects")), ("Indirectly Used Objects", uses("indirectly_used_objects")), ("Direct + Indirect Objects", uses("direct_and_indirect_objects")), ("DAX Dependencies", of("n_edges")),
        ("Unresolved DAX References", health("unresolved")), ("Circular Dependencies", health("cycles")), ("DAX Objects Analyzed", of("dax.objects_analyzed")), ("Optimization Opportunities", of("dax.objects_with_improvements")), ("AI Provider", F.lit(provider_name)),
    ]
    lines = F.array(*[F.to_json(F.struct(F.lit(label).alias("label"), value.alias("value"))) for label, value in values])
    return rows.select("project_id", F.posexplode(lines).alias("place", "record"))


def sheet_rows(found: dict[str, DataFrame], provider_name: str = "None") -> DataFrame:
    """(project_id, sheet, place, record): every row of every project's workbook. record is the row as JSON; place is its order in the sheet, whose number follows SHEETS."""

    def placed(df: DataFrame, *order: str) -> DataFrame:
        by = [c for c in order if c in df.columns]
        keys = ", ".join(f"`{c}`" for c in by)
        shown = [c for c in df.columns if c not in ("project_id", *by)]
        # What the sheet shows may be what it is ordered by.
        record = F.to_json(F.struct(*[df[c] for c in dict.fromkeys([*shown, *by])]), {"ignoreNullFields": "false"})
        return df.select("project_id", F.expr(f"row_number() OVER (PARTITION BY project_id ORDER BY {keys})").alias("place"), record.alias("record"))

    told = findings(found["model_health"], found["usage_summary"])
    parts = {
        SUMMARY: summary_rows(found, provider_name), FINDINGS: told.select("project_id", "place", F.to_json(F.struct("category", "text")).alias("record")),
        "Model Inventory": placed(found["inventory"], "part", "ord"), "Report Usage": placed(found["visual_usage"], "ord", "canonical"), "Relationships & Lineage": placed(lineage_sheet(found["relationships"], found["dax_dependencies"]), "part", "at"),
        "Data Sources": placed(found["data_sources"], "part", "ord"), "DAX Analysis": placed(found["analysis_sheet"], "ord"),
    }
    out = [df.select("project_id", F.lit(name).alias("sheet"), "place", "record") for name, df in parts.items()]
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def fill(file: BinaryIO, rows: Iterable[Row]) -> None:
    """One project's workbook from its rows of sheet_rows(), in order of place."""
    sheets: dict[str, list[dict]] = {name: [] for name in (SUMMARY, FINDINGS, *SHEETS)}
    for r in rows:
        sheets[r["sheet"]].append(json.loads(r["record"]))
    summary = [(x["label"], x["value"]) for x in sheets.pop(SUMMARY)]
    write(file, summary, [(x["category"], x["text"]) for x in sheets.pop(FINDINGS)], sheets)


def write_workbook(found: dict[str, DataFrame], project_id: str, path: str | Path, provider_name: str = "None") -> str:
    """The workbook of one project of an analysis, written by the driver; a project's tables are as small as its model."""
    own = {k: df.filter(F.col("project_id") == project_id) for k, df in found.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        fill(f, sheet_rows(own, provider_name).orderBy("place").toLocalIterator())
    return str(path)


def file_name(project_id: str) -> str:
    """The workbook's name: that of the project's archive, and a part of its id's digest, as archives of several folders may share a name."""
    stem = re.sub(r"\.[^.]*$", "", project_id.rsplit("/", 1)[-1])
    return f"{re.sub(r'[^\w.-]+', '_', stem) or 'project'}-{hashlib.sha256(project_id.encode()).hexdigest()[:12]}.xlsx"


@dataclass
class Written(WriterCommitMessage):
    """What an attempt of a task has written: (project_id, file in the pending folder)."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Writes a workbook a project. A task's attempt writes to names of its own in a pending folder; what is committed is
    moved to its place by the driver, so that attempts that were lost or came second leave nothing."""

    def __init__(self, folder: str) -> None:
        self.folder, self.pending = folder.rstrip("/"), f"_pending-{uuid.uuid4().hex}"

    def place(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder)

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = self.place()
        fs.create_dir(f"{root}/{self.pending}", recursive=True)
        files = []
        for project_id, own in itertools.groupby(rows, lambda r: r["project_id"]):
            at = f"{self.pending}/{uuid.uuid4().hex}.xlsx"
            with fs.open_output_stream(f"{root}/{at}") as f:
                fill(f, own)
            files.append((project_id, at))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self.place()
        files = [x for m in messages if m is not None for x in m.files]
        if len({p for p, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("The rows of a project must come together, in one task")
        for project_id, at in files:
            final = f"{root}/{file_name(project_id)}"
            if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(final)
            fs.move(f"{root}/{at}", final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes what is pending."""
        fs, root = self.place()
        if fs.get_file_info(f"{root}/{self.pending}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.pending}")


class Workbooks(DataSource):
    """Sink of sheet_rows(), for DataFrames whose rows of a project lie in one partition, ordered by project and place."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def write_workbooks(found: dict[str, DataFrame], folder: str | Path, provider_name: str = "None") -> DataFrame:
    """A workbook for each project that could be analysed, in a shared folder (a path or URI that pyarrow can open), written by tasks.

    A workbook that is there already is replaced. Returns (project_id, file). A task holds one project's rows at a time.
    """
    projects = found["projects"].filter("error IS NULL").select("project_id")
    rows = sheet_rows(found, provider_name).join(projects, "project_id", "left_semi")
    projects.sparkSession.dataSource.register(Workbooks)
    rows.repartition("project_id").sortWithinPartitions("project_id", "place").write.format("workbooks").mode("append").save(str(folder))
    named = F.udf(file_name, "string")
    return projects.withColumn("file", F.concat(F.lit(str(folder).rstrip("/") + "/"), named("project_id")))

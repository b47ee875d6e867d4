"""Archives of projects as a table of files, and where in them models and reports are."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the files of an archive may have together, by its own list; none is read beyond its listed size.
MOST_BYTES = 1 << 30
FILES = "project_id string, path string, content binary, error string"


def unsafe(path: str) -> bool:
    """A member that would leave the folder it is unpacked to."""
    return path.startswith(("/", "\\")) or path[1:2] == ":" or ".." in path.replace("\\", "/").split("/")


def members(archive: bytes) -> list[tuple[str, bytes]]:
    """Paths and contents of an archive's files; all paths are checked before any file is read."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        if bad := next((i.filename for i in z.infolist() if unsafe(i.filename)), None):
            raise ValueError(f"Unsafe path in archive: '{bad}'")
        if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
            raise ValueError("The archive's files are too large")
        return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]


def unpack(archives: DataFrame) -> DataFrame:
    """archives (project_id, content) -> FILES: a row a file, an archive at a time. One that can't be read
    gives a single row with an error and no path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for project, content in zip(b["project_id"], b["content"], strict=True):
                try:
                    rows = [(project, p, c, None) for p, c in members(bytes(content))]
                except zipfile.BadZipFile:
                    rows = [(project, None, None, "Not a valid ZIP archive")]
                except (ValueError, RuntimeError, EOFError, zlib.error) as e:  # unsafe, too large, encrypted, of an unknown method, damaged
                    rows = [(project, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["project_id", "path", "content", "error"])

    return archives.select("project_id", "content").mapInPandas(run, FILES)


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of all archives at some paths, which may have patterns; a project's id is its archive's path."""
    found = spark.read.format("binaryFile").load(paths)
    return unpack(found.select(F.col("path").alias("project_id"), "content"))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """The path without its last part; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def within(folder: Column, rest: str) -> Column:
    return F.when(folder == "", F.lit(rest)).otherwise(F.concat(folder, F.lit("/" + rest)))


def under(folder: Column, path: Column) -> Column:
    return (folder == "") | F.startswith(path, F.concat(folder, F.lit("/")))


def folders(paths: Column) -> Column:
    """All folders that hold any of the files, at any depth, shallow ones first."""
    parts = lambda p: F.split(p, "/")
    above = lambda p: F.transform(F.sequence(F.lit(0), F.size(parts(p)) - 1), lambda k: F.array_join(F.slice(parts(p), 1, k), "/"))
    every = F.array_distinct(F.flatten(F.transform(paths, above)))
    depth = lambda d: F.size(F.split(d, "/"))
    return F.transform(F.array_sort(F.transform(every, lambda d: F.struct(depth(d).alias("depth"), d.alias("folder")))), lambda x: x["folder"])



def model_at(paths: Column, folder: Column) -> Column:
    """struct<folder, definition, format> if the folder holds a model; else null. TMDL counts before JSON,
    and the definition folder before the folder itself; last comes any model file further down."""
    inner = within(folder, "definition")
    tmdl = lambda d: F.exists(paths, lambda p: (folder_of(p) == d) & F.endswith(F.lower(p), F.lit(".tmdl")))
    bim = lambda d: F.array_contains(paths, within(d, "model.bim"))
    deep = F.get(F.filter(paths, lambda p: under(folder, p) & (F.endswith(F.lower(p), F.lit(".bim")) | F.lower(name_of(p)).isin("model.json", "datamodel.json"))), F.lit(0))
    made = lambda d, kind: F.struct(folder.alias("folder"), d.alias("definition"), F.lit(kind).alias("format"))
    return (
        F.when(tmdl(inner), made(inner, "TMDL")).when(bim(inner), made(inner, "BIM_JSON")).when(tmdl(folder), made(folder, "TMDL"))
        .when(bim(folder), made(folder, "BIM_JSON")).when(deep.isNotNull(), made(folder_of(deep), "BIM_JSON"))
    )


def report_at(paths: Column, folder: Column) -> Column:
    """struct<folder, definition, format> if the folder holds a report; else null."""
    inner = within(folder, "definition")
    pages = lambda d: F.exists(paths, lambda p: F.startswith(p, F.concat(within(d, "pages"), F.lit("/"))))
    has = lambda d, n: F.array_contains(paths, within(d, n))
    made = lambda d, kind: F.struct(folder.alias("folder"), d.alias("definition"), F.lit(kind).alias("format"))
    return (
        F.when(pages(inner) | has(inner, "report.json"), made(inner, "PBIR_PAGES")).when(pages(folder), made(folder, "PBIR_PAGES"))
        .when(has(folder, "report.json"), made(folder, "LEGACY_REPORT_JSON")).when(has(folder, "definition.pbir"), made(folder, "PBIR_PAGES"))
    )


def artifacts(manifest: Column, base: Column, kinds: tuple[str, ...]) -> Column:
    """Folders that the manifest names for artifacts of some kinds, in its order."""
    listed = F.try_variant_get(manifest, "$.artifacts", "array<struct<type:string,path:string>>")
    chosen = F.filter(F.coalesce(listed, F.array().cast("array<struct<type:string,path:string>>")), lambda a: F.lower(a["type"]).isin(*kinds) & (a["path"] != ""))
    clean = lambda p: F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/+$", "")
    return F.transform(chosen, lambda a: F.when(base == "", clean(a["path"])).otherwise(F.concat(base, F.lit("/"), clean(a["path"]))))


def discover(files: DataFrame) -> DataFrame:
    """A row a project: where its model and report are (model and report: struct<folder, definition, format>),
    their formats, its name, and an error if it can't be analysed.

    The project file nearest the top counts, by name among equals. Candidate folders are those that the
    manifest names, then those named or marked as models (or reports), then those with model files.
    """
    is_file = F.endswith(F.lower("path"), F.lit(".pbip"))
    depth = F.struct(F.size(F.split("path", "/")), F.col("path"))
    per = files.groupBy("project_id").agg(
        F.array_sort(F.collect_list("path")).alias("paths"), F.max("error").alias("error"),
        F.min_by("path", F.when(is_file, depth)).alias("pbip"), F.min_by("content", F.when(is_file, depth)).alias("manifest"),
    )
    paths = F.col("paths")
    per = per.withColumns({"dirs": folders(paths), "manifest": F.try_parse_json(F.decode("manifest", "UTF-8")), "base": folder_of(F.coalesce("pbip", F.lit("")))})
    holds = lambda *names: (lambda d: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(paths, F.when(d == "", n).otherwise(F.concat(d, F.lit("/"), n)))))
    ends = lambda *tails: (lambda d: F.exists(F.array(*[F.lit(t) for t in tails]), lambda t: F.endswith(F.lower(d), t)))
    named = lambda ending, marks: F.filter("dirs", lambda d: ending(d) | marks(d))
    holder = F.transform(
        F.filter("dirs", lambda d: F.exists(paths, lambda p: (folder_of(p) == d) & F.endswith(F.lower(p), F.lit(".tmdl")))),
        lambda d: F.when(F.lower(name_of(d)) == "definition", folder_of(d)).otherwise(d),
    )
    models = F.array_distinct(F.concat(artifacts(F.col("manifest"), F.col("base"), ("semanticmodel", "dataset")), named(ends(".semanticmodel", ".dataset"), holds("definition.pbism", "model.bim")), holder))
    reports = F.array_distinct(F.concat(artifacts(F.col("manifest"), F.col("base"), ("report",)), named(ends(".report"), holds("definition.pbir", "report.json"))))
    hit = lambda found, at: F.get(F.filter(F.transform(found, lambda d: at(paths, d)), lambda x: x.isNotNull()), F.lit(0))
    per = per.withColumns({"model": hit(models, model_at), "report": hit(reports, report_at), "reports": reports})
    unknown = F.when(F.size("reports") > 0, "UNKNOWN").otherwise("NONE")
    error = F.coalesce(
        "error", F.when(F.col("pbip").isNull(), "No project file (.pbip) found"),
        F.when(F.col("model").isNull(), "No semantic model with supported metadata (TMDL or model.bim) found"),
    )
    return per.select(
        "project_id", F.regexp_replace(name_of(F.col("pbip")), r"\.[^.]*$", "").alias("project_name"), "model", "report",
        F.coalesce("model.format", F.lit("UNKNOWN")).alias("model_format"), F.coalesce("report.format", unknown).alias("report_format"),
        name_of(F.col("model.folder")).alias("model_name"), error.alias("error"),
    )


def text_files(files: DataFrame, projects: DataFrame, part: str) -> DataFrame:
    """(project_id, path, rel, text): files below the definition folder of each project's model or report;
    rel is the path from there."""
    at = projects.filter(f"error IS NULL AND {part} IS NOT NULL").select("project_id", F.col(f"{part}.definition").alias("at"), F.col(f"{part}.format").alias("format"))
    met = files.filter("path IS NOT NULL").join(at, "project_id").filter(under(F.col("at"), F.col("path")))
    rel = F.when(F.col("at") == "", F.col("path")).otherwise(F.substring(F.col("path"), F.length("at") + 2, F.length("path")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return met.select("project_id", "path", rel.alias("rel"), "format", text.alias("text"))

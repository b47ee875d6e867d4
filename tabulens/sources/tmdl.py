"""Models in TMDL: files to lines, lines to items, items to raw tables.

What a line means depends on what is open when it comes: a section, a fenced expression. That much
is found by going through a file's lines; everything else is done to the lines as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .. import schemas
from ..functions import names as N

# Properties of each section, as bare words and as beginnings.
BARE = {
    "table": ("isHidden",), "column": ("isHidden", "isKey", "isUnique", "isNullable", "isDefault"), "measure": ("isHidden",), "partition": (), "expression": (),
}
BEGINNINGS = {
    "table": ("isHidden:", "description:", "dataCategory:", "annotation ", "lineageTag:"),
    "column": (
        "isHidden:", "isKey:", "isUnique:", "isNullable:", "dataType:", "formatString:", "description:", "sourceColumn:", "sourceProviderType:", "dataCategory:",
        "summarizeBy:", "displayFolder:", "sortByColumn:", "annotation ", "lineageTag:", "variation", "dateTime variation", "relationship:", "defaultHierarchy:", "hierarchy ", "level ",
    ),
    "measure": ("isHidden:", "formatString:", "description:", "lineageTag:", "dataCategory:", "displayFolder:", "kpi:", "kpi ", "annotation "),
    "partition": ("mode:", "source =", "source:", "annotation ", "lineageTag:"),
    "expression": (),
}
HEADS = ("column ", "measure ", "partition ", "table ", "relationship ", "expression ")
HEADER = {
    "table": re.compile(r"table (.*)()$"),
    "column": re.compile(r"column\s+('[^']+'|\[[^\]]+\]|[^\s=]+)(?:\s*=\s*(.*))?$"),
    "measure": re.compile(r"measure\s+('[^']+'|\[[^\]]+\]|[^\s=]+)(?:\s*=\s*(.*))?$"),
    "partition": re.compile(r"partition\s+('[^']+'|[^\s=]+)\s*=\s*(.*)$"),
    "expression": re.compile(r"expression\s+('[^']+'|[^\s=]+)(?:\s*=\s*(.*))?$"),
}
FENCE = "```"
EVENTS = (("line", T.IntegerType()), ("item", T.IntegerType()), ("section", T.StringType()), ("role", T.StringType()), ("chunk", T.IntegerType()), ("value", T.StringType()))


class Reader:
    """Goes through the lines of a file, one after another, and knows what is open: an item's section, a fenced expression."""

    def __init__(self) -> None:
        self.section, self.item, self.chunk, self.fenced, self.filled = "table", 0, 0, False, False

    def read(self, n: int, raw: str) -> Iterator[tuple[int, int, str, str, int, str | None]]:
        """(line, item, section, role, chunk, value) for each line that counts. role is head (value: the name),
        defined (what follows the head's equals sign), prop (the line) or text (a line of an expression).

        Lines of one chunk belong together; a property or a closed fence ends a chunk, and of an
        item's chunks the last is its expression. Blank and comment lines never count.
        """
        line = raw.strip()
        if not line or line.startswith("//"):
            return
        if self.fenced:
            ends = line.endswith(FENCE)
            kept = line[: -len(FENCE)].strip() if ends else raw
            if kept:
                yield n, self.item, self.section, "text", self.chunk, kept
            if ends:
                self.fenced, self.filled, self.chunk = False, False, self.chunk + 1
            return
        known = line.startswith(HEADS) or line in BARE[self.section] or line.startswith(BEGINNINGS[self.section])
        if known and self.filled:
            self.chunk, self.filled = self.chunk + 1, False
        opened = next(((s, m) for s, p in HEADER.items() if (m := p.match(line))), None)
        if opened:
            self.section, match = opened
            self.item, self.chunk = self.item + 1, 0
            yield n, self.item, self.section, "head", 0, match[1]
            if self.section == "partition":  # what follows is its type
                yield n, self.item, self.section, "defined", 0, match[2].strip()
                return
            value = match[2]
            if value is None or self.section == "table":
                return
            yield n, self.item, self.section, "defined", 0, value.strip()
        elif self.section == "partition" and line.startswith(("source =", "source:")):
            value = line.partition("=" if "=" in line else ":")[2]
            yield n, self.item, self.section, "prop", self.chunk, line
        elif known or self.section in ("table", "expression"):
            yield n, self.item, self.section, "prop", self.chunk, line
            return
        else:
            yield n, self.item, self.section, "text", self.chunk, raw
            self.filled = True
            return
        value = value.strip()
        if value.startswith(FENCE):
            inline = value.endswith(FENCE) and len(value) > len(FENCE) and self.section in ("column", "measure")
            rest = value[len(FENCE) :]
            rest = (rest[: -len(FENCE)] if inline else rest).strip()
            if rest and self.section != "expression":
                yield n, self.item, self.section, "text", self.chunk, rest
            if inline:
                self.chunk += 1
            else:
                self.fenced = True
        elif value:
            yield n, self.item, self.section, "text", self.chunk, value
            self.filled = True


class Events:
    """Table function: the events of files whose lines are the rows of its table, with columns n and line and any others, which name the file.

    It asks for the rows of each file together and in order of n, so that a file is read as it comes and never held whole. Callable from SQL once
    registered: SELECT * FROM tmdl_events(TABLE(lines)).
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        keys = [f for f in lines.dataType.fields if f.name not in ("n", "line")]
        made = T.StructType([*keys, *(T.StructField(*e) for e in EVENTS)])
        return AnalyzeResult(made, partitionBy=[PartitioningColumn(f.name) for f in keys], orderBy=[OrderingColumn("n")])

    def __init__(self) -> None:
        self.reader = Reader()

    def eval(self, row: Row) -> Iterator[tuple]:
        keys = tuple(v for name, v in row.asDict().items() if name not in ("n", "line"))
        for event in self.reader.read(row["n"], row["line"]):
            yield (*keys, *event)


def file_lines(files: DataFrame) -> DataFrame:
    """files (project_id, path, text) -> (project_id, path, n, line)."""
    return files.select("project_id", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("n", "line"))


def file_events(files: DataFrame) -> DataFrame:
    """files (project_id, path, text) -> (project_id, path) and EVENTS."""
    return udtf(Events)(file_lines(files).asTable())


def register(spark: SparkSession, name: str = "tmdl_events") -> None:
    """Makes Events a function of SQL."""
    spark.udtf.register(name, udtf(Events))


def dedented(lines: Column) -> Column:
    """Lines without the white space that all of them begin with, joined and stripped."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(N.WHITE)))
    common = F.array_min(F.transform(lines, indent))
    return N.strip(F.array_join(F.transform(lines, lambda x: F.rtrim(F.substring(x, common + 1, F.length(x)), F.lit(N.WHITE))), "\n"))


KEY = ["project_id", "path", "item"]


def items(found: DataFrame) -> DataFrame:
    """A row an item: its section, name, what it is defined by, its properties and its expression.

    props maps a property to its last value, marks has the bare words and beginnings without one, annotations
    keeps all. The table itself is item 1, or 0 where a file has no head.
    """
    prop = found.filter("role = 'prop'")
    colon = F.instr("value", ":")
    pair = prop.filter((colon > 0) & ~F.startswith("value", F.lit("annotation "))).select(*KEY, "line", F.substring(F.col("value"), F.lit(1), colon - 1).alias("key"), N.strip(F.substring(F.col("value"), colon + 1, F.length("value"))).alias("v"))
    last = pair.groupBy(*KEY, "key").agg(F.max_by("v", "line").alias("v")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("props"))
    notes = prop.withColumns({"a": F.regexp_extract("value", r"^annotation\s+([^\s=]+)\s*=\s*(.*)$", 1), "b": F.regexp_extract("value", r"^annotation\s+([^\s=]+)\s*=\s*(.*)$", 2)})
    other = notes.groupBy(*KEY).agg(
        F.collect_set("value").alias("marks"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("a") != "", F.struct("line", "a", "b")))), lambda x: F.struct(x["a"].alias("name"), F.btrim(x["b"], F.lit('"')).alias("value"))).alias("annotations"),
    )
    text = found.filter("role = 'text'").groupBy(*KEY, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]).alias("lines"))
    expression = text.groupBy(*KEY).agg(F.max_by("lines", "chunk").alias("lines"))
    heads = found.groupBy(*KEY, "section").agg(F.max(F.when(F.col("role") == "head", F.col("value"))).alias("name"), F.max(F.when(F.col("role") == "defined", F.col("value"))).alias("defined"))
    out = heads.join(last, KEY, "left").join(other, KEY, "left").join(expression, KEY, "left")
    return out.withColumns({
        "name": N.unquoted(F.col("name")),
        "props": F.coalesce("props", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")),
        "marks": F.coalesce("marks", F.array().cast("array<string>")),
        "annotations": F.coalesce("annotations", F.array().cast(schemas.ANNOTATIONS)),
    })


def value_of(name: str, default: str | None = "", quoted: bool = False) -> Column:
    v = F.try_element_at("props", F.lit(name))
    return F.coalesce(F.btrim(v, F.lit('"')) if quoted else v, F.lit(default))


def flag(name: str) -> Column:
    return F.array_contains("marks", name) | F.contains(F.lower(value_of(name)), F.lit("true"))


def table_files(files: DataFrame) -> DataFrame:
    """The models' files (project_id, path, rel, text) that are tables, with rank: 0 for those of the tables folder, 1 for those beside it that begin with a table."""
    beside = ~F.contains("rel", F.lit("/")) & ~F.lower("rel").isin("model.tmdl", "relationships.tmdl", "expressions.tmdl") & F.startswith(N.strip(F.col("text")), F.lit("table "))
    inside = F.col("rel").rlike("^tables/[^/]*$")
    return files.filter(F.endswith(F.lower("rel"), F.lit(".tmdl")) & (inside | beside)).withColumn("rank", F.when(inside, 0).otherwise(1))


def table_items(chosen: DataFrame) -> DataFrame:
    """(project_id, path, item, section) and t, column, measure, partition of the items of table_files(): a row an item, with the one of these that it is."""
    found = items(file_events(chosen))
    text = F.when(F.col("lines").isNotNull(), dedented(F.col("lines"))).otherwise("")
    variation = F.array_contains("marks", "isDefault") | F.exists("marks", lambda m: F.startswith(m, F.lit("variation")) | F.startswith(m, F.lit("dateTime variation")) | F.startswith(m, F.lit("defaultHierarchy:")) | F.startswith(m, F.lit("relationship:")))
    ord_ = F.col("item").alias("ord")
    name = F.col("name").alias("name")
    column = F.struct(
        ord_, name, value_of("dataType", "Unknown").alias("dataType"), flag("isHidden").alias("isHidden"), flag("isKey").alias("isKey"),
        F.when(F.col("defined").isNotNull(), "calculated").otherwise("data").alias("type"), text.alias("expression"), value_of("formatString", quoted=True).alias("formatString"),
        value_of("description", quoted=True).alias("description"), N.unquoted(value_of("sourceColumn")).alias("sourceColumn"), value_of("dataCategory").alias("dataCategory"),
        value_of("summarizeBy").alias("summarizeBy"), variation.alias("hasDateVariation"), value_of("defaultHierarchy").alias("defaultHierarchy"), F.col("annotations").alias("annotations"),
    )
    measure = F.struct(ord_, name, text.alias("expression"), value_of("formatString", quoted=True).alias("formatString"), value_of("description", quoted=True).alias("description"), flag("isHidden").alias("isHidden"), value_of("lineageTag").alias("lineageTag"))
    partition = F.struct(ord_, name, value_of("mode", "import").alias("mode"), F.col("defined").alias("type"), text.alias("expression"))
    head = F.struct(name, flag("isHidden").alias("isHidden"), value_of("description", quoted=True).alias("description"), value_of("dataCategory").alias("dataCategory"), F.col("annotations").alias("annotations"))
    kinds = {"t": ("table", head), "column": ("column", column), "measure": ("measure", measure), "partition": ("partition", partition)}
    return found.select(*KEY, "section", *[F.when(F.col("section") == section, x).alias(k) for k, (section, x) in kinds.items()])


def table_name() -> Column:
    """A table's name: that of its head, or else of its file."""
    return F.coalesce("t.name", F.regexp_replace(F.regexp_replace("rel", "^.*/", ""), r"\.[^.]*$", ""))


def last_head() -> Column:
    return F.max_by("t", F.when(F.col("section") == "table", F.col("item"))).alias("t")


def table_objects(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """found, table_items(), with table_name and table_hidden: what raw_tables() has as lists, a row an object, so that files of any length take no more of a task.

    found is read twice, and had better be a table that is written."""
    heads = found.filter("section = 'table'").groupBy("project_id", "path").agg(last_head())
    named = chosen.select("project_id", "path", "rel").join(heads, ["project_id", "path"], "left").select("project_id", "path", table_name().alias("table_name"), F.coalesce("t.isHidden", F.lit(False)).alias("table_hidden"))
    return found.filter("section IN ('column', 'measure', 'partition')").drop("t").join(named, ["project_id", "path"])


def raw_tables(files: DataFrame) -> DataFrame:
    """schemas.RAW_TABLE of the models' files (project_id, path, rel, text): those of the tables folder, then
    those beside it that begin with a table. Order is by path, and by place in a file."""
    chosen = table_files(files)
    listed = lambda kind: F.array_sort(F.collect_list(kind)).alias(f"{kind}s")
    per = table_items(chosen).groupBy("project_id", "path").agg(last_head(), listed("column"), listed("measure"), listed("partition"))
    return numbered(chosen, per).select(
        "project_id", "ord", table_name().alias("name"), F.coalesce("t.isHidden", F.lit(False)).alias("isHidden"), F.coalesce("t.description", F.lit("")).alias("description"),
        F.coalesce("t.dataCategory", F.lit("")).alias("dataCategory"), F.lit(None).cast("boolean").alias("markAsDateTable"), F.coalesce("t.annotations", F.array().cast(schemas.ANNOTATIONS)).alias("annotations"), "columns", "measures", "partitions",
    )


def numbered(chosen: DataFrame, per: DataFrame) -> DataFrame:
    """per (project_id, path, ...) with rel, and ord by rank and rel. Files are numbered without what they hold, as a project's meet in one task."""
    held = chosen.select("project_id", "path", "rel", "rank").join(per.select("project_id", "path"), ["project_id", "path"])
    placed = held.select("project_id", "path", "rel", F.expr("CAST(row_number() OVER (PARTITION BY project_id ORDER BY rank, rel) - 1 AS INT)").alias("ord"))
    return placed.join(per, ["project_id", "path"])


def lines(files: DataFrame) -> DataFrame:
    """(project_id, path, n, line): stripped lines that are neither blank nor comments."""
    rows = files.select("project_id", "path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line")).withColumn("line", N.strip(F.col("line")))
    return rows.filter((F.col("line") != "") & ~F.startswith("line", F.lit("//")))


def raw_relationships(files: DataFrame) -> DataFrame:
    """schemas.RAW_RELATIONSHIP: an item for each head, with the last value of each property. The last item of a
    file counts only if it has a table."""
    head = F.startswith("line", F.lit("relationship "))
    rows = lines(files.filter("lower(rel) = 'relationships.tmdl'")).withColumn("head", head)
    numbered = rows.withColumn("item", F.expr("sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, path ORDER BY n)"))
    value = lambda k: F.max_by(F.when(F.startswith("line", F.lit(k + ":")), N.strip(F.substring(F.col("line"), F.lit(len(k) + 2), F.length("line")))), F.when(F.startswith("line", F.lit(k + ":")), F.col("n")))
    per = numbered.groupBy("project_id", "path", "item").agg(
        F.max(F.when(F.col("head"), N.strip(F.substring("line", 14, 100000)))).alias("id"), *[value(k).alias(k) for k in ("fromColumn", "toColumn", "cardinality", "crossFilteringBehavior", "isActive")]
    )
    per = per.withColumns({"f": N.column_reference(F.coalesce("fromColumn", F.lit(""))), "t": N.column_reference(F.coalesce("toColumn", F.lit(""))), "last": F.expr("item = max(item) OVER (PARTITION BY project_id, path)")})
    kept = per.filter("NOT last OR f.table <> '' OR t.table <> ''")
    return kept.select(
        "project_id", F.col("item").cast("int").alias("ord"), "id", F.col("f.table").alias("fromTable"), F.col("f.column").alias("fromColumn"), F.col("t.table").alias("toTable"), F.col("t.column").alias("toColumn"),
        F.coalesce("cardinality", F.lit("manyToOne")).alias("cardinality"), F.lit(None).cast("string").alias("fromCardinality"), F.lit(None).cast("string").alias("toCardinality"),
        F.coalesce("crossFilteringBehavior", F.lit("oneDirection")).alias("crossFilteringBehavior"), F.coalesce((F.lower("isActive") == "true"), F.lit(True)).cast("string").alias("isActive"),
    )


def raw_expressions(files: DataFrame) -> DataFrame:
    """schemas.RAW_EXPRESSION: shared expressions; what stands on the line that opens a fence is dropped."""
    found = items(file_events(files.filter("lower(rel) = 'expressions.tmdl'"))).filter("section = 'expression'")
    return found.select("project_id", F.col("item").alias("ord"), "name", F.coalesce(F.array_join("lines", "\n"), F.lit("")).alias("expression"), value_of("kind", "m").alias("kind"))


def raw_models(files: DataFrame) -> DataFrame:
    """schemas.RAW_MODEL of the models' main files."""
    rows = lines(files.filter("lower(rel) = 'model.tmdl'"))
    value = lambda k: F.max_by(F.when(F.startswith("line", F.lit(k + ":")), N.strip(F.substring(F.col("line"), F.lit(len(k) + 2), F.length("line")))), F.when(F.startswith("line", F.lit(k + ":")), F.col("n")))
    head = F.startswith("line", F.lit("model "))
    return rows.groupBy("project_id").agg(
        F.max_by(F.when(head, N.unquoted(F.substring("line", 7, 100000))), F.when(head, F.col("n"))).alias("name"), value("culture").alias("culture"), F.lit("Unknown").alias("compatibilityLevel"),
        value("sourceQueryCulture").alias("sourceQueryCulture"), value("defaultPowerBIDataSourceVersion").alias("defaultPowerBIDataSourceVersion"),
    )

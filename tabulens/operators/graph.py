"""The graph of dependencies between a model's objects, its closure and its cycles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import names as N
from .resolve import Catalog, resolve
from .trees import TREE, trees

#: Rounds whose pairs are looked up apart, before they are written as one table.
ROUNDS = 8
#: Roots, on average, whose ways are followed at a time: what is shuffled and written meanwhile is deleted before the next.
ROOTS = 2**17
#: Tables that are written and not yet deleted.
TABLES: list[str] = []


#: Whether a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """df, written to the shared folder that the session names and read from there: a cut in lineage that
    outlives executors and tells the optimizer its size. Rows are added to a table that this has made, if one is given."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabulens-"))
    path = to._written_path if to is not None else f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/tabulens-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if to is None:
        TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    TABLES.remove(path)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame made by written(), once nothing reads it any more."""
    delete(df.sparkSession, df._written_path)


def sweep(spark: SparkSession) -> None:
    """Deletes every table that written() has made and that is still there: results that are read from them can't be used any more."""
    for path in list(TABLES):
        delete(spark, path)


def sources(measures: DataFrame, calculated: DataFrame) -> DataFrame:
    """(project_id, kind, table_name, name, dax, ord): objects with an expression, measures first."""
    rows = measures.select("project_id", F.lit("Measure").alias("kind"), "table_name", F.col("measure_name").alias("name"), F.col("dax_expression").alias("dax"), F.struct(F.lit(0).alias("part"), "ord").alias("ord"))
    more = calculated.select("project_id", F.lit("Calculated Column").alias("kind"), "table_name", F.col("column_name").alias("name"), F.col("dax_expression").alias("dax"), F.struct(F.lit(1).alias("part"), "ord").alias("ord"))
    return rows.unionByName(more).filter("dax <> '' AND dax <> 'Unknown'")


def with_references(objects: DataFrame, strict: bool = False) -> DataFrame:
    """Objects with their stripped text, its mask and references, each computed once.

    Objects are dealt anew by name: a table of a million of them is a file of some megabytes, which would be one task.
    """
    out = objects.repartition("project_id", "name").withColumn("text", N.strip(F.col("dax"))).withColumn("mask", E.masked(F.col("text")))
    return out.withColumn("refs", E.references(F.col("mask"), strict))


def edges(objects: DataFrame, cat: Catalog) -> DataFrame:
    """Edges out of objects (with_references): the first reference of each to each target, not to itself.

    Columns: project_id, src, dst, ord (of the source), ref_ord, source_kind, source_table, source_name,
    target_kind, target_table, target_name, raw, dax, resolved. What resolves to nothing has a
    target of kind Unknown and is no edge of the graph.
    """
    # Outer, as in quality.improvements(): no filter by the array is to be pushed below the columns that make it.
    refs = objects.select("project_id", F.col("kind").alias("source_kind"), F.col("table_name").alias("context"), F.col("name").alias("source_name"), "dax", "ord", F.posexplode_outer("refs").alias("ref_ord", "r")).filter("r IS NOT NULL")
    flat = refs.select("project_id", "source_kind", "context", "source_name", "dax", "ord", "ref_ord", "r.kind", "r.table", "r.name", "r.raw")
    met = resolve(flat, cat)
    found = F.col("found")
    out = met.select(
        "project_id", "ord", "ref_ord", "source_kind", F.col("context").alias("source_table"), "source_name", "raw", "dax",
        found.isNotNull().alias("resolved"),
        F.coalesce(found["kind"], F.lit("Unknown")).alias("target_kind"),
        F.coalesce(found["table_name"], "table", F.lit("Unknown")).alias("target_table"),
        F.coalesce(found["name"], "name").alias("target_name"),
    )
    out = out.withColumn("src", N.canonical(F.col("source_kind"), F.col("source_table"), F.col("source_name")))
    unknown = F.concat(F.lit("UNKNOWN:"), "target_table", F.lit("["), "target_name", F.lit("]"))
    out = out.withColumn("dst", F.when(F.col("resolved"), N.canonical(F.col("target_kind"), F.col("target_table"), F.col("target_name"))).otherwise(unknown))
    out = out.filter("src <> dst")
    rest = [c for c in out.columns if c not in ("project_id", "src", "dst", "source_kind")]
    first = out.groupBy("project_id", "src", "dst", "source_kind", "ord").agg(F.min_by(F.struct(*[c for c in rest if c != "ord"]), "ref_ord").alias("x"))
    return first.select("project_id", "src", "dst", "source_kind", "ord", "x.*")


def numbered_edges(found: DataFrame) -> DataFrame:
    """(project_id, src, dst, label, n): the graph's edges; n numbers a source's edges in order of reference."""
    label = F.when(F.col("target_name") != "", F.col("target_name")).otherwise(F.col("target_table"))
    return found.filter("resolved").select("project_id", "src", "dst", label.alias("label"), "dax", F.col("ref_ord").alias("n"))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like written(), whose tables are deleted at the end: what is to stay is written apart."""
    made: list[DataFrame] = []

    def put(df: DataFrame) -> DataFrame:
        made.append(written(df))
        return made[-1]

    try:
        yield put
    finally:
        for df in made:
            discard(df)


def squares(edges: DataFrame, put: Callable[[DataFrame], DataFrame]) -> Callable[[int], DataFrame]:
    """The k-th square of the graph (src, dst): its ways of exactly 2**k edges. Each is made when it is first asked for."""
    made = [put(edges.select("src", "dst").distinct())]

    def power(k: int) -> DataFrame:
        while len(made) <= k:
            made.append(put(made[-1].withColumnRenamed("dst", "via").join(made[-1].withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()))
        return made[k]

    return power


def levels(power: Callable[[int], DataFrame], starts: DataFrame, put: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(root, node, level): the least number of edges from each of starts (root) to each node it leads to, itself included. power: squares() of the graph.

    By repeated squaring: a round extends what the roots reach within fewer than 2**k edges by the ways of exactly 2**k edges, which is the k-th
    square of the graph and gives the next. New pairs are those that no earlier round has reached. The first round without any is the last, on rings
    too, as the way to what lies further would lead through some that lies nearer: there are as many rounds as the depth has binary digits, and two.
    """
    seen = [put(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("level")).distinct())]
    k = 0
    while True:
        step = reduce(DataFrame.unionByName, seen).join(power(k).withColumnRenamed("src", "node"), "node").select("root", F.col("dst").alias("node"), (F.col("level") + 2**k).alias("level"))
        first = step.groupBy("root", "node").agg(F.min("level").alias("level"))
        new = put(first.join(reduce(DataFrame.unionByName, seen), ["root", "node"], "left_anti"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(new)
        if len(seen) > ROUNDS:
            seen = [put(reduce(DataFrame.unionByName, seen))]
        k += 1


def numbered_graph(graph: DataFrame, roots: DataFrame, put: Callable[[DataFrame], DataFrame], *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names (project_id, name, id), the graph with ids for src and dst and its columns more, and roots as ids: numbers stand for names while pairs are made."""
    ends = graph.select("project_id", F.explode(F.array("src", "dst")).alias("name")).unionByName(roots.select("project_id", F.col("root").alias("name")))
    names = written(ends.filter("name IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()))
    of = lambda end: names.select("project_id", F.col("name").alias(end), F.col("id").alias(f"{end}_id"))
    edges = graph.join(of("src"), ["project_id", "src"]).join(of("dst"), ["project_id", "dst"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), *more)
    starts = roots.select("project_id", "root").distinct().join(of("root"), ["project_id", "root"]).select(F.col("root_id").alias("root"))
    return names, put(edges), put(starts)


class Ways(NamedTuple):
    """What each root leads to: names (project_id, name, id), and trees (TREE of the module trees), whose roots and nodes are such ids. Two written tables."""

    names: DataFrame
    trees: DataFrame

    def of(self, end: str) -> DataFrame:
        """(project_id, <end>_name, <end>): names of roots or nodes."""
        return self.names.select("project_id", F.col("name").alias(f"{end}_name"), F.col("id").alias(end))

    def pairs(self) -> DataFrame:
        """(project_id, root, node)."""
        met = self.trees.select("root", F.explode(F.flatten("nodes")).alias("node")).join(self.of("root"), "root").join(self.of("node").drop("project_id"), "node")
        return met.select("project_id", F.col("root_name").alias("root"), F.col("node_name").alias("node"))


def along(start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A value of each way of a tree, level by level: step makes it of the value of the way's first part and its last label; start is the root's."""
    last = lambda x: F.element_at(x, -1)
    level = lambda made, x: F.zip_with(x["parents"], x["labels"], lambda p, label: step(F.get(last(made), p), label))
    made = F.aggregate(F.arrays_zip("parents", "labels"), F.array(F.array(start)), lambda made, x: F.concat(made, F.array(level(made, x))))
    return F.flatten(F.slice(made, F.lit(2), F.size("parents")))


def each_level() -> Column:
    """The level of each way of a tree."""
    return F.flatten(F.transform("labels", lambda x, k: F.transform(x, lambda _: k + 1)))


def ways(graph: DataFrame, roots: DataFrame) -> Ways:
    """The first shortest ways from each root (project_id, root) to all it leads to along graph (project_id, src, dst, n, label, dax), the root itself excluded.

    Levels first, by numbers (levels()); then each pair meets the edges of its node, and what meets is sorted by root, a tree each. A tree holds
    a place for each way, not its labels, and ways are written out where they are read. Some roots are followed at a time, so that
    what lies on disk meanwhile doesn't grow with their number.
    """
    shape = "root long, src long, level int, n int, dst long, label string, dax string"
    with scratch() as put:
        names, edges, starts = numbered_graph(graph, roots, put, "n", "label", "dax")
        least = edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct(F.col("n").cast("int").alias("n"), "label", "dax")).alias("e"))
        links = put(least.select("src", "dst", "e.*"))
        power = squares(edges, put)
        found = written(names.sparkSession.createDataFrame([], TREE))
        parts = -(-starts.count() // ROOTS)
        for part in range(parts):
            some = starts.filter(F.pmod(F.xxhash64("root"), F.lit(parts)) == part)
            with scratch() as own:
                met = levels(power, some, own).withColumnRenamed("node", "src").join(links, "src").filter("dst <> root").selectExpr(*(c.split()[0] for c in shape.split(", ")))
                found = written(met.repartition("root").sortWithinPartitions("root").mapInArrow(trees, TREE), found)
    return Ways(names, found)


def closure(graph: DataFrame, roots: DataFrame, paths: bool = True) -> DataFrame:
    """What each root leads to: (project_id, root, node, level[, path, dax]), the root itself excluded.

    graph (project_id, src, dst, n, label, dax), roots (project_id, root). By repeated squaring, with numbers for names (levels()). Of the shortest paths to
    a node the one that comes first by edge numbers is kept, as a queue would visit it: path is its array of labels, dax the expression of its last edge (ways()).
    Each root is followed once however many use it. Tables between are written to the shared folder and deleted; the result is one written table.
    """
    if not paths:
        with scratch() as put:
            names, edges, starts = numbered_graph(graph, roots, put)
            found = Ways(names, edges)
            named = levels(squares(edges, put), starts, put).filter("level > 0").join(found.of("root"), "root").join(found.of("node").drop("project_id"), "node")
            out = written(named.select("project_id", F.col("root_name").alias("root"), F.col("node_name").alias("node"), "level"))
        discard(names)
        return out
    found = ways(graph, roots)
    path = along(F.array().cast("array<string>"), lambda first, label: F.concat(first, F.array(label)))
    dax = F.flatten(F.transform("daxes", lambda x: F.transform(x, lambda k: F.get("exprs", k))))
    each = F.arrays_zip(F.flatten("nodes").alias("node"), each_level().alias("level"), path.alias("path"), dax.alias("dax"))
    met = found.trees.select("root", F.inline(each)).join(found.of("root"), "root").join(found.of("node").drop("project_id"), "node")
    out = written(met.select("project_id", F.col("root_name").alias("root"), F.col("node_name").alias("node"), "level", "path", "dax"))
    for df in found:
        discard(df)
    return out


def on_cycles(graph: DataFrame) -> DataFrame:
    """(project_id, node): nodes that lead back to themselves."""
    return components(graph).select("project_id", "node").unionByName(graph.filter("src = dst").select("project_id", F.col("src").alias("node"))).distinct()


def components(graph: DataFrame) -> DataFrame:
    """(project_id, node, component): the strongly connected components of more than one node, named by their least node.

    A node's component is what it reaches forward that also reaches back to it; only nodes with edges in and out can be in one.
    """
    edges = graph.select("project_id", "src", "dst").filter("src <> dst").distinct().withColumns({"n": F.lit(0), "label": F.lit(""), "dax": F.lit("")})
    ends = edges.select("project_id", F.col("src").alias("root")).intersect(edges.select("project_id", F.col("dst").alias("root")))
    met = closure(edges, ends, paths=False).select("project_id", "root", "node")
    both = met.join(met.select("project_id", F.col("node").alias("root"), F.col("root").alias("node")), ["project_id", "root", "node"], "left_semi")
    return both.groupBy("project_id", F.col("root").alias("own")).agg(F.min("node").alias("least")).select("project_id", F.col("own").alias("node"), F.least("own", "least").alias("component"))


def rings(graph: DataFrame) -> DataFrame:
    """(project_id, cycle_id, nodes, path): cycles by a rule that no order of search decides.

    An edge is a back edge if it leads to its own source or, within a component, to a lesser node; every cycle has one. Of each back edge the
    shortest ring through it counts, the first by its nodes among equals, from its least node and back to it; a set of nodes
    counts once, with its first ring. Rings of a project are numbered by length, then by nodes.
    """
    comp = components(graph)
    edges = graph.select("project_id", "src", "dst").distinct()
    of = lambda end: comp.select("project_id", F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    inside = edges.filter("src <> dst").join(of("src"), ["project_id", "src"]).join(of("dst"), ["project_id", "dst"]).filter("src_component = dst_component")
    inside = written(inside.select("project_id", "src", "dst"))
    # Names stand for edge numbers, so that paths compare by nodes.
    order = inside.select("project_id", F.col("dst").alias("label")).distinct().select("project_id", "label", F.row_number().over(W.partitionBy("project_id").orderBy("label")).alias("n"))
    links = inside.withColumn("label", F.col("dst")).join(order, ["project_id", "label"]).withColumn("dax", F.lit(""))
    back = inside.filter("dst < src")
    ways = closure(links, back.select("project_id", F.col("dst").alias("root")))
    ring = ways.join(back.select("project_id", F.col("dst").alias("root"), F.col("src").alias("node")), ["project_id", "root", "node"])
    nodes = ring.select("project_id", F.concat(F.array("root"), "path").alias("nodes")).unionByName(edges.filter("src = dst").select("project_id", F.array("src").alias("nodes")))
    least = F.array_position("nodes", F.array_min("nodes")).cast("int")
    turned = nodes.select("project_id", F.concat(F.slice("nodes", least, F.size("nodes")), F.slice("nodes", F.lit(1), least - 1)).alias("nodes"))
    once = turned.groupBy("project_id", F.array_sort("nodes").alias("set")).agg(F.min("nodes").alias("nodes"))
    number = F.row_number().over(W.partitionBy("project_id").orderBy(F.size("nodes"), "nodes"))
    closed = F.concat("nodes", F.slice("nodes", 1, 1))
    return once.select("project_id", F.concat(F.lit("Cycle-"), number).alias("cycle_id"), closed.alias("nodes"), F.array_join(closed, " -> ").alias("path"))


def cycles(graph: DataFrame, order: DataFrame) -> DataFrame:
    """(project_id, cycle_id, nodes, path): cycles found by depth-first search from the sources in order
    (project_id, src, at), each set of nodes once.

    Only edges between nodes on cycles matter to which cycles there are, but the search's order decides
    which it records, so that it sees each project's graph. A project is one model, which fits a task.
    """
    rows = graph.join(order, ["project_id", "src"]).select("project_id", "src", "dst", "n", "at")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"], kind="stable")
        out: dict[str, list[str]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            out.setdefault(s, []).append(d)
        done: set[str] = set()
        known: set[frozenset[str]] = set()
        rows: list[tuple[str, str, list[str], str]] = []
        for start in list(out):
            if start in done:
                continue
            done.add(start)
            stack: list[tuple[str, Iterator[str]]] = [(start, iter(out[start]))]
            place = {start: 0}
            while stack:
                node, targets = stack[-1]
                for target in targets:
                    if target not in done:
                        done.add(target)
                        place[target] = len(stack)
                        stack.append((target, iter(out.get(target, ()))))
                        break
                    if target in place:
                        ring = [n for n, _ in stack[place[target] :]] + [target]
                        if frozenset(ring) not in known:
                            known.add(frozenset(ring))
                            rows.append((pdf["project_id"].iloc[0], f"Cycle-{len(rows) + 1}", ring, " -> ".join(ring)))
                else:
                    stack.pop()
                    del place[node]
        return pd.DataFrame(rows, columns=["project_id", "cycle_id", "nodes", "path"])

    return rows.groupBy("project_id").applyInPandas(search, "project_id string, cycle_id string, nodes array<string>, path string")

"""Helpers that the corpus operators share: reading tables, cutting lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of a plan's description.
PLAN = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver; its size does not depend on the corpus."""
    with open(path, "rb") as f:
        return f.read()


def small_batches(spark: SparkSession) -> None:
    """Texts can be very long, so that Arrow batches are bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def short_plans(spark: SparkSession) -> None:
    """Plans that hold a vocabulary as a literal are described in so many characters at most: the driver makes a description
    for every stage that ends, and keeps the last ones of up to a thousand queries."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while a table is written, put back after it."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def workdir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of its own only in local mode where none is named."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tabulens-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so that later steps neither repeat
    its work nor depend on the executors that did it; its size is then known to the optimizer."""
    spark = df.sparkSession
    path = f"{workdir(spark)}/tabulens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """Like cut(), with rows dealt to files by a column, so that a join on it moves only its other side. Compressed
    more than is usual, as such tables are as large as the corpus's distinct text."""
    spark, name = df.sparkSession, f"tabulens_{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{workdir(spark)}/{name}"
    df.write.bucketBy(files, column).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._cut_path = path
    spark.sql(f"DROP TABLE {name}")  # from the catalogue only: the files stay
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame made by cut(), once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@arrow_udf(StringType())
def folded(text: pa.Array) -> pa.Array:
    """Text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts that hold at most so many bytes of a column of text or binary, or one row more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most, prepend=-1))
    for s, e in zip(cuts, np.r_[cuts[1:], len(ends)], strict=True):
        yield batch.slice(s, e - s)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several intervals, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once and named, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fresh(taken: list[str], name: str) -> str:
    """A column name that is not among those taken, whatever their case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph with edges (a long, b long), null-free.

    Returns (node, component), the component being its smallest node; nodes without edges are
    absent. Each round gives every node the neighbour (or itself) with the least hash and merges
    the nodes that chose alike, so that the graph shrinks by a constant factor whatever its shape;
    the hash changes with the round. Only aggregates with map-side combining and equi-joins that
    adaptive execution may split are used; each round's tables are written to the shared folder.
    An empty graph gives an empty result. Repeated edges and loops change nothing.
    """
    now = cut(edges.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    held, node_map = [now], None
    for step in range(most_rounds):
        if now.isEmpty():
            break
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("v"))
        chosen = cut(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("other"))
            .select(F.col("a").alias("node"), F.least("other", rank("a"))["v"].alias("to"))
        )
        if node_map is None:
            node_map = chosen
        else:
            node_map = cut(
                node_map.withColumnRenamed("to", "via")
                .join(chosen.withColumnRenamed("node", "via"), "via", "left")
                .select("node", F.coalesce("to", "via").alias("to"))
            )
        ends = chosen.withColumnRenamed("to", "x")
        nxt = (
            now.join(ends.withColumnRenamed("node", "a"), "a")
            .withColumnRenamed("x", "p")
            .join(ends.withColumnRenamed("node", "b"), "b")
            .filter("p <> x")
            .selectExpr("least(p, x) AS a", "greatest(p, x) AS b")
            .distinct()
        )
        now = cut(nxt)
        held += [chosen, node_map, now]
    else:
        raise RuntimeError("the graph did not contract")
    if node_map is None:
        out = edges.sparkSession.createDataFrame([], "node long, component long")
    else:
        least = node_map.groupBy("to").agg(F.min("node").alias("component"))
        out = cut(node_map.join(least, "to").select("node", "component"))
    for x in {id(x): x for x in held}.values():
        discard(x)
    return out

"""Requests to a provider from tasks, and the table that keeps its replies.

A reply is a row under the hash of its request, so that what has been asked once, in this run or an
earlier one, for this project or another, is not asked again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that send requests at a time, at most: what the provider's endpoint has to bear.
SENDERS = 8
ROW = "request string, status string, reply string"


def answer(reply: Any) -> Any:
    """A provider's reply; none at all is a failure, to be asked for again."""
    if reply is None:
        raise ValueError("no answer")
    return reply


class Replies:
    """A table of replies in a folder that all executors share, to which runs append.

    status is answered (reply: what the provider said, as JSON), silent (it said nothing that can be used) or failed. A request that failed is sent again by the
    next run; of several rows of one request an answered one counts, then a silent one. A task that is lost sends its requests anew, but only one attempt's rows
    come into the table.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """(request, status, reply), a row a request."""
        rows = self.rows()
        rank = F.when(F.col("status") == "answered", 0).when(F.col("status") == "silent", 1).otherwise(2)
        return rows.withColumn("rank", rank).groupBy("request").agg(F.min(F.struct("rank", "status", "reply")).alias("r")).select("request", "r.status", "r.reply")

    def ask(self, wanted: DataFrame, call: Callable[[dict[str, Any]], Any]) -> tuple[DataFrame, int, int]:
        """wanted (request, context as JSON) -> replies to all of it (request, reply) that were answered, and how many requests were sent and failed.

        call gives what is to be kept of the answer to a context, or None; it is sent to the tasks, with the provider that it uses.
        """
        known = self.read().filter("status <> 'failed'").select("request")
        new = wanted.select("request", "context").dropDuplicates(["request"]).join(known, "request", "left_anti")

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for request, context in zip(b["request"], b["context"], strict=True):
                    try:
                        said = call(json.loads(context))
                        row = (request, "silent" if said is None else "answered", None if said is None else json.dumps(said))
                    except Exception:  # a provider is foreign code: its failure is a row like others
                        row = (request, "failed", None)
                    yield pd.DataFrame([row], columns=["request", "status", "reply"])

        before = self.count()
        new.repartition(SENDERS, "request").mapInPandas(send, ROW).write.mode("append").parquet(self.path)
        after = self.count()
        mine = self.read().join(wanted.select("request").distinct(), "request", "left_semi")
        return mine.filter("status = 'answered'").select("request", "reply"), after[0] - before[0], after[1] - before[1]

    def rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        return self.spark.read.schema(ROW).parquet(self.path) if there else self.spark.createDataFrame([], ROW)

    def count(self) -> tuple[int, int]:
        """Rows of the table, and those that failed."""
        return tuple(self.rows().agg(F.count("*"), F.count_if(F.col("status") == "failed")).first())

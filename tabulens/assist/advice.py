"""Advice on whole models and reports: a provider's where it gives any, the rules' for all other projects."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health
from .providers import REPLY_SEVERITIES, Provider, json_of
from .replies import Replies, answer

log = logging.getLogger(__name__)

#: Counts of a project that a request on its model, or on its report, shows.
ON_MODELS = ("score", "grade", "tables", "measures", "calculated", "unused", "unresolved", "cycles", "both_directions", "odd_cardinality")
ON_REPORTS = ("pages", "visuals", "objects_used")
ROWS = "project_id string, place int, type string, severity string, description string, recommendation string"


def issues_of(reply: Any) -> list[dict[str, str]] | None:
    """The issues that a reply lists, as text; None if it has no list of them. An unknown severity is Medium."""
    reply = json_of(reply)
    if not isinstance(reply, dict) or not isinstance(reply.get("issues"), list):
        return None
    out = []
    for issue in reply["issues"]:
        if not isinstance(issue, dict):
            continue
        said = {k: str(issue.get(k) or "").strip() for k in ("type", "severity", "description", "recommendation")}
        said["severity"] = said["severity"] if said["severity"] in REPLY_SEVERITIES else "Medium"
        out.append(said)
    return out


def advised(provider: Provider, found: DataFrame, subject: str, shown: tuple[str, ...], rules: Callable[[DataFrame], DataFrame], table: Replies | None = None) -> DataFrame:
    """rules(found), but for projects on which the provider gives a list of issues: those are its own, in its order.

    found has one row a project. One request is sent for each, which shows counts only: with a table of replies from tasks, projects with the same counts
    sharing one, without from the driver. A failure, or a reply without a list, leaves the rules' advice. An empty list is an answer: such a project has no rows.
    """
    if not provider.is_available():
        return rules(found)
    if table is not None:
        context = F.to_json(F.struct(F.lit(subject).alias("subject"), F.struct(*shown).alias("counts")))
        asked = found.select("project_id", context.alias("context")).withColumn("request", F.sha2(F.concat(F.lit("advice:"), "context"), 256))
        said, _, _ = table.ask(asked, lambda context: issues_of(answer(provider.advise(context))))
        issue = "array<struct<type:string,severity:string,description:string,recommendation:string>>"
        answers = asked.select("project_id", "request").join(said, "request").select("project_id", F.from_json("reply", issue).alias("issues"))
        own = answers.select("project_id", F.posexplode("issues").alias("place", "i")).select("project_id", "place", "i.*")
        return rules(found.join(answers.select("project_id"), "project_id", "left_anti")).unionByName(own)
    answered, rows = [], []
    for row in found.select("project_id", *shown).toLocalIterator():
        context = row.asDict()
        project = context.pop("project_id")
        try:
            issues = issues_of(provider.advise({"subject": subject, "counts": context}))
        except Exception as e:  # a provider is foreign code
            log.warning("advice on a %s failed: %s", subject, e)
            continue
        if issues is not None:
            answered.append((project,))
            rows += [(project, k, *issue.values()) for k, issue in enumerate(issues)]
    spark = found.sparkSession
    left = found.join(spark.createDataFrame(answered, "project_id string"), "project_id", "left_anti")
    return rules(left).unionByName(spark.createDataFrame(rows, ROWS))


def model_advice(provider: Provider, found: DataFrame, table: Replies | None = None) -> DataFrame:
    """found: health()."""
    return advised(provider, found, "model", ON_MODELS, health.model_advice, table)


def report_advice(provider: Provider, found: DataFrame, visual_usage: DataFrame, table: Replies | None = None) -> DataFrame:
    """found: health(). The provider is also shown how many objects a report uses."""
    used = visual_usage.filter("object_name <> ''").groupBy("project_id").agg(F.countDistinct("object_name").alias("objects_used"))
    counted = found.join(used, "project_id", "left").withColumn("objects_used", F.coalesce("objects_used", F.lit(0))) if provider.is_available() else found
    return advised(provider, counted, "report", ON_REPORTS, health.report_advice, table)

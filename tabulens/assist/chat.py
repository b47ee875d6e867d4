"""Answers to questions about an analysed model: the context of a question, and the conversation with a provider."""

from __future__ import annotations

import hashlib
import json
import logging
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assistant
from ..operators.resolve import catalog
from . import prompts
from .providers import MOST_REQUESTS, Provider, unknown_references

log = logging.getLogger(__name__)

#: Most rows of each part of a context, and messages that are passed on.
FOCUSED, REFERENCES, UNUSED, RELATIONSHIPS, USES, ADVICE, SAMPLE, TABLES, MEASURES, PASSED = 3, 10, 30, 25, 20, 5, 10, 15, 20, 6

#: An answer with one of these proposes an expression.
EXPRESSION_MARKS = ("DIVIDE(", "CALCULATE(", "VAR ")


def rows(df: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("part", "ord", "place")) -> list[dict[str, Any]]:
    """At most so many rows, in the order of the model, as plain values."""
    by = [c for c in order if c in df.columns]
    df = df.orderBy(*by) if by else df
    df = df.limit(limit) if limit is not None else df
    return [r.asDict(recursive=True) for r in df.drop("project_id", *order, "raw", "raw_page").collect()]


def build_context(question: str, found: dict[str, DataFrame], project_id: str, history: list[dict[str, str]] | None = None) -> dict[str, Any]:
    """The parts of an analysis that a question asks for. Tables are filtered and cut before they are collected."""
    spark = found["tables"].sparkSession
    own = {k: df.filter(F.col("project_id") == project_id) for k, df in found.items()}
    asked = spark.createDataFrame([(project_id, question)], "project_id string, text string")
    measures = own["measures"].select("project_id", F.struct(F.lit(0).alias("part"), "ord").alias("ord"), F.col("measure_name").alias("name"))
    calculated = own["calculated_columns"].select("project_id", F.struct(F.lit(1).alias("part"), "ord").alias("ord"), F.col("column_name").alias("name"))
    named, tables = measures.unionByName(calculated), own["tables"].select("project_id", "ord", F.col("table_name").alias("name"))
    focus = [r["name"] for r in assistant.contained(asked, named).orderBy("ord").limit(FOCUSED).collect()]
    about = [r["name"] for r in assistant.whole_words(asked, tables).orderBy("ord").limit(FOCUSED).collect()]
    flags = asked.select(assistant.intents(F.col("text")).alias("i"), assistant.refers_back(F.col("text")).alias("back")).first()
    if history and flags["back"]:
        messages = spark.createDataFrame([(project_id, 0, k, m.get("content", "")) for k, m in enumerate(history)], "project_id string, conv_id long, turn long, text string")
        met = assistant.recent_entity(messages, named, tables).first()
        if met and met["name"] not in (focus if met["kind"] == "measure" else about):
            (focus if met["kind"] == "measure" else about).append(met["name"])

    project = own["projects"].first()
    out: dict[str, Any] = {"project_name": project["project_name"], "model_format": project["model_format"], "report_format": project["report_format"], "model_info": (rows(own["model_info"]) or [{}])[0]}
    least = len(out)
    health = lambda: rows(own["model_health"].select("project_id", "score", "grade", "status_text", "deductions"))
    is_name = lambda n: F.col("object_name") == n
    if focus:
        out["focused_objects"] = [
            {
                "object_name": n, "usage_info": rows(own["object_usage"].filter(is_name(n)), 1), "static_dax_analysis": rows(own["dax_analysis"].filter(is_name(n)), 1), "improvements": rows(own["dax_improvements"].filter(is_name(n))),
                "visual_references": rows(own["visual_usage"].filter(is_name(n)), REFERENCES),
                "dependency_edges": rows(own["dax_dependencies"].filter(F.col("source_name") == n).select("ord", "source_table", "source_name", "target_table", "target_name", "target_kind"), REFERENCES),
            }
            for n in focus[: FOCUSED]
        ]
    intents = set(flags["i"])
    if "unused_objects_summary" in intents:
        out["unused_objects_summary"] = {"unused_objects_count": own["unused_objects"].count(), "unused_objects": rows(own["unused_objects"], UNUSED), "usage_summary": rows(own["usage_summary"])}
    if "relationships_summary" in intents:
        rels = own["relationships"].filter(F.col("from_table").isin(about) | F.col("to_table").isin(about)) if about else own["relationships"]
        out["relationships_summary"] = {"relationship_metrics": rows(own["relationship_metrics"]), "relationships": rows(rels, RELATIONSHIPS), "key_columns": rows(own["key_columns"], RELATIONSHIPS)}
    if "data_sources" in intents:
        out["data_sources"] = rows(own["data_sources"])
    if "model_health" in intents:
        out["model_health"] = health()
    if "report" in intents:
        out |= {"pages": rows(own["pages"].select("project_id", "ord", "page_id", "page_name")), "visual_count": own["visuals"].count(), "visual_usage_sample": rows(own["visual_usage"], USES)}
    if "executive_overview" in intents:
        out["executive_overview"] = {
            "model_health": health(), **{f"{n}_count": own[t].count() for n, t in (("table", "tables"), ("column", "columns"), ("measure", "measures"), ("page", "pages"), ("visual", "visuals"), ("unused_objects", "unused_objects"))},
            "top_dax_improvements": rows(own["dax_improvements"], ADVICE), "relationship_metrics": rows(own["relationship_metrics"]), "data_source_types": sorted(r[0] for r in own["data_sources"].select("source_type").distinct().collect()),
        }
    if about and not focus:
        cols = lambda t: own["columns"].filter(F.col("table_name") == t)
        meas = lambda t: own["measures"].filter(F.col("table_name") == t)
        out["focused_tables"] = [
            {
                "table_name": t, "columns_count": cols(t).count(), "measures_count": meas(t).count(), "columns_sample": [r["column_name"] for r in rows(cols(t), SAMPLE)], "measures_list": [r["measure_name"] for r in rows(meas(t), SAMPLE)],
                "relationships": rows(own["relationships"].filter((F.col("from_table") == t) | (F.col("to_table") == t))),
            }
            for t in about[: FOCUSED]
        ]
    if len(out) <= least:
        out["general_model_summary"] = {"tables": [r["table_name"] for r in rows(own["tables"], TABLES)], "measures": [r["measure_name"] for r in rows(own["measures"], MEASURES)], "model_health": health(), "unused_count": own["unused_objects"].count()}
    return out


class Assistant:
    """A conversation about one project: a budget of requests, and answers kept for questions asked again."""

    def __init__(self, found: dict[str, DataFrame] | None, project_id: str, provider: Provider, most: int = MOST_REQUESTS) -> None:
        self.found, self.project_id, self.provider, self.most = found, project_id, provider, most
        self.sent, self.answers = 0, {}

    def ask(self, question: str, history: list[dict[str, str]] | None = None) -> dict[str, Any]:
        """status and answer: no_metadata, ai_disabled, limit_reached, error, or success; cached says that it was known."""
        said = lambda status, answer, cached=False: {"status": status, "answer": answer, "cached": cached}
        if not self.found:
            return said("no_metadata", "No project has been analysed.")
        if not self.provider.is_available():
            return said("ai_disabled", "No provider is set up.")
        if self.sent >= self.most:
            return said("limit_reached", f"The limit of {self.most} requests has been reached.")
        context = json.dumps(build_context(question, self.found, self.project_id, history), sort_keys=True, default=str)
        key = hashlib.sha256(f"{question.strip().lower()}:{context}".encode()).hexdigest()
        if key in self.answers:
            return said("success", self.answers[key], True)
        messages = [{"role": "system", "content": f"{prompts.CHAT_SYSTEM}\n\nContext:\n{context}"}, *(history or [])[-PASSED:], {"role": "user", "content": question}]
        self.sent += 1
        try:
            answer = self.provider.chat(messages)
        except Exception as e:  # a provider is foreign code
            return said("error", f"The provider failed: {e}")
        if not answer:
            return said("error", "The provider gave no answer.")
        self.check(answer)
        self.answers[key] = answer
        return said("success", answer)

    def check(self, answer: str) -> None:
        """Logs what an answer's expressions refer to that the model lacks; the answer itself stays as it is."""
        if not any(mark in answer for mark in EXPRESSION_MARKS):
            return
        own = {k: self.found[k].filter(F.col("project_id") == self.project_id) for k in ("tables", "columns", "measures", "calculated_columns")}
        cat = catalog(own["tables"], own["columns"], own["measures"], own["calculated_columns"])
        try:
            note = unknown_references(own["tables"].sparkSession, self.project_id, answer, cat)
        except Exception as e:  # a check that fails must not take the answer away
            note = f"the check failed: {e}"
        if note:
            log.debug("an answer has references to nothing: %s", note)

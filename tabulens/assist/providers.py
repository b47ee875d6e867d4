"""Providers of suggestions, and how the expressions of an analysis are put to them.

A provider is called once for each distinct request and within a budget: from the driver, or, where a table of
replies is named, from a bounded number of tasks. Expressions are shown to it without secrets.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import lint, origins
from ..operators.resolve import Catalog, resolve
from . import prompts
from .replies import Replies, answer

#: Requests a project, severities of replies, and suggestions that are none.
MOST_REQUESTS = 50
REPLY_SEVERITIES = ("High", "Medium", "Low", "Informational")
NO_SUGGESTION = ("Manual review required", "No change required", "No safe automatic rewrite")
REPLY_DEFAULTS = {
    "category": "Performance", "severity": "Medium", "issue": "AI Optimization Opportunity", "explanation": "", "recommendation": "",
    "suggested_dax": "Manual review required", "confidence": "Medium",
}


class Provider(ABC):
    """What a provider of suggestions does. Any failure gives None."""

    name = "Provider"

    @abstractmethod
    def is_available(self) -> bool: ...

    @abstractmethod
    def analyze_expression(self, context: dict[str, Any]) -> Any: ...

    @abstractmethod
    def chat(self, messages: list[dict[str, str]]) -> str | None: ...

    def advise(self, context: dict[str, Any]) -> Any:
        """Issues of a whole model or report, from its counts. A provider need not have any."""
        return None


class NullProvider(Provider):
    name = "None"

    def is_available(self) -> bool:
        return False

    def analyze_expression(self, context: dict[str, Any]) -> Any:
        return None

    def chat(self, messages: list[dict[str, str]]) -> str | None:
        return None


class HttpProvider(Provider):
    """A chat-completions endpoint."""

    def __init__(self, url: str, headers: dict[str, str], model: str | None, name: str, timeout: float = 15) -> None:
        self.url, self.headers, self.model, self.name, self.timeout = url, headers, model, name, timeout

    def is_available(self) -> bool:
        return bool(self.url) and all(self.headers.values())

    def complete(self, messages: list[dict[str, str]], as_json: bool) -> str | None:
        body: dict[str, Any] = {"messages": messages, "temperature": 0.1, "max_tokens": 1200}
        body |= {"model": self.model} if self.model else {}
        body |= {"response_format": {"type": "json_object"}} if as_json else {}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]
        except (OSError, ValueError, LookupError, TypeError):
            return None

    def analyze_expression(self, context: dict[str, Any]) -> Any:
        return self.complete([{"role": "system", "content": prompts.EXPRESSION_SYSTEM}, {"role": "user", "content": prompts.expression(context)}], True)

    def chat(self, messages: list[dict[str, str]]) -> str | None:
        return self.complete(messages, False)

    def advise(self, context: dict[str, Any]) -> Any:
        return self.complete([{"role": "system", "content": prompts.ADVICE_SYSTEM}, {"role": "user", "content": prompts.advice(context)}], True)


def provider_from(env: dict[str, str] | None = None) -> Provider:
    """The provider that the environment names, the first of two that is complete, or none."""
    env = dict(os.environ) if env is None else env
    on = lambda k: env.get(k, "").strip()
    if on("DISABLE_AI").lower() in ("1", "true", "yes"):
        return NullProvider()
    wanted = on("AI_PROVIDER").lower()
    base, key, deployment = on("AZURE_OPENAI_ENDPOINT").rstrip("/"), on("AZURE_OPENAI_API_KEY"), on("AZURE_OPENAI_DEPLOYMENT")
    if wanted in ("", "azure", "azure_openai") and base and key and deployment:
        version = on("AZURE_OPENAI_API_VERSION") or "2024-02-01"
        return HttpProvider(f"{base}/openai/deployments/{deployment}/chat/completions?api-version={version}", {"api-key": key}, None, "Azure OpenAI")
    if wanted in ("", "openai") and on("OPENAI_API_KEY"):
        return HttpProvider("https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {on('OPENAI_API_KEY')}"}, on("OPENAI_MODEL") or "gpt-4o-mini", "OpenAI")
    return NullProvider()


def json_of(reply: Any) -> Any:
    """A reply that is text, in a fence or not, as the JSON that it holds; None if it holds none."""
    if not isinstance(reply, str):
        return reply
    try:
        return json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip(), flags=re.MULTILINE))
    except ValueError:
        return None


def parse_reply(reply: Any) -> dict[str, Any] | None:
    """A reply as an issue's fields with defaults; None if it is no object or sees no improvement."""
    reply = json_of(reply)
    if not isinstance(reply, dict) or not reply or not reply.get("has_improvement", True):
        return None
    out = {k: str(reply.get(k, d)).strip() for k, d in REPLY_DEFAULTS.items()}
    out["severity"] = out["severity"] if out["severity"] in REPLY_SEVERITIES else "Medium"
    return out | {"requires_manual_validation": bool(reply.get("requires_manual_validation", True))}


def validated(replies: DataFrame, cat: Catalog) -> DataFrame:
    """replies (project_id, kind, table_name, name, suggested_dax, ...) with validation_status and note: a suggestion
    is valid if everything it refers to is in the model; the first three that are not are named."""
    rows = replies.withColumn("refs", E.references(E.masked(F.coalesce("suggested_dax", F.lit("")))))
    keys = ["project_id", "kind", "table_name", "name"]
    refs = rows.select(*[F.col(k).alias(f"of_{k}") for k in keys], "project_id", F.col("table_name").alias("context"), F.posexplode("refs").alias("place", "r")).select("*", "r.kind", "r.table", "r.name").drop("r")
    shown = F.when(F.col("kind") == "column", F.concat("table", F.lit("["), "name", F.lit("]"))).when(F.col("kind") == "bracket", F.concat(F.lit("["), "name", F.lit("]"))).otherwise(F.concat(F.lit("Table '"), "name", F.lit("'")))
    lost = resolve(refs, cat).filter("found IS NULL").groupBy(*[F.col(f"of_{k}").alias(k) for k in keys]).agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("lost"))
    names = F.array_join(F.slice(F.transform("lost", lambda x: x["shown"]), 1, 3), ", ")
    none = F.coalesce("suggested_dax", F.lit("")).isin("", *NO_SUGGESTION)
    status = F.when(none, "No Suggestion").when(F.col("lost").isNotNull(), "Invalid").otherwise("Validated")
    out = rows.drop("refs").join(lost, keys, "left").withColumn("validation_status", status)
    return out.withColumn("note", F.when(F.col("validation_status") == "Invalid", F.concat(F.lit("Suggested DAX references unknown model object(s): "), names)).otherwise("")).drop("lost")


def unknown_references(spark: SparkSession, project_id: str, text: str, cat: Catalog) -> str:
    """What an answer's expressions refer to that the project's model lacks, in words; empty if there is nothing."""
    asked = spark.createDataFrame([(project_id, "Answer", "", "", text)], "project_id string, kind string, table_name string, name string, suggested_dax string")
    return validated(asked, cat).first()["note"]


def request_key(dependencies: Column) -> Column:
    """What makes two requests the same: SHA-256 of the object, its expression and what it refers to, sorted."""
    return F.sha2(F.concat_ws(":", "kind", "table_name", "name", "dax", F.array_join(F.array_sort(dependencies), ",")), 256)


def requests(analysed: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects with the names of what they refer to (dependencies) and their request's key."""
    name = F.when(F.col("target_kind") == "Measure", F.concat(F.lit("["), "target_name", F.lit("]"))).otherwise(F.concat(F.lit("'"), "target_table", F.lit("'["), "target_name", F.lit("]")))
    per = edges.filter("resolved AND target_kind <> 'Table'").groupBy("project_id", "source_kind", "source_table", "source_name").agg(F.collect_set(name).alias("dependencies"))
    per = per.select("project_id", F.col("source_kind").alias("kind"), F.col("source_table").alias("table_name"), F.col("source_name").alias("name"), "dependencies")
    out = analysed.join(per, ["project_id", "kind", "table_name", "name"], "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    return out.withColumn("request", request_key(F.col("dependencies")))


REPLIES = f"project_id string, kind string, table_name string, name string, reply {lint.ISSUE}"


def ask_all(provider: Provider, analysed: DataFrame, edges: DataFrame, cat: Catalog, most: int = MOST_REQUESTS, table: Replies | None = None) -> tuple[DataFrame, int, int]:
    """Replies on an analysis's expressions, with the numbers of requests sent and failed.

    Each distinct request is sent once, at most so many a project, in order of objects; objects with the same
    request share its reply. With a table of replies they are sent from tasks, and none that the table answers; without
    one from the driver, to which only the requests within the budget come.
    """
    spark = analysed.sparkSession
    if not provider.is_available():
        return spark.createDataFrame([], REPLIES), 0, 0
    wanted = requests(analysed, edges)
    first = wanted.groupBy("project_id", "request").agg(F.min_by(F.struct("kind", "table_name", "name", "dax", "dependencies", "issues"), "ord").alias("o"), F.min("ord").alias("ord"))
    within = first.withColumn("n", F.expr("row_number() OVER (PARTITION BY project_id ORDER BY ord)")).filter(F.col("n") <= most).select("project_id", "request", "o.*")
    shown = F.when(F.col("kind") == "Measure", F.concat(F.lit("["), "name", F.lit("]"))).otherwise(F.concat("table_name", F.lit("["), "name", F.lit("]")))
    context = F.to_json(F.struct(
        shown.alias("object_name"), F.col("kind").alias("object_type"), F.col("table_name").alias("table"), origins.redacted(F.col("dax")).alias("original_dax"), "dependencies",
        F.transform("issues", lambda i: F.struct(i["issue"].alias("issue"), i["severity"].alias("severity"), i["explanation"].alias("explanation"))).alias("static_issues"),
    ))
    within = within.select("project_id", "request", context.alias("context"))
    fields = ", ".join(f"{k} string" for k in REPLY_DEFAULTS)
    fields = f"{fields}, requires_manual_validation boolean"
    if table is not None:
        said, sent, failed = table.ask(within, lambda context: parse_reply(answer(provider.analyze_expression(context))))
        replies = within.select("project_id", "request").join(said, "request").select("project_id", "request", F.from_json("reply", fields).alias("r")).select("project_id", "request", "r.*")
    else:
        sent, failed, got = 0, 0, []
        for row in within.toLocalIterator():
            sent += 1
            try:
                reply = parse_reply(provider.analyze_expression(json.loads(row["context"])))
            except Exception:  # a provider is foreign code: its failure leaves the rules' own result
                failed += 1
                continue
            if reply:
                got.append((row["project_id"], row["request"], *[reply[k] for k in REPLY_DEFAULTS], reply["requires_manual_validation"]))
        replies = spark.createDataFrame(got, f"project_id string, request string, {fields}")
    met = validated(wanted.select("project_id", "kind", "table_name", "name", "request").join(replies, ["project_id", "request"]), cat)
    met = met.withColumns({"source": F.lit("AI"), "explanation": F.concat("explanation", F.when(F.col("note") != "", F.concat(F.lit(" [Warning: "), "note", F.lit("]"))).otherwise(""))})
    return met.select("project_id", "kind", "table_name", "name", F.struct(*lint.FIELDS, "requires_manual_validation").alias("reply")), sent, failed

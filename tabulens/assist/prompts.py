"""Texts that providers are given."""

from __future__ import annotations

from typing import Any

EXPRESSION_SYSTEM = (
    "You review expressions of a tabular model. Answer with one JSON object with the keys has_improvement, category, severity (High, Medium, Low or Informational), "
    "issue, explanation, recommendation, suggested_dax, confidence and requires_manual_validation. Refer only to objects that are named to you."
)
CHAT_SYSTEM = (
    "You answer questions about a tabular model and its reports from the context given to you, and from nothing else. "
    "You see descriptions of the model, not its data, and never evaluate an expression. If the context has no answer, say so."
)
ADVICE_SYSTEM = (
    "You advise on the design of a tabular model or of its report, from counts alone. Answer with one JSON object whose key issues lists objects with the keys "
    "type, severity (High, Medium, Low or Informational), description and recommendation."
)
#: Most dependencies and columns that are shown.
MOST_DEPENDENCIES, MOST_COLUMNS = 10, 15


def expression(context: dict[str, Any]) -> str:
    shown = sorted(context["dependencies"])[:MOST_DEPENDENCIES]
    columns = context.get("known_columns", [])[:MOST_COLUMNS]
    issues = [f"- {i['severity']}: {i['issue']}" for i in context["static_issues"]]
    return "\n".join(
        [
            f"{context['object_type']} {context['object_name']} of table '{context['table']}':",
            context["original_dax"],
            "It refers to: " + (", ".join(shown) or "nothing that is known"),
            *(["The table has the columns: " + ", ".join(columns)] if columns else []),
            "Rules have found:",
            *(issues or ["- nothing"]),
        ]
    )


def advice(context: dict[str, Any]) -> str:
    return "\n".join([f"Counts of a {context['subject']}:", *(f"- {k}: {v}" for k, v in context["counts"].items())])

"""Field references in visuals' JSON, against a recursive walk."""

import json
import random

import pytest

from tabulens.operators import report

SCHEMA = "project_id string, ord int, visual_title string, raw string"
HOLDERS = {"Column": "Property", "Measure": "Property", "HierarchyLevel": "Level"}


def walk(x, known, out):
    if isinstance(x, list):
        for y in x:
            walk(y, known, out)
    elif isinstance(x, dict):
        for holder, prop in HOLDERS.items():
            named = x.get(holder)
            if isinstance(named, dict) and named.get(prop):
                ref = named.get("Expression")
                ref = ref.get("SourceRef") if isinstance(ref, dict) else {}
                ref = ref if isinstance(ref, dict) else {}
                out.add((ref.get("Entity") or known.get(ref.get("Source")), named[prop], "Measure" if holder == "Measure" else "Column"))
        if isinstance(x.get("queryRef"), str):
            text = x["queryRef"].strip(" \t\n")
            if text.endswith(")") and "(" in text and text.split("(")[0].isidentifier():
                text = text[text.index("(") + 1 : -1].strip()
            bare = lambda s: s.strip(" ").strip("'\"[]")
            table, dot, field = text.partition(".")
            out.add((bare(table), bare(bare(field).split(".")[0]), None) if dot else (None, text.strip("'\"[]"), None))
        for y in x.values():
            walk(y, known, out)


def slow(raw, title):
    out = set()
    try:
        doc = json.loads(raw or "")
    except ValueError:
        doc = None
    known = {}
    if isinstance(doc, dict):
        query = doc.get("prototypeQuery") or (doc.get("singleVisual") or {}).get("prototypeQuery") or {}
        known = {s["Name"]: s["Entity"] for s in query.get("From", []) if s.get("Name") and s.get("Entity")}
    walk(doc, known, out)
    if title and "[" in title and "]" in title[title.index("[") + 2 :]:
        out.add((None, title[title.index("[") + 1 :].split("]")[0], None))
    return out


def made(rng, depth):
    ref = rng.choice([{"Entity": f"T{rng.randrange(3)}"}, {"Source": rng.choice("abz")}, {"Entity": "", "Source": "a"}, {}, None])
    holder = rng.choice(list(HOLDERS))
    leaf = rng.choice([
        {holder: {"Expression": {"SourceRef": ref}, HOLDERS[holder]: rng.choice(["F1", "F 2", "", None])}}, {holder: "text"}, {holder: {"Expression": "none", HOLDERS[holder]: "F3"}},
        {"queryRef": rng.choice(["Sales.Amount", "Sum(Sales.Amount)", " 'My Table'.[Total] ", "Dates.Date.Variation.Year", "Alone", "[Alone]", "Count(T)"])}, {"queryRef": {"x": 1}}, 5, "queryRef", None, [], {},
    ])
    for _ in range(depth):
        leaf = rng.choice([lambda x: [x, 1], lambda x: {"a": x, "b": "{"}, lambda x: {"Column": x, "c": [x]} if len(json.dumps(x)) < 500 else [x], lambda x: {"Measure": {"Property": "P", "Expression": x}}])(leaf)
    return leaf


@pytest.mark.parametrize("levels", [2, 10])
def test_references_are_those_of_a_walk(spark, monkeypatch, levels):
    monkeypatch.setattr(report, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(None, None), ("", "[M] x"), ("not json", ""), ("[1, 2]", "a]b["), ("{}", "About [Total] and [Other]"), ('"queryRef"', None), ("null", None)]
    for k in range(60):
        doc = {"visual": [made(rng, rng.randrange(7)) for _ in range(3)]}
        query = {"From": [{"Name": "a", "Entity": "First"}, {"Name": "b", "Entity": "Bee"}, {"Name": "a", "Entity": "Last"}, {"Name": "z"}]}
        doc |= rng.choice([{}, {"prototypeQuery": query}, {"singleVisual": {"prototypeQuery": query}}, {"prototypeQuery": {}, "singleVisual": {"prototypeQuery": query}}])
        rows.append((json.dumps(doc), rng.choice([None, "plain", f"[K{k}]"])))
    rows.append((json.dumps(made(rng, 6)), None))
    deep = {"queryRef": "Deep.Field"}
    for _ in range(45):
        deep = {"x": [deep]}
    rows.append((json.dumps(deep), None))
    df = spark.createDataFrame([("p", k, title, raw) for k, (raw, title) in enumerate(rows)], SCHEMA)
    got = {}
    for r in report.field_references(df).collect():
        got.setdefault(r["ord"], []).append(tuple(r["f"]))
    for k, (raw, title) in enumerate(rows):
        assert sorted(got.get(k, []), key=repr) == sorted(slow(raw, title), key=repr), raw


def test_no_python_worker(spark):
    df = spark.createDataFrame([("p", 0, "[M]", '{"queryRef": "T.F"}')], SCHEMA)
    assert "Python" not in report.field_references(df)._jdf.queryExecution().toString()

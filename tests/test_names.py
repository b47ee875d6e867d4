"""Names in questions by their index, against a look at every name."""

import random
import re

from tabulens.operators import assistant

ASKED = "project_id string, conv_id int, turn int, text string, ord string"
NAMES = "project_id string, ord int, name string"


def test_names_are_those_of_a_look_at_each(spark):
    rng = random.Random(4)
    words = ["Total Sales", "total", "a", "AB", "Ärger", "x.y", "Sales[1]", "ß", "日本語", "b c", "\\E.", "", "İx"]
    names = [(f"p{rng.randrange(3)}", k, rng.choice(words) + rng.choice(["", " YTD", "s"])) for k in range(40)] + [("p0", 99, "a"), ("p0", 99, "a"), ("p9", 0, "lonely")]
    texts = [None, "", "a", "AB", "what of TOTAL sales ytd?", "x.y's and xay", "[a] b", "日本語s", "ärger", "no", "totals of Sales[1]"]
    asked = [(f"p{rng.randrange(4)}", k // 5, k % 5, " ".join(t or "" for t in rng.sample(texts, 2)) if rng.random() < 0.8 else rng.choice(texts), "o") for k in range(120)]
    q, n = spark.createDataFrame(asked, ASKED).drop("ord"), spark.createDataFrame(names, NAMES)
    have = lambda t, x: x and x.lower() in (t or "").lower()
    want = {(p, c, u, t, o, x) for p, c, u, t, _ in asked for r, o, x in names if r == p and have(t, x)}
    got = [tuple(r) for r in assistant.contained(q, n).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    word = lambda t, x: re.search(rf"\b{re.escape(x.lower())}\b", t.lower())
    assert {tuple(r) for r in assistant.whole_words(q, n).collect()} == {w for w in want if word(w[3], w[5])}
    measures, tables = n.filter("ord % 2 = 0"), n.filter("ord % 2 = 1")
    best = {}
    for p, c, u, t, o, x in want:
        back = max(a[2] for a in asked if a[:2] == (p, c)) - u
        if sum(a[:2] == (p, c) and a[2] > u for a in asked) < 4:
            rank = 2 if o % 2 else 0 if f"[{x.lower()}]" in t.lower() else 1
            best[p, c] = min(best.get((p, c), (99,)), (back, rank, o, x, "table" if o % 2 else "measure"))
    assert {tuple(r) for r in assistant.recent_entity(q, measures, tables).collect()} == {(p, c, b[4], b[3]) for (p, c), b in best.items()}


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("'p' AS project_id", "id AS ord", "concat('Total Sales ', id, '.') AS name")
    asked = spark.range(200).selectExpr("'p' AS project_id", "CAST(id AS INT) AS conv_id", "0 AS turn", "concat('how is total sales ', id * 499, '. doing against plan') AS text")
    got = assistant.contained(asked, names)
    assert got.selectExpr("count(*)", "sum(ord)").first() == (200, 499 * 199 * 100)
    assert "Cartesian" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    index = assistant.index(names)
    assert index.count() == 100_000 and index.groupBy("gram").count().agg({"count": "max"}).first()[0] < 5_000

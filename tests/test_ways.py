"""Ways as trees against all shortest paths by hand: numbers and labels that tie, some roots at a time, ways that read alike."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.operators import graph, trees, usage

EDGE = "project_id string, src string, dst string, label string, dax string, n int"
LABELS = ["a", "b", "a -> b", "b -> a", "x ->", "-> x", ""]


def random_graph(seed, nodes=9, most=22):
    rng = random.Random(seed)
    pairs = {(rng.choice("pq"), rng.randrange(nodes), rng.randrange(nodes)) for _ in range(most)}
    return [(p, f"n{s}", f"n{d}", rng.choice(LABELS), f"x{rng.randrange(3)}", rng.randrange(2)) for p, s, d in sorted(pairs)]


def shortest(edges, project, root):
    """node -> (level, numbers, labels, dax): the least of all shortest paths."""
    found, layer = {root: None}, [((), (), "", root)]
    while layer:
        step = {}
        for at, path, _, node in layer:
            for p, s, d, label, dax, n in edges:
                if (p, s) == (project, node) and d not in found:
                    step.setdefault(d, []).append(((*at, n), (*path, label), dax))
        best = {d: min(x) for d, x in step.items()}
        found |= {d: (len(x[0]), *x) for d, x in best.items()}
        layer = [(*x, d) for d, x in best.items()]
    del found[root]
    return found


@pytest.mark.parametrize("roots_at_a_time", [1, 4, 2**17])
def test_first_of_all_shortest_ways(spark, monkeypatch, roots_at_a_time):
    monkeypatch.setattr(graph, "ROOTS", roots_at_a_time)
    edges = random_graph(11 + roots_at_a_time)
    roots = [(p, f"n{k}") for p in "pq" for k in range(0, 9, 2)]
    got = graph.closure(spark.createDataFrame(edges, EDGE), spark.createDataFrame(roots, "project_id string, root string")).collect()
    want = {(p, r, d, level, path, dax) for p, r in roots for d, (level, _, path, dax) in shortest(edges, p, r).items()}
    assert len(got) == len(want) and {(*r[:4], tuple(r["path"]), r["dax"]) for r in got} == want


def test_trees_do_not_depend_on_batches(monkeypatch):
    rng, edges = random.Random(7), []
    for root in range(100, 140):
        of_root = [("p", root if s == 0 else s, root if d == 0 else d, rng.choice(LABELS), rng.choice("xyz"), rng.randrange(2)) for s, d in sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(20)} | {(0, 1)})]
        level = {root: 0} | {node: x[0] for node, x in shortest(of_root, "p", root).items()}
        edges += [(root, s, level[s], n, d, label, dax) for _, s, d, label, dax, n in of_root if s in level and d not in (s, root)]
    shape = pa.schema([("root", pa.int64()), ("src", pa.int64()), ("level", pa.int32()), ("n", pa.int32()), ("dst", pa.int64()), ("label", pa.string()), ("dax", pa.string())])
    whole = pa.Table.from_pylist([dict(zip(shape.names, e, strict=True)) for e in edges], schema=shape).combine_chunks()

    def read(size):
        for r in pa.Table.from_batches(list(trees.trees(iter(whole.to_batches(max_chunksize=size)))), trees.SCHEMA).to_pylist():
            exprs = r.pop("exprs")
            yield r | {"daxes": [[exprs[k] for k in x] for x in r["daxes"]]}

    want = list(read(10_000))
    assert [r["root"] for r in want] == list(range(100, 140)) and max(len(r["nodes"]) for r in want) > 3
    for most, size in ((1, 1), (1, 7), (50, 3), (300, 1)):
        monkeypatch.setattr(trees, "EDGES", most)
        assert list(read(size)) == want


def test_lineage_of_ways_that_read_alike(spark):
    """Objects of one name in one visual, ways of one text in one tree: the first use counts, once."""
    rng, alone = random.Random(5), 0
    for seed in range(3):
        edges = random_graph(seed, most=26)
        uses = sorted({(rng.choice("pq"), f"n{rng.randrange(9)}", rng.choice(["page", None]), rng.choice("vw"), rng.choice(["t", ""]), rng.choice(["o", "m", "k", None]), k) for k in range(30)}, key=str)
        want = {}
        for p, node, page, visual, title, name, ord_ in uses:
            for level, _, path, dax in shortest(edges, p, node).values():
                key = (p, page, visual, name, path[-1], " -> ".join([*([] if name is None else [name]), *path]))
                want[key] = min(want.get(key, (99,)), (ord_, title, level, dax))
        used = spark.createDataFrame(uses, "project_id string, canonical string, page_name string, visual_name string, visual_title string, object_name string, ord int").repartition(3)
        got = usage.lineage(used, usage.ways(used, spark.createDataFrame(edges, EDGE))).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == {(*k, *x[1:]) for k, x in want.items()}
        alone += len(want)
    assert alone > 100


def test_deep_ways(spark):
    chain = spark.range(500).selectExpr("'p' AS project_id", "'n' || id AS src", "'n' || (id + 1) AS dst", "sha2(CAST(id AS STRING), 256) AS label", "'' AS dax", "0 AS n")
    used = spark.range(200).selectExpr("'p' AS project_id", "'n' || id AS canonical", "'page' AS page_name", "'v' AS visual_name", "'' AS visual_title", "'o' || id AS object_name", "id AS ord")
    rows = usage.lineage(used, usage.ways(used, chain))
    assert rows.agg(F.count("*"), F.max("dependency_level"), F.sum("dependency_level")).first() == (sum(500 - k for k in range(200)), 500, sum((500 - k) * (501 - k) // 2 for k in range(200)))

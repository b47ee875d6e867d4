"""Closure, components, rings and use of random and of deep graphs, against searches by hand."""

import random
from collections import deque

from tabulens.operators import graph, usage

EDGE = "project_id string, src string, dst string, label string, dax string, n int"


def frame(spark, edges):
    return spark.createDataFrame([(p, s, d, f"L{d}", f"x{s}", n) for p, s, d, n in edges], EDGE)


def random_edges(seed, projects=4, nodes=14, most=26):
    rng = random.Random(seed)
    out = []
    for p in range(projects):
        pairs = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(rng.randrange(most))})
        rng.shuffle(pairs)
        out += [(f"p{p}", f"n{s:02}", f"n{d:02}", k) for k, (s, d) in enumerate(pairs)]
    return out


def by_queue(edges, project, root):
    out, known, queue = {}, {root}, deque([(root, (), "")])
    while queue:
        node, path, _ = queue.popleft()
        for _, s, d, _ in sorted((e for e in edges if e[0] == project and e[1] == node), key=lambda e: e[3]):
            if d not in known:
                known.add(d)
                out[d] = ((*path, f"L{d}"), f"x{s}")
                queue.append((d, *out[d]))
    return out


def test_closure_is_that_of_a_queue(spark):
    edges = [*random_edges(1), *random_edges(2, projects=2, nodes=40, most=70)]
    edges = list({(p, s, d): (p, s, d, n) for p, s, d, n in edges}.values())
    roots = sorted({(p, x) for p, s, d, _ in edges for x in (s, d)})[::2]
    want = {(p, r, d, len(path), path, dax) for p, r in roots for d, (path, dax) in by_queue(edges, p, r).items()}
    for paths in (True, False):
        got = graph.closure(frame(spark, edges), spark.createDataFrame(roots * 2, "project_id string, root string"), paths).collect()
        rows = {(*r[:4], tuple(r["path"]), r["dax"]) for r in got} if paths else {tuple(r) for r in got}
        assert len(got) == len(rows) and rows == (want if paths else {w[:4] for w in want})


def test_a_long_chain_takes_few_rounds(spark):
    n = 5000
    edges = spark.range(n).selectExpr("'p' AS project_id", "CAST(id AS STRING) AS src", "CAST(id + 1 AS STRING) AS dst", "'' AS label", "'' AS dax", "0 AS n")
    before = len(graph.TABLES)
    met = graph.closure(edges, spark.createDataFrame([("p", "0"), ("p", "4000")], "project_id string, root string"), paths=False)
    assert met.selectExpr("count(*)", "max(level)", "sum(level)").first() == (6000, 5000, 5000 * 5001 // 2 + 1000 * 1001 // 2)
    assert len(graph.TABLES) == before + 1
    assert len(met._jdf.queryExecution().toString()) < 3000
    ring = edges.unionByName(edges.limit(1).selectExpr("project_id", "'5000' AS src", "'0' AS dst", "label", "dax", "n"))
    assert graph.closure(ring, spark.createDataFrame([("p", "7")], "project_id string, root string"), paths=False).selectExpr("count(*)", "max(level)").first() == (5000, 5000)


def simple_rings(edges, project):
    """Of each back edge the shortest ring, found by walking all simple paths."""
    out = {s: sorted(d for p, x, d, _ in edges if p == project and x == s) for _, s, _, _ in edges}
    found = {}
    for p, s, d, _ in edges:
        if p != project or d > s:
            continue
        if d == s:
            ways = [(s,)]
        else:
            ways, layer, known = [], [(d,)], {d}
            while layer and not ways:  # a layer of shortest paths at a time
                layer = [(*w, x) for w in layer for x in out.get(w[-1], ()) if x not in w and x not in known]
                known |= {w[-1] for w in layer}
                ways = [w for w in layer if w[-1] == s]
        if ways:
            way = min(ways)
            k = way.index(min(way))
            way = way[k:] + way[:k]
            found[frozenset(way)] = min(found.get(frozenset(way), way), way)
    return sorted(found.values(), key=lambda w: (len(w), w))


def test_rings_and_components(spark):
    edges = random_edges(5, projects=6, nodes=9, most=30)
    edges = list({(p, s, d): (p, s, d, n) for p, s, d, n in edges}.values())
    got = {}
    for r in graph.rings(frame(spark, edges)).collect():
        got[r["project_id"], r["cycle_id"]] = tuple(r["nodes"])
    want = {(p, f"Cycle-{k}"): (*w, w[0]) for p in {e[0] for e in edges} for k, w in enumerate(simple_rings(edges, p), 1)}
    assert got == want and len({k for k in got if k[1] == "Cycle-3"}) > 1
    reach = {(p, s): set(by_queue(edges, p, s)) for p, s, _, _ in edges}
    comp = {(r["project_id"], r["node"]): r["component"] for r in graph.components(frame(spark, edges)).collect()}
    for (p, s), there in reach.items():
        same = {s} | {x for x in there if s in reach.get((p, x), ())}
        assert comp.get((p, s)) == (min(same) if len(same) > 1 else None)
    assert {tuple(r) for r in graph.on_cycles(frame(spark, edges)).collect()} == set(comp) | {(p, s) for p, s, d, _ in edges if s == d}
    assert graph.rings(frame(spark, [])).count() == 0


def test_use_counts_places_once(spark):
    """Bitmaps of places against sets; places without a page or visual, used twice, and of many projects."""
    rng = random.Random(3)
    edges = [e for e in random_edges(9, projects=5, nodes=10, most=25) if e[1] != e[2]]
    edges = list({(p, s, d): (p, s, d, n) for p, s, d, n in edges}.values())
    uses = [(f"p{rng.randrange(5)}", f"n{rng.randrange(10):02}", rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 70_000, None])) for _ in range(150)]
    objects = [(f"p{p}", f"n{n:02}") for p in range(5) for n in range(11)]
    used = spark.createDataFrame(uses, "project_id string, canonical string, page_name string, visual_id long").repartition(3)
    universe = spark.createDataFrame(objects, "project_id string, canonical string")
    got = usage.object_usage(universe, used, usage.reach(used, frame(spark, edges), paths=False)).collect()
    assert len(got) == len(objects)
    for r in got:
        p, node = r["project_id"], r["canonical"]
        leads = {s for _, s in objects if node in by_queue(edges, p, s)}
        direct = [u for u in uses if u[:2] == (p, node)]
        other = [u for u in uses if u[0] == p and u[1] in leads]
        assert (r["direct_count"], r["indirect_count"], r["location_count"]) == (len(direct), len(other), len({u[2:] for u in direct + other}))


def test_more_places_than_a_bitmap_holds(spark):
    used = spark.range(100_000).selectExpr("'p' AS project_id", "IF(id % 2 = 0, 'a', 'b') AS canonical", "'page' AS page_name", "id DIV 4 AS visual_id").repartition(4)
    universe = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c")], "project_id string, canonical string")
    met = usage.reach(used, frame(spark, [("p", "a", "c", 0), ("p", "b", "c", 1)]), paths=False)
    got = {r["canonical"]: (r["direct_count"], r["indirect_count"], r["location_count"]) for r in usage.object_usage(universe, used, met).collect()}
    assert got == {"a": (50_000, 0, 25_000), "b": (50_000, 0, 25_000), "c": (0, 100_000, 25_000)}

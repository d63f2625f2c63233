import glob
import os
import random
from collections import defaultdict, deque

import duckdb
import numpy as np
import pytest

from vaultspark.functions import scores
from vaultspark.operators import between, graph
from vaultspark.plans import catalogue
from vaultspark.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """Neighbours of every entity with the weight of the edge, from the tables as they are."""
    near = {r["id"]: {} for r in tables.entities(spark, DATA).collect()}
    for r in tables.relationships(spark, DATA).collect():
        a, b, w = r["source_id"], r["target_id"], r["weight"]
        near[a][b] = near[b][a] = max(w, near[a].get(b, 0))
    return near


def run(spark, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, DATA).collect()]


def test_components_and_stats(spark, whole):
    want = {}
    for i in sorted(whole):
        todo = [i]
        while todo:
            if (k := todo.pop()) not in want:
                want[k] = i
                todo += whole[k]
    assert dict(run(spark, "graph_components")) == want
    (nodes, edges, density, degree, parts), n = run(spark, "graph_stats")[0], len(whole)
    e = sum(map(len, whole.values())) / 2
    assert (nodes, edges, parts) == (n, e, len(set(want.values()))) and e > 2 * n  # not a tree
    assert density == pytest.approx(2 * e / (n * (n - 1)), abs=1e-8) and degree == pytest.approx(2 * e / n, abs=1e-5)


def test_betweenness(spark, whole):
    total = dict.fromkeys(whole, 0.0)
    for s in whole:
        far, paths, order, todo = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while todo:
            order.append(v := todo.popleft())
            for w in whole[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in whole[w]:
                if far[v] == far[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(whole)
    want = {i: t / ((n - 1) * (n - 2)) for i, t in total.items()}
    assert dict(run(spark, "graph_betweenness")) == pytest.approx(want, abs=1e-6)
    rows = {r["id"]: r for r in tables.entities(spark, DATA).withColumn("recency", scores.recency(tables.F.col("last_seen"), tables.F.to_date(tables.F.lit("2001-12-31")))).collect()}
    top = [max(x) for x in (map(len, whole.values()), want.values(), (r["mention_count"] for r in rows.values()))]
    score = {i: 0.3 * len(whole[i]) / top[0] + 0.25 * want[i] / top[1] + 0.25 * r["mention_count"] / top[2] + 0.2 * r["recency"] for i, r in rows.items()}
    got = run(spark, "graph_importance")
    assert {i: x for i, x, _ in got} == pytest.approx(score, abs=2e-6) and sorted(r for *_, r in got) == list(range(1, n + 1))


def test_path(spark, whole):
    goal = max(r for k in whole["supplier-1"] if k.startswith("nation") for r in whole[k] if r.startswith("region"))
    best = {"supplier-1": (0.0, ["supplier-1"])}
    for _ in range(4):
        for v, (cost, path) in list(best.items()):
            for w, weight in whole[v].items():
                best[w] = min(best.get(w, (float("inf"), [])), (cost + 1 / max(weight, 0.01), [*path, w]))
    [(path, hops, cost, _)] = run(spark, "graph_path")
    assert cost == pytest.approx(best[goal][0], abs=1e-5) and path == best[goal][1] and hops == len(path) - 1


@pytest.mark.parametrize(
    "name",
    ["graph_edges", "graph_degree", "graph_top_degrees", "graph_stats", "graph_components", "graph_path", "graph_neighborhood", "graph_neighborhood_edges", "graph_export", "graph_export_edges", "suggest_missing"],
)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    plain = lambda rows: sorted([tuple(round(x, 5) if isinstance(x, float) else str(x) for x in r) for r in rows], key=str)
    want = plain(con.execute(catalogue.ORACLES[name]).fetchall())
    got = plain(run(spark, name))
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, abs=2e-5) if isinstance(a, float) else a == b for x, y in zip(got, want) for a, b in zip(x, y))


def test_both_ways_of_betweenness_and_missing_links(spark):
    g = catalogue._graph(spark, DATA).stored()
    for sample in (None, 20):
        held, joined = ({r["id"]: r["betweenness"] for r in graph.betweenness(g, sample, most_edges=m).collect()} for m in (graph.MOST_EDGES, 0))
        assert held == pytest.approx(joined, abs=1e-9) and sum(x > 0 for x in held.values()) > 10
    for entity in (None, "supplier-1", "nobody"):
        held, joined = ([tuple(r) for r in graph.missing_links(g, entity, limit=40, most_edges=m).collect()] for m in (graph.MOST_EDGES, 0))
        assert held == joined and bool(held) == (entity != "nobody")


def test_missing_links_by_blocks(spark):
    """All pairs of a graph that is counted in many blocks, ties at the limit included, against brute force."""
    rng = random.Random(5)
    near = defaultdict(set)
    for _ in range(420):
        a, b = rng.choice([(rng.randrange(6), rng.randrange(60)), (rng.randrange(60), rng.randrange(60))])
        if a != b:
            near[f"n{a}"].add(f"n{b}")
            near[f"n{b}"].add(f"n{a}")
    nodes = spark.createDataFrame([(f"n{i}", "x", "x", 1) for i in range(70)], "id string, type string, name string, mention_count int")  # ten without edges
    g = graph.Graph(nodes, spark.createDataFrame([(a, b, 1.0, ["x"]) for a in near for b in near[a]], "src string, dst string, weight double, types array<string>"))
    want = sorted((-len(near[a] & near[b]), a, b) for a in near for b in near if a < b and b not in near[a] and len(near[a] & near[b]) >= 2)
    for limit, block in ((3, 30), (25, 90), (5000, 50)):
        got = [(-r["common"], r["a"], r["b"]) for r in graph.missing_links(g, limit=limit, most_edges=0, block=block).collect()]
        assert got == want[:limit]
    assert len(want) > 25 and want[2][0] == want[3][0] or want[24][0] == want[25][0]  # a tie at a limit


def test_betweenness_of_parts_and_hubs(spark):
    """Dense parts, sparse ones, nodes by themselves and paths by way of hubs against one source at a time."""
    rng = np.random.default_rng(3)
    for n, m, k in ((60, 70, 0), (60, 70, 6), (50, 200, 3), (40, 44, 1)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        pairs = np.unique(np.sort(np.stack([a, b], 1)[a != b], 1), axis=0)
        whole = between.Adjacency(n, np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]])
        want, got = sum(whole.depends(s) for s in range(n)), np.zeros(n)
        hubs = np.sort(rng.choice(n, k, replace=False)).astype(np.int32)
        for r in between.total(spark, whole, hubs, 8).collect():
            got[r["i"]] = r["delta"]
        assert got == pytest.approx(want, abs=1e-6)


def test_betweenness_by_pairs_of_a_cover():
    """All pairs of a dense part at once, in blocks of rows, for edges within the cover too; no source walks by itself."""
    rng, used = np.random.default_rng(4), 0
    for trial in range(60):
        n, m = int(rng.integers(3, 40)), int(rng.integers(2, 160))
        a, b = rng.integers(0, n, m) % (max(1, n // 5) if trial % 2 else n), rng.integers(0, n, m)
        pairs = np.unique(np.sort(np.stack([a, b], 1)[a != b], 1), axis=0)
        g = between.Adjacency(n, np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]])
        label, want, got = between.parts(g), sum(g.depends(s) for s in range(n)), np.zeros(n)
        for name in np.unique(label):
            nodes = np.flatnonzero(label == name)
            part = between.Part(g, nodes, between.covers(g))
            if len(nodes) > 1:
                bits, none = part.weighed(0, 0.0), np.zeros((len(nodes), 0))
                assert bits >= 40 and part.weighed(20, 0.0) == 0  # too few bits: longer paths would count
                for lo, hi in ((0, len(nodes) // 3), (len(nodes) // 3, len(nodes))):
                    got[part.nodes] += part.pairs(lo, hi, bits, none, none, 4, 5)[0]
                used += 1
        assert got == pytest.approx(want, abs=1e-8)
    assert used >= 60


def test_dense_parts_are_dealt_whole():
    """Six like parts to six tasks, one each: what a task makes for a part is made once."""
    links = [(p * 50 + i, p * 50 + 5 + j) for p in range(6) for i in range(5) for j in range(45)]
    a, b = np.array(links + [(y, x) for x, y in links]).T
    g = between.Adjacency(300, a, b)
    label = between.parts(g)
    assert between.dealt(g, label, np.argsort(label, kind="stable"), 3, 6, 8) == list(range(0, 301, 50))
    one = between.dealt(g, np.zeros(300, int), np.arange(300), 0, 6, 8)  # the first nodes have the most after them
    assert len(one) == 7 and one[1] < 50 < 60 < 300 - one[-2]
    assert between.dealt(g, label, np.arange(0), 3, 6, 8) == [0]  # all nodes are hubs


def test_betweenness_takes_turns(spark):
    """Rarest types as hubs, and sources in turns of bounded size where the graph isn't held."""
    links = [(f"a{i}", f"b{j}") for i in range(9) for j in range(4) if (i * j) % 3] + [(f"c{i}", f"d{i % 3}") for i in range(7)] + [("b0", "h"), ("b1", "h"), ("d0", "h"), ("d1", "h"), ("d2", "d1"), ("a0", "b0")]
    ids = sorted({x for pair in links for x in pair})
    nodes = spark.createDataFrame([(i, "hub" if i == "h" else "x", i, 1) for i in ids] + [(f"z{i}", "x", "z", 0) for i in range(60)], "id string, type string, name string, mention_count int")
    g = graph.Graph(nodes, spark.createDataFrame([(*x, 1.0, ["x"]) for a, b in links for x in ((a, b), (b, a))], "src string, dst string, weight double, types array<string>"))
    held = {r["id"]: r["betweenness"] for r in graph.betweenness(g).collect()}
    joined = {r["id"]: r["betweenness"] for r in graph.betweenness(g, most_edges=0, most_rows=3000).collect()}
    assert held == pytest.approx(joined, abs=1e-12) and held["h"] == max(held.values()) > 0


def test_edges_are_formed_once(spark, monkeypatch):
    """Both ways of an edge come from one row, a loop once; graph_importance keeps its tables one by one, so that it never holds all it shuffles."""
    nodes = spark.createDataFrame([(i, "x", i, 1) for i in "abc"], "id string, type string, name string, mention_count int")
    seen = [("a", "b", "r", 1.0), ("b", "a", "s", 2.0), ("c", "c", "r", 3.0), ("a", "gone", "r", 1.0)]
    g = graph.load(nodes, spark.createDataFrame(seen, "source_id string, target_id string, type string, weight double"))
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b", 2.0, ["r", "s"]), ("b", "a", 2.0, ["r", "s"]), ("c", "c", 3.0, ["r"])]
    plans, stored = [], graph.Graph.stored
    monkeypatch.setattr(graph.Graph, "stored", lambda g: plans.append(g.edges._jdf.queryExecution().optimizedPlan().toString()) or stored(g))
    assert run(spark, "graph_importance")
    assert [p.count("Relation [") for p in plans] == [3]  # relationships, and the entities at either end


def test_importance_joins_trades_once(spark, monkeypatch):
    """Entities whose mentions are counted from relationships equal those counted from trades; graph_importance reads the trades once."""
    related = tables.relationships(spark, DATA)
    plain, counted = (sorted(map(tuple, tables.entities(spark, DATA, x).collect()), key=lambda r: r[0]) for x in (None, related))
    assert plain == counted and any(r[4] > 1 for r in plain)
    reads, trade = [], tables._trade
    monkeypatch.setattr(tables, "_trade", lambda *a: reads.append(a) or trade(*a))
    assert run(spark, "graph_importance") and len(reads) == 1

import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vaultspark.functions import text as X
from vaultspark.functions.query import words
from vaultspark.operators import fulltext, graph, maintenance, stores, temporal, vectors
from vaultspark.operators.keyword_index import KeywordIndex


def notes(spark, texts):
    rows = [(i + 1, f"d/{i + 1}.md", f"t{i + 1}", "d", ["x"], t, 1000 * i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, path string, title string, directory string, tags array<string>, content string, modified_at long")


def test_bm25(spark):
    docs = fulltext.indexed(notes(spark, ["apple banana", "apple apple cherry", "banana", "date"]), ("content",))
    scores = lambda q: {r["id"]: r["score"] for r in fulltext.match(docs, ("content",), q).collect()}
    assert scores("cherry") == {2: pytest.approx(-0.655698, abs=1e-6)}
    assert scores("date") == {4: pytest.approx(-1.027432, abs=1e-6)}
    assert scores("apple") == {2: pytest.approx(-1.144981e-6, abs=1e-11), 1: pytest.approx(-9.447853e-7, abs=1e-11)}
    assert set(scores('"apple cherry"')) == {2}
    assert set(scores("apple NOT cherry")) == {1}
    assert set(scores("^banana")) == {3}
    assert set(scores("NEAR(apple cherry, 0)")) == {2}
    assert set(scores("ban*")) == {1, 3}
    assert scores("") == {}


def test_vectors(spark):
    rows = [(1, 1, 0, "a", None, [1.0, 0.0]), (2, 1, 1, "b", "h", [0.0, 1.0]), (3, 2, 0, "c", "", [1.0, 1.0]), (4, 3, 0, "d", "", [0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, file_id long, chunk_index int, chunk_text string, heading string, embedding array<double>")
    assert [r["id"] for r in vectors.top_chunks(e, [1.0, 0.2], 2).collect()] == [1, 3]
    files = notes(spark, ["a", "b", "c"])
    assert [(r["path"], round(r["score"], 6)) for r in vectors.similar_files(e, files, "d/1.md").collect()] == [("d/2.md", 1.0), ("d/3.md", 0.0)]
    assert vectors.similar_files(e, files, "none").count() == 0


def test_filters_by_day(spark):
    files = spark.createDataFrame([(k, "d", ["x"], 86_400_000 * k) for k in range(5)], "id long, directory string, tags array<string>, modified_at long")
    got = lambda **f: sorted(r["id"] for r in fulltext.file_filter(files, **f).collect())
    assert got(since="1970-01-03") == [2, 3, 4] and got(since=86_400_000, until="1970-01-04") == [1, 2, 3] and got(directory="e") == [] and got(tag="X") == [0, 1, 2, 3, 4]


def make_graph(spark, edges, nodes=()):
    ids = sorted({x for a, b, *_ in edges for x in (a, b)} | set(nodes))
    entities = spark.createDataFrame([(i, "person", i, 0) for i in ids], "id string, type string, name string, mention_count long")
    rel = spark.createDataFrame([(a, b, (r or ["t"])[0] if r and isinstance(r[0], str) else "t", float(r[-1]) if r else 1.0) for a, b, *r in edges], "source_id string, target_id string, type string, weight double")
    return graph.load(entities, rel).stored()


def test_edge_collapse(spark):
    g = make_graph(spark, [("a", "b", "t1", 1), ("b", "a", "t2", 3), ("a", "b", "t1", 2)])
    assert [(r["src"], r["dst"], r["weight"], r["types"]) for r in g.edges.orderBy("src").collect()] == [("a", "b", 3.0, ["t1", "t2"]), ("b", "a", 3.0, ["t1", "t2"])]


def test_path(spark):
    g = make_graph(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 0.25), ("c", "d", 1)])
    got = lambda *a: [(r["path"], r["hops"], r["total_weight"]) for r in graph.shortest_path(g, *a).collect()]
    assert got("a", "c") == [(["a", "b", "c"], 2, 2.0)]
    assert got("a", "c", 1) == [(["a", "c"], 1, 0.25)]
    assert got("a", "d", 2) == [(["a", "c", "d"], 2, 1.25)]
    assert got("q", "q") == [(["q"], 0, 0.0)]
    assert got("a", "q") == []


def test_neighborhood(spark):
    g = make_graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "e"), ("d", "e"), ("c", "e")])
    nodes, edges = graph.neighborhood(g, "a", 1)
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "d"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("a", "b"), ("a", "d")}
    nodes, edges = graph.neighborhood(g, "a", 2)
    assert {r["id"]: r["distance"] for r in nodes.collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert ("c", "e") not in {(r["src"], r["dst"]) for r in edges.collect()}


def test_centrality(spark):
    path = make_graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert {r["id"]: round(r["betweenness"], 6) for r in graph.betweenness(path).collect()} == {"a": 0, "b": 0.666667, "c": 0.666667, "d": 0}
    stats = graph.stats(make_graph(spark, [("a", "b"), ("b", "c"), ("a", "c")], ["z"])).first()
    assert (stats["nodes"], stats["edges"], stats["density"], stats["avg_degree"], stats["components"]) == (4, 3.0, 0.5, 1.5, 2)


def test_communities_and_missing(spark):
    g = make_graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")], ["lone"])
    assert sorted(r["members"] for r in graph.community_members(g).collect()) == [["a", "b", "c"], ["x", "y", "z"]]
    square = make_graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert [(r["a"], r["b"], r["common"]) for r in graph.missing_links(square).collect()] == [("a", "c", 2), ("b", "d", 2)]


def test_consolidation(spark):
    rows = [(1, "a", "b", "t", None, "f", 0.5, "rule"), (2, "a", "b", "t", "x", "f", 0.2, "rule"), (3, "b", "a", "t", None, None, 1.0, "rule")]
    log = spark.createDataFrame(rows, "seq long, source_id string, target_id string, type string, context string, source_file string, confidence double, extraction_method string").withColumn("observed_on", F.lit("2024-01-01").cast("date"))
    got = {(r["source_id"], r["target_id"]): r for r in stores.consolidated(log, as_of="2024-01-01").collect()}
    assert got["a", "b"]["seen_count"] == 2 and got["a", "b"]["confidence"] == 0.5
    assert got["a", "b"]["weight"] == pytest.approx(0.2 * 1.5849625)
    assert got["b", "a"]["seen_count"] == 1
    assert stores.evidence_log(log).count() == 1


def test_facts_without_file_never_merge(spark):
    schema = "id long, type string, content string, entity_ids array<string>, recorded_at date, valid_until date, source_file string"
    batch = spark.createDataFrame([(1, "t", "c", ["a"], None, None, "f"), (2, "t", "c", ["a"], None, None, "f"), (3, "t", "c", [], None, None, None), (4, "t", "c", [], None, None, None)], schema)
    out = stores.added_facts(batch.limit(0), batch.withColumn("seq", F.col("id")), "2024-01-01")
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 4]


@pytest.mark.parametrize(("r", "p", "trend", "metric"), [(2, 0, "emerging", 2), (4, 2, "emerging", 2), (3, 2, "stable", 5), (2, 1, "stable", 3), (1, 3, "fading", 3), (0, 1, "fading", 1), (1, 2, "stable", 3)])
def test_trends(spark, r, p, trend, metric):
    facts = spark.createDataFrame([(["a"], "2024-03-25")] * r + [(["a"], "2024-02-10")] * p, "entity_ids array<string>, day string").withColumn("recorded_at", F.col("day").cast("date"))
    entities = spark.createDataFrame([("a", "A", "person")], "id string, name string, type string")
    got = temporal.trends(facts, entities, "2024-03-31").first()
    assert (got["trend"], got["metric"]) == (trend, metric)


def test_incremental(spark):
    files = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "path string, modified_at long")
    scan = spark.createDataFrame([("a", 999), ("b", 1000), ("new", 5)], "path string, modified_at long")
    assert sorted(r["path"] for r in maintenance.changed(scan, files).collect()) == ["b", "new"]
    assert [r["path"] for r in maintenance.stale(files, scan).collect()] == ["c"]


def test_communities_settle(spark):
    pairs = [(f"p{k}", f"q{k}") for k in range(8)]
    tree = [(f"t{k}", f"t{(k - 1) // 2}", 1.0 + k % 3) for k in range(1, 15)]
    bipartite = [(f"c{i}", f"s{j}", 1.0 + (3 * i + 5 * j) % 7) for i in range(6) for j in range(4)]
    edges = pairs + tree + bipartite
    g = make_graph(spark, edges, nodes=["alone"])
    own = dict((r["id"], r["colour"]) for r in graph.colours(g).collect())
    assert all(own[a] != own[b] for a, b, *_ in edges)
    found = {r["id"]: r["community"] for r in graph.communities(g, rounds=30).collect()}
    assert found == {r["id"]: r["community"] for r in graph.communities(g, rounds=31).collect()}
    assert all(found[a] == found[b] for a, b in pairs)
    for i in found:  # no other label around a node is heavier than its own
        weight = {}
        for a, b, *w in edges:
            if i in (a, b):
                c = found[b if a == i else a]
                weight[c] = weight.get(c, 0) + (w[0] if w else 1.0)
        assert not weight or weight.get(found[i], 0) == pytest.approx(max(weight.values())), i


def plain_chunks(text, limit):
    """Sections by heading lines; a section that is too long is cut at blank lines, each piece as long as it can be."""
    sections, out = [["", ""]], []
    for line in text.split("\n"):
        m = re.fullmatch(r"#{1,6}[ \t]+([^\n]+)", line)
        if m:
            sections.append([m[1], ""])
        sections[-1][1] += line + "\n"
    for heading, body in sections:
        body = body.strip()
        parts = re.split("\n\n+", body) if len(body) > limit else [body]
        while parts:
            k = 1
            while k < len(parts) and len("\n\n".join(parts[: k + 1])) <= limit:
                k += 1
            piece = "\n\n".join(parts[:k]).strip()
            if piece:
                out.append((heading, piece))
            parts = parts[k:]
    return out


def test_chunks_against_brute_force(spark):
    draw = random.Random(3)
    bits = ["word", "a longer run of words", "# One", "## Two words", "#no heading", "", "", "x" * 30]
    texts = ["\n".join(draw.choice(bits) for _ in range(draw.randrange(30))) for _ in range(200)] + ["", "# only", "p" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {}
    for r in vectors.chunks(rows, 60).orderBy("file_id", "chunk_index").collect():
        got.setdefault(r["file_id"], []).append((r["heading"], r["chunk_text"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(t, 60), t


def test_snippets_against_brute_force(spark):
    draw = random.Random(4)
    vocabulary = ["apple", "Äpple", "pear", "fig", "plum", "kiwi"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(60))) + draw.choice(["", ".", "!"]) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", fulltext.snippet(F.col("t"), "apple fi*", "<", ">", "~", 8))
    for r in rows.collect():
        w = r["t"].split(" ") if r["t"] else []
        hit = [words(x)[0] == "apple" or words(x)[0].startswith("fi") for x in w] if any(map(words, w)) else []
        kinds = lambda s: len({words(x)[0] for x, h in zip(w[s : s + 8], hit[s : s + 8]) if h})
        plain = re.sub("[<>~]", "", r["s"])
        assert plain in r["t"] and len(words(plain)) == min(8, len(hit))
        starts = range(max(1, len(hit) - 8 + 1))
        best = max(map(kinds, starts), default=0) if hit else 0
        marked = {words(x)[0] for run in re.findall("<([^>]*)>", r["s"]) for x in run.split(" ")}
        assert len(marked) == best
        assert r["s"].startswith("~") == (not r["t"].startswith(plain)) or not best


def test_index_after_changes(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), ("title", "content", "tags"), ("path",))
    assert index.segments() == [] and index.scored("apple").count() == 0
    index.update(notes(spark, ["apple banana", "apple apple cherry", "banana", "date"]))
    index.update(notes(spark, ["cherry", "apple"]).where("id = 2"), spark.createDataFrame([(4,)], "id long"))
    now = fulltext.indexed(notes(spark, ["apple banana", "apple", "banana"]), ("title", "content", "tags"))
    scores = lambda q: {r["id"]: r["score"] for r in index.scored(q).collect()}
    for _ in range(2):
        for q in ("apple", "cherry", "date", "banana OR apple", "app*", "title:t2", '"apple banana"', "apple NOT banana", ""):
            assert scores(q) == {r["id"]: r["score"] for r in fulltext.match(now, ("title", "content", "tags"), q).collect()}, q
        index.compact()
    assert len(index.segments()) == 1
    index.update(notes(spark, ["x"]).limit(0), spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert scores("apple") == {} and index.rows().count() == 0


def test_small_expressions(spark):
    row = spark.range(1).select(
        X.snippet_line(F.lit("a\nb" * 50), 5).alias("line"), X.day_ms(F.lit("2024-03-01")).alias("ms"), X.percent(F.lit(0.12345)).alias("p"), X.percent(F.lit(0.5), 2).alias("q"),
        vectors.from_blob(F.lit(bytearray(struct.pack("<2d", 1.5, -2.0) + b"x"))).alias("v"), X.comma_list(F.lit(" a, ,b")).alias("l"), X.comma_list(F.lit(" a, ,b"), drop_empty=True).alias("m"),
        X.extract_date(F.lit("x/24.03.09 y.md"), F.lit(0)).alias("d1"), X.extract_date(F.lit("x/99.03.09.md"), F.lit(0)).alias("d2"), X.extract_date(F.lit("x.md"), F.lit(86_400_000)).alias("d3"),
        X.shaped(F.lit(bytearray(b"abc")), "binary").alias("blob"),
    ).first()
    assert (row["line"], row["ms"], row["p"], row["q"], row["v"]) == ("a ba ", 1_709_251_200_000, "12.3%", "50.00%", [1.5, -2.0])
    assert (row["l"], row["m"]) == (["a", "", "b"], ["a", "b"])
    assert (row["d1"], row["d2"], row["d3"], row["blob"]) == ("2024-03-09", "1999-03-09", "1970-01-02", "[BLOB 3 bytes]")


def test_communities_against_brute_force(spark):
    """On random graphs: turn after turn by colour, each node takes the heaviest label around it."""
    draw = random.Random(8)
    for _ in range(3):
        ids = [f"n{k:02}" for k in range(24)]
        edges = [(a, b, float(draw.randrange(1, 4))) for k, a in enumerate(ids) for b in ids[:k] if draw.random() < 0.15]
        g = make_graph(spark, edges, ids)
        near = {i: {} for i in ids}
        for a, b, w in edges:
            near[a][b] = near[b][a] = w
        colour, label = {r["id"]: r["colour"] for r in graph.colours(g).collect()}, {i: i for i in ids}
        moved = True
        while moved:
            moved = False
            for turn in sorted(set(colour.values())):
                new = {}
                for i in (i for i in ids if colour[i] == turn and near[i]):
                    votes = Counter()
                    for j, w in near[i].items():
                        votes[label[j]] += w
                    new[i] = min(votes, key=lambda x: (-votes[x], x != label[i], x))
                moved |= any(label[i] != x for i, x in new.items())
                label |= new
        groups = sorted((sorted(i for i in ids if label[i] == x) for x in set(label.values())), key=lambda m: m[0])
        found = {r["id"]: r["community"] for r in graph.communities(g).collect()}
        assert found == {i: k for k, m in enumerate(groups) for i in m}
        want = sorted(([k, len(m), m] for k, m in enumerate(groups) if len(m) > 1), key=lambda x: (-x[1], x[0]))
        assert [list(r) for r in graph.community_members(g).collect()] == want
